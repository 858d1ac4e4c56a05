"""Queries over the driver's tables and their oracle SQL, by name.

The tables stand in for files: documents are files (text = content, source = folder), pages
are paths with bytes to sniff, events are job events and samples (user = job), orders carry
dates. Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelake.functions import columns as C
from filelake.operators import actions, claims, cleanup, gates, jobs, keyed, placement, reports, series, summary, verify
from filelake.session import scratch, table
from filelake.sources.content import sniffed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its own name together with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: path, size, sha256, ext and group by id."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), "source", "lang")


_FILES = "WITH f AS (SELECT doc_id, doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, source, lang FROM documents)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("outcome"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """One series for each event type: seconds since its first event."""
    e = _events(spark, d)
    first = e.groupBy("outcome").agg(F.min("us").alias("_first"))
    return e.join(first, "outcome").withColumn("elapsed", F.expr("(us - _first) div 1000000")).drop("_first")


_SAMPLES = "WITH s AS (SELECT event_id, event_type AS outcome, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) // 1000000 AS elapsed FROM events)"


@query("SELECT doc_id, sha256(text) AS sha256, sha256(left(text, 1024)) AS partial_sha256 FROM documents")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    full, part = C.digests(F.col("text"), 1024)
    return table(spark, d, "documents").select("doc_id", full.alias("sha256"), part.alias("partial_sha256"))


@query(f"{_FILES} SELECT doc_id, sha256, canonical_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256) AS canonical_id FROM f) WHERE doc_id <> canonical_id")
def duplicate_claim(spark: SparkSession, d: str) -> DataFrame:
    out = claims.claim(_files(spark, d)).where("disposition = 'DUPLICATE'")
    return out.select("doc_id", "sha256", F.col("matched").alias("canonical_id"))


@query(f"{_FILES} SELECT source, count(*) AS duplicates, sum(size)::BIGINT AS bytes_saved FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256) AS m FROM f) WHERE doc_id <> m GROUP BY source")
def duplicate_savings(spark: SparkSession, d: str) -> DataFrame:
    return reports.savings(claims.claim(_files(spark, d)), ["source"])


@query(f"{_FILES} SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256) AS canonical_id FROM f QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY sha256)")
def partial_digest_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Three stages: equal size, equal first KiB, then the full digest of what is left. Only ids are grouped; texts are met again for those that are left."""
    docs = table(spark, d, "documents")
    heads = docs.select("doc_id", F.octet_length("text").alias("size"), C.digests(F.col("text"), 1024)[1].alias("part"))
    again = heads.join(heads.groupBy("size", "part").count().where("count > 1"), ["size", "part"]).select("doc_id")
    left = docs.join(again, "doc_id", "left_semi").select("doc_id", C.digests(F.col("text"), 1024)[0].alias("sha256"))
    out = claims.claim(left, order="doc_id")
    return out.where("disposition = 'DUPLICATE'").select("doc_id", F.col("matched").alias("canonical_id"))


@query(f"{_FILES} SELECT f.doc_id, c.sha256 IS NOT NULL AS hit FROM f LEFT JOIN (SELECT path, CASE WHEN path % 3 = 0 THEN size + 1 ELSE size END AS size, path % 5 AS mtime, sha256 FROM f) c ON f.path = c.path AND f.size = c.size AND f.path % 10 = c.mtime")
def cache_hit_join(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    cache = f.select("path", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("path") % 5).alias("mtime"), "sha256")
    out = claims.cache_lookup(f.withColumn("mtime", F.col("path") % 10).drop("sha256"), cache)
    return out.select("doc_id", F.col("sha256").isNotNull().alias("hit"))


@query(f"""{_FILES} SELECT coalesce(CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN lang = 'en' AND size < 500 THEN 'SMALL_FILE' WHEN lang <> 'en' AND size < 1000 THEN 'SMALL_FILE' END, 'VALID') AS gate,
  count(*) AS n, sum(size)::BIGINT AS bytes FROM f GROUP BY 1""")
def gate_chain(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).withColumn("kind", F.when(F.col("lang") == "en", "IMAGE").otherwise("VIDEO"))
    return f.groupBy(F.coalesce(gates.size_gate(F.col("size"), F.col("kind"), 500, 1000), F.lit("VALID")).alias("gate")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'IMAGE' WHEN 'de' THEN 'VIDEO' END AS file_type,
  CASE WHEN source GLOB 'src1[0-4]' OR source GLOB 'src[0-8]' THEN 'IGNORE_RULE_MATCHED' WHEN lang NOT IN ('en', 'de') THEN 'UNSUPPORTED_FORMAT' END AS skip FROM documents""")
def media_filter(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", "JPG").when(F.col("lang") == "de", "mkv").otherwise("txt")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/"), "source", F.lit("-x."), ext).alias("path"))
    return gates.walk_disposition(files, ["src{1[0-4],[0-8]}-*", "broken["]).select("doc_id", "file_type", F.col("walk_skip").alias("skip"))


@query("SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([^./]*)$', 1)) AS ext FROM pages")
def extension_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", C.extension(C.file_name(F.col("url"))).alias("ext"))


@query("""SELECT mime, 'DOCUMENT' AS grp, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT octet_length(encode(html)) AS size,
  CASE WHEN regexp_matches(html, '(?is)^\\s*(<!doctype html|<html)') THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages) GROUP BY mime""")
def mime_sniff_group(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(sniffed(F.substring(F.encode("html", "utf-8"), 1, 4096)).alias("mime"), F.octet_length("html").cast("long").alias("size"))
    return p.groupBy("mime", C.mime_group(F.col("mime")).alias("grp")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


#: Leading bytes in hex, by page_id modulo their number.
_HEADS = [
    "FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425056503820", "524946460000000041564920", "000000186674797069736F6D", "00000014667479707174202000",
    "1A45DFA3", "255044462D", "504B0304", "1F8B08", "7F454C46", "494433", "00000018667479706865696300", "C3A9C3A9C3A9C3A9C3A9", "C3A90041",
]


@query("""SELECT mime, grp, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT octet_length(encode(html)) AS size, page_id % 16 AS k FROM pages) JOIN (VALUES
  (0, 'image/jpeg', 'PROTECTED_MEDIA'), (1, 'image/png', 'PROTECTED_MEDIA'), (2, 'image/gif', 'PROTECTED_MEDIA'), (3, 'image/webp', 'PROTECTED_MEDIA'), (4, 'video/x-msvideo', 'PROTECTED_MEDIA'), (5, 'video/mp4', 'PROTECTED_MEDIA'), (6, 'video/quicktime', 'PROTECTED_MEDIA'),
  (7, 'video/x-matroska', 'PROTECTED_MEDIA'), (8, 'application/pdf', 'DOCUMENT'), (9, 'application/zip', 'ARCHIVE'), (10, 'application/gzip', 'ARCHIVE'), (11, 'application/x-elf', 'EXECUTABLE'), (12, 'audio/mpeg', 'AUDIO'),
  (13, 'image/heic', 'PROTECTED_MEDIA'), (14, 'text/plain', 'DOCUMENT'), (15, 'application/octet-stream', 'OTHER')) AS t(k, mime, grp) USING (k) GROUP BY mime, grp""")
def mime_sniff_types(spark: SparkSession, d: str) -> DataFrame:
    """Types by leading bytes: pages behind signatures, and behind text with and without a null byte."""
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("page_id") % len(_HEADS) + 1).cast("int")))
    p = table(spark, d, "pages").select(sniffed(F.concat(head, F.substring(F.encode("html", "utf-8"), 1, 4000))).alias("mime"), F.octet_length("html").cast("long").alias("size"))
    return p.groupBy("mime", C.mime_group(F.col("mime")).alias("grp")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS ym, strftime(o_orderdate, '%Y/%b') AS ymmm, strftime(o_orderdate, '%Y/%b/%d') AS ymmmd, strftime(o_orderdate, '%Y/%m/%d') AS ymd FROM orders")
def folder_path(spark: SparkSession, d: str) -> DataFrame:
    names = {"ym": "YYYY_MM", "ymmm": "YYYY_MMM", "ymmmd": "YYYY_MMM_DD", "ymd": "YYYY_MM_DD"}
    return table(spark, d, "orders").select("o_orderkey", *[placement.folder(F.col("o_orderdate"), p).alias(k) for k, p in names.items()])


@query("SELECT o_orderstatus, count(DISTINCT strftime(o_orderdate, '%Y/%m')) AS folders FROM orders GROUP BY o_orderstatus")
def folders_created(spark: SparkSession, d: str) -> DataFrame:
    return placement.folders_created(table(spark, d, "orders"), ["o_orderstatus"], "o_orderdate", "YYYY_MM")


@query("""WITH l AS (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(e, s, m) AS date, CASE WHEN e IS NOT NULL THEN 'EMBEDDED_CAPTURE' WHEN s IS NOT NULL THEN 'FILE_CREATION' WHEN m IS NOT NULL THEN 'FILE_MODIFIED' END AS date_source
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS e, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE s END AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS m FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)""")
def date_priority(spark: SparkSession, d: str) -> DataFrame:
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    o, epoch = table(spark, d, "orders").join(ship, "o_orderkey", "left"), F.lit("1970-01-01").cast("timestamp_ntz")
    key = F.col("o_orderkey")
    date, source = C.capture_date(F.when(key % 2 == 0, F.col("o_orderdate")), F.when(key % 3 == 0, epoch).otherwise(F.col("s")), F.when(key % 5 == 0, epoch).otherwise(F.col("o_orderdate")))
    return o.select("o_orderkey", date.alias("date"), source.alias("date_source"))


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), placement.folder(F.col("o_orderdate"), "YYYY_MM").alias("dir"), F.concat("o_orderpriority", F.lit(".jpg")).alias("name"))


_INCOMING = "i AS (SELECT o_orderkey AS path, strftime(o_orderdate, '%Y/%m') AS dir, o_orderpriority || '.jpg' AS name, o_orderpriority AS stem FROM orders)"


@query(f"WITH {_INCOMING}, r AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY path) - 1 AS k FROM i) SELECT path, dir, CASE WHEN k = 0 THEN name ELSE stem || '(' || k || ').jpg' END AS final_name FROM r")
def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = _incoming(spark, d)
    return placement.place(rows, rows.select("dir", "name").limit(0)).select("path", "dir", "final_name")


@query(f"""WITH {_INCOMING}, e AS (SELECT DISTINCT dir, name, stem, k FROM i, (VALUES (0), (1), (2), (4), (7)) t(k)),
g AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY path) AS r FROM i),
n AS (SELECT dir, name, max(r) AS m FROM g GROUP BY dir, name),
free AS (SELECT dir, name, x, row_number() OVER (PARTITION BY dir, name ORDER BY x) AS r FROM (SELECT dir, name, unnest(range(1, m + 6)) AS x FROM n) WHERE x NOT IN (1, 2, 4, 7))
SELECT path, dir, stem || '(' || x || ').jpg' AS final_name FROM g JOIN free USING (dir, name, r)""")
def first_free_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = _incoming(spark, d)
    ladder = F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 4, 7)]))
    held = rows.select("dir", "name").distinct().withColumn("k", ladder)
    held = held.select("dir", F.when(F.col("k") == 0, F.col("name")).otherwise(C.numbered(F.col("name"), F.col("k"))).alias("name"))
    return placement.place(rows, held).select("path", "dir", "final_name")


@query(f"WITH {_INCOMING} SELECT path, dir, stem || '_DUP_' || row_number() OVER (PARTITION BY dir, name ORDER BY path) || '.jpg' AS final_name FROM i")
def dup_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = _incoming(spark, d)
    return placement.place(rows, rows.select("dir", "name").limit(0), form="_DUP_{}", always=True).select("path", "dir", "final_name")


@query("SELECT user_id AS job_id, event_type AS outcome, count(*) AS n, coalesce(sum(floor(value)::BIGINT), 0)::BIGINT AS bytes FROM events GROUP BY 1, 2")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.outcome_counts(_events(spark, d).withColumn("file_size", F.floor("value")))


@query("""SELECT outcome, event_id, rank, total, total > 100 AS truncated FROM (SELECT event_type AS outcome, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INTEGER AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rank <= 100""")
def capped_report(spark: SparkSession, d: str) -> DataFrame:
    """The cap is the feature: a report lists its oldest rows and says how many there are."""
    return reports.capped(_events(spark, d), 100, ["outcome"], ["event_id"]).select("outcome", "event_id", "rank", "total", "truncated")


_OUT = """o AS (SELECT user_id, floor(value)::BIGINT AS size, event_type AS folder, CASE event_id % 3 WHEN 0 THEN 'EMPTY_FILE' WHEN 1 THEN 'SMALL_FILE' END AS reason, CASE WHEN event_id % 10 < 6 THEN 'TRANSFERRED' WHEN event_id % 10 < 8 THEN 'SKIPPED' WHEN event_id % 10 = 8 THEN 'FAILED' ELSE 'DUPLICATE' END AS outcome FROM events)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 10
    kind = F.when(k < 6, "TRANSFERRED").when(k < 8, "SKIPPED").when(k == 8, "FAILED").otherwise("DUPLICATE")
    why = F.when(F.col("event_id") % 3 == 0, "EMPTY_FILE").when(F.col("event_id") % 3 == 1, "SMALL_FILE")
    return table(spark, d, "events").select("user_id", F.floor("value").alias("size"), F.col("event_type").alias("folder"), why.alias("reason"), kind.alias("outcome"))


@query(f"""WITH {_OUT} SELECT user_id, count(*) FILTER (outcome = 'TRANSFERRED') AS files_processed, count(*) FILTER (outcome = 'FAILED') AS files_failed, count(*) FILTER (outcome = 'SKIPPED') AS files_skipped,
count(*) FILTER (outcome = 'DUPLICATE') AS duplicates_found, 0::BIGINT AS files_copied, count(*) FILTER (outcome = 'TRANSFERRED') AS files_moved, count(*) FILTER (outcome = 'SKIPPED' AND reason = 'EMPTY_FILE') AS empty_files,
count(*) FILTER (outcome = 'SKIPPED' AND reason = 'SMALL_FILE') AS small_files, count(*) FILTER (outcome = 'FAILED') AS corrupt_files,
coalesce(sum(size) FILTER (outcome = 'TRANSFERRED'), 0)::BIGINT AS bytes_processed, coalesce(sum(size) FILTER (outcome = 'TRANSFERRED'), 0)::BIGINT AS bytes_moved, 0::BIGINT AS bytes_copied,
coalesce(sum(size) FILTER (outcome IN ('FAILED', 'SKIPPED')), 0)::BIGINT AS bytes_skipped, coalesce(sum(size) FILTER (outcome = 'DUPLICATE'), 0)::BIGINT AS bytes_saved,
count(DISTINCT folder) FILTER (outcome = 'TRANSFERRED') AS folders_created FROM o GROUP BY user_id""")
def job_statistics(spark: SparkSession, d: str) -> DataFrame:
    return gates.job_counters(_outcomes(spark, d), "user_id", move=True)


@query(f"""{_SAMPLES}, w AS (SELECT *, greatest(1, max(elapsed) OVER (PARTITION BY outcome) // 600 + 1) AS width FROM s)
SELECT outcome, elapsed // width AS bucket, min(elapsed) AS elapsed, round(avg(value), 6) AS value FROM w GROUP BY 1, 2""")
def bucket_average(spark: SparkSession, d: str) -> DataFrame:
    out = series.bucket_average(_samples(spark, d), "outcome", "elapsed", ["value"], 600)
    return out.select("outcome", "bucket", "elapsed", F.round("value", 6).alias("value"))


@query("""WITH r AS (SELECT event_type AS outcome, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
b AS (SELECT *, ((i + 1) * 50 - 1) // n AS b FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY outcome, b ORDER BY value, i) AS lo, row_number() OVER (PARTITION BY outcome, b ORDER BY value DESC, i) AS hi FROM b)
SELECT outcome, event_id, value FROM k WHERE n <= 100 OR i = 0 OR i = n - 1 OR lo = 1 OR hi = 1""")
def envelope(spark: SparkSession, d: str) -> DataFrame:
    return series.envelope(_events(spark, d), "outcome", ["us", "event_id"], "value", 50).select("outcome", "event_id", "value")


def _rolling_sql(n: int) -> str:
    return f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 9) AS average FROM events"


@query(_rolling_sql(5))
def rolling_rate_5(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling(_events(spark, d), "job_id", ["us", "event_id"], "value", {"average": 5}).select("event_id", F.round("average", 9).alias("average"))


@query(_rolling_sql(150))
def rolling_rate_150(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling(_events(spark, d), "job_id", ["us", "event_id"], "value", {"average": 150}).select("event_id", F.round("average", 9).alias("average"))


@query("""WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS us, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events),
l AS (SELECT *, total - lag(total) OVER w AS dv, (us - lag(us) OVER w) / 1e6 AS dt FROM t WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, round(CASE WHEN dv > 0 THEN dv / greatest(dt, 0.001) ELSE 0 END, 6)::DOUBLE AS rate FROM l""")
def delta_rate(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, d).withColumn("total", F.sum(F.floor("value")).over(w))
    return series.delta_rate(e, "job_id", ["us", "event_id"], "total", F.col("us")).select("event_id", F.round("rate", 6).alias("rate"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def running_peak(spark: SparkSession, d: str) -> DataFrame:
    return series.running_peak(_events(spark, d), "job_id", ["us", "event_id"], "value").select("event_id", "peak")


@query("""WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 2 = 0) AS done, avg(value) AS r FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN r > 0 AND total > done THEN (total - done) / r END, 6) AS eta FROM c""")
def eta(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_id") % 2 == 0).alias("done"), F.avg("value").alias("r"))
    return c.select("user_id", F.round(series.eta(F.col("total"), F.col("done"), F.col("r")), 6).alias("eta"))


@query(f"{_SAMPLES} SELECT outcome, event_id, elapsed FROM s QUALIFY elapsed >= greatest(0, max(elapsed) OVER (PARTITION BY outcome) - 86400)")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    return series.trailing(_samples(spark, d), "outcome", "elapsed", 86400).select("outcome", "event_id", "elapsed")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def recent_n(spark: SparkSession, d: str) -> DataFrame:
    """The number is the feature: the list of the last files shows eight."""
    return reports.recent(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT >= 0 AS ended FROM events GROUP BY user_id")
def job_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n"))
    return jobs.history(e.withColumn("ended", F.col("end_time") >= F.col("start_time")).withColumnRenamed("user_id", "job_id")).withColumnRenamed("job_id", "user_id")


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status FROM events GROUP BY user_id")
def status_latest(spark: SparkSession, d: str) -> DataFrame:
    return reports.status_latest(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


def _archive(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, k = _files(spark, d), F.col("doc_id")
    cat = f.where(k % 11 != 0).select("sha256", F.when(k % 13 != 0, F.concat_ws("/", "source", k.cast("string"))).alias("destination_path"), F.col("size").alias("destination_size"))
    seen = f.where(k % 7 != 0).select(
        F.concat_ws("/", "source", k.cast("string")).alias("path"), F.when(k % 17 != 0, F.when(k % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))).alias("size"),
        F.concat_ws("/", F.when(k % 22 == 0, "_skipped").otherwise(F.col("source")), k.cast("string")).alias("relative"),
        F.when(k % 19 != 0, F.when(k % 3 == 0, F.sha2("sha256", 256)).otherwise(F.upper("sha256"))).alias("observed_sha256"),
    )
    return cat, seen


_ARCHIVE = f"""{_FILES}, c AS (SELECT sha256, CASE WHEN doc_id % 13 <> 0 THEN source || '/' || doc_id END AS dest, size AS dsize FROM f WHERE doc_id % 11 <> 0),
l AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 17 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END END AS size,
  CASE WHEN doc_id % 22 = 0 THEN '_skipped' ELSE source END || '/' || doc_id AS relative, CASE WHEN doc_id % 19 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN sha256(sha256) ELSE upper(sha256) END END AS obs FROM f WHERE doc_id % 7 <> 0),
v AS (SELECT coalesce(l.path, c.dest) AS path, relative, CASE WHEN c.sha256 IS NULL THEN 'UNTRACKED' WHEN dest IS NULL THEN 'UNVERIFIABLE' WHEN l.path IS NULL THEN 'MISSING' WHEN l.size IS NULL THEN 'UNREADABLE'
  WHEN l.size <> dsize THEN 'RESIZED' @DEEP@ ELSE 'INTACT' END AS status FROM c FULL OUTER JOIN l ON c.dest = l.path),
k AS (SELECT path, status FROM v WHERE NOT (status = 'UNTRACKED' AND regexp_matches(relative, '(^|/)(_skipped|_failures|_duplicates)(/|$)')))"""
_QUICK = _ARCHIVE.replace("@DEEP@", "")
_DEEP = _ARCHIVE.replace("@DEEP@", "WHEN obs IS NULL THEN 'UNREADABLE' WHEN lower(obs) <> lower(c.sha256) THEN 'CORRUPTED'")


@query(f"{_QUICK} SELECT path, status FROM k WHERE status <> 'INTACT'")
def verify_quick(spark: SparkSession, d: str) -> DataFrame:
    return verify.reconcile(*_archive(spark, d)).where("status <> 'INTACT'").select("path", "status")


@query(f"{_DEEP} SELECT path, status FROM k WHERE status <> 'INTACT'")
def verify_deep(spark: SparkSession, d: str) -> DataFrame:
    return verify.reconcile(*_archive(spark, d), deep=True).where("status <> 'INTACT'").select("path", "status")


@query(f"""{_DEEP} SELECT t.status, rank, problem, count(k.status) AS n FROM (VALUES ('INTACT', 0, false), ('MISSING', 1, true), ('RESIZED', 2, true), ('CORRUPTED', 3, true), ('UNREADABLE', 4, true),
  ('UNTRACKED', 5, false), ('UNVERIFIABLE', 6, false)) t(status, rank, problem) LEFT JOIN k ON k.status = t.status GROUP BY 1, 2, 3""")
def verify_counts(spark: SparkSession, d: str) -> DataFrame:
    return verify.status_counts(verify.reconcile(*_archive(spark, d), deep=True))


@query(f"{_DEEP} SELECT count(*) FILTER (status IN ('INTACT', 'MISSING', 'RESIZED', 'CORRUPTED', 'UNREADABLE')) AS verified, count(*) FILTER (status IN ('MISSING', 'RESIZED', 'CORRUPTED', 'UNREADABLE')) AS problems, count(*) FILTER (status IN ('MISSING', 'RESIZED', 'CORRUPTED', 'UNREADABLE')) = 0 AS clean FROM k")
def verify_verdict(spark: SparkSession, d: str) -> DataFrame:
    return verify.verdict(verify.reconcile(*_archive(spark, d), deep=True))


@query(f"{_QUICK} SELECT path FROM k WHERE status = 'UNTRACKED'")
def untracked(spark: SparkSession, d: str) -> DataFrame:
    cat, seen = _archive(spark, d)
    return verify.untracked(cat, seen).select("path")


_GROUPED = _FILES + ", g AS (SELECT path, size, lower(lang) AS ext, CASE lang WHEN 'en' THEN 'PROTECTED_MEDIA' WHEN 'fr' THEN 'DOCUMENT' WHEN 'de' THEN 'ARCHIVE' ELSE 'OTHER' END AS grp FROM f)"


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    mime = F.when(F.col("lang") == "en", "image/png").when(F.col("lang") == "fr", "Application/PDF ; x=1").when(F.col("lang") == "de", "application/zip").otherwise("application/unknown")
    return f.select("path", "size", F.lower("lang").alias("ext"), C.mime_group(mime).alias("group"))


@query(f"""{_GROUPED} SELECT t.name AS "group", t.deletable, count(grp) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM (VALUES ('PROTECTED_MEDIA', false), ('ANDROID_PACKAGE', true), ('EXECUTABLE', true), ('ARCHIVE', true),
  ('DOCUMENT', true), ('AUDIO', true), ('OTHER', true)) t(name, deletable) LEFT JOIN g ON grp = t.name GROUP BY 1, 2""")
def cleanup_totals(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.group_totals(_grouped(spark, d)).select("group", "deletable", "n", "bytes")


@query(f"{_GROUPED} SELECT path, grp AS \"group\" FROM g WHERE (grp IN ('DOCUMENT') OR ext IN ('es', 'en')) AND grp <> 'PROTECTED_MEDIA'")
def cleanup_select(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.select_for_deletion(_grouped(spark, d), ["DOCUMENT"], [" *.ES", "en "]).select("path", "group")


@query(f"""{_GROUPED} SELECT path, CASE WHEN path % 9 = 0 OR path % 8 = 0 OR grp = 'PROTECTED_MEDIA' THEN 'SKIPPED_REVERIFY' ELSE 'PREVIEWED' END AS outcome,
  CASE WHEN path % 9 = 0 THEN 'no longer exists' WHEN path % 8 = 0 THEN 'now AUDIO' END AS reason FROM g""")
def reverify(spark: SparkSession, d: str) -> DataFrame:
    g = _grouped(spark, d)
    now = g.where("path % 9 <> 0").withColumn("group", F.when(F.col("path") % 8 == 0, "AUDIO").otherwise(F.col("group")))
    return cleanup.reverify(g, now).select("path", "outcome", "reason")


_DIRS = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), a AS (SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:i], '/') AS dir, page_id FROM (SELECT path, page_id, unnest(range(1, len(string_split(path, '/')))) AS i FROM p))"


@query(f"WITH {_DIRS} SELECT DISTINCT dir FROM a EXCEPT SELECT dir FROM a WHERE page_id % 3 = 0")
def empty_dirs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    dirs = cleanup.ancestors(p).select(F.col("dir").alias("path"))
    return cleanup.empty_directories(dirs, p.where("page_id % 3 = 0")).select(F.col("path").alias("dir"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS escaped FROM documents""")
def csv_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.csv_escape(F.col("text")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", C.html_escape(F.col("html")).alias("escaped"))


@query("""WITH t AS (SELECT user_id, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS s FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id)
SELECT user_id, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS duration FROM t""")
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", C.duration(F.col("a"), F.col("b")).alias("duration"))


@query(f"{_FILES} SELECT path, path % 4 <> 0 AND path % 6 <> 0 AS present FROM f")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    own = f.select("path", F.concat(F.lit("a/"), F.col("path").cast("string")).alias("destination_path"), F.col("size").alias("destination_size"))
    there = f.where("path % 4 <> 0").select(F.concat(F.lit("a/"), F.col("path").cast("string")).alias("path"), F.when(F.col("path") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return claims.resume(own, there).select("path", "present")


@query(f"""{_FILES}, o AS (SELECT * FROM f WHERE path % 2 = 0), n AS (SELECT path, size + 1 AS size, sha256, CASE WHEN path % 5 <> 0 THEN path END AS media_date FROM f WHERE path % 3 = 0)
SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, coalesce(n.sha256, o.sha256) AS sha256, coalesce(n.media_date, o.path) AS media_date FROM o FULL OUTER JOIN n ON o.path = n.path""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    old = f.where("path % 2 = 0").select("path", "size", "sha256", F.col("path").alias("media_date"))
    new = f.where("path % 3 = 0").select("path", (F.col("size") + 1).alias("size"), "sha256", F.when(F.col("path") % 5 != 0, F.col("path")).alias("media_date"))
    return claims.upsert_cache(old, new)


@query("SELECT event_type, count(*) AS chartable FROM (SELECT event_type, user_id FROM events GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY event_type")
def chartable(spark: SparkSession, d: str) -> DataFrame:
    n = series.chartable(table(spark, d, "events"), ["event_type", "user_id"])
    return n.groupBy("event_type").agg(F.count("*").alias("chartable"))


_LITERAL = "i AS (SELECT o_orderkey AS path, strftime(o_orderdate, '%Y/%m') AS dir, o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN '(1)' WHEN 1 THEN '(3)' ELSE '' END AS stem FROM orders)"


@query(f"""WITH {_LITERAL}, g AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY path) - 1 AS r FROM i), h AS (SELECT DISTINCT dir, stem FROM i),
c AS (SELECT dir, stem, unnest(range(1, m + 3)) AS x FROM (SELECT dir, stem, max(r) AS m FROM g GROUP BY dir, stem)),
free AS (SELECT dir, stem, x, row_number() OVER (PARTITION BY dir, stem ORDER BY x) AS r FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.dir = c.dir AND h.stem = c.stem || '(' || c.x || ')'))
SELECT path, dir, CASE WHEN g.r = 0 THEN g.stem ELSE g.stem || '(' || x || ')' END || '.jpg' AS final_name FROM g LEFT JOIN free USING (dir, stem, r)""")
def literal_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Incoming names that look like numbered ones keep their names; numbers step over them."""
    mark = F.when(F.col("o_orderkey") % 3 == 0, "(1)").when(F.col("o_orderkey") % 3 == 1, "(3)").otherwise("")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), placement.folder(F.col("o_orderdate"), "YYYY_MM").alias("dir"), F.concat("o_orderpriority", mark, F.lit(".jpg")).alias("name"))
    return placement.place(rows, rows.select("dir", "name").limit(0)).select("path", "dir", "final_name")


_JOBS = "j AS (SELECT user_id::VARCHAR AS job_id, arg_max(CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'PAUSED' ELSE 'COMPLETED' END, event_id) AS status, min(ts) AS start_time FROM events GROUP BY user_id)"


def _job_log(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a row of a job's log."""
    kind = F.when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "view", "PAUSED").otherwise("COMPLETED")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), kind.alias("status"), first.alias("start_time"), F.col("event_id").alias("seq"))


@query(f"WITH {_JOBS} SELECT job_id, status FROM j")
def job_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_jobs(_job_log(spark, d)).select("job_id", "status")


@query(f"WITH {_JOBS} SELECT job_id, status FROM j WHERE status IN ('RUNNING', 'PAUSED') ORDER BY start_time DESC, job_id LIMIT 1")
def active_job(spark: SparkSession, d: str) -> DataFrame:
    return jobs.active_job(jobs.latest_jobs(_job_log(spark, d))).select("job_id", "status")


@query("SELECT event_id, elapsed, value FROM (SELECT event_id, value, event_type, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) // 1000000 AS elapsed FROM events) WHERE event_type = 'click'")
def samples_of_job(spark: SparkSession, d: str) -> DataFrame:
    return jobs.of_job(_samples(spark, d).withColumn("job_id", F.col("outcome")), "click").select("event_id", "elapsed", "value")


@query("""SELECT j.job_id, coalesce(s.n, 0) AS samples, last_elapsed, round(mean, 6) AS mean, most FROM (SELECT DISTINCT o_orderpriority AS job_id FROM orders UNION SELECT DISTINCT event_type FROM events) j
LEFT JOIN (SELECT event_type, count(*) AS n, max(elapsed) AS last_elapsed, avg(value) AS mean, max(value) AS most FROM (SELECT event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) // 1000000 AS elapsed FROM events) GROUP BY event_type) s ON j.job_id = s.event_type""")
def job_samples(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("job_id")).union(table(spark, d, "events").select("event_type")).distinct()
    samples = _samples(spark, d).select(F.col("outcome").alias("job_id"), "elapsed", F.col("value").alias("files_per_sec"), F.col("value").alias("mb_per_sec"))
    return jobs.with_samples(names, samples).select("job_id", "samples", "last_elapsed", F.round("mean_files_per_sec", 6).alias("mean"), F.col("most_mb_per_sec").alias("most"))


@query("SELECT event_id, user_id AS job_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"))
    return jobs.without_job(e, e.where("event_id % 50 = 0"))


@query(f"{_QUICK} SELECT sha256, dest AS destination_path FROM c WHERE dest IS NOT NULL ORDER BY dest")
def canonical_cursor(spark: SparkSession, d: str) -> DataFrame:
    return jobs.transferred(_archive(spark, d)[0]).select("sha256", "destination_path")


@query(f"{_FILES} SELECT path, size FROM f WHERE sha256 = (SELECT arg_min(sha256, path) FROM f)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return jobs.by_key(f, "sha256", f.orderBy("path").first()["sha256"]).select("path", "size")


@query("SELECT count(*) AS total FROM pages WHERE lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([^./]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'mp4') OR page_id % 2 = 0")
def media_total(spark: SparkSession, d: str) -> DataFrame:
    """The counting pass over a listing: files that the walk does not leave out."""
    p = table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/x.JPG"))).otherwise(F.col("url")).alias("path"))
    return gates.walk_disposition(p).where("walk_skip is null").agg(F.count("*").alias("total"))


@query("""WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 2 = 0) AS done, epoch(max(ts)) - epoch(min(ts)) AS s FROM events GROUP BY user_id)
SELECT user_id, done / total AS fraction, greatest(0, total - done) AS remaining, CASE WHEN floor(s) >= 1 THEN done / floor(s) ELSE 0 END AS job_rate FROM c""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_id") % 2 == 0).alias("done"), ((F.max(us) - F.min(us)) / 1e6).alias("s"))
    return c.select("user_id", C.fraction_done(F.col("total"), F.col("done")).alias("fraction"), C.remaining(F.col("total"), F.col("done")).alias("remaining"), series.job_rate(F.col("done"), F.col("s")).alias("job_rate"))


@query("""SELECT event_id, last_value(CASE WHEN value > 0 AND event_id % 4 <> 0 THEN (10000 - event_id) / value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS eta FROM
(SELECT * FROM events WHERE event_id < 10000)""")
def eta_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """Events as progress ticks of a job of 10 000 files; a tick without a rate keeps the last estimate."""
    e = _events(spark, d).where("event_id < 10000")
    e = e.withColumn("_eta", series.eta(F.lit(10000), F.col("event_id"), F.when(F.col("event_id") % 4 != 0, F.col("value"))))
    return series.keep_last(e, "job_id", ["us", "event_id"], "_eta", "eta").select("event_id", "eta")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 360")
def history_cap(spark: SparkSession, d: str) -> DataFrame:
    """The cap is the feature: a live history holds a fixed number of points."""
    return series.latest(_events(spark, d), "outcome", ["us", "event_id"], 360).select("event_id")


@query(f"{_GROUPED} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (grp <> 'PROTECTED_MEDIA') AS deletable, count(*) FILTER (grp = 'PROTECTED_MEDIA') AS protected FROM g")
def deletable_totals(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.deletable_totals(_grouped(spark, d))


@query(f"{_GROUPED} SELECT path, size FROM g WHERE grp = 'ARCHIVE'")
def group_extract(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.in_group(_grouped(spark, d), "ARCHIVE").select("path", "size")


@query(f"""{_GROUPED} SELECT CASE grp WHEN 'DOCUMENT' THEN 'Documents' WHEN 'ARCHIVE' THEN 'Archives' ELSE 'Other non-media' END AS display_name, count(*) AS deleted FROM g
WHERE grp <> 'PROTECTED_MEDIA' AND path % 3 <> 0 GROUP BY 1 ORDER BY 1""")
def deleted_per_group(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("group") != "PROTECTED_MEDIA") & (F.col("path") % 3 != 0), "DELETED").otherwise("KEPT")
    return actions.deleted_per_group(_grouped(spark, d).select("path", F.col("group").alias("destination"), status.alias("status")))


@query(f"""{_GROUPED} SELECT count(*) FILTER (path % 7 <> 0) AS examined, count(*) FILTER (path % 7 NOT IN (0, 1)) AS deleted, sum(size) FILTER (path % 7 NOT IN (0, 1))::BIGINT AS bytes_deleted,
count(*) FILTER (path % 7 = 1) AS failed, count(*) FILTER (path % 7 = 0) = 0 AS completed FROM g""")
def deletion_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("path") % 7
    return actions.running_totals(_grouped(spark, d).select(F.when(k == 0, "NOT_REACHED").when(k == 1, "FAILED").otherwise("DELETED").alias("status"), F.col("size").alias("bytes")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 123 MILLISECOND WHEN 2 THEN o_orderdate END AS parsed,
'JOB-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || printf('-%03d', o_orderkey % 1000) AS job_id, 'CLEAN-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') AS run_id FROM orders""")
def parse_instant(spark: SparkSession, d: str) -> DataFrame:
    k, base = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit(".123000000Z"))).when(k == 2, base).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    number = (F.col("o_orderkey") % 1000).cast("int")
    return table(spark, d, "orders").select("o_orderkey", C.parse_instant(text).alias("parsed"), C.run_id("JOB", F.col("o_orderdate"), number).alias("job_id"), C.run_id("CLEAN", F.col("o_orderdate")).alias("run_id"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%dh %02dm', s // 3600, s % 3600 // 60) END AS short,
CASE WHEN s < 60 THEN s || 's' ELSE printf('%d min %02d s', s // 60, s % 60) END AS long FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)""")
def clock_formats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("event_id") * 7 % 9000
    return table(spark, d, "events").select("event_id", C.clock(s).alias("clock"), C.elapsed_short(s).alias("short"), C.minutes_long(s * 1000 + 999).alias("long"))


@query("""SELECT event_id, CASE WHEN r >= 1024 THEN printf('%.2f GB/s', r / 1024) WHEN r >= 1 THEN printf('%.1f MB/s', r) ELSE printf('%.1f KB/s', r * 1024) END AS rate FROM (SELECT event_id, (event_id % 4096) / 17.0 * (event_id % 5) AS r FROM events)""")
def human_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.human_rate(F.col("event_id") % 4096 / F.lit(17.0) * (F.col("event_id") % 5)).alias("rate"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS line, CASE WHEN lang = 'en' THEN 'IOException' ELSE 'IOException: ' || source END AS failure FROM documents")
def first_line(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("lang") != "en", F.col("source")).otherwise("")
    return table(spark, d, "documents").select("doc_id", C.first_line(F.col("text")).alias("line"), C.describe_failure(F.lit("IOException"), text).alias("failure"))


def _bytes_sql(n: str) -> str:
    part = lambda power, digits: f"CAST(round(CAST({n} / {1024**power}.0 AS DECIMAL(28,10)), {digits}) AS DECIMAL(28,{digits}))::VARCHAR"
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < {1024**2} THEN {part(1, 1)} || ' KB' WHEN {n} < {1024**3} THEN {part(2, 1)} || ' MB' WHEN {n} < {1024**4} THEN {part(3, 2)} || ' GB' ELSE {part(4, 2)} || ' TB' END"


def _summary_sql() -> str:
    """The columns of ``s`` below, one row for each field."""
    show = {
        "text": "{}::VARCHAR", "time": r"regexp_replace(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0*$', '')", "count": "{}::VARCHAR",
        "decimal": "CAST(round(CAST({} AS DECIMAL(28,10)), 2) AS DECIMAL(28,2))::VARCHAR", "gigas": "CAST(round(CAST({} / 1024.0 AS DECIMAL(28,10)), 2) AS DECIMAL(28,2))::VARCHAR",
    }
    known = {"job_id", "status", "start_time", "end_time", "files_processed", "files_skipped", "bytes_processed", "avg_mb_per_sec", "peak_mb_per_sec"}
    rows = []
    for k, (label, how, name) in enumerate(summary.FIELDS):
        if how == "duration":
            value = "printf('%d:%02d:%02d', secs // 3600, secs % 3600 // 60, secs % 60)"
        else:
            value = _bytes_sql(name if name in known else "0") if how == "bytes" else show[how].format(name if name in known else "0")
        rows.append(f"{{'pos': {k}, 'field': '{label}', 'value': {value}}}")
    return f"""WITH s AS (SELECT user_id AS job_id, arg_max(event_type, row(ts, event_id)) AS status, min(ts) AS start_time, max(ts) AS end_time,
epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS secs, count(*) AS files_processed, count(*) FILTER (event_type = 'click') AS files_skipped,
sum(floor(value)::BIGINT)::BIGINT AS bytes_processed, avg(floor(value)) AS avg_mb_per_sec, max(value) AS peak_mb_per_sec FROM events GROUP BY user_id)
SELECT job_id, f.pos AS pos, f.field AS field, f.value AS value FROM (SELECT job_id::VARCHAR AS job_id, unnest([{", ".join(rows)}]) AS f FROM s)"""


@query(_summary_sql())
def summary_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("whole", F.floor("value"))
    stats = e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("files_processed"),
        F.count_if(F.col("event_type") == "click").alias("files_skipped"), F.sum("whole").alias("bytes_processed"), F.avg("whole").alias("avg_mb_per_sec"), F.max("value").alias("peak_mb_per_sec"),
    )
    return summary.long_form(summary.summary_fields(stats))


_OWNED = f"""{_FILES}, o AS (SELECT sha256, min(path) AS canonical, 'd/' || min(path) AS destination_path, max(size) AS destination_size FROM f WHERE path % 4 <> 0 GROUP BY sha256),
t AS (SELECT sha256, path, 'e/' || path AS destination_path, size + 1 AS destination_size FROM f WHERE path % 3 <> 1),
n AS (SELECT t.* FROM t LEFT JOIN o USING (sha256) WHERE o.canonical IS NULL OR o.canonical = t.path QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY path) = 1)
SELECT coalesce(o.sha256, n.sha256) AS sha256, coalesce(o.canonical, n.path) AS canonical, coalesce(n.destination_path, o.destination_path) AS destination_path,
  coalesce(n.destination_size, o.destination_size) AS destination_size FROM o FULL OUTER JOIN n ON o.sha256 = n.sha256"""


def _owners(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(recorded owners, later transfers: new claims, new places of owners, and transfers of others that change nothing)."""
    f = _files(spark, d)
    old = f.where("path % 4 <> 0").groupBy("sha256").agg(F.min("path").alias("_p"), F.max("size").alias("destination_size"))
    old = old.select("sha256", F.col("_p").alias("canonical"), F.concat(F.lit("d/"), F.col("_p").cast("string")).alias("destination_path"), "destination_size")
    new = f.where("path % 3 <> 1").select("sha256", F.col("path").alias("canonical"), F.concat(F.lit("e/"), F.col("path").cast("string")).alias("destination_path"), (F.col("size") + 1).alias("destination_size"))
    return old, new


@query(_OWNED)
def owner_update(spark: SparkSession, d: str) -> DataFrame:
    return claims.commit_claims(*_owners(spark, d))


@query(_OWNED)
def owner_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same through the versioned table: two commits, each into the buckets it touches."""
    store = keyed.KeyedTable(spark, f"{scratch(spark)}/owners", "sha256", "sha256 string, canonical long, destination_path string, destination_size long")
    for rows in _owners(spark, d):
        store.merge(rows, claims.commit_claims)
    return store.read()


@query(f"{_FILES}, c AS (SELECT * FROM f WHERE path % 2 = 0) SELECT sha256, min(CASE WHEN path % 10 = 0 THEN -path END) AS given, coalesce(min(CASE WHEN path % 10 = 0 THEN -path END), min(path)) AS canonical FROM c GROUP BY sha256")
def owner_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Owners from a cache, inserted or ignored beside those that are recorded."""
    cache = _files(spark, d).where("path % 2 = 0").select("path", "sha256")
    old = cache.where("path % 10 = 0").groupBy("sha256").agg(F.min(-F.col("path")).alias("canonical"))
    old = old.withColumns({"destination_path": F.lit(None).cast("string"), "destination_size": F.lit(None).cast("long")})
    out = claims.insert_or_ignore(old, claims.backfill(cache))
    return out.join(old.select("sha256", F.col("canonical").alias("given")), "sha256", "left").select("sha256", "given", "canonical")


@query("""SELECT mime, grp, count(*) AS n FROM (SELECT CASE page_id % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'audio/mpeg' WHEN 3 THEN 'application/rtf' WHEN 4 THEN 'application/x-msdownload'
  WHEN 5 THEN 'application/gzip' WHEN 6 THEN 'video/x-matroska' WHEN 7 THEN 'application/octet-stream' WHEN 8 THEN 'application/zip' END AS mime,
  CASE page_id % 9 WHEN 0 THEN 'DOCUMENT' WHEN 1 THEN 'PROTECTED_MEDIA' WHEN 2 THEN 'AUDIO' WHEN 3 THEN 'DOCUMENT' WHEN 4 THEN 'EXECUTABLE' WHEN 5 THEN 'ARCHIVE' WHEN 6 THEN 'PROTECTED_MEDIA' WHEN 7 THEN 'OTHER' WHEN 8 THEN 'ARCHIVE' END AS grp FROM pages) GROUP BY 1, 2""")
def mime_sniff_types(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of nine kinds, by what each page's own content is put behind."""
    starts = [b"%PDF-", b"GIF89a", b"ID3", b"{\\rtf", b"MZ", b"\x1f\x8b", b"\x1aE\xdf\xa3", b"\x00\x01\xfe", b"PK\x03\x04"]
    lead = F.element_at(F.array(*[F.unhex(F.lit(x.hex())) for x in starts]), (F.col("page_id") % 9 + 1).cast("int"))
    p = table(spark, d, "pages").select(sniffed(F.concat(lead, F.substring(F.encode("html", "utf-8"), 1, 4000))).alias("mime"))
    return p.groupBy("mime", C.mime_group(F.col("mime")).alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN date_trunc('second', o_orderdate) END AS creation_time FROM orders")
def probe_creation_time(spark: SparkSession, d: str) -> DataFrame:
    """The creation time in a probe's JSON: of the format, of a stream only, as an instant; absent or no time: null."""
    stamp, kind = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 5
    tags = lambda when: F.concat(F.lit('"tags": {"creation_time": "'), when, F.lit('"}'))
    probed = (
        F.when(kind == 0, F.concat(F.lit('{"format": {'), tags(stamp), F.lit("}}"))).when(kind == 1, F.concat(F.lit('{"streams": [{'), tags(stamp), F.lit('}], "format": {}}')))
        .when(kind == 2, F.concat(F.lit('{"format": {'), tags(F.concat(stamp, F.lit(".000000Z"))), F.lit("}}"))).when(kind == 3, F.lit('{"format": {"tags": {"creation_time": "soon"}}}')).otherwise(F.lit("no JSON"))
    )
    return table(spark, d, "orders").select("o_orderkey", C.creation_time(probed).alias("creation_time"))


@query(f"""{_SAMPLES}, w AS (SELECT *, greatest(1, max(elapsed) OVER (PARTITION BY outcome) // 600 + 1) AS width FROM s)
SELECT outcome, elapsed // width AS bucket, min(elapsed) AS elapsed, min(event_id) AS event_id, round(avg(value), 6) AS value FROM w GROUP BY 1, 2""")
def bucket_first(spark: SparkSession, d: str) -> DataFrame:
    """Averages with the first sample of each bucket."""
    out = series.bucket_average(_samples(spark, d), "outcome", "elapsed", ["value"], 600, ("event_id",))
    return out.select("outcome", "bucket", "elapsed", "event_id", F.round("value", 6).alias("value"))
