"""Periodic runs of words in a text, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q that holds at least ``shortest``
words and two periods, and that no neighbouring word extends with that period.

1. Stretches that can hold a run: in a run of L words L - q >= shortest / 2, so every word of it
   lies in a window of that many words that occurs again in the same run. Windows are hashed and
   sorted for many texts at once; only stretches covered by repeated windows are left (a hash that
   collides keeps a stretch, it never loses one), and the same again inside each stretch.
2. Of each stretch the suffix automaton gives the LZ factors: the longest prefix of what follows
   that also starts earlier.
3. Runs that cross or touch the start of a factor and end before the next one: Main's algorithm,
   with the longest common extensions to both sides of that border.
4. Runs strictly inside a factor are copies of runs at the factor's earlier occurrence.

One text is worked on in one task, in time and memory in proportion to its length; no row is
shuffled, so copies of one text do not gather. A null text counts as empty: no word, no run, an
empty collapsed text. Texts of any length are read whole. Repeated rows give repeated rows, an
empty table an empty result. Only id and text are read, so further columns of any name do no
harm. A null id is returned as it is; ``op12_periodic_runs`` repeats no words of such a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.texts import _OTHER, groups
from filelake.session import ship

SHORTEST = 12
GROUP = 8 << 20
#: Rounds of narrowing stretches; more would only save time.
ROUNDS = 6
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixAutomaton:
    """States of the words of a list; a state's first transition lies in arrays, only further ones in a dictionary."""

    def __init__(self, words: list[int]) -> None:
        link, length, first, letter, to = [-1], [0], [-1], [-1], [-1]
        more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(words):
            cur = len(link)
            link.append(0), length.append(i + 1), first.append(i), letter.append(-1), to.append(-1)
            p, there = last, -1
            while p >= 0:
                if letter[p] == c:
                    there = to[p]
                    break
                if letter[p] == -1:
                    letter[p], to[p] = c, cur
                else:
                    others = more.setdefault(p, {})
                    if (there := others.get(c, -1)) >= 0:
                        break
                    others[c] = cur
                p = link[p]
            if there >= 0:
                if length[p] + 1 == length[there]:
                    link[cur] = there
                else:
                    copy = len(link)
                    link.append(link[there]), length.append(length[p] + 1), first.append(first[there]), letter.append(letter[there]), to.append(to[there])
                    if there in more:
                        more[copy] = more[there].copy()
                    while p >= 0:
                        if letter[p] == c:
                            if to[p] != there:
                                break
                            to[p] = copy
                        elif more.get(p, {}).get(c, -1) == there:
                            more[p][c] = copy
                        else:
                            break
                        p = link[p]
                    link[there] = link[cur] = copy
            last = cur
        self.first, self.letter, self.to, self.more = first, letter, to, more

    def factors(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(begin, end, place of an earlier occurrence or -1) of each LZ factor; the occurrence may overlap the factor."""
        first, letter, to, more = self.first, self.letter, self.to, self.more
        n, begin = len(words), 0
        while begin < n:
            state, at, source = 0, begin, -1
            while at < n:
                c = words[at]
                state = to[state] if letter[state] == c else more.get(state, {}).get(c, -1)
                if state < 0 or first[state] >= at:
                    break
                source = first[state] - (at - begin)
                at += 1
            yield begin, max(at, begin + 1), source
            begin = max(at, begin + 1)


def _extensions(s: list[int]) -> list[int]:
    """At each place the length of the longest prefix of ``s`` that starts there."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def find_runs(words: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of word numbers (from 0), by start, then period."""
    n = len(words)
    if n < max(2, shortest):
        return []
    w = [*words, -2]  # an end that equals nothing
    found: dict[int, dict[int, int]] = {}  # start -> end -> period

    def add(start: int, end: int, q: int) -> None:
        """``end``: behind the last word. Of several periods of one stretch the smallest counts."""
        if end - start >= max(shortest, 2 * q) and (start == 0 or w[start - 1] != w[start - 1 + q]):
            ends = found.setdefault(start, {})
            ends[end] = min(q, ends.get(end, q))

    before = 0  # length of the factor before
    for b, end, source in SuffixAutomaton(w).factors(w):
        if b:
            back = max(0, b - 2 * before - (end - b))
            left, right = w[back:b], w[b : end + 1]  # with the first word of the next factor, where its mismatch may lie
            size, reach = end - b, len(left)
            ahead = _extensions([*right, -3, *left, *right])
            behind = _extensions([*left[::-1], -3, *right[:size][::-1], *left[::-1]])
            shift = len(right) + 1 + reach
            for q in range(1, size + 1):  # the left copy begins at or before the border, the right one q words later
                more, less = ahead[q] if q < len(right) else 0, behind[reach + 1 + size - q]
                if more + less >= q and b + q + more <= min(end, n):
                    add(b - less, b + q + more, q)
            for q in range(1, reach + 1):
                more, less = min(ahead[shift - q], len(right)), behind[q] if q < reach else 0
                if more + less >= q and b + more <= min(end, n):
                    add(b - q - less, b + more, q)
        before = end - b
        if source >= 0 and end - b > shortest + 1:
            apart, limit = b - source, end - 1
            for start in range(b + 1, limit):
                for stop, q in found.get(start - apart, {}).items():
                    if stop + apart <= limit:
                        found.setdefault(start, {})[stop + apart] = q
    return sorted((s, e - s, q) for s, ends in found.items() for e, q in ends.items())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def stretches(codes: np.ndarray, bound: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(begin, end) rows of the stretches that can hold a run. ``bound``: where each text begins and ends in ``codes``."""
    wide = -(-shortest // 2)
    spans = np.stack([bound[:-1], bound[1:]], axis=1)
    spans = spans[spans[:, 1] - spans[:, 0] >= shortest]
    place = np.arange(len(codes))
    hashed = _mixed(codes)
    for _ in range(ROUNDS):
        sizes = spans[:, 1] - spans[:, 0]
        if not len(sizes):
            break
        owner = np.repeat(np.arange(len(spans)), sizes)
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(owner)) - starts[owner]
        at = place[spans[:, 0][owner] + inside]
        own = hashed[at]
        total = _mixed(owner)
        m = len(own)
        for k in range(wide):  # words behind the end of a stretch belong to windows that do not count
            total[: m - k] += own[k:] * np.uint64(pow(0x100000001B3, k + 1, 1 << 64))
        whole = np.flatnonzero(inside + wide <= sizes[owner])
        order = np.argsort(total[whole], kind="stable")
        ranked = total[whole][order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(whole), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        open_ = whole[again]
        depth = np.zeros(m + 1, np.int64)
        np.add.at(depth, open_, 1)
        np.add.at(depth, open_ + wide, -1)
        covered = np.cumsum(depth[:-1]) > 0
        first = covered & ~np.append(False, covered[:-1] & (owner[1:] == owner[:-1]))
        last = covered & ~np.append(covered[1:] & (owner[1:] == owner[:-1]), False)
        next_ = np.stack([at[first], at[last] + 1], axis=1)
        next_ = next_[next_[:, 1] - next_[:, 0] >= shortest]
        if len(next_) == len(spans) and np.array_equal(next_, spans):
            break
        spans = next_
    return spans


def runs_of_texts(texts: pa.Array, shortest: int = SHORTEST) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs, collapsed text) of each text. Collapsed: without the words of a run behind its first period."""
    for ch in _OTHER:
        texts = pc.replace_substring(texts, ch, " ")
    parts = pc.split_pattern(texts, " ")
    flat, bound = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    bound = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[bound - bound[0]]
    flat = flat.filter(full)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    owner, runs, drop = [], [], np.zeros(len(codes) + 1, np.int64)
    for begin, end in stretches(codes, bound, shortest).tolist():
        text = int(np.searchsorted(bound, begin, side="right")) - 1
        for start, length, q in find_runs(codes[begin:end].tolist(), shortest):
            owner.append(text)
            runs.append((begin + start - int(bound[text]), length, q))
            drop[begin + start + q] += 1
            drop[begin + start + length] -= 1
    each = np.zeros(len(bound), np.int32)
    np.add.at(each, np.array(owner, np.int64) + 1, 1)
    columns = np.array(runs, np.int64).reshape(len(runs), 3)
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum(each, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=list(RUN)))
    if runs:
        kept = np.cumsum(drop[:-1]) == 0
        flat = flat.filter(pa.array(kept))
        bound_kept = np.append(0, np.cumsum(kept))[bound]
    else:
        bound_kept = bound
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bound_kept.astype(np.int32)), flat), " ")
    return pa.array(np.diff(bound)), listed, collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``id_col, n_words, runs`` (start, length, period in words, by start, then period) and ``collapsed`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1), GROUP):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *runs_of_texts(texts, shortest)], [id_col, "n_words", "runs", "collapsed"])
                at += len(texts)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _repeated(h: Column, text: Column) -> Column:
    """The text whose words from word a on repeat its words a to a + p - 1, where h says so."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(words), F.expr("h div 10")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    found = periodic_runs(docs.select("doc_id", _repeated(F.col("h"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", longest).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH h AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k) & 1)))),
      lambda crc, bit: xor(crc >> 1, 3988292384::BIGINT * (xor(crc, bit) & 1))), 4294967295::BIGINT) AS h FROM documents
), s AS (
  SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM h
), t AS MATERIALIZED (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // d) + 1] END) ELSE w END AS w FROM s
), words AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t
), grams AS MATERIALIZED (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM runs
), lines AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
