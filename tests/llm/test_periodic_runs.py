"""Runs of words against a brute-force search, and the query against a slow version of its contract."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filelake.llm import periodic_runs
from filelake.llm.periodic_runs import SuffixAutomaton, find_runs, runs_of_texts


def slow(w: list, shortest: int) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def texts(n: int):
    rnd = random.Random(3)
    for _ in range(n):
        k = rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randrange(k) for _ in range(rnd.randrange(90))]
        for _ in range(rnd.randrange(4)):
            if w:
                a, c = rnd.randrange(len(w)), rnd.randrange(len(w))
                w[c:c] = w[a : a + rnd.randrange(1, 12)] * rnd.randrange(1, 5)
        yield w * rnd.choice([1, 1, 1, 2]), rnd.choice([2, 2, 4, 5, 12])


def test_runs_equal_brute_force():
    for w, shortest in texts(1500):
        assert find_runs(w, shortest) == slow(w, shortest), (w, shortest)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    assert find_runs(fib[-1], 2) == slow(fib[-1], 2)


def test_factors_are_the_longest_earlier_ones():
    for w, _ in texts(200):
        w, at = [*w, -2], 0
        for begin, end, source in SuffixAutomaton(w).factors(w):
            assert begin == at < end and (source < 0 or source < begin and w[source : source + end - begin] == w[begin:end])
            longer = w[begin : end + 1] if source >= 0 else w[begin:end]
            assert end == len(w) and source < 0 or not any(w[k : k + len(longer)] == longer for k in range(begin))
            at = end
        assert at == len(w)


def test_stretches_lose_no_run():
    for w, shortest in texts(300):
        line = " ".join(f"w{x}" for x in w)
        n, runs, collapsed = runs_of_texts(pa.array(["a b c", line, None if not w else "", f"\t{line}\n z"]).fill_null(""), shortest)
        want = slow(w, shortest)
        assert [tuple(r.values()) for r in runs[1].as_py()] == want and n.to_pylist() == [3, len(w), 0, len(w) + 1]
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert collapsed[1].as_py() == " ".join(f"w{x}" for i, x in enumerate(w) if i not in gone) and collapsed[2].as_py() == ""


def row(doc_id, text) -> tuple:
    w = [x for x in re.split("[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = slow(w, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    hit = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    out = [(k, " ".join(rnd.choice(("ä", "b", "c d", "e", "f")) for _ in range(rnd.randrange(120)))) for k in [*range(40), *hit]]
    out += [(hit[0], None), (hit[1], " \t\n"), (hit[2], "one"), (None, None), (None, "a b " * 20), (900, None), (901, ""), (902, "x\ty\x0b" * 9000), (903, "same " * 11), (904, "same " * 12), (904, "same " * 12), (905, "z" * 100_000)]
    return out


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("odd"), "runs": F.lit(1), "_text": F.lit(2)}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {repr(row(*r)) for r in rows if r[0] != 902}
    found = {repr(tuple(r)) for r in got.where("doc_id is null or doc_id <> 902").collect()}
    assert found == want and got.count() == len(rows)
    assert tuple(got.where("doc_id = 902").first())[1:6] == (1, 0, 18_000, 2, 9_000_000)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_operator_keeps_texts_and_spans(spark):
    df = spark.createDataFrame([("k", "go a b c a b c a b c a b c stop", 1)], "id string, body string, n_words int")
    assert [tuple(r) for r in periodic_runs.periodic_runs(df, "id", "body").collect()] == [("k", 14, [(1, 12, 3)], "go a b c stop")]
    assert periodic_runs.periodic_runs(df, "id", "body", 13).first().runs == []
