"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, odd columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filelake.llm import attention, bpe_codec, exact_dedup, impact_search, lm_scoring, packing, rule_quality, sharding, simhash, substring_dedup, token_counts
from filelake.llm.bpe import load
from filelake.llm.texts import ChunkCache

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rnd = random.Random(5)
    vocab = ["Th" + a + b for a in ("er", "on", "ß", "é", "日") for b in ("", "ing", ",", "'s", "42")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, near = text(60), text(200)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, passage), (6, "x " + passage + "\ty"), (7, passage.replace(" ", "  ", 3)), (8, text(6000)), (9, "a" * 3000)]
    rows += [(10 + k, near.replace("Th", "th", k)) for k in range(8)] + [(30, near), (31, near), (31, near), (None, near), (None, "alone")]
    rows += [(40 + k, text(rnd.randrange(1, 80))) for k in range(60)] + [(101, "s <|endoftext|> t\n\n\n  u \U00018f1b v")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "src0", len(t or ""), "odd", True) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def order(i):
    return math.inf if i is None else i


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t in corpus():
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, min(groups[norm(t)], key=order), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in corpus())
    far = docs.union(docs.limit(0)).unionByName(docs.sparkSession.createDataFrame([((1 << 63) - 1, "alone", None, None, 5, "", True)], docs.schema))
    assert {r.doc_id: r._keep_id for r in exact_dedup.exact_groups(far).collect()}[None] == (1 << 63) - 1  # the largest id is not null
    rows = exact_dedup.exact_groups(docs, capacity=4).collect()
    assert Counter((r.doc_id, r._keep_id, r._size, r._sha) for r in rows) == want
    assert sum(r._uid == r._keep_uid for r in rows) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_directory_splits_only_full_buckets(spark):
    found = exact_dedup.Directory(6, 3)
    assert found.page(0, 0, 16, {0: 5, 1: 5, 40000: 1}) == []
    found.close()
    assert found.first[:3] == [0, 1 << 48, 2 << 48] and max(found.entries) == 5 and sorted(found.owners) == found.owners
    assert [found.bucket(k) for k in (0, (1 << 48) - 1, 1 << 48, (1 << 64) - 1)] == [0, 0, 1, len(found.first) - 1]
    rnd = random.Random(4)
    hot = [(77 << 48) + (k % 2 << 41) + k // 2 for k in range(60)] + [(9 << 50) + 5] * 40  # one full slot that parts late, one key
    keys = [rnd.randrange(1 << 64) for _ in range(300)] + hot
    entries = [(exact_dedup._signed(k), n, None, n, 1, "t") for n, k in enumerate(keys)]
    df = spark.createDataFrame(entries, "key long, entry long, min_id long, min_uid long, n long, text string").repartition(3)
    found = exact_dedup.build_directory(df, "key", 20, 5)
    depth = {k: found.buckets[k][0] for k in found.first}
    assert max(depth.values()) > 16 and sum(found.entries) == len(keys) and all(n <= 20 or n >= 40 and depth[k] == 64 for k, n in zip(found.first, found.entries, strict=True))
    assert found.first[0] == 0 and all(a + (1 << 64 - depth[a]) == b for a, b in zip(found.first, [*found.first[1:], 1 << 64], strict=True))  # no gaps
    got = exact_dedup.place_entries(df, found).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(keys) and {r.task for r in got} == set(found.owners)
    for r in got:
        assert r.bucket == found.bucket(r.key & (1 << 64) - 1) and r.task == found.owners[r.bucket]
    assert exact_dedup.build_directory(df.limit(0), "key", 20, 5).first == [0]


ODD = ["_score", "_fp", "_key", "_uid", "_UID", "_component", "_first", "_sha", "_entry", "_n", "_keep_id", "_f_log_words", "_F_n_chars", "part", "docs", "blob", "bucket", "tier", "score"]


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "substring", "packing", "counts", "codec", "lm", "shards"])
def test_stages_take_odd_columns_and_empty_tables(stage, docs, empty, spark, tmp_path):
    labels = spark.createDataFrame([(i, int(len(t or "") > 100)) for i, t in corpus() if i], "doc_id long, quality int")
    byte, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    run = {
        "quality": lambda d: rule_quality.drop_low_quality(d, labels), "exact": exact_dedup.drop_exact_duplicates, "near": simhash.drop_near_duplicates, "substring": substring_dedup.remove_repeats,
        "packing": lambda d: packing.pack_documents(d, byte), "counts": lambda d: token_counts.count_tokens(d, byte), "codec": lambda d: bpe_codec.encode_documents(d, word),
        "lm": lambda d: lm_scoring.score_documents(d, byte).select("doc_id", "n_tokens", "base_score"), "shards": lambda d: stored(spark, d, tmp_path),
    }[stage]
    odd = docs.withColumns({c: F.lit("odd") for c in ODD if c != "_UID" and c != "_F_n_chars"})
    rows = lambda df: Counter(repr(r) for r in df.collect())
    plain, got = run(docs), run(odd)
    if plain.columns == docs.columns:
        assert got.columns == odd.columns and {r[-1] for r in got.collect()} == {"odd"}
        got = got.select(*docs.columns)
    if stage == "packing":  # which piece shares a sequence is the task's affair
        plain, got = (x.groupBy("doc_id").agg(F.sum("length")) for x in (plain, got))
    if stage in ("exact", "near"):  # of rows alike in text and id any one may stay
        plain, got = (x.select("doc_id", "text") for x in (plain, got))
    assert rows(got) == rows(plain) and run(odd.limit(0)).count() == 0 and run(empty).count() == 0


def stored(spark, df, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/{random.random()}")
    store.append(df)
    return store.read()


def test_substring_dedup(docs, empty, spark, tmp_path):
    first: dict = {}
    for i, t in sorted(corpus(), key=lambda r: order(r[0])):
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), order(i))
    want = Counter()
    for i, t in corpus():
        w = WORDS.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                keep[k : k + 13] = [False] * 13
        left = " ".join(a for a, b in zip(w, keep, strict=True) if b)
        want[i, len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest()] += 1
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in substring_dedup.op3_substring_dedup(spark, str(tmp_path)).collect()) == want
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and substring_dedup.remove_repeats(empty).count() == 0


def fingerprint(text):
    w = WORDS.findall((text or "").encode().lower().decode())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = simhash.op5_simhash(spark, str(tmp_path)).collect()
    prints = [(i, fingerprint(t)) for i, t in corpus()]
    group = {f: f for _, f in prints}
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                if bin(a ^ b).count("1") <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {g: min((order(i) for i, f in prints if group[f] == g)) for g in group.values()}
    want = Counter((i, f"{f:016x}", None if least[group[f]] == math.inf else least[group[f]]) for i, f in prints)
    assert Counter(tuple(r) for r in rows) == want
    assert simhash.drop_near_duplicates(docs).columns == docs.columns and simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_links_through_null_ids(spark):
    prints = [(1, 0), (None, 0b1111), (3, 0b11111111), (None, -1), (None, -1), (None, -2), (7, 1 << 40 | 0x5555 << 20)]
    rows = simhash.near_groups(spark.createDataFrame([(*r, k) for k, r in enumerate(prints)], "doc_id long, fp long, uid long")).collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {(0, 1, 0), (15, 1, 0), (255, 1, 0), (-1, None, 3), (-2, None, 3), (1 << 40 | 0x5555 << 20, 7, 6)}
    docs = spark.createDataFrame([(None, "one two three four five six")] * 3 + [(5, "quite other words stand in this text"), (None, "quite other words stand in this text")], "doc_id long, text string").repartition(3)
    assert Counter(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == Counter([None, 5])


def test_pivot_links_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in (1, 2, 3, 4, 5, 6) for _ in range(6)]]))
    key = np.arange(len(fps)) % 2
    a, b = simhash.link_groups(key, fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    other = list(range(len(fps)))

    def find2(i):
        while other[i] != i:
            i = other[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        root[find(i)] = find(j)
    for i in range(len(fps)):
        for j in range(i):
            if key[i] == key[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 4:
                other[find2(i)] = find2(j)
    assert all((find(i) == find(j)) == (find2(i) == find2(j)) for i in range(len(fps)) for j in range(i))


def check_packing(rows, want, window=1024):
    """Every id of every document lies in exactly one piece; sequences are gapless and without padding."""
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    parts: dict = {}
    for r in rows:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for i, ids in want:  # of rows alike, each takes its own pieces
        at, raw = 0, np.array(ids, "<u4").tobytes()
        while at < len(ids):
            step = next(n for s, n in sorted(set(parts[i, len(ids)])) if s == at and pieces[i, at, n, zlib.crc32(raw[at * 4 : (at + n) * 4]), len(ids)] > 0)
            pieces[i, at, step, zlib.crc32(raw[at * 4 : (at + step) * 4]), len(ids)] -= 1
            at += step
        assert at == len(ids)
    assert not +pieces
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == own[0].tier <= window and len({r.step_group for r in own}) == 1


def test_packer_fills_every_tier():
    rnd = random.Random(3)
    packer, lengths, got = packing.Packer(), [rnd.choice([3, 40, 90, 130, 250, 300, 510, 600, 900, 1023]) for _ in range(3000)], []
    for k, n in enumerate(lengths):
        packer.add(k, 0, n)
        if packer.held >= 500:
            got += packer.windows(False)
    got += packer.windows(True)
    own = Counter(sum(p[2] for p in w) for w in got)
    assert all(own[size] > 20 for size in (128, 256, 512, 1024)) and all(size & (size - 1) == 0 for size in own)
    ends = {}
    for doc, start, n in sorted(p for w in got for p in w):
        assert ends.get(doc, 0) == start
        ends[doc] = start + n
    assert [ends[k] for k in range(len(lengths))] == lengths
    steps = packing.step_groups([[p[2] for p in w] for w in got], 7)
    tokens = Counter()
    for w, step in zip(got, steps, strict=True):
        tokens[step] += sum(p[2] for p in w)
    assert min(steps) == 7 and sorted(tokens) == list(range(7, max(steps) + 1)) and max(tokens.values()) <= packing.STEP


def test_tier_report(spark):
    rows = [(1, 0, 1024, 0, 1030, 0, 0, 1024, 0), (1, 1024, 6, 0, 1030, 1, 0, 8, 1), (2, 0, 1, 0, 1, 1, 6, 8, 1)]
    got = {r.tier: (r.sequences, r.tokens, r.padding, r.pieces, r.cut_pieces) for r in packing.tier_report(spark.createDataFrame(rows, packing.SCHEMA)).collect()}
    assert got == {1024: (1, 1024, 0, 1, 1), 8: (1, 7, 1, 2, 1)}


def test_chunks_with_white_space_equal_the_library():
    byte, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    rnd = random.Random(8)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "Word,", "'s", "1", "<|endoftext|>", "é", "Σ", "\U00018f1b", "...", "日本", "\u0301"]
    texts = ["", " ", None, "a\n \nb", "x" * 9000, "ab" * 4000, *("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(3000))]
    t = Tokenizer.from_file(byte)
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.IdBytes(load(byte)).encode(pa.array(texts))] == want
    assert token_counts.Counts(load(byte), token_counts.proved(byte)).count(pa.array(texts)).tolist() == list(map(len, want))
    t = Tokenizer.from_file(word)
    for (n, ids, decoded), e in zip(bpe_codec.Codec(load(word)).code(pa.array(texts)), t.encode_batch([x or "" for x in texts], add_special_tokens=False), strict=True):
        assert (n, bytes(ids).decode(), bytes(decoded).decode()) == (len(e.ids), " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False))


def test_chunk_cache_forgets_and_learns_again():
    asked = []
    cache = ChunkCache(lambda new: asked.append(new) or [len(c) for c in new], 4)
    for names in (["a", "bb"], ["bb", "ccc"], ["dddd", "bb"], ["e", "f"], ["a", "bb"]):
        assert cache(names) == [len(c) for c in names]
    assert len(cache.known) <= 6 and asked[2] == ["dddd"] and "a" in asked[4]


def test_tokenizers(docs, empty, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t or "" for _, t in corpus()]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (i, _), e in zip(corpus(), t.encode_batch(texts, add_special_tokens=False), strict=True):
        want[i, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe_codec.op6_bpe_codec(spark, str(tmp_path)).collect()) == want
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = Counter(tuple(r) for r in token_counts.op8_token_counts(spark, str(tmp_path)).collect())
    assert got == Counter((i, len(x.encode()), len(e), len(e) > 512) for (i, _), x, e in zip(corpus(), texts, ids, strict=True))
    rows = packing.op10_packing(spark, str(tmp_path)).collect()
    check_packing(rows, [(i, [*e, 0]) for (i, _), e in zip(corpus(), ids, strict=True)])
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe_codec.encode_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_lm_scoring(docs, empty, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = lm_scoring.score_documents(docs, path).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORDS.findall((t or "").encode().lower().decode()), None]
    c = Counter(x for i, t in corpus() if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(x in c for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in corpus())
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_scoring.score_documents(empty, path).count() == 0


def test_windows_score_each_token_once():
    size = np.array([1, 31, 32, 33, 56, 57, 500])
    seq = np.concatenate([np.arange(n) for n in size])
    for stride in (attention.SPAN, attention.STRIDE):
        x, y, use = lm_scoring.windows(seq, size, -1, stride)
        assert y[use].tolist() == seq.tolist() and x[use].tolist() == (seq - 1).tolist()


def learned(monkeypatch, texts):
    """(classes that the trainer learned, classes of the texts with their ends, the weight it reports), texts given twice."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tables = lm_scoring.Tables(len(load(path).tokens), [], [(i, 1) for i in range(300)], 1)
    seen, step = [], attention.step
    monkeypatch.setattr(lm_scoring.net, "step", lambda p, prior, x, y, use: seen.extend(y[use].tolist()) or step(p, prior, x, y, use))
    monkeypatch.setattr(lm_scoring.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array([t for t in texts for _ in range(2)])], ["text"])  # which texts train is settled before
    out = list(lm_scoring._trainer(path, tables, attention.flat(attention.initial(lm_scoring.CLASSES)), 0.006)(iter([batch])))
    want = [c for t in texts for c in [*tables.cls[lm_scoring.subwords(load(path), t.lower().split())[0]].tolist(), tables.end]]
    return Counter(seen), Counter(want * 2), out[0].column(2)[0].as_py()


def test_training_learns_every_position_of_every_text(monkeypatch):
    rnd = random.Random(4)
    got, want, weight = learned(monkeypatch, ["", "one", " ".join(rnd.choice(["the", "cat", "sat", "down"]) for _ in range(3000))])
    assert got == want and weight == sum(want.values())


def test_training_learns_long_words_and_every_end(monkeypatch):
    rnd = random.Random(6)
    long = " ".join("".join(rnd.choice("bcdfgxz0123") for _ in range(40)) for _ in range(32))
    got, want, _ = learned(monkeypatch, [long, long + " tail"])
    assert sum(want.values()) > 2000 and got == want and got[lm_scoring.CLASSES - 1] == 4


def test_earlier_counts_stay_inside_a_text():
    rnd = np.random.default_rng(1)
    where, text = rnd.integers(0, 5, 200), np.repeat(np.arange(8), 25)
    assert lm_scoring.earlier(where, text).tolist() == [sum(where[j] == where[i] and text[j] == text[i] for j in range(i)) for i in range(200)]
    assert lm_scoring.earlier(where[:0], text[:0]).tolist() == []


def slow_logs(p, prior, classes, seq):
    """log P of every class of one text, position by position, without folding, batches or masks."""
    size, out = attention.set_size(classes), []
    for t, goal in enumerate(seq):
        start = 0 if t < attention.SPAN else (t - attention.SPAN) // attention.STRIDE * attention.STRIDE + attention.STRIDE
        before = [classes if k == 0 else int(seq[k - 1]) for k in range(start, t + 1)]
        x = [p["embed"][c].astype(float) + p["place"][k] for k, c in enumerate(before)]
        weight = [math.exp(min(40, float((x[-1] @ p["query"]) @ (y @ p["key"])) / math.sqrt(attention.WIDTH))) for y in x]
        mixed = sum(w * (y @ p["value"]) for w, y in zip(weight, x, strict=True)) / sum(weight)
        h = np.tanh(np.concatenate([x[-1], mixed]) @ p["mix"])
        row = np.exp(prior[before[-1]].astype(float)).reshape(-1, size)
        sets = row.sum(axis=1) * np.exp(h @ p["sets"])
        inner = row[goal // size] / row[goal // size].sum() * np.exp(h @ p["out"].reshape(-1, classes // size, size)[:, goal // size])
        out.append(math.log(sets[goal // size] / sets.sum()) + math.log(inner[goal % size] / inner.sum()))
    return np.array(out)


def test_folded_network_equals_the_slow_one():
    rnd, classes = np.random.default_rng(3), 20
    p = {k: x + rnd.normal(0, 0.5, x.shape).astype(np.float32) for k, x in attention.initial(classes).items()}
    prior = np.log(rnd.dirichlet(np.ones(classes), classes + 1)).astype(np.float32)
    size = np.array([1, 31, 32, 33, 56, 57, 200])
    seq = rnd.integers(0, classes, size.sum())
    got, at = lm_scoring._class_logs(attention.Scorer(p, prior), classes, seq, size), 0
    for n in size.tolist():
        assert np.allclose(slow_logs(p, prior, classes, seq[at : at + n]), got[at : at + n], atol=2e-3)
        at += n


def test_gradients_equal_differences():
    rnd, classes = np.random.default_rng(5), 20
    p = {k: (x + rnd.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in attention.initial(classes).items()}
    prior = np.log(rnd.dirichlet(np.ones(classes), classes + 1)).astype(np.float32)
    x, y = rnd.integers(0, classes, (2, 5, attention.SPAN))
    use = rnd.random(x.shape) < 0.8
    loss = lambda p: -attention.Scorer(p, prior).goal_logs(attention.hidden(p, x)[0][use], x[use], y[use]).mean()
    g = attention.step(p, attention.Prior(prior), x, y, use)
    for name in attention.NAMES:
        way = rnd.normal(0, 1, p[name].shape).astype(np.float32)
        up, down = (loss(p | {name: (p[name] + e * way).astype(np.float32)}) for e in (1e-2, -1e-2))
        assert abs((up - down) / 2e-2 - float((g[name] * way).sum())) < 3e-3, name


def test_words_are_spelled_alike_together_and_alone():
    vocab = load(public_tokenizers.path("byte_bpe_50k.json"))
    for found in (["a", "don't", "x" * 50, "<|endoftext|>", "naïve", "日本語", "1234,5"], ["a\u00a0", "\u00a0", "\u00a0\u00a0b", "c"], []):
        ids, size = lm_scoring.subwords(vocab, found)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size))[: len(size)]] == [vocab.plain(" " + w) for w in found]


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(len(t or "") > 100)) for i, t in corpus() if i] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = rule_quality.train(docs, labels)
    rows = rule_quality.score_quality(docs, model).select("text", "score").collect()
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([(r.score >= 0.5) == (len(r.text or "") > 100) for r in rows]) > 0.9
    assert rule_quality.drop_low_quality(docs, labels).columns == docs.columns
    assert rule_quality.drop_low_quality(empty, labels.limit(0)).count() == 0


def best(rows, queries, k):
    """Brute force over (id, vector) rows, vectors as whole numbers."""
    out = []
    for q, v in queries:
        clip = lambda x: max(-impact_search.LIMIT, min(impact_search.LIMIT, x))
        found = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_impact_search(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(16)]) for i in range(300)] + [(300 + i, [0.1] * 16) for i in range(100)] + [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (None, [0.1] * 16)]
    rows += [(1000, [1.0, 2.0]), (1050, [2.0, 2.0]), (1001, [3.0, -1.0]), (7, rows[7][1])]  # other lengths, a repeated row
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = [(i, v) for i, v in good if i % 50 == 0]
    for block in (impact_search.BLOCK, 40):
        monkeypatch.setattr(impact_search, "BLOCK", block)
        got = impact_search.top_k(df, df.where("vec_id % 50 = 0"), 5)
        assert sorted(tuple(r) for r in got.collect()) == best(good, asked, 5)
    assert impact_search.top_k(df.limit(0), df.limit(0), 5).count() == 0 and impact_search.top_k(df, df.limit(0), 5).count() == 0


def test_impact_search_of_large_numbers_and_repeated_queries(spark):
    rows = [(50, [1e16, 1.0]), (50, [0.5, 1.0]), (100, [3e8, 4e8]), (1, [2e9, 1.0]), (2, [-1e16, 5.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    got = impact_search.top_k(df, df.where("vec_id % 50 = 0"), 3).collect()
    assert sorted(tuple(r) for r in got) == best(good, [(50, good[1][1]), (100, good[2][1])], 3)  # a query that repeats asks once, with its smallest vector


def test_quality_query(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, int(len(t or "") > 100)) for i, t in corpus() if i]
    spark.createDataFrame([*rows, (None, 1), (5, None), (99_999, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rule_quality.op4_rule_quality(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in corpus())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    # labels of held-out rows are never learned from
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    spark.createDataFrame(other, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    again = rule_quality.op4_rule_quality(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in again) == Counter((r.doc_id, round(r.score, 9)) for r in got)
    held = [(r.score >= 0.5) == dict(rows).get(r.doc_id) for r in got if r.held_out]
    assert np.mean(held) > 0.8
    with pytest.raises(ValueError):
        rule_quality.score_quality(docs.withColumn("Score", F.lit(1)), rule_quality.RuleModel((), (), 0.0))


def test_substring_buckets_grow_with_the_text(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARE", 1000)
    assert substring_dedup.shares(docs) == -(-sum(len((t or "").encode()) for _, t in corpus()) // 1000) and substring_dedup.shares(docs.limit(0)) == 4


def test_sharding(docs, empty, spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path), target=1 << 20)
    assert store.read().count() == 0 and store.compact()["shards"] == []
    assert store.append(empty)["shards"] == [] and store.read().columns == docs.columns and store.read().count() == 0
    for _ in range(5):
        store.append(docs)
    assert store.append(empty)["version"] == 6
    first = store.manifest(2)
    done = store.compact()
    assert len(done["shards"]) < 5 and done["version"] > 6
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    assert rows(store.read()) == Counter({k: 5 * n for k, n in rows(docs).items()}) and rows(store.read(2)) == rows(docs) and len(first["shards"]) == 3
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(done["version"] - 1), [])
    assert store.manifest() == done
    assert store.vacuum(keep=3) == 0 and store.read().count() == 5 * docs.count()  # too young
    stray = store._run(99)
    docs.write.parquet(f"{tmp_path}/{stray}")
    assert store.vacuum(keep=2, age=0) == 3 and store.read().count() == 5 * docs.count() and store.read(done["version"] - 1).count() == 5 * docs.count()
    with pytest.raises(ValueError):
        store.read(2)
    odd = docs.withColumnRenamed("lang", "arrival")
    backlog = sharding.ShardStore(spark, f"{tmp_path}/backlog")
    assert backlog.append_backlog(odd, F.pmod(F.xxhash64("doc_id"), F.lit(3)))["version"] == 3 and rows(backlog.read()) == rows(odd)
    assert backlog.append_backlog(odd.limit(0), F.lit(1))["version"] == 3 and rows(backlog.read(1) .unionByName(backlog.read().limit(0))) <= rows(odd)
    assert sharding.ShardStore(spark, f"{tmp_path}/none").append_backlog(empty, F.lit(0))["shards"] == []


def test_merged_files_keep_the_target_size(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path), target=400_000)
    rnd = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, rnd.bytes(4000).hex()) for k in range(400)], "doc_id long, text string")
    store.append(rows.repartition(16))
    shards = store.manifest()["shards"]
    merges = store.plan(shards)
    assert len(merges) > 2 and all(sum(s["bytes"] for s in m) <= 400_000 for m in merges)
    done = store.compact()["shards"]
    assert max(s["bytes"] for s in done) <= 400_000 + max(s["bytes"] for s in shards) and len(done) >= len(merges) and sum(s["bytes"] for s in done) > 1_500_000
    ids = lambda files: frozenset(r.doc_id for r in store._read(files, rows.schema).collect())
    assert ids([s["file"] for s in merges[0]]) in {ids([s["file"]]) for s in done} and store.read().distinct().count() == 400


def test_sharding_query(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus())
    assert Counter(tuple(r) for r in sharding.op7_sharding(spark, str(tmp_path)).collect()) == want


def test_pipeline_stages_keep_columns(docs, spark, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(40, 1), (41, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {i for i, _ in corpus()}


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = list({i: (i, t) for i, t in corpus() if i is not None}.values()) + [(200, "  ".join(t.split(" "))) for i, t in corpus() if i == 8]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(len(t or "") > 100)) for i, t in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    given = {}

    def seen(name, stage):
        def run(spark, docs, sf_dir):
            given[name] = {r.doc_id: r.text for r in docs.collect()}
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [seen(*s) for s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    scores = rule_quality.score_quality(docs, rule_quality.train(docs, labels)).collect()
    assert given["quality"] == dict(rows)
    kept = {r.doc_id: r.text for r in scores if r.score >= rule_quality.THRESHOLD}
    assert given["exact_dedup"] == kept and 30 < len(kept) < len(rows)
    norm = {}
    for i, t in sorted(kept.items()):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    kept = {i: kept[i] for i in norm.values()}
    assert given["near_dedup"] == kept
    prints, group = {i: fingerprint(t) for i, t in kept.items()}, {i: i for i in kept}
    for _ in kept:
        for a in kept:
            group[a] = min(group[b] for b in kept if bin(prints[a] ^ prints[b]).count("1") <= 4)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    assert given["substring_dedup"] == kept
    first, left = {}, {}
    for i, t in sorted(kept.items()):
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        left[i] = [x for j, x in enumerate(w) if j not in gone]
    assert {i: WORDS.findall(t or "") for i, t in given["packing"].items()} == left
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in given["packing"].items()}
    length = Counter()
    for r in out:
        length[r.doc_id] += r.length
        assert r.length < len(ids[r.doc_id]) or r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())
    assert length == {i: len(x) for i, x in ids.items()}
