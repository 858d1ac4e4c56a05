"""The compiled rule score against plain Python; the whole pipeline on empty tables and on tables with further columns."""

import math

import pytest
import regex

from filelake.llm import rule_quality
from tests.llm.test_operators import corpus


def slow_features(text):
    t = text or ""
    words = [w for w in regex.split(r"[ \t-\r]+", t) if w]
    lines = t.split("\n")
    count = lambda pattern: sum(map(len, regex.findall(pattern, t)))
    letters, chars, n = count(r"\p{L}+"), max(len(t), 1), max(len(words), 1)
    return {
        "log_words": math.log1p(len(words)), "word_length": len(t) / n, "distinct_ratio": len(set(words)) / n, "root_ratio": len(set(words)) / math.sqrt(n),
        "line_words": n / len(lines), "line_distinct": len(set(lines)) / len(lines), "upper_ratio": count(r"\p{Lu}+") / max(letters, 1),
        "digit_ratio": count(r"\p{N}+") / chars, "letter_ratio": letters / chars, "mark_ratio": count("[!?]+") / n,
        "sign_ratio": count(r"""[^\p{L}\p{N} \t\n\x0b\f\r.,!?'"-]+""") / n, "bar_ratio": t.count("|") / n, "stop_ratio": count("[.,]+") / n,
    }


def slow_score(model, text):
    x, total = slow_features(text), model.bias
    for rule, weight in zip(model.rules, model.weights, strict=True):
        if all((x[rule_quality.FEATURES[k]] > cut) == above for k, above, cut in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_compiled_score_equals_plain_python(spark):
    rows = [(i, t) for i, t in corpus() if i not in (None, 101)] + [(300, "A|B | c!? #5 Été, x.\n\nA|B"), (301, "\n\n\n"), (302, "!!! ??? |||"), (303, "٣ ٤ x" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(len(t or "") > 100 and i % 9 > 0)) for i, t in rows], "doc_id long, quality int")
    model = rule_quality.train(docs, labels)
    assert len(model.rules) > 1
    got = rule_quality.score_quality(docs, model).select("text", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(slow_score(model, r.text), rel=1e-9)
    plain = rule_quality.with_features(docs).collect()
    for r in plain:
        for name, value in slow_features(r.text).items():
            assert r[f"_f_{name}"] == pytest.approx(value, rel=1e-12)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    """Columns that the stages use inside change nothing; repeated rows and equal texts leave one row."""
    import corpus_pipeline

    rows = [(i, t, None, "src0", None) for i, t in corpus()]
    base = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = base.selectExpr("*", "'x' as score", "'y' as _score", "doc_id as keep_id", "false as kept", "0 as part", "'z' as fingerprint", "1 as ids", "2 as start", "'w' as _f_chars")
    found = []
    for name, docs in (("plain", base), ("more", extra)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, int(len(t or "") > 100)) for i, t in corpus() if i], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.collect()))
    lengths = [{}, {}]
    for n, pieces in enumerate(found):
        for null, i, _, length, _, total in pieces:
            seen = lengths[n].setdefault((null, i), [0, total])
            seen[0] += length
    assert lengths[0] == lengths[1] and lengths[0] and all(a == b for a, b in lengths[0].values())
