"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

1. Statistics of the whole text are Spark column expressions (``STATISTICS``).
2. A bounded sample of labelled rows (``SAMPLE`` of them, smallest hashed ids first, held-out
   ids never) comes to the driver as statistics, not as texts.
3. Small boosted trees over the sample give rules: each tree path is a conjunction of
   threshold tests. A lasso logistic regression (FISTA) keeps few of them.
4. The kept rules and weights become one column expression; scoring is JVM-only.

Null text counts as empty and gets a score like any other. Labels with a null id or null
quality are left out; repeated labels of an id count once (the largest). Labels, language,
source and id are never inputs of a score. With no usable label the score is 0.5. Repeated rows
each get a score, a null id is never held out, texts of any length count whole, an empty table
gives an empty result. Internal columns take names that the table does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.session import unused

SAMPLE = 6000
THRESHOLD = 0.3
FOLD = 5


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Raw counts of a text; each is computed once per row."""
    found = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text), "words": F.size(found), "distinct": F.size(F.array_distinct(found)), "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)), "upper": _removed(text, "\\p{Lu}+"), "digits": _removed(text, "\\p{N}+"),
        "letters": _removed(text, "\\p{L}+"), "marks": _removed(text, "[!?]+"), "signs": _removed(text, "[^\\p{L}\\p{N}\\s.,!?'\"-]+"),
        "bars": F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))), "stops": _removed(text, "[.,]+"),
    }


def features(c: dict[str, Column]) -> dict[str, Column]:
    """Ratios of the counts: bounded, and alike for short and long texts."""
    chars, count = F.greatest(c["chars"], F.lit(1)), F.greatest(c["words"], F.lit(1))
    return {
        "log_words": F.log1p(c["words"]), "word_length": c["chars"] / count, "distinct_ratio": c["distinct"] / count,
        "root_ratio": c["distinct"] / F.sqrt(count), "line_words": count / F.greatest(c["lines"], F.lit(1)),
        "line_distinct": c["distinct_lines"] / F.greatest(c["lines"], F.lit(1)), "upper_ratio": c["upper"] / F.greatest(c["letters"], F.lit(1)),
        "digit_ratio": c["digits"] / chars, "letter_ratio": c["letters"] / chars, "mark_ratio": c["marks"] / count,
        "sign_ratio": c["signs"] / count, "bar_ratio": c["bars"] / count, "stop_ratio": c["stops"] / count,
    }


FEATURES = [
    "log_words", "word_length", "distinct_ratio", "root_ratio", "line_words", "line_distinct", "upper_ratio", "digit_ratio",
    "letter_ratio", "mark_ratio", "sign_ratio", "bar_ratio", "stop_ratio",
]


def feature_prefix(columns: list[str], prefix: str = "_f_") -> str:
    """A prefix that no column begins with, in any case."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "_f_") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.withColumns({f"{prefix}n_{k}": v for k, v in statistics(text).items()})
    names = {k: F.col(f"{prefix}n_{k}") for k in statistics(F.lit(""))}
    return counted.withColumns({f"{prefix}{k}": v.cast("double") for k, v in features(names).items()}).drop(*[f"{prefix}n_{k}" for k in names])


@dataclass(frozen=True)
class RuleModel:
    """``rules``: conjunctions of (feature number, above, threshold); one weight each."""

    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, prefix: str = "_f_") -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, above, cut in rule:
                x = F.col(f"{prefix}{FEATURES[k]}")
                test = test & ((x > cut) if above else (x <= cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def fires(self, x: np.ndarray) -> np.ndarray:
        return fires(self.rules, x)


def fires(rules, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for r, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, r] &= (x[:, k] > cut) == above
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: tuple, rules: list, rows: np.ndarray, out: np.ndarray) -> None:
    """One tree on gradients; every path to a node becomes a rule, leaves also set ``out``."""
    best = (1e-6, -1, 0.0)
    gs, hs = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * least:
        base = gs * gs / (hs + 1)
        for k, c in enumerate(cuts):
            at = np.searchsorted(c, x[rows, k], side="left")  # x <= c[i] for i >= at
            gl = np.cumsum(np.bincount(at, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - base
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            i = int(gain.argmax()) if len(gain) else -1
            if i >= 0 and gain[i] > best[0]:
                best = (gain[i], k, float(c[i]))
    if path:
        rules.append(path)
    if best[1] < 0:
        out[rows] = -gs / (hs + 1)
        return
    _, k, cut = best
    low = x[rows, k] <= cut
    _grow(x, g, h, cuts, depth - 1, least, (*path, (k, False, cut)), rules, rows[low], out)
    _grow(x, g, h, cuts, depth - 1, least, (*path, (k, True, cut)), rules, rows[~low], out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.0008, seed: int = 4) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else (len(y) * float(y[0]) + 0.5) / (len(y) + 1)
        return RuleModel((), (), float(np.log(p / (1 - p))))
    rng, n = np.random.default_rng(seed), len(y)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    f, found = np.full(n, np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step, part = np.zeros(n), np.flatnonzero(rng.random(n) < 0.7)
        rules: list = []
        _grow(x, p - y, p * (1 - p), cuts, depth, max(5, n // 400), (), rules, part, step)
        f += 0.3 * step
        found += rules
    rules = list(dict.fromkeys(found))
    a = fires(rules, x).astype(np.float64)
    keep = (a.mean(0) > 0) & (a.mean(0) < 1)
    _, first = np.unique(a, axis=1, return_index=True)
    keep &= np.isin(np.arange(len(rules)), first)
    rules = [r for r, k in zip(rules, keep, strict=True) if k]
    a = a[:, keep]
    lip = (np.linalg.norm(a, 2) ** 2 + n) / (4 * n)
    w, v, b, c, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 0.0, 0.0, 1.0
    for _ in range(1500):
        err = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - a.T @ err / n / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        bias = c - err.mean() / lip
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    used = np.flatnonzero(np.abs(w) > 1e-9)
    return RuleModel(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLD
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = with_features(texts.join(F.broadcast(chosen), "doc_id")).select("_y", *[f"_f_{k}" for k in FEATURES])  # ``sample`` rows
    data = np.array(sorted(tuple(r) for r in rows.collect()), np.float64).reshape(-1, 1 + len(FEATURES))  # in an order that no shuffle changes
    return fit(data[:, 1:], data[:, 0])


def score_quality(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, which ``docs`` must not have: probability that the label would be 1."""
    if unused(docs.columns, name) != [name]:
        raise ValueError(f"the table already has a column {name!r}")
    prefix = feature_prefix([*docs.columns, name])
    scored = with_features(docs, prefix=prefix).withColumn(name, model.score(prefix))
    return scored.drop(*[f"{prefix}{k}" for k in FEATURES])


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLD == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    model = train(docs, labels)
    name, *_ = unused(docs.columns, "_score")
    return score_quality(docs, model, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)
