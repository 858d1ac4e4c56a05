"""Running values and row frames within groups of any size.

A window over a group puts the group into one task. That is right for groups of up to ``WHOLE`` rows,
which are counted first. Beyond it rows are dealt by ranges of group and order together, so a group
that holds a third of all rows spans many tasks:

* ``prefix``: each task folds its own run, and what the runs before it fold to (one row for each group
  and range) is carried in. It serves any associative value: sum, count, max, min, last that is not null.
* ``frames``: the last rows of a run are copied to the ranges behind it that reach back so far.

Both ways give the same rows. ``order`` should name every row of a group apart; rows that it does not are in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake.session import materialize, shuffle_partitions

WHOLE = 1_000_000
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
#: How a carried value and one's own go together; the carried one may be null.
_JOIN = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "last": lambda a, b: F.coalesce(b, a),
}


def large(rows: DataFrame, by: list[str]) -> bool:
    """Whether some group is too large for one task."""
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0]
    return (most or 0) > WHOLE


def _dealt(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with the number of their range. Ranges come from a sample, so they are pinned by writing the dealt rows once."""
    n = shuffle_partitions(rows.sparkSession)
    return materialize(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "dealt")


def _met(rows: DataFrame, pieces: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on group and range; null groups are groups like any other."""
    renamed = pieces.withColumnsRenamed({c: f"_g{k}" for k, c in enumerate(by)} | {"_part": "_gp"})
    same = F.col("_part") == F.col("_gp")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(renamed, same, how).drop("_gp", *[f"_g{k}" for k in range(len(by))])


def prefix(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` and for each name its value over the rows of the group up to and with this one: (sum, max, min or last, column)."""
    inside = [Window.unboundedPreceding, 0]
    if not large(rows, by):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*inside)
        out = rows.select("*", *[_FOLD[kind](c).over(w).alias(name) for name, (kind, c) in values.items()])
        return out.withColumns({name: F.coalesce(name, F.lit(0)) for name, (kind, _) in values.items() if kind == "sum"})
    cells = {name: f"_v{k}" for k, name in enumerate(values)}
    dealt = _dealt(rows.withColumns({cells[name]: c for name, (_, c) in values.items()}), by, order)
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(*inside)
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    whole = {name: F.max_by(cells[name], F.when(F.col(cells[name]).isNotNull(), place)) if kind == "last" else _FOLD[kind](cells[name]) for name, (kind, _) in values.items()}
    folds = dealt.groupBy(*by, "_part").agg(*[c.alias(f"_f{k}") for k, c in enumerate(whole.values())])
    carried = folds.select(*by, "_part", *[_FOLD[kind](f"_f{k}").over(ahead).alias(f"_c{k}") for k, (kind, _) in enumerate(values.values())])
    carried = carried.where(reduce(Column.__or__, [F.col(f"_c{k}").isNotNull() for k in range(len(values))]))
    out = dealt.withColumns({f"_o{k}": _FOLD[kind](cells[name]).over(own) for k, (name, (kind, _)) in enumerate(values.items())})
    out = _met(out, carried, by, "left")
    return out.withColumns({name: _JOIN[kind](F.col(f"_c{k}"), F.col(f"_o{k}")) for k, (name, (kind, _)) in enumerate(values.items())}).select(*rows.columns, *values)


def running(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the group up to and with this one."""
    return prefix(rows, by, order, {name: ("sum", value.cast("long"))})


def frames(rows: DataFrame, by: list[str], order: list[Column], behind: int, columns: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """``rows`` with the columns that ``columns`` makes from a window, looking at most ``behind`` rows back."""
    if not large(rows, by):
        return rows.withColumns(columns(Window.partitionBy(*by).orderBy(*order)))
    own = Window.partitionBy(*by, "_part")
    dealt = _dealt(rows, by, order)
    pieces = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy(*by).orderBy("_part")
    pieces = pieces.withColumn("_before", F.sum("_rows").over(along) - F.col("_rows"))
    # every range has a row at least, so none of more than ``behind`` ranges on is reached
    pieces = pieces.withColumn("_next", F.collect_list(F.struct("_part", "_before")).over(along.rowsBetween(1, behind)))
    numbered = _met(dealt.withColumn("_i", F.row_number().over(own.orderBy(*order))), pieces, by, "inner")
    tails = numbered.where(F.col("_i") > F.col("_rows") - behind).withColumn("_at", F.col("_before") + F.col("_i"))
    tails = tails.withColumn("_to", F.explode(F.filter("_next", lambda x: x["_before"] - F.col("_at") < behind)))
    halo = tails.select(*rows.columns, F.col("_to._part").alias("_part"), F.lit(True).alias("_halo"))
    both = dealt.withColumn("_halo", F.lit(False)).unionByName(halo)
    return both.withColumns(columns(own.orderBy(*order))).where("not _halo").drop("_halo", "_part")


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group with their number ``name`` (from 1)."""
    return running(rows, by, order, F.lit(1), name).where(F.col(name) <= n)
