"""Destinations and collision-free names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.functions import columns as C
from filelake.functions.fixed import FOLDER_PATTERNS
from filelake.operators.ranking import running
from filelake.session import materialize


def folder(date: Column, pattern: str) -> Column:
    return F.date_format(date, FOLDER_PATTERNS[pattern])


def destination(target: str, date: Column, pattern: str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(target.rstrip("/")), folder(date, pattern), name)


def folders_created(rows: DataFrame, by: list[str], date: str, pattern: str) -> DataFrame:
    """How many folders of the pattern each group's dates fall into."""
    return rows.groupBy(*by).agg(F.count_distinct(folder(F.col(date), pattern)).alias("folders"))


def place(incoming: DataFrame, existing: DataFrame, form: str = "({})", always: bool = False) -> DataFrame:
    """Adds final_name to (dir, name, path): the first free number of each name, in path order.

    ``existing`` is (dir, name) on disk. A name nobody holds goes to its first file bare unless
    ``always``. Names that incoming files take bare count as held, so a literal ``a(1).jpg``
    never meets a numbered ``a.jpg``; two numbered names differ because a name parses in one way.

    Names are parsed once into stem, number and extension and meet on (dir, stem, extension).
    The r-th free number is r plus the held numbers n at place j with n - j < r, a running count
    over both; neither a name nor a folder with very many files gathers in one task.
    """
    before, after = form.split("{}")
    held = existing.select("dir", "name").distinct()
    ranked = running(incoming, ["dir", "name"], [F.col("path")], F.lit(1), "_rank").join(held.withColumn("_held", F.lit(True)), ["dir", "name"], "left")
    bare = F.lit(0) if always else F.when(F.col("_held").isNull(), 1).otherwise(0)
    ranked = materialize(ranked.withColumn("_need", F.col("_rank") - bare).drop("_rank", "_held"), "ranked")  # met four times
    first = ranked.where("_need = 0").drop("_need").withColumn("final_name", F.col("name"))
    asked = ranked.where("_need > 0").withColumns({"_stem": C.stem(F.col("name")), "_ext": C.suffix_of(F.col("name"))})
    if not always:
        held = held.union(incoming.select("dir", "name")).distinct()
    taken = held.withColumns({"_whole": C.stem(F.col("name")), "_ext": C.suffix_of(F.col("name"))})
    pattern = f"(?s)^(.+){re.escape(before)}([1-9][0-9]{{0,8}}){re.escape(after)}$"
    taken = taken.where(F.col("_whole").rlike(pattern)).withColumns({"_stem": F.regexp_extract("_whole", pattern, 1), "_n": F.regexp_extract("_whole", pattern, 2).cast("int")})
    taken = materialize(taken.join(asked.select("dir", "_stem", "_ext").distinct(), ["dir", "_stem", "_ext"], "left_semi"), "taken")
    taken = running(taken, ["dir", "_stem", "_ext"], [F.col("_n")], F.lit(1), "_place")
    taken = taken.select("dir", "_stem", "_ext", (F.col("_n") - F.col("_place")).cast("long").alias("_need"), F.lit(1).alias("_kind"), F.col("_n").alias("_tie"))
    both = asked.withColumns({"_kind": F.lit(0), "_tie": F.lit(0)}).unionByName(taken, allowMissingColumns=True)
    both = running(both, ["dir", "_stem", "_ext"], [F.col("_need"), F.col("_kind"), F.col("_tie")], F.col("_kind"), "_passed").where("_kind = 0")
    numbered = both.withColumn("final_name", F.concat("_stem", F.lit(before), (F.col("_need") + F.col("_passed")).cast("string"), F.lit(after), "_ext"))
    return first.unionByName(numbered.select(*first.columns))
