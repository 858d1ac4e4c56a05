"""The operators' queries and oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filelake.llm.additive_search import op13_additive_search
from filelake.llm.bpe_codec import op6_bpe_codec
from filelake.llm.centroids import OP11_SQL, op11_centroids
from filelake.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from filelake.llm.impact_search import OP9_SQL, op9_impact_search
from filelake.llm.lm_scoring import op1_lm_scoring
from filelake.llm.packing import op10_packing
from filelake.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from filelake.llm.rule_quality import op4_rule_quality
from filelake.llm.sharding import OP7_SQL, op7_sharding
from filelake.llm.simhash import op5_simhash
from filelake.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from filelake.llm.token_counts import op8_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_exact_dedup, op3_substring_dedup, op4_rule_quality, op5_simhash, op6_bpe_codec, op7_sharding, op8_token_counts, op9_impact_search, op10_packing,
              op11_centroids, op12_periodic_runs, op13_additive_search)
}

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op7_sharding": OP7_SQL, "op9_impact_search": OP9_SQL, "op11_centroids": OP11_SQL, "op12_periodic_runs": OP12_SQL}
