"""The queries of this package, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hmm, langid, minhash, mixing, packing, pq, recipes, tokenfile, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov_lm": hmm.op1_hidden_markov_lm,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_exact_dedup": recipes.op3_exact_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filter": urls.op5_url_filter,
    "op6_language_id": langid.op6_language_id,
    "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
    "op8_token_file": tokenfile.op8_token_file,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_embedding_near_dedup": pq.op10_embedding_near_dedup,
}
ORACLES: dict[str, str] = {"op3_exact_dedup": recipes.OP3_SQL, "op7_minhash_near_dedup": minhash.OP7_SQL, "op10_embedding_near_dedup": pq.OP10_SQL}
