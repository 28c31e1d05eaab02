"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from symlake.llm import bpe, collocation, decontam, lexical, media, oddsketch, packing, patricia, sharding, suffix, toxicity, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [toxicity.op1_nnpu_toxicity, media.op2_signature_sniffing, sharding.op3_rendezvous_sharding, bpe.op4_bpe_round_trip, suffix.op5_suffix_array_dedup, oddsketch.op6_minhash_near_dedup, patricia.op7_exact_dedup, warc.op8_warc_transactions, packing.op9_best_two_fit_packing, urlfilter.op10_temporal_url_filter, lexical.op11_ranked_lexical_search, collocation.op12_phrase_collocation_mining, decontam.op13_benchmark_decontamination]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op2_signature_sniffing": media.sql(), "op3_rendezvous_sharding": sharding.SQL, "op5_suffix_array_dedup": suffix.SQL, "op6_minhash_near_dedup": oddsketch.SQL, "op7_exact_dedup": patricia.SQL, "op8_warc_transactions": warc.SQL, "op10_temporal_url_filter": urlfilter.SQL, "op11_ranked_lexical_search": lexical.SQL, "op12_phrase_collocation_mining": collocation.SQL, "op13_benchmark_decontamination": decontam.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
