"""One query per operator with its production parameters, and the DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import exact, gridjoin, lines, mixing, packing, partenum, pii, quality, secrets, spelling, tokenfile, toxicity, trie
from tallyspark.llm.common import documents
from tallyspark.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_robust_outliers": lambda spark, folder: quality.report(quality.judged(documents(spark, folder))),
    "op2_toxicity_chain": lambda spark, folder: toxicity.classify(
        documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")),
    "op3_exact_dedup": lambda spark, folder: exact.exact_dedup(documents(spark, folder)),
    "op4_partenum_join": lambda spark, folder: partenum.report(partenum.jaccard_join(documents(spark, folder))),
    "op5_sanitise": lambda spark, folder: pii.report(pii.sanitise(documents(spark, folder))),
    "op6_pack": lambda spark, folder: packing.pack(documents(spark, folder), tokenizer_path()),
    "op7_token_file": lambda spark, folder: tokenfile.token_file_round_trip(documents(spark, folder), tokenizer_path()),
    "op8_line_dedup": lambda spark, folder: lines.dedup_lines(documents(spark, folder)),
    "op9_secrets": lambda spark, folder: secrets.report(secrets.scan_secrets(documents(spark, folder))),
    "op10_mix_sources": lambda spark, folder: mixing.mix(documents(spark, folder)),
    "op11_grid_order_join": lambda spark, folder: gridjoin.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet")),
    "op12_spelling_variants": lambda spark, folder: spelling.variants(documents(spark, folder)),
    "op13_prefix_trie": lambda spark, folder: trie.report(trie.build(spark.read.parquet(f"{folder}/conversations.parquet"))),
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": exact.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op11_grid_order_join": gridjoin.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
