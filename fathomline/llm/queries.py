"""Queries of the problems, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import ann, clusters, packing, provenance, quality, splitting, tokens
from fathomline.llm.oracle import ORACLE as ORACLE

#: Where the public tokenizers' files lie; a parameter of the operators.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
#: Tokens of a container.
CAPACITY = 2048
#: Bytes of an item's largest piece, and bytes that neighbours share.
MOST_BYTES, OVERLAP_BYTES = 8192, 256
DIMENSION, NEIGHBOURS, SIMILAR = 64, 5, 0.85


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "vectors").select("id", "data")
    return clusters.isolated_cliques(*clusters.clusters(vectors, DIMENSION, SIMILAR, compare=False), vectors=vectors, dim=DIMENSION, threshold=SIMILAR)


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    nodes, assignment, _ = clusters.clusters(table(spark, d, "vectors").select("id", "data"), DIMENSION, SIMILAR)
    return clusters.cluster_summary(nodes, assignment)


def slices(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_slices(table(spark, d, "documents"), table(spark, d, "embed_sources"), table(spark, d, "lang_names"), BYTE_BPE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return slices(spark, d).select("doc_id", "source", "lang", "domain")


def p2_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(slices(spark, d))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    functions = table(spark, d, "function_defs").select(
        F.lit("function").alias("item_kind"), F.col("def_id").alias("item_id"), "filepath", "begin_pos", "end_pos"
    )
    sources = table(spark, d, "embed_sources").select(
        F.lit("source").alias("item_kind"), F.col("source_id").alias("item_id"), "filepath",
        F.col("subset.start_pos").alias("begin_pos"), F.col("subset.end_pos").alias("end_pos"),
    )
    ends = table(spark, d, "function_defs").where("begin_pos is null or begin_pos < end_pos")
    return splitting.split_oversized(functions.unionByName(sources), table(spark, d, "documents"), MOST_BYTES, OVERLAP_BYTES, ends)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece = 0").select("item_kind", "item_id").distinct()


def not_hand_written(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "documents").where("doc_kind = 'code'")
    return provenance.not_hand_written(code, table(spark, d, "upstream_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return not_hand_written(spark, d).select("doc_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return not_hand_written(spark, d)


def nearest(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "query_log").select(F.col("query_id").alias("id"), F.col("embedding").alias("data"))
    return ann.nearest(table(spark, d, "vectors").select("id", "data"), probes, DIMENSION, NEIGHBOURS, SIMILAR)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ann.neighbour_pairs(nearest(spark, d))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), BYTE_BPE)


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from the ids."""
    return tokens.decode_corpus(p7_ids(spark, d), BYTE_BPE)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_sizes(table(spark, d, "documents"), BYTE_BPE), CAPACITY)


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents").where("doc_kind = 'text'"), table(spark, d, "common_words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.mostly_not_prose(p9_statistics(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_clusters, p2_found, p2_budget, p4_pieces, p4_found, p5_found, p5_reasons, p6_found, p6_nearest, p7_ids, p7_texts, p8_containers, p9_statistics, p9_found,
    )
}
