"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, exact_dedup, html_text, language, mixing, ngram_join, packing, quality, resample, sharding, vector_packing
from .common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_rotated_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="max")


#: A conversation whose texts are control strings of a template.
CONTROL_CASE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = spark.createDataFrame(CONTROL_CASE, "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(case)
    tree = chat.linear_tree(rows)
    return chat.read_back(chat.format_paths(tree, chat.best_paths(tree)))


def quality_model(spark: SparkSession, sf_dir: str):
    """Learned from labelled rows outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").where(quality.fold("doc_id", 4) != 2)
    return quality.fit(read(spark, sf_dir, "documents"), labels)


#: Documents that score lower are rejected.
QUALITY_THRESHOLD = 0.7


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality_model(spark, sf_dir)).select(
        "doc_id", (quality.fold("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = quality.fold("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair_mix(read(spark, sf_dir, "documents"), mixing.WEIGHTS, block_rows=mixing.BLOCK_ROWS)


def op10_recurrent_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op11_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return resample.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return alignment.align_corpus(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return vector_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_rotated_code_search": op3_rotated_code_search,
    "op4_histogram_sharding": op4_histogram_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_reply_tree_chat": op6_reply_tree_chat,
    "op7_rule_quality": op7_rule_quality,
    "op8_language_id": op8_language_id,
    "op9_pfair_mixing": op9_pfair_mixing,
    "op10_recurrent_html": op10_recurrent_html,
    "op11_prefix_crc_resampling": op11_prefix_crc_resampling,
    "op12_lockstep_alignment": op12_lockstep_alignment,
    "op13_vector_best_fit": op13_vector_best_fit,
}
ORACLES = {"op2_ngram_join": ngram_join.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op9_pfair_mixing": mixing.ORACLE, "op11_prefix_crc_resampling": resample.ORACLE}
