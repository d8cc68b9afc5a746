"""From documents to packed training sequences, in five stages.

1. quality      drops documents that the rule ensemble scores below 0.7
2. exact_dedup  keeps, of equal texts, the row with the largest doc_id
3. near_dedup   keeps, of each component of similar texts, the smallest doc_id
4. mix          orders all rows by the Pfair schedule of their sources: nothing
                is lost, and the rows are stored in the order of the mix, in
                which every source keeps its target share to less than a block
                for as long as it lasts
5. pack         packs the token ids into sequences of 4096, in the stored order:
                each class of pieces is filled by position, and sequences are
                numbered by the first position they hold

Each stage gets (spark, docs, sf_dir) with the rows that its predecessor kept,
and returns the columns of `docs`, but for the last, which returns the pieces.
Rows without id pass the first three stages by their texts alone and are packed
under a null id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import entries, exact_dedup, mixing, ngram_join, packing, quality
from tapewright.llm.common import read, written
from tapewright.sources.scratch import release, tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(quality.fold("doc_id", 4) != 2)
    model = quality.fit(docs, labels)
    return quality.scored(docs, model, out="_score").where(F.col("_score") >= entries.QUALITY_THRESHOLD).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs, keep="max")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_components(docs)
    stays = F.max(F.col("doc_id") == F.col("component_id"))  # an id that repeats stays if one of its texts does
    dropped = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(stays.alias("_stays")).where("NOT _stays").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.pfair_mix(docs, mixing.WEIGHTS, block_rows=mixing.BLOCK_ROWS)
    order = placed.groupBy(F.col("doc_id").alias("_id")).agg(F.min("position").alias("_position"))
    return docs.join(order, docs["doc_id"].eqNullSafe(F.col("_id"))).orderBy("_position").select(*docs.columns)


def stored_positions(docs: DataFrame) -> DataFrame:
    """`docs` with `_position`, the place of each row in the order its table was written in.

    A written table's files are named in the order of their parts, and Spark gives
    each row's place in its file. Rows that come from no files count as they come.
    """
    try:
        stored = docs.metadataColumn("_metadata")
        rows = docs.select("*", stored["file_name"].alias("_file"), stored["row_index"].alias("_row"))
        rows.schema  # noqa: B018  (resolves the names)
    except AnalysisException:
        return docs.withColumn("_position", F.monotonically_increasing_id())
    starts, at = [], 0
    for name, n in sorted(rows.groupBy("_file").agg(F.max("_row") + 1).collect()):
        starts.append((name, at))
        at += n
    first = docs.sparkSession.createDataFrame(starts, "_file string, _start long")
    return rows.join(F.broadcast(first), "_file").select(*docs.columns, (F.col("_start") + F.col("_row")).alias("_position"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(stored_positions(docs), entries.tokenizer_path(), order_col="_position").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: The first stage scores by a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again, and what they were made of is dropped."""
    docs, before = read(spark, sf_dir, "documents"), tables(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
