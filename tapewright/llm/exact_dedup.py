"""Exact dedup: 128-bit content hash, stable representative, bytes compared.

DataFrame functions only. Texts are grouped by their MD5 (128 bits) and by the
text itself, so rows are put together only when their bytes are equal: a hash
collision gives two groups. The grouping aggregates before its shuffle; a group
of copies with a third of all rows sends one row per task. The way back to the
rows joins on the MD5 and the SHA-256, without texts; the rows of a digest are dealt to
salted parts by their places in the table, so that no key holds all copies of a text.

Null texts count as empty. Rows that repeat both id and text come back as often
as they are given, as in the SQL, and count in group_size. A null id is kept only if its whole
group has no other id. An empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    `keep` names the row that stays of equal texts: that with the smallest
    ("min") or largest ("max") id.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_h", F.md5("_text"))
    groups = (
        rows.groupBy("_h", "_text")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    ids = rows.select("_id", "_h", F.sha2("_text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_place"))
    return join_hot(ids, groups, ["_h", "text_sha256"], "_place", how="inner").select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one per group of equal texts.

    The same grouping with the whole rows in the aggregate, so nothing is joined
    back and of repeated rows one stays. A kept null text stays null.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rest = [c for c in docs.columns if c != id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).isNotNull().cast("int").alias("_has") if keep == "max" else F.col(id_col).isNull().cast("int").alias("_has"),
                   id_col, *(c for c in rest if c != text_col), F.col(text_col).isNull().alias("_null"))
    groups = docs.groupBy(F.md5(text).alias("_h"), text.alias("_text")).agg(best(row).alias("_row"))
    back = {c: F.col("_row")[c] for c in docs.columns if c != text_col} | {text_col: F.when(~F.col("_row")["_null"], F.col("_text"))}
    return groups.select(*(back[c].alias(c) for c in docs.columns))


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
