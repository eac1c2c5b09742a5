"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so, so equal stretches give equal chunks wherever they stand. Chunks are deduplicated to
identifiers that a second fingerprint verifies, and texts are compared as ordered lists of identifiers: eight bytes for about a
thousand characters are shuffled, and a text itself never leaves the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stash, ascii_lower, join_small, read

#: A chunk ends after at least LEAST characters at a consonant, a vowel and a space; at MOST characters if there is none.
LEAST, MOST = 700, 8192
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?[bcdfghklmpvwz][aeiou] |.{{1,{MOST}}}"


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, and per chunk its identifier and fingerprint. Null texts count as empty; an empty text has no chunks."""
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    seen = cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"), F.transform("chunks", lambda c: F.xxhash64(F.sha2(c.cast("binary"), 256))).alias("prints"))
    return seen


def chunk_table(recipe: DataFrame) -> DataFrame:
    """One row for each chunk identifier: occurrences, and whether all of them have one fingerprint."""
    each = recipe.select(F.explode(F.arrays_zip("ids", "prints")).alias("c")).select("c.ids", "c.prints")
    return each.groupBy("ids").agg(F.count("*").alias("occurrences"), (F.min("prints") == F.max("prints")).alias("verified")).withColumnRenamed("ids", "chunk_id")


def exact_duplicates(docs: DataFrame, stash: Stash | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the largest doc_id
    stays (a null doc_id only if the whole group has none; of rows that repeat a doc_id all are marked kept). An empty table gives
    an empty result; columns besides doc_id and text are ignored, whatever their names."""
    stash = stash or Stash(docs.sparkSession)
    base = stash.keep(recipes(docs.select("doc_id", "text")), "recipes")
    verified = chunk_table(base).where("not verified").isEmpty()
    # Where two chunks share an identifier, every list gets its fingerprints too, which tells them apart.
    listed = F.col("ids") if verified else F.concat("ids", "prints")
    base = base.select("doc_id", "text_sha256", listed.alias("ids"), F.xxhash64(listed).alias("h"))
    groups = base.groupBy("h", "ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stash.keep(groups, "groups")
    found = join_small(base.withColumn("own", F.col("doc_id")).drop("doc_id"), groups, ["h", "ids"])
    own = F.col("own")
    keep = F.when(F.col("group_size").isNull(), own).otherwise(F.col("keep_id"))
    return found.select(own.alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), own.eqNullSafe(keep).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
