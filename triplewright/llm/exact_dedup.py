"""Exact dedup by skew-safe combining, in DataFrame operations only.

Three combining steps, each grouping by the full content beside its digest:

1. locally: the map-side half of the first aggregation leaves one row per text and task;
2. salted: those rows meet per (digest, salt, text), so a group of copies is dealt over ``salts`` tasks;
3. globally: at most ``salts`` winners per text are combined into one.

Rows are then matched to their winner by digest: the fewer than ``LARGE_SHARE`` groups that each hold more
than one part in ``LARGE_SHARE`` of all rows are broadcast, the others joined by shuffle, so no group of
copies meets in one task. Digests that two different texts share (none is known for SHA-256) are matched by
content on a path of their own, so content decides there as well.

Defined results: a null text counts as empty; null ids lose to any id; rows that repeat both id and text
are members of their group each, and ``drop_copies`` keeps one of them (of a null and an empty text under one id,
the empty one); a very long text is compared whole and shuffled at most twice; an empty table gives an empty
table; extra columns are carried by ``drop_copies`` under any name and ignored by ``exact_groups``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.llm.common import materialize, whole

SALTS = 16
LARGE_SHARE = 1000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _winners(keyed: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    salted = keyed.withColumn("salt", F.spark_partition_id() % salts)
    by_salt = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_text = by_salt.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return by_text.select("digest", "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest id among equal texts), group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    winners = materialize(_winners(keyed, salts), "dedup-winners")
    rows = keyed.select("doc_id", "digest")
    total = winners.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    large = F.broadcast(winners.where(F.col("group_size") > total // LARGE_SHARE))  # fewer than LARGE_SHARE rows
    small = winners.where(F.col("group_size") <= total // LARGE_SHARE)
    parts = [rows.join(large, "digest"), rows.join(large, "digest", "left_anti").join(small, "digest")]
    shared = winners.groupBy("digest").count().where("count > 1").select("digest")
    if not shared.isEmpty():  # two texts with one digest: content decides
        clash = keyed.join(shared, "digest", "left_semi")
        groups = clash.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        parts = [p.join(shared, "digest", "left_anti") for p in parts] + [clash.join(groups, ["digest", "text"])]
    found = reduce(DataFrame.unionByName, [p.select("digest", F.col("doc_id"), "keep_id", "group_size") for p in parts])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _match(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row for each distinct text, that of the largest id; all columns stay as they were.

    Winners are matched on id and digest. Rows that repeat a winning id and text are cut to one by a
    ``row_number`` over only those ids that occur more than once, so other rows aren't shuffled for it.
    """
    keyed = _keyed(docs, id_col, text_col)
    won = materialize(_winners(keyed, salts).select(F.col("digest").alias("_tw_digest"), F.col("keep_id").alias("_tw_keep")), "dedup-kept")
    digest = F.unhex(F.sha2(whole(docs[text_col]), 256))
    kept = docs.join(won, (digest == won["_tw_digest"]) & _match(docs[id_col], won["_tw_keep"]), "left_semi")
    often = docs.groupBy(F.col(id_col).alias("_tw_id")).count().where("count > 1").select("_tw_id")
    once = kept.join(often, _match(kept[id_col], often["_tw_id"]), "left_anti")
    again = kept.join(often, _match(kept[id_col], often["_tw_id"]), "left_semi")
    order = Window.partitionBy(id_col, whole(text_col)).orderBy(F.col(text_col).asc_nulls_last())
    again = again.withColumn("_tw_nth", F.row_number().over(order)).where("_tw_nth = 1").drop("_tw_nth")
    return once.unionByName(again)
