"""Exact deduplication by a distributed content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised text (its leading characters, then a content hash, so that
splitters stay short and shared openings do not pile up), an external sort puts equal texts next to each other,
and a window over the sorted run compares neighbours in full and picks the row that stays.

A text with very many copies would make one run that no splitter can cut. Such texts are found first by counting
content hashes (pre-aggregated, 8 bytes a text) and their copies get a salt from the row id, so a run is cut into
pieces; the pieces' survivors, one row for each piece, are merged afterwards. There are at most
``PIECES * partitions`` hot hashes, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, require

PREFIX = 32
PIECES = 4
LEAST_HOT = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` is "max" or "min", the id
    that stays in a group. Rows with one id twice are one group member each and both carry ``kept`` if that id stays.
    An empty table gives an empty result. Other columns are ignored. A null id never stays unless its whole group has
    null ids.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    n_parts = partitions(spark, docs)
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.select("id", "norm", F.xxhash64("norm").alias("h"))

    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = docs.count()
    bound = max(LEAST_HOT, -(-total // (PIECES * n_parts)))
    hot = counts.where(F.col("n") > bound).select("h", F.ceil(F.col("n") / bound).cast("int").alias("pieces"))

    # hot has at most total / bound <= PIECES * n_parts rows of 12 bytes
    salted = rows.join(F.broadcast(hot), "h", "left").select(
        "id", "norm", "h", F.substring("norm", 1, PREFIX).alias("lead"),
        F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(-1)).alias("piece"),
    )
    dealt = salted.repartitionByRange(n_parts, "lead", "h", "piece")

    best = F.max("id") if keep == "max" else F.min("id")
    run = Window.partitionBy("lead", "h", "piece", "norm")
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    runs = dealt.select(
        "id", "h", "piece", best.over(run).alias("keep_id"), F.count("*").over(run).alias("group_size"),
        F.row_number().over(run.orderBy(order)).alias("place"), F.sha2("norm", 256).alias("text_sha256"),
    )

    # The pieces of a hot text: one row for each piece and text, so PIECES * n_parts * pieces short rows at most.
    merged = (
        runs.where((F.col("piece") >= 0) & (F.col("place") == 1))
        .groupBy("h", "text_sha256")
        .agg((F.max if keep == "max" else F.min)("keep_id").alias("whole_id"), F.sum("group_size").alias("whole_size"))
    )
    return merge_pieces(runs, merged, id_col)


def merge_pieces(runs: DataFrame, merged: DataFrame, id_col: str) -> DataFrame:
    whole = runs.join(F.broadcast(merged), ["h", "text_sha256"], "left")
    keep_id = F.when(F.col("piece") >= 0, F.col("whole_id")).otherwise(F.col("keep_id"))
    size = F.when(F.col("piece") >= 0, F.col("whole_size")).otherwise(F.col("group_size"))
    return whole.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), size.cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep_id, keep_id.isNull()).alias("kept"), "text_sha256",
    )
