"""Hashed features shared by the classifiers, and the bounded sample of labelled rows that they learn from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T

#: Spaces before each text and after the last one, so that n-grams see where a text starts and ends.
GAP = 2


@dataclass
class Spaced:
    """Texts in one buffer, each between spaces; text k is data[starts[k]:ends[k]]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def spaced(data: np.ndarray, offsets: np.ndarray) -> Spaced:
    n = len(offsets) - 1
    shift = GAP * (np.arange(n) + 1)
    starts, ends = offsets[:-1] + shift, offsets[1:] + shift
    out = np.full(len(data) + GAP * (n + 1) + 8, 32, np.uint8)
    for a, b, s in zip(offsets[:-1].tolist(), offsets[1:].tolist(), starts.tolist(), strict=True):
        out[s : s + b - a] = data[a:b]
    return Spaced(out, starts, ends)


def buckets(values: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((values * np.uint64(T.ODD)) >> np.uint64(64 - bits)).astype(np.int64)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] (rows); the same for a text whatever stands around it."""
    shape = (len(starts), *values.shape[1:])
    full = ends > starts
    if not full.any():
        return np.zeros(shape)
    cuts = np.stack([starts[full], ends[full]], 1).ravel()
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
    out = np.zeros(shape)
    out[full] = np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
    return out


def trigram_buckets(text: Spaced, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket at each position, first and end position of each text): one trigram for each byte, boundaries included."""
    return buckets(T.byte_ngrams(text.data, 3) + np.uint64(1), bits), text.starts - 1, np.where(text.ends > text.starts, text.ends - 1, text.starts - 1)


def word_spans(text: Spaced, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, owners) of maximal runs of bytes that ``table`` marks."""
    mask = table[text.data]
    edge = np.diff(mask.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    return starts, ends, np.searchsorted(text.starts, starts, side="right") - 1


#: A label's rows are dealt to so many parts before the first ones are taken, so that no task sees all of a label.
PARTS = 16


def first_of_each(rows: DataFrame, label_cols: list[str], per_label: int, id_col: str) -> DataFrame:
    """At most ``per_label`` rows of each combination of labels: of each of PARTS parts by a hash of the id, the first by another.

    Row numbers up to a small bound are cut down in every task before the shuffle (WindowGroupLimit)."""
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), F.lit(PARTS))
    order = Window.partitionBy(*label_cols, "__part").orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    numbered = rows.withColumn("__part", part).withColumn("__at", F.row_number().over(order))
    return numbered.where(F.col("__at") <= max(1, per_label // PARTS)).drop("__at", "__part")


def labelled_sample(
    docs: DataFrame, label: Column, where: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 20_000,
) -> list[tuple[bytes, object]]:
    """At most ``per_class`` (text, label) rows of each label, chosen by hashes of the id among those that ``where`` admits and
    whose text has at most ``max_bytes``; the bound holds at any size of the table."""
    rows = docs.where(where & label.isNotNull() & (F.coalesce(F.octet_length(text_col), F.lit(0)) <= max_bytes))
    ids = first_of_each(rows.select(F.col(id_col).alias("__id"), label.alias("__y")), ["__y"], per_class, "__id")
    # at most per_class ids of each label
    found = rows.join(F.broadcast(ids.select("__id").distinct()), rows[id_col] == F.col("__id")).select(F.col(text_col).cast("binary"), label)
    return sorted(((bytes(t or b""), y) for t, y in found.toLocalIterator()), key=lambda x: (str(x[1]), x[0]))


def with_labels(docs: DataFrame, labels: DataFrame, where: Column, per_class: int, label_cols: list[str], id_col: str = "doc_id") -> DataFrame:
    """``docs`` rows joined to a bounded choice of label rows: at most ``per_class`` of each combination of labels."""
    keyed = labels.where(where).select(id_col, *label_cols).dropna(subset=label_cols)
    return docs.drop(*label_cols).join(F.broadcast(first_of_each(keyed, label_cols, per_class, id_col)), id_col)


def as_arrow(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary())
