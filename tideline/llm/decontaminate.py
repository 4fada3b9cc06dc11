"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document if at least ``threshold`` of the item's distinct word shingles occur in it. Sketches come
from the items' side, so a long document costs nothing in recall: of an item with q shingles at most q - ceil(threshold * q)
may be missing, so one of its q - ceil(threshold * q) + 1 smallest hashes must occur in any document that contains it.
Items are partitioned by size (powers of two); each partition has its own sketch table, and documents with too few shingles
for a partition are left out of it. A hit makes a candidate, which is then verified on the words themselves. An item of fewer
than ``n`` words counts as one shingle, its whole sequence of words, and is looked for among the documents' word runs of that width.

Items come to the executors in blocks of bounded size (``BLOCK_BYTES`` of text), each block meeting all documents in one
scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textops as T
from .common import require
from .features import Spaced, as_arrow, spaced, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20
#: Words: letters and digits, and all beyond ASCII, after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def shingles(text: bytes | None, n: int = SHINGLE) -> set[bytes]:
    words = WORD.findall((text or b"").lower())
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def item_shingles(text: bytes, n: int = SHINGLE) -> tuple[int, set[bytes]]:
    """The width of an item's shingles, n or all its words if there are fewer, and the shingles; without a word 0 and none."""
    width = min(n, len(WORD.findall(text.lower())))
    return width, shingles(text, width) if width else set()


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of a block."""
    text = spaced(T.LOWER[data], offsets)
    clean = np.where(T.WORDISH[text.data], text.data, np.uint8(32))
    starts, ends, owner = word_spans(Spaced(clean, text.starts, text.ends), T.WORDISH)
    return T.Spans(clean).hash(starts, ends), owner


@dataclass
class Partition:
    """The sketches of the items of one size class and width of shingles."""

    width: int
    least: int  # a document needs so many shingles
    hashes: np.ndarray  # sorted
    items: np.ndarray  # the item of each
    filter: np.ndarray  # one bit of a hash's top bits
    bits: int


@dataclass
class Items:
    ids: list
    texts: list[bytes]
    widths: list[int]
    sets: list[set[bytes]]
    needed: np.ndarray
    partitions: list[Partition]


def sketch(rows: list[tuple[object, bytes]], threshold: float, n: int = SHINGLE) -> Items:
    """Sketch tables of items; those without a word match nothing."""
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    made = [item_shingles(t, n) for t in texts]
    widths, sets = [w for w, _ in made], [s for _, s in made]
    needed = np.array([int(np.ceil(threshold * len(s) - 1e-9)) for s in sets], np.int64)
    by_item: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for at, count, data, offsets in T.blocks(as_arrow(texts)):
        words, of = word_rows(data, offsets)
        for width in sorted({w for w in widths[at : at + count] if w}):
            hashes, owner = T.word_ngrams(words, of, width)
            first = np.searchsorted(owner, np.arange(count + 1))
            for k in range(count):
                if widths[at + k] == width:
                    own = np.unique(hashes[first[k] : first[k + 1]])
                    miss = len(own) - int(np.ceil(threshold * len(own) - 1e-9))
                    by_item.setdefault((width, len(own).bit_length()), []).append((at + k, own[: miss + 1]))
    partitions = []
    for (width, size_class), members in sorted(by_item.items()):
        hashes = np.concatenate([h for _, h in members])
        items = np.repeat([k for k, _ in members], [len(h) for _, h in members])
        order = np.argsort(hashes, kind="stable")
        bits = max(16, int(len(hashes)).bit_length() + 4)
        marked = np.zeros(1 << bits, bool)
        marked[hashes >> np.uint64(64 - bits)] = True
        partitions.append(Partition(width, int(np.ceil(threshold * (1 << (size_class - 1)) - 1e-9)), hashes[order], items[order], marked, bits))
    return Items(ids, texts, widths, sets, needed, partitions)


def candidates(found: Items, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct (text, item) pairs that share a sketch hash."""
    words, of = word_rows(data, offsets)
    out, last = [], 0
    for p in found.partitions:  # ordered by width
        if p.width != last:
            last, (hashes, owner) = p.width, T.word_ngrams(words, of, p.width)
            count = np.bincount(owner, minlength=len(offsets) - 1)
        hit = np.flatnonzero(p.filter[hashes >> np.uint64(64 - p.bits)])
        hit = hit[count[owner[hit]] >= p.least]
        lo, hi = np.searchsorted(p.hashes, hashes[hit]), np.searchsorted(p.hashes, hashes[hit], side="right")
        several = hi - lo
        at = np.repeat(lo, several) + np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        out.append(np.stack([np.repeat(owner[hit], several), p.items[at]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def contained(found: Items, data: np.ndarray, offsets: np.ndarray, first_only: bool = False) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of every pair that passes the exact test."""
    out, last, done = [], -1, False
    own: dict[int, set[bytes]] = {}  # of the text, by width
    for row, item in candidates(found, data, offsets).tolist():
        if row != last:
            last, own, done = row, {}, False
        if not (done and first_only):
            width = found.widths[item]
            if width not in own:
                own[width] = shingles(data[offsets[row] : offsets[row + 1]].tobytes(), width)
            shared = sum(s in own[width] for s in found.sets[item])
            if shared >= found.needed[item]:
                out.append((row, item, shared))
                done = True
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, threshold: float, n: int) -> Iterator[Broadcast]:
    """The items' sketches, block by block; a block has about BLOCK_BYTES of text, whatever the size of the table."""
    require(items, id_col, text_col)
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k).collect()
        yield items.sparkSession.sparkContext.broadcast(sketch(sorted(((r["id"], bytes(r["t"] or b"")) for r in part), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1])), threshold, n))


def contamination(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each (document row, item row) with containment >= threshold: ids, n_shared, n_item, containment.

    Null texts and texts without a word contain nothing and are contained in nothing. An item under ``n`` words is one shingle,
    its whole sequence of words, and is contained where a document holds this run of words.
    Repeated rows give repeated results; null ids on either side come back as null. An empty table on either side gives an empty
    result. Columns other than the two of each side are ignored.
    """
    require(docs, id_col, text_col)
    names = [id_col, item_col, "n_shared", "n_item", "containment"]
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    ddl = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, n_shared long, n_item long, containment double"
    item_type = to_arrow_type(items.schema[item_col].dataType)
    source = docs.select(id_col, F.col(text_col).cast("binary").alias("__text"))
    parts = []
    for shared in item_blocks(items, item_col, item_text_col, threshold, n):

        def scan(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            found = shared.value
            for batch in batches:
                for at, _, data, offsets in T.blocks(batch.column(1)):
                    hits = contained(found, data, offsets)
                    if hits:
                        size = [len(found.sets[i]) for _, i, _ in hits]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array([at + r for r, _, _ in hits])), pa.array([found.ids[i] for _, i, _ in hits], item_type),
                                pa.array([s for _, _, s in hits]), pa.array(size), pa.array([s / q for (_, _, s), q in zip(hits, size, strict=True)]),
                            ],
                            names=names,
                        )

        parts.append(source.mapInArrow(scan, ddl))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns kept, without a shuffle. Null texts contain nothing; rows with equal
    or null ids are judged each by itself; an empty table comes back empty, and with no items every row stays."""
    require(docs, text_col)
    at_col = docs.columns.index(text_col)
    for shared in item_blocks(items, item_col, item_text_col, threshold, n):

        def scan(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, _, data, offsets in T.blocks(batch.column(at_col)):
                    clean[[at + r for r, _, _ in contained(shared.value, data, offsets, first_only=True)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
