"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits falls into two segments of 32. If two fingerprints differ in at most ``RADIUS`` = 4 bits, some
segment differs in at most 2. Every fingerprint is stored in its segments' tables under each point of the Hamming ball of
radius 1 around the segment (33 points) and looked up under the same points, so two segments meet exactly if their balls do,
that is at 2 bits or fewer; complete distances are then verified. That is 66 short rows for each *distinct* fingerprint.

Segments that very many fingerprints share would make entries that no task can hold. They are found by counting; the entries in
their balls are cut by the other segment: two fingerprints at 4 bits or fewer agree in one of five pieces of it, so each row goes
to five parts of its entry.

The rows of one table entry come sorted and are read as a stream. A small entry is compared pair by pair. In a larger one
links are found by a search that leaves out what is linked already and returns the edges of a spanning tree, so a dense
group gives as many edges as members, not as many as pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, require, written
from .graph import connected_components

RADIUS = 4
SMALL = 16
CHUNK = 1 << 20
GAP = re.compile(rb"[ \t-\r]")


def word_runs(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of ``text`` in runs of about CHUNK bytes; each run starts with the last ``overlap`` words before it."""
    if len(text) <= CHUNK:
        yield text.split()
        return
    kept: list[bytes] = []
    at = 0
    while at < len(text):
        end = GAP.search(text, at + CHUNK)  # a run ends where a word ends, however long the word
        upto = end.start() if end else len(text)
        words = text[at:upto].split()
        if words:
            yield kept + words
            kept = (kept + words)[-overlap:] if overlap else []
        at = upto


@dataclass(frozen=True)
class Spec:
    """What a fingerprint is taken over: ``n``-word shingles, repeats counted or not, and the hashes' seed."""

    n: int = 4
    repeats: bool = True
    seed: int = 42


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the space-joined n-word shingles, repeats included."""
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = starts + lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=False)), np.uint64, len(words) - n + 1)


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, the lowest first."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        out += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprint(text: bytes | None, spec: Spec = Spec()) -> int:
    """SimHash over word shingles: a bit is 1 if set in over half the hashes. No words: 0; fewer than n: one shingle."""
    low = (text or b"").lower()
    ones, total, distinct = np.zeros(64, np.int64), 0, []
    for words in word_runs(low, spec.n - 1):
        if len(words) >= spec.n:
            hashes = shingle_hashes(words, spec.n, spec.seed)
            if spec.repeats:
                total += len(hashes)
                ones += ones_of(hashes)
            else:
                distinct.append(np.unique(hashes))
    if distinct:
        hashes = np.unique(np.concatenate(distinct))
        ones, total = ones_of(hashes), len(hashes)
    if total == 0:
        words = low.split()
        return xxhash.xxh64_intdigest(b" ".join(words), spec.seed) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, specs: tuple[Spec, ...] = (Spec(),), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0, fp1, ...): the 64-bit fingerprints as signed longs, for every row."""
    require(docs, id_col, text_col)
    names = [f"fp{k}" for k in range(len(specs))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([[fingerprint(t.as_py(), s) for s in specs] for t in batch.column(1)], np.uint64).reshape(-1, len(specs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k].copy().view(np.int64)) for k in range(len(specs)))], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{x} long" for x in names)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(scan, schema)


#: Pieces of the other segment (first bit, bits): one more than the bits that may differ.
PIECES = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))
#: Rows of one segment beyond which its entries are cut.
LARGE = 1 << 13


def segment_of(number: int) -> Column:
    return F.col("fp").bitwiseAND(0xFFFFFFFF) if number == 0 else F.shiftrightunsigned("fp", 32)


def ball(masks: Column, number: int) -> Column:
    return F.transform(masks, lambda m: segment_of(number).bitwiseXOR(m).bitwiseOR(number << 32))


def table_rows(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """(key, fp, rep): each segment's ball; a key holds a point's 32 bits, above them the segment's number, and in a cut entry
    the number of the piece from 1 on and its value."""
    masks = F.array(*(F.lit(m) for m in [0, *(1 << i for i in range(32))]))
    parts = []
    for number in (0, 1):
        parts.append(ball(masks, number))
    rows = nodes.select(F.explode(F.concat(*parts)).alias("key"), "fp", "rep")
    total = nodes.count()
    bound = max(large, -(-total // (4 * partitions(nodes.sparkSession))))
    if total <= bound:
        return rows
    segments = nodes.select(F.explode(F.array(*(segment_of(k).bitwiseOR(k << 32) for k in (0, 1)))).alias("s"))
    # at most 2 * total / bound segments, with a ball of 33 points each
    hot = segments.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > bound).select(F.explode(F.transform(masks, lambda m: F.col("s").bitwiseXOR(m))).alias("key")).distinct()
    other = F.when(F.shiftright("key", 32) == 0, segment_of(1)).otherwise(segment_of(0))
    pieces = F.array(*(F.shiftleft(F.shiftright(other, at).bitwiseAND((1 << bits) - 1), 36).bitwiseOR((k + 1) << 33) for k, (at, bits) in enumerate(PIECES)))
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    return marked.select(F.explode(F.when(F.col("hot"), F.transform(pieces, lambda p: F.col("key").bitwiseOR(p))).otherwise(F.array("key"))).alias("key"), "fp", "rep")


def near(fps: np.ndarray, one: np.uint64, radius: int) -> np.ndarray:
    return np.bitwise_count(fps ^ one) <= radius


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (positions) of a spanning forest of the links among ``fps``: each search step sees only what is left."""
    left = np.arange(len(fps))
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(fps[left], fps[at], radius)
            if hit.any():
                got, left = left[hit], left[~hit]
                out.append((np.full(len(got), at), got))
                queue.extend(got.tolist())
        if not len(left):
            break
    return out


def entry_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of each (complete) table entry; the arrays are sorted by key."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    half = np.where((key >> 32) & 1 == 1, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF)).astype(np.int64)
    point = key & 0xFFFFFFFF
    a_all, b_all = [], []
    for size in range(2, SMALL + 1):
        first = starts[sizes == size]
        if len(first):
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(first), 1 << 16):
                a = (first[at : at + (1 << 16), None] + i).ravel()
                b = (first[at : at + (1 << 16), None] + j).ravel()
                # equal segments meet in 33 entries; the one of the segment itself will do
                ok = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & ((half[a] != half[b]) | (half[a] == point[a]))
                a_all.append(rep[a[ok]])
                b_all.append(rep[b[ok]])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        s = slice(start, start + size)
        if (half[s] == half[start]).all() and half[start] != point[start]:
            continue
        for a, b in spanning_links(fp[s], radius):
            a_all.append(rep[s][a])
            b_all.append(rep[s][b])
    if not a_all:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(a_all), np.concatenate(b_all)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (fp, rep) to connect all that are within ``radius``."""
    if radius > 4:
        raise ValueError("two segments with balls of radius 1 reach 4 bits")
    spark = nodes.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the rows of the last, perhaps unfinished entry

        def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, fp, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = entry_links(key, fp.view(np.uint64), rep, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1][0][-1] != key[0]):
                head = (key[:cut], fp[:cut], rep[:cut])
                yield flush([*held, head])
                held = []
            held.append((key[cut:].copy(), fp[cut:].copy(), rep[cut:].copy()))
        if held:
            yield flush(held)

    rows = table_rows(nodes, large).repartition(partitions(spark, nodes), "key").sortWithinPartitions("key")
    return rows.mapInArrow(scan, "a long, b long")


def simhash_components(
    docs: DataFrame, specs: tuple[Spec, ...] = (Spec(),), id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
) -> DataFrame:
    """(id, fp0, ..., component_id) for every row: the smallest id reachable over links of at most ``radius`` bits in any of
    the fingerprints.

    Null and empty texts have fingerprint 0 and link like any other; rows with equal texts or ids keep a row each; an
    empty table gives an empty result. Ids must be integers and not null.
    """
    fps = [f"fp{k}" for k in range(len(specs))]
    marked = written(fingerprints(docs, specs, id_col, text_col), "fingerprints")
    nodes = written(marked.groupBy(*fps).agg(F.min("id").cast("long").alias("rep")), "fingerprint-nodes")
    edges = None
    for fp in fps:
        single = nodes.groupBy(F.col(fp).alias("fp")).agg(F.min("rep").alias("rep"))
        found = links(single, radius)
        if len(fps) > 1:  # nodes that share this fingerprint
            same = nodes.join(single.withColumnRenamed("rep", "b"), nodes[fp] == single["fp"]).where("rep <> b")
            found = found.union(same.select(F.col("rep").alias("a"), "b"))
        edges = found if edges is None else edges.union(found)
    named = connected_components(edges)
    named = nodes.join(named, nodes["rep"] == named["node"], "left").select(*fps, F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, fps).select(F.col("id").alias(id_col), *fps, "component_id")
