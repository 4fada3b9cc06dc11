"""Near copies by word shingles: SimHash tables and MinHash bands find candidates, exact shingle sets decide.

Two texts are near copies if their sets of distinct ``SHINGLE``-word shingles have a Jaccard similarity of at least
``THRESHOLD``. Texts of fewer words have one shingle, all their words; texts without words have none and are equal.

Texts with one set are one node. Nodes meet first by the multi-index tables of ``simhash``: those that hang together by 4
bits or fewer are one bucket. 4 bits are too few for many pairs close to the threshold, so nodes that agree in all ``WIDTH`` minima of
one of ``BANDS`` bands are a bucket too, unless they are all in one bucket of the tables: at 0.8 a pair is missed by these with
probability (1 - 0.8 ** 5) ** 20 = 0.00035, above it less often. Buckets with the same members are looked at once. The members'
texts come to their bucket, and no pair becomes an edge before its sets have been compared; a search that leaves out what is linked already gives a spanning forest, so a dense bucket is not expanded into pairs. A large
bucket is searched in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import partitions, release, require, written
from .graph import connected_components
from .ppm import text_words
from .simhash import Spec, simhash_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, WIDTH = 20, 5
#: The fingerprint is over distinct word pairs. Texts with one set of shingles have one set of pairs, so it is the node's.
SPEC = Spec(2, False, 42)
#: Shingles (8 bytes each) that a task searches at once.
PIECE = 4 << 20
_seeds = T.mix(np.arange(1, 2 * BANDS * WIDTH + 1, dtype=np.uint64))
FACTORS, SHIFTS = _seeds[::2] | np.uint64(1), _seeds[1::2]
#: For the second half of a set's identity.
OTHER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of text k, sorted, are hashes[ends[k]:ends[k + 1]]."""
    n = len(offsets) - 1
    words, owner = text_words(data, offsets)
    count = np.bincount(owner, minlength=n)
    found = [T.word_ngrams(words, owner, SHINGLE)]
    for length in range(1, SHINGLE):
        short = count[owner] == length
        if short.any():
            found.append(T.word_ngrams(words[short], owner[short], length))
    hashes, who = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, who))
    hashes, who = hashes[order], who[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(who[new], minlength=n))])


def sketches(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, keys) of each set: 128 bits that name it, and a key for each band (of no use for empty sets)."""
    n = len(ends) - 1
    names, keys = np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        starts = ends[some]
        with np.errstate(over="ignore"):
            names[0, some] = np.add.reduceat(hashes, starts)
            names[1, some] = np.add.reduceat(T.mix(hashes ^ OTHER), starts)
            for band in range(BANDS):
                key = np.full(len(some), band + 1, np.uint64)
                for k in range(band * WIDTH, (band + 1) * WIDTH):
                    key = T.mix(key * np.uint64(T.ODD) + np.minimum.reduceat(hashes * FACTORS[k] + SHIFTS[k], starts))
                keys[some, band] = key
    return names[0], names[1], keys


def sketched(rows: DataFrame) -> DataFrame:
    """(row, id, first, second, size, keys) for every row of (row, id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in T.blocks(batch.column(2)):
                hashes, ends = shingle_sets(data, offsets)
                first, second, keys = sketches(hashes, ends)
                size = np.diff(ends)
                lists = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                        pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(keys[size > 0].ravel().view(np.int64))),
                    ],
                    names=["row", "id", "first", "second", "size", "keys"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"row long, id {kind}, first long, second long, size long, keys array<long>")


class Sets:
    """Sets of distinct hashes with their sizes; ``near`` finds those at the threshold to one of them."""

    def __init__(self, sets: list[np.ndarray], threshold: float) -> None:
        self.sets, self.threshold = sets, threshold
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def near(self, at: int, others: np.ndarray) -> np.ndarray:
        size = self.sizes[at]
        tried = others[np.minimum(self.sizes[others], size) >= self.threshold * np.maximum(self.sizes[others], size) - 1e-9]
        if not len(tried):
            return tried
        flat = np.concatenate([self.sets[k] for k in tried])
        place = np.minimum(np.searchsorted(self.sets[at], flat), size - 1)
        shared = np.add.reduceat((self.sets[at][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(self.sizes[tried])[:-1]]))
        return tried[shared >= self.threshold * (self.sizes[tried] + size - shared) - 1e-9]


def bucket_links(sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges (positions) of a spanning forest of the pairs at ``threshold`` or more, each step seeing only what is left, and
    what is not connected to the first set."""
    found, left, out, apart = Sets(sets, threshold), np.arange(1, len(sets)), [], None
    queue = [0]
    while len(left):
        while queue and len(left):
            at = queue.pop()
            got = found.near(at, left)
            left = left[~np.isin(left, got)]
            out.extend((at, int(k)) for k in got)
            queue.extend(got.tolist())
        if apart is None:
            apart = left
        if len(left):
            queue, left = [int(left[0])], left[1:]
    return out, np.zeros(0, np.int64) if apart is None else apart


def query_links(members: list[np.ndarray], queries: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Edges (query, member) of a spanning forest of the pairs at ``threshold`` or more between the two lists."""
    found, n = Sets([*members, *queries], threshold), len(members)
    group = list(range(n + len(queries)))

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for q in range(len(queries)):
        for k in found.near(n + q, np.arange(n)).tolist():
            a, b = root(n + q), root(k)
            if a != b:
                group[a] = b
                out.append((q, k))
    return out


def searched(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, key): edges of each part of (key, part, side, rep, text); ``side`` 0 is the first, 1 a member, 2 a query.

    Without queries a part is searched whole, and members that are not connected to the first come back too, with b null.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reps, sets, sides = None, [], [], []

        def flush() -> pa.RecordBatch:
            asked = sides[-1] == 2
            lone: list[int] = []
            if asked:
                n = sum(x < 2 for x in sides)
                pairs = [(n + q, k) for q, k in query_links(sets[:n], sets[n:], threshold)]
            else:
                pairs, apart = bucket_links(sets, threshold)
                lone = apart.tolist() if sides[0] == 0 else []
            a, b = [reps[x] for x, _ in pairs] + [reps[x] for x in lone], [reps[y] for _, y in pairs] + [None] * len(lone)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([part[0]] * len(a), pa.int64())], names=["a", "b", "key"])

        for batch in batches:
            keys, row_parts, row_sides, row_reps = (batch.column(k).to_pylist() for k in range(4))
            for at, n, data, offsets in T.blocks(batch.column(4)):
                hashes, ends = shingle_sets(data, offsets)
                for k in range(n):
                    if (keys[at + k], row_parts[at + k]) != part:
                        if len(sets) > 1:
                            yield flush()
                        part, reps, sets, sides = (keys[at + k], row_parts[at + k]), [], [], []
                    reps.append(row_reps[at + k])
                    sets.append(hashes[ends[k] : ends[k + 1]])
                    sides.append(row_sides[at + k])
        if len(sets) > 1:
            yield flush()

    dealt = rows.repartition(partitions(rows.sparkSession, rows), "key", "part").sortWithinPartitions("key", "part", "side", "rep")
    return dealt.select("key", "part", "side", "rep", "text").mapInArrow(scan, "a long, b long, key long")


def verified(buckets: DataFrame, texts: DataFrame, threshold: float, piece: int = PIECE) -> DataFrame:
    """(a, b): edges between the nodes of each bucket of (key, rep, size), enough to connect all pairs at the threshold.

    A bucket of more than ``piece`` shingles is cut into pieces, each searched by itself with the bucket's first node in it.
    What a piece connects to that node is settled; the rest, few where copies are dense, is then looked up in every piece of its
    bucket, itself in groups of bounded size. So a task holds two pieces at most and no pair is left out.
    """
    whole = buckets.groupBy("key").agg(F.ceil(F.sum("size") / piece).cast("int").alias("pieces"), F.min("rep").alias("first"))
    members = buckets.join(whole.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    firsts = whole.where("pieces > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"), F.lit(0).alias("side"), F.col("first").alias("rep"))
    rest = members.where((F.col("pieces") == 1) | (F.col("rep") != F.col("first"))).select("key", "part", F.lit(1).alias("side"), "rep")
    texts = texts.hint("merge")  # the same way at every size: a list of nodes has no bound
    found = written(searched(rest.unionByName(firsts).join(texts, "rep"), threshold), "near-edges")
    edges = found.where("b is not null").select("a", "b")
    apart = found.where("b is null").select("key", F.col("a").alias("rep")).distinct()
    if apart.isEmpty():
        return edges
    sized = apart.join(buckets, ["key", "rep"])
    groups = sized.groupBy("key").agg(F.ceil(F.sum("size") / piece).cast("int").alias("groups"))
    asked = sized.join(groups, "key").join(whole.drop("first"), "key").select("key", "rep", "groups", "pieces", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("group"))
    number = (F.col("group") * F.col("pieces") + F.col("part")).cast("int").alias("part")
    queries = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("key", number, F.lit(2).alias("side"), "rep")
    against = members.join(groups, "key").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("key", number, F.lit(1).alias("side"), "rep")
    more = searched(queries.unionByName(against).join(texts, "rep"), threshold)
    return edges.union(more.where("b is not null").select("a", "b"))


def buckets_of(rows: DataFrame) -> DataFrame:
    """(key, rep, size): buckets of (key, rep, size, comp) with more than one ``comp``; of those with the same members, one."""
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"m{k}") for k in range(2)]
    found = rows.groupBy("key").agg(F.count("*").alias("n"), *marks, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    once = found.groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    return rows.join(once.hint("merge"), "key").select("key", "rep", "size")


def near_copy_components(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """(node, component) of the ``nodes`` (rep, size, keys) that hang together by pairs at the threshold; ``texts`` is (rep, text).

    A bucket is searched for all pairs in it, so of the bands' buckets only those are looked at that are not within one of the tables.
    """
    alike = simhash_components(texts, (SPEC,), "rep", "text").select("rep", F.col("component_id").alias("comp"))
    named = written(nodes.where("size > 0").join(alike.hint("merge"), "rep").select("rep", "size", "keys", "comp"), "near-named")
    bands = named.select("rep", "size", F.explode("keys").alias("key"), "comp")
    tables = named.select("rep", "size", F.col("comp").alias("key"), F.col("rep").alias("comp"))
    buckets = written(buckets_of(tables.unionByName(bands)), "near-buckets")
    release(named)
    return connected_components(verified(buckets, texts, threshold, piece))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns kept, less all but one of every group that hangs together by near copies.

    The one with the smallest id stays; null ids come last, and of rows with one id the first stored row. Nodes and survivors are
    rows, not ids: rows that share an id, or have none, stay if their texts differ. Every row that goes has a partner at
    ``threshold`` or more in ``docs``; in a chain that need not be the row that stays. Null texts count as empty, and all texts
    without words are copies of each other. An empty table gives an empty result. A column named __row is replaced.
    """
    require(docs, id_col, text_col)
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    text = F.col(text_col).cast("binary").alias("text")
    found = sketched(numbered.select(F.col("__row").alias("row"), F.col(id_col).alias("id"), text))
    nodes = written(
        found.groupBy("first", "second", "size").agg(F.min("row").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.first("keys").alias("keys")),
        "near-nodes",
    )
    named = near_copy_components(nodes.select("rep", "size", "keys"), numbered.select(F.col("__row").alias("rep"), text), threshold)
    whole = nodes.select("rep", "best").join(named.hint("merge"), nodes["rep"] == named["node"], "left").select(F.coalesce("component", "rep").alias("component"), "best")
    stays = written(whole.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row")), "near-stays")
    release(nodes)
    return numbered.join(stays.hint("merge"), "__row", "left_semi").select(*docs.columns)
