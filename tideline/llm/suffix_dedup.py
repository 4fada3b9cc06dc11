"""Repeated substrings by column-wise construction of a collection's Burrows-Wheeler transform.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller id, or same text and earlier start) is
removed. Building one transform over a whole corpus takes as many rounds as the longest text has bytes, each over all that is
built so far, so the collection is first cut into short documents that can be built apart:

* Each window of ``length`` bytes is owned by the leftmost of its smallest ``GRAM``-gram hashes, its anchor. An anchor depends
  on the window's bytes alone, so equal windows have equal anchors at equal offsets. The windows that an occurrence of an
  anchor owns are consecutive; the bytes that they cover are its segment, of fewer than 2 * length bytes.
* Occurrences meet by anchor. Segments that agree in two 64-bit hashes are one document of the collection. All but the first
  are removed whole, as copies of the one before; tasks do this for their own rows before the shuffle. No copy is believed: runs
  of copied bytes are fetched from where they are said to come from and compared byte for byte before anything is removed, and a
  difference ends the job with an error.
* What is left are anchors with several different segments. Half of a window's bytes beside its anchor lie to one side of it, so
  windows whose half is in no other segment of the anchor are unique, as are those whose own hash is; they are left out. What
  remains of the segments are the documents of collections whose transform is built column by column: each round puts one more
  symbol in front of every document's last suffix. A stable sort of the transform's symbols moves the suffixes of all documents
  to their new order, and common prefixes follow from range minima. Rows that share ``length`` bytes are equal windows; all but
  the first in the order of (id, start) are removed.

An anchor with very many segments, which a sample of the texts shows, is dealt to several tasks by the segments' hashes.
An anchor with more than ``SPLIT`` different segments is dealt to several collections; of the windows that are first in
theirs, the first of all is then found by a second grouping on the windows' hashes. A collection holds ``COLLECTION``
segments or so, which bounds a task's memory; the files between rounds that the method keeps are arrays of that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import partitions, release, require, written

LENGTH = 100
GRAM = 16
SPLIT = 2000
#: Of so many texts one is looked at for anchors with more than LARGE segments.
SAMPLE = 64
LARGE = 1 << 18
LIVE, DONE, CUT = 0, 1, 2
COLLECTION = 1500
HELD_ROWS = 1 << 20
PLACE_BITS = 24


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window) of every anchor occurrence, positions in the block."""
    none = (np.zeros(0, np.int64),) * 4
    width = length - GRAM + 1
    if len(data) < length:
        return none
    with np.errstate(over="ignore"):
        eight = T.byte_ngrams(data, 8)
        grams = T.mix(eight[: len(data) - GRAM + 1] * np.uint64(T.ODD) + T.mix(eight[8:][: len(data) - GRAM + 1]))
    step = (1 << PLACE_BITS) - length
    starts, places = [], []
    for at in range(0, len(grams), step):  # a place has to fit into PLACE_BITS
        part = grams[at : at + step + width - 1]
        if len(part) < width:
            break
        low = (part & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        places.append((low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
        starts.append(np.arange(at, at + len(low)))
    start, place = np.concatenate(starts), np.concatenate(places)
    owner = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[owner + 1]
    start, place, owner = start[inside], place[inside], owner[inside]
    if not len(start):
        return none
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    last = np.append(new[1:], len(start)) - 1
    return owner[new], place[new], start[new], start[last]


def first_of_class(h: np.ndarray, c: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, new anchor): rows by (h, c, doc, lo), repeated rows left out; which are the first of their class. Any other
    row is a copy of the one before it."""
    order = np.lexsort((lo, doc, c, h))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    h, c, doc, lo = h[order], c[order], doc[order], lo[order]
    new_h = np.append(True, h[1:] != h[:-1])
    first = new_h | np.append(True, c[1:] != c[:-1])
    again = ~first & np.append(False, (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1]))
    return order[~again], first[~again], new_h[~again]


def copied_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows lo to hi of ``doc``, copies of those from ``at`` on in ``other``: the same with runs that touch put together."""
    order = np.lexsort((lo, at - lo, other, doc))
    doc, lo, hi, other, at = (x[order] for x in (doc, lo, hi, other, at))
    if not len(doc):
        return doc, lo, hi, other, at
    same = (doc[1:] == doc[:-1]) & (other[1:] == other[:-1]) & ((at - lo)[1:] == (at - lo)[:-1])
    new = np.flatnonzero(np.append(True, ~same | (lo[1:] > hi[:-1] + 1)))
    return doc[new], lo[new], np.maximum.reduceat(hi, new), other[new], at[new]


def collection(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, length of suffix, common prefix with the row before, symbol before the suffix) of all suffixes in order.

    Round by round one symbol is put in front of each document's newest suffix. The rows of a round are the documents' ends
    and, in the stable order of the last round's transform, all rows that have a symbol before them. A row is kept as the place
    of the symbol before its suffix; symbol 0 is a document's edge.
    """
    m = len(segments)
    size = np.fromiter(map(len, segments), np.int64, m)
    most = int(size.max(initial=0))
    text = np.frombuffer(b"\0" + b"\0".join(segments), np.uint8)
    high = int(text.max(initial=0)) + 1
    edges = np.cumsum(np.append(0, size + 1))[:-1]  # the place of each document's edge
    text = text.astype(np.uint8 if high < 256 else np.uint16) + 1
    text[edges] = 0
    ends = (edges + size).astype(np.int32)
    narrow = np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32
    at, common, no_common = ends, np.zeros(m, narrow), np.zeros(m, narrow)
    total = int(size.sum()) + m
    levels = np.zeros(total + 1, np.int8)  # floor of the binary logarithm
    for k in range(1, total.bit_length()):
        levels[1 << k :] = k
    kind = np.int32 if total * total.bit_length() < 1 << 31 else np.int64
    sizes = (1 << np.arange(total.bit_length(), dtype=np.int64)).astype(kind)
    symbol = text[at]
    for _ in range(most):
        counts = np.bincount(symbol)
        order = np.argsort(symbol, kind="stable")[counts[0] :].astype(kind)
        if not len(order):
            at, common, symbol = ends, no_common, text[ends]
            continue
        n = len(common)
        counts = counts[1:]
        fresh = (np.cumsum(counts) - counts)[counts > 0]  # where a symbol's rows start; the rows before and at such a place differ
        gap, left = np.diff(order), order[:-1] + 1
        gap[fresh[1:] - 1], left[fresh[1:] - 1] = 1, 0
        level = levels.take(gap)
        deep = int(level.max(initial=0)) + 1
        lowest = np.empty((deep, n), narrow)  # lowest[k, i]: the least common prefix of rows i to i + 2 ** k - 1
        lowest[0] = common
        for k in range(1, deep):
            half = 1 << (k - 1)
            np.minimum(lowest[k - 1, : n - 2 * half + 1], lowest[k - 1, half : n - half + 1], out=lowest[k, : n - 2 * half + 1])
        flat = lowest.ravel()
        left += level * kind(n)
        least = flat.take(left)
        left += gap
        left -= sizes.take(level)
        new_common = np.zeros(len(order), narrow)
        np.add(np.minimum(least, flat.take(left), out=least), narrow(1), out=new_common[1:])
        new_common[fresh] = 0
        at = np.concatenate([ends, at.take(order) - np.int32(1)])
        common = np.concatenate([no_common, new_common])
        symbol = text.take(at)
    doc = np.repeat(np.arange(m), size + 1).take(at)
    return doc, ends[doc] - at, common, symbol


def repeated_windows(segments: list[bytes], ids: np.ndarray, lo: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window start in it) of all windows, and whether an earlier window of the collection is equal."""
    doc, suffix, common, _ = collection(segments)
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    start = size[doc] - suffix
    group = np.cumsum(common < length)
    keep = (suffix >= length) & (start < windows[doc])
    doc, start, group = doc[keep], start[keep], group[keep]
    order = np.lexsort((lo[doc] + start, ids[doc], group))
    doc, start, group = doc[order], start[order], group[order]
    later = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
    return np.stack([doc, start], 1), later


def spans_of(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of the runs of consecutive windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], start[last] + length


@dataclass
class Hot:
    """Anchors with very many segments, sorted, and in how many parts each is dealt."""

    anchors: np.ndarray
    parts: np.ndarray

    def dealt(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, cut): the anchor itself or, where it is cut, its part by the segment's hash."""
        if not len(self.anchors) or not len(h):
            return h, np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.anchors, h), len(self.anchors) - 1)
        cut = self.anchors[at] == h
        with np.errstate(over="ignore"):
            part = T.mix(h + (c % self.parts[at] + np.uint64(1)) * np.uint64(T.ODD))
        return np.where(cut, part, h), cut


NONE_HOT = Hot(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def occurrences(texts: DataFrame, length: int, hot: Hot = NONE_HOT) -> DataFrame:
    """(h, c, l, r, doc, lo, hi, lead, state, other, at): anchor occurrences. DONE ones are runs of windows that are copies of those
    from ``at`` on in ``other``, as their task saw; CUT ones belong to a part of an anchor.

    A window has half of its bytes beside the anchor to one side of it: l and r are hashes of that many bytes to the left and
    to the right, so windows of different segments can only be equal if l or r are. ``lead``: from lo to the anchor."""
    half = (length - GRAM) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h, c, left, right, doc, lo, hi, lead = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first, _ = first_of_class(h, c, doc, lo)
            copy = np.flatnonzero(~first)
            a, b = order[copy], order[copy - 1]
            runs = copied_runs(doc[a], lo[a], hi[a], doc[b], lo[b])
            live, n = order[first], len(runs[0])
            h, c, left, right, doc, lo, hi, lead = (x[live] for x in (h, c, left, right, doc, lo, hi, lead))
            key, cut = hot.dealt(h, c)
            none = lambda k, kind: np.zeros(k, kind)
            columns = [
                np.concatenate([key, T.mix(runs[0].astype(np.uint64))]).view(np.int64),  # what is done needs no partner: any partition will do
                np.concatenate([c, none(n, np.uint64)]).view(np.int64), np.append(left, none(n, np.int32)), np.append(right, none(n, np.int32)),
                np.append(doc, runs[0]), np.append(lo, runs[1]).astype(np.int32), np.append(hi, runs[2]).astype(np.int32), np.append(lead, none(n, np.int64)).astype(np.int16),
                np.append(np.where(cut, CUT, LIVE), np.full(n, DONE)).astype(np.int8), np.append(none(len(live), np.int64), runs[3]), np.append(none(len(live), np.int64), runs[4]).astype(np.int32),
            ]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "l", "r", "doc", "lo", "hi", "lead", "state", "other", "at"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in T.blocks(batch.column(1)):
                owner, place, lo, hi = anchors(data, offsets, length)
                if not len(owner):
                    continue
                spans = T.Spans(data)
                h, c = spans.hash(place, place + GRAM), spans.hash(lo, hi + length)
                c = T.mix(c + (place - lo).astype(np.uint64))
                short = lambda x: (x >> np.uint64(33)).astype(np.int32)
                left = short(spans.hash(np.maximum(lo, place - half), place))
                right = short(spans.hash(place + GRAM, np.minimum(hi + length, place + GRAM + half)))
                held.append((h, c, left, right, ids[at + owner], lo - offsets[owner], hi - offsets[owner], place - lo))
                if sum(len(x[0]) for x in held) > HELD_ROWS:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(scan, "h long, c long, l int, r int, doc long, lo int, hi int, lead short, state byte, other long, at int")


def hot_anchors(texts: DataFrame, length: int) -> Hot:
    """Anchors that a sample of the texts shows to have more than LARGE segments; their number is bounded by the partitions."""
    some = occurrences(texts.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SAMPLE)) == 0), length).where(F.col("state") == LIVE)
    counted = written(some.groupBy("h").agg(F.count("*").alias("n")), "repeat-anchors")
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(LARGE, total * SAMPLE // (4 * partitions(texts.sparkSession, texts)))
    found = sorted((r["h"] % (1 << 64), -(-r["n"] * SAMPLE // most)) for r in counted.where(F.col("n") * SAMPLE > most).collect())
    release(counted)
    return Hot(np.array([h for h, _ in found], np.uint64), np.array([k for _, k in found], np.uint64))


def shared(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows have another row with equal (h, side)."""
    with np.errstate(over="ignore"):
        _, inverse, n = np.unique(T.mix(h.view(np.uint64) + side.astype(np.int64).view(np.uint64) * np.uint64(T.ODD)), return_inverse=True, return_counts=True)
    return n[inverse] > 1


def classes(found: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi, h, part, split, other, at) from occurrences: ``h`` null: all windows are copies of those from ``at`` on in
    ``other``; else the first of a segment whose anchor has other segments, for collection ``part`` of it; ``split``: there are
    several parts. Of such segments only the windows stay whose half beside the anchor is in another segment too."""
    half = (length - GRAM) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        open_run = [0, 0, False]  # anchor, segments so far and whether it was cut, of a run that outgrew HELD_ROWS

        def flush(more: bool) -> pa.RecordBatch:
            h, c, left, right, doc, lo, hi, lead, state, other, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            live = np.flatnonzero(state != DONE)
            order, first, new_h = first_of_class(h[live], c[live], doc[live], lo[live])
            rows = live[order]
            copy = np.flatnonzero(~first)
            other[rows[copy]], at[rows[copy]] = doc[rows[copy - 1]], lo[rows[copy - 1]]
            run = np.cumsum(new_h) - 1
            number = np.cumsum(first) - 1
            base = number[new_h][run] if len(rows) else number
            nth = number - base
            several = np.bincount(run, first)[run] if len(rows) else number
            grown = (h[rows] == open_run[0]) & open_run[2] if len(rows) else np.zeros(0, bool)
            nth = nth + np.where(grown, open_run[1], 0)
            split = (several > SPLIT) | grown | (state[rows] == CUT)
            if more and len(rows):
                split |= run == run[-1]
                open_run[:] = [h[rows[-1]], int(nth[-1]) + 1, True]
            rep = np.flatnonzero(first & ((several > 1) | split))
            reps, cut_run = rows[rep], split[rep]
            left_too = (lead[reps] >= half) & (cut_run | shared(h[reps], left[reps]))  # windows that start half or more before the anchor
            right_too = (lo[reps] + lead[reps] - half < hi[reps]) & (cut_run | shared(h[reps], right[reps]))
            turn = lo[reps] + lead[reps] - half  # the last of those
            lo[reps] = np.where(left_too, lo[reps], np.maximum(lo[reps], turn + 1))
            hi[reps] = np.where(right_too, hi[reps], np.minimum(hi[reps], turn))
            rep = rep[left_too | right_too]
            copies = np.concatenate([rows[copy], np.flatnonzero(state == DONE)])
            out, kind = np.concatenate([copies, rows[rep]]), len(copies)
            null = np.arange(len(out)) < kind
            part = np.concatenate([np.zeros(kind, np.int64), nth[rep] // SPLIT])
            cuts = np.concatenate([np.zeros(kind, bool), split[rep]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[out]), pa.array(lo[out]), pa.array(hi[out]), pa.array(h[out], mask=null), pa.array(part.astype(np.int32)), pa.array(cuts),
                    pa.array(other[out], mask=~null), pa.array(at[out], mask=~null),
                ],
                names=["doc", "lo", "hi", "h", "part", "split", "other", "at"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False).copy() for k in range(11)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut or (held and held[-1][0][-1] != cols[0][0]):
                held.append([x[:cut] for x in cols])
                yield flush(False)
            held.append([x[cut:].copy() for x in cols])
            if sum(len(x[0]) for x in held) > 4 * HELD_ROWS:
                yield flush(True)
        if held:
            yield flush(False)

    dealt = found.repartition(partitions(found.sparkSession, found), "h").sortWithinPartitions("h", "c", "doc", "lo")
    return dealt.mapInArrow(scan, "doc long, lo int, hi int, h long, part int, split boolean, other long, at int")


def segments_of(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """(h, part, split, doc, lo, n, bytes): the segments of the marks that still need comparing."""
    wanted = marks.where(F.col("h").isNotNull()).groupBy("doc").agg(F.collect_list(F.struct("h", "part", "split", "lo", "hi")).alias("m"))
    cut = texts.join(wanted, texts["id"] == wanted["doc"]).select("doc", "text", F.explode("m").alias("m"))
    return cut.select("m.h", "m.part", "m.split", "doc", "m.lo", (F.col("m.hi") - F.col("m.lo") + 1).alias("n"), F.substring("text", F.col("m.lo") + 1, F.col("m.hi") - F.col("m.lo") + length).alias("bytes"))


def without_unique(data: list[bytes], anchor: np.ndarray, n: np.ndarray, split: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(segments, their rows, bytes left out in front, windows): without the windows at either end whose hash is in no other
    segment of the anchor, which are unique. A split anchor's segments stay whole, as other parts have to see them."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(data)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[owner] + nth
    with np.errstate(over="ignore"):
        marks = T.Spans(np.frombuffer(b"".join(data), np.uint8)).hash(start, start + length) + T.mix(anchor.view(np.uint64))[owner]
    _, inverse, times = np.unique(marks, return_inverse=True, return_counts=True)
    needed = np.flatnonzero((times[inverse] > 1) | split[owner])
    kept, first = np.unique(owner[needed], return_index=True)
    last = np.append(first[1:], len(needed)) - 1
    skip, upto = nth[needed[first]] if len(kept) else first, nth[needed[last]] if len(kept) else first
    return [data[k][a : b + length] for k, a, b in zip(kept.tolist(), skip.tolist(), upto.tolist(), strict=True)], kept, skip, upto - skip + 1


def compared(segments: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi, key): spans that a collection removes (key null), and windows that are first in a part of a split anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            data = [bytes(r[6]) for r in rows]
            anchor, ids, lo, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 3, 4, 5))
            split = np.array([r[2] for r in rows], bool)
            data, kept, skip, n = without_unique(data, anchor, n, split, length)
            ids, lo, split = ids[kept], lo[kept] + skip, split[kept]
            at, later = repeated_windows(data, ids, lo, n, length)
            doc, start = ids[at[:, 0]], lo[at[:, 0]] + at[:, 1]
            spans = spans_of(doc[later], start[later], length)
            first = np.flatnonzero(~later & split[at[:, 0]])
            keys = [hashlib.blake2b(data[s][p : p + length], digest_size=16).digest() for s, p in at[first].tolist()]
            size = len(spans[0])
            columns = [np.concatenate([spans[0], doc[first]]), np.concatenate([spans[1], start[first]]), np.concatenate([spans[2], start[first] + length])]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * size + keys, pa.binary())], names=["doc", "lo", "hi", "key"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[-1][:2] and (len(held) >= COLLECTION or row[0] == held[-1][0]):
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    dealt = segments.repartition(partitions(segments.sparkSession, segments), "h", "part").sortWithinPartitions("h", "part")
    return dealt.mapInArrow(scan, "doc long, lo long, hi long, key binary")


def copies(marks: DataFrame) -> DataFrame:
    """(doc, lo, hi, other, at) of the marks that are copies, in runs as long as one text has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = copied_runs(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs], names=["doc", "lo", "hi", "other", "at"])

    found = marks.where(F.col("h").isNull()).select("doc", "lo", "hi", "other", "at")
    dealt = found.repartition(partitions(marks.sparkSession, marks), "doc").sortWithinPartitions("doc", "other", F.col("at") - F.col("lo"), "lo")
    return dealt.mapInArrow(scan, "doc long, lo int, hi int, other long, at int")


def without_repeats(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): each text without its spans (doc, lo, hi, source); ``source``, where
    there is one, holds the bytes that the span was found to repeat, and has to be equal to them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, froms, tos, sources in zip(*(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
                whole = text.as_py() or b""
                data = np.frombuffer(whole, np.uint8)
                if froms.as_py():
                    lo, hi = np.minimum(froms.values.to_numpy(), len(data)), np.minimum(tos.values.to_numpy(), len(data))
                    for a, b, source in zip(lo.tolist(), hi.tolist(), sources.as_py(), strict=True):
                        if source is not None and source != whole[a:b]:
                            raise RuntimeError("two different segments agree in both hashes: change T.ODD and run again")
                    change = np.zeros(len(data) + 1, np.int64)
                    np.add.at(change, lo, 1)
                    np.add.at(change, hi, -1)
                    gone = np.cumsum(change)[:-1] > 0
                else:
                    gone = np.zeros(len(data), bool)
                kept = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    span = F.struct("lo", "hi", "source")
    lists = spans.groupBy("doc").agg(F.collect_list(span).alias("s"))
    joined = texts.join(lists, texts["id"] == lists["doc"], "left").select("id", "text", F.col("s.lo").alias("froms"), F.col("s.hi").alias("tos"), F.col("s.source").alias("sources"))
    return joined.mapInArrow(scan, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes, of the text in UTF-8.

    Null counts as empty; texts under ``length`` bytes lose nothing. Rows with one id are one document: equal strings that
    start at one place of it are no repeats, and each such row loses what any of them loses; copies from or to such rows rest on
    the hashes alone. Ids must be integers and not null. An empty table gives an empty result. Other columns are ignored.
    """
    require(docs, id_col, text_col)
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    marks = written(classes(occurrences(texts, length, hot_anchors(texts, length)), length), "repeat-marks")
    dealt = texts.repartition(partitions(docs.sparkSession, texts), "id")  # one shuffle of the texts serves both joins
    found = written(compared(segments_of(dealt, marks, length), length), "repeat-spans")
    still = found.where(F.col("key").isNotNull())
    least = still.groupBy("key").agg(F.min(F.struct("doc", "lo")).alias("first"))
    more = still.join(least, "key").where(F.struct("doc", "lo") != F.col("first"))
    compared_spans = found.where(F.col("key").isNull()).union(more.select(*found.columns)).select("doc", "lo", "hi", F.lit(None).cast("binary").alias("source"))
    runs = copies(marks)
    shared_ids = texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    unsure = F.lit(False)
    if not shared_ids.isEmpty():
        for side in ("doc", "other"):
            runs = runs.join(shared_ids.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_shared")), side, "left")
        unsure = F.coalesce("doc_shared", "other_shared", F.lit(False))
    source = F.when(~unsure, F.substring("text", F.col("at") + 1, F.col("hi") - F.col("lo") + length)).alias("source")
    copied = dealt.join(runs.hint("merge"), dealt["id"] == runs["other"]).select("doc", F.col("lo").cast("long").alias("lo"), (F.col("hi") + length).cast("long").alias("hi"), source)
    spans = copied.union(compared_spans)
    return without_repeats(dealt, spans).withColumnRenamed("id", id_col)
