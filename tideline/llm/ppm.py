"""Language-model scoring by prediction by partial matching over bytes, beside a unigram word baseline.

Training gathers two kinds of counts over all admitted texts in one pass: (``ORDER`` + 1)-byte strings, and words. Counts are
combined in each task before they are shuffled and are stored as a table in the shared folder.

The byte-context trie holds the strings of every length up to ORDER + 1, whatever their counts. A symbol weighs its count less
one half, an escape one half for each of the context's distinct symbols; after an escape the symbols that the longer context knows
are excluded. The trie is pretrained and
fixed, so all that an exclusion needs depends on the longer context alone and is computed when the trie is built; what a byte
costs depends on its (ORDER + 1)-byte string alone, and a text's code length is a sum of look-ups.

No task holds the whole trie. All of it that strings with the same two bytes before their symbol need are those strings and the
two-byte ones (at most 65,536, sent to every task), so counts are dealt by these two bytes and each task builds its part, which
is exact. Where two bytes have very many strings or rare occurrences, these are dealt by three bytes, or four, or five, and the strings that end in
the shorter contexts (256 at most for each context that is so split) are sent to every task as well. Strings that make up at least ``SHARE`` of the training bytes, at most 1 / SHARE of them, are scored there once, and
their logarithms broadcast; every other string of a text goes by a shuffle to its part of the trie.

The baseline needs the count of every word, and there is no bound on words. Frequent words (at least 1 / ``FREQUENT`` of the
tokens, so at most FREQUENT of them) are looked up in each task; the rest go to the table of counts by a shuffle on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import partitions, require, written
from .features import Spaced, spaced, word_spans

ORDER = 5
SHARE = 5e-7
FREQUENT = 1_000_000
#: The word key of the end of a text.
END = 0
HELD_KEYS = 2_000_000
#: A part's weight in strings and rare occurrences from which on it may be split.
LEAST_PART = 1 << 16
#: What a zero byte of a text counts as, since zero is the end's: a byte that no UTF-8 text holds.
ZERO = 255
NO_KEY = np.uint64((1 << 64) - 1)
WORDS, BYTES = 0, 1


class Table:
    """A hash table of 64-bit keys with the place of each."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys, self.places = np.full(size, NO_KEY), np.full(size, -1, np.int32)
        slot, rest = self.slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[slot] == NO_KEY
            first = np.unique(np.where(free, slot, -1), return_index=True)
            won = first[1][first[0] >= 0]
            self.keys[slot[won]], self.places[slot[won]] = keys[rest[won]], rest[won]
            lost = np.ones(len(rest), bool)
            lost[won] = False
            rest, slot = rest[lost], (slot[lost] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(T.ODD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.places[slot], -1)
        rest = np.flatnonzero((held != keys) & (held != NO_KEY))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            hit = held == keys[rest]
            out[rest[hit]] = self.places[slot[hit]]
            go = ~hit & (held != NO_KEY)
            rest, slot = rest[go], slot[go]
        return out


@dataclass
class Level:
    """Contexts of one length. Logarithms are to base 10."""

    entries: Table  # context and symbol
    log_count: np.ndarray
    nodes: Table  # context
    log_top: np.ndarray  # of all weights, when coding starts here
    escape_top: np.ndarray
    log_below: np.ndarray  # of the shorter context's weights without the symbols known here
    escape_below: np.ndarray


class Trie:
    """PPM with exclusion over counts of strings of 1 to order + 1 bytes; ``counts[k]`` is (keys, counts) for contexts of k."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels: list[Level] = []
        last = None
        for keys, n in counts:
            order = np.argsort(keys)
            keys, n = keys[order].astype(np.uint64), n[order] - 0.5
            ctx, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            distinct = np.diff(np.append(first, len(keys))).astype(np.float64)
            unseen = distinct / 2  # the weight of an escape
            below, escape_below = np.zeros(len(ctx)), np.zeros(len(ctx))
            if last is not None and len(ctx):
                bits = np.uint64((1 << 8 * len(self.levels)) - 1)
                shared = last[1][np.searchsorted(last[0], keys & bits)]  # the shorter context's counts of the same symbols
                up = np.searchsorted(last[2], ctx & (bits >> np.uint64(8)))
                left, escape = np.maximum(0, last[3][up] - np.add.reduceat(shared, first)), last[4][up]
                some = escape > 0
                below[some] = np.log10(left[some] + escape[some])
                escape_below[some] = np.log10(escape[some] / (left[some] + escape[some]))
            self.levels.append(Level(Table(keys), np.log10(n), Table(ctx), np.log10(total + unseen), np.log10(unseen / (total + unseen)), below, escape_below))
            last = (keys, n, ctx, total, unseen)
        known = len(counts[0][0]) if counts else 0
        self.unknown = -np.log10(max(1, 256 - known))

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of each position; a key holds the ORDER bytes before it and the symbol."""
        out, rest = np.zeros(len(keys)), np.arange(len(keys))
        came = np.full(len(keys), -1)  # node of the longer context that coding came from
        for k in range(len(self.levels) - 1, -1, -1):
            level, key = self.levels[k], keys[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            entry, node = level.entries.find(key), level.nodes.find(key >> np.uint64(8))
            top, longer = came[rest] < 0, self.levels[k + 1] if k + 1 < len(self.levels) else level
            at = came[rest]
            norm = np.where(top, level.log_top[node] if len(level.log_top) else 0.0, longer.log_below[at] if len(longer.log_below) else 0.0)
            escape = np.where(top, level.escape_top[node] if len(level.log_top) else 0.0, longer.escape_below[at] if len(longer.log_below) else 0.0)
            hit, miss = entry >= 0, (entry < 0) & (node >= 0)
            out[rest[hit]] += level.log_count[entry[hit]] - norm[hit]
            out[rest[miss]] += escape[miss]
            came[rest[miss]] = node[miss]
            rest = rest[~hit]
            if not len(rest):
                return out
        out[rest] += self.unknown
        return out


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, end): every byte of every text, and a zero byte at its end, with the ORDER bytes before it (zeros before
    the start); text k has keys[first[k]:end[k]]. A-Z are lower-cased."""
    n = len(offsets) - 1
    first = offsets[:-1] + (ORDER + 1) * np.arange(n) + ORDER
    end = first + np.diff(offsets) + 1
    out = np.zeros(len(data) + (ORDER + 1) * n + ORDER, np.uint8)
    low = T.LOWER[data]
    low[low == 0] = ZERO
    for a, b, s in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), strict=True):
        out[s : s + b - a] = low[a:b]
    keys = T.byte_ngrams(out, ORDER + 1)
    return keys, first - ORDER, end - ORDER


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every word: maximal runs without white space, A-Z lower-cased."""
    text = spaced(T.LOWER[data], offsets)
    starts, ends, owner = word_spans(Spaced(text.data, text.starts, text.ends), ~T.SPACE)
    hashes = T.Spans(text.data).hash(starts, ends)
    hashes[hashes == END] = 1
    return hashes, owner


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over the one text column of ``texts``: kind 0 for words and ends, 1 for (ORDER + 1)-byte strings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORDS: [], BYTES: []}

        def flush(kind: int) -> pa.RecordBatch:
            keys, n = merged(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            for _, n, data, offsets in T.blocks(batch.column(0)):
                words, _ = text_words(data, offsets)
                keys, first, end = coded(data, offsets)
                inside = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                for kind, found in ((WORDS, np.append(words, np.full(n, END, np.uint64))), (BYTES, keys[inside])):
                    held[kind].append(np.unique(found, return_counts=True))
                    if len(held[kind]) > 8:
                        held[kind] = [merged(held[kind])]
                        if len(held[kind][0][0]) > HELD_KEYS:
                            yield flush(kind)
        for kind in (WORDS, BYTES):
            if held[kind]:
                yield flush(kind)

    found = texts.mapInArrow(scan, "kind byte, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Split:
    """Contexts of 2, 3 and 4 bytes whose strings are dealt by a longer context, and all strings that end in them."""

    contexts: list[np.ndarray]
    strings: list[tuple[np.ndarray, np.ndarray]]

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """How many bytes before its symbol each key is dealt by."""
        out = np.full(len(keys), 2)
        for k, contexts in enumerate(self.contexts, 2):
            inside = (keys >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
            out += (out == k) & np.isin(inside, contexts)
        return out


@dataclass
class Scorer:
    pairs: tuple[np.ndarray, np.ndarray]  # keys and counts of two-byte strings
    split: Split
    strings: Table  # the frequent ones of ORDER + 1 bytes
    string_logs: np.ndarray
    words: Table
    word_counts: np.ndarray
    tokens: int  # N
    distinct: int  # V


def suffixes(keys: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the last ``length`` bytes."""
    return merged([(keys & np.uint64((1 << 8 * length) - 1), n)])


def context(length: int) -> Column:
    return F.shiftright("key", 8).bitwiseAND((1 << 8 * length) - 1)


def split_of(strings: DataFrame, least: int) -> Split:
    """What has to be split of the strings (key, n): a bounded number of contexts, as each has more than a part's share of the
    strings and of the occurrences of those under ``least``, which are looked up one by one."""
    weight = F.sum(1 + F.when(F.col("n") < least, F.col("n")).otherwise(0))
    total = strings.agg(weight.alias("w")).first()["w"] or 0
    most = max(LEAST_PART, -(-total // (4 * partitions(strings.sparkSession))))
    found, ends, rows = [], [], strings
    for k in (2, 3, 4):
        large = [] if rows is None else rows.groupBy(context(k).alias("c")).agg(weight.alias("w")).where(F.col("w") > most).select("c").collect()
        found.append(np.sort(np.array([r["c"] for r in large], np.uint64)))
        rows = None if not large else rows.where(context(k).isin([r["c"] for r in large]))
        last = rows and rows.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        ends.append((last.column("key").to_numpy().astype(np.uint64), last.column("n").to_numpy().astype(np.int64)) if last else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return Split(found, ends)


def trie_part(pairs: tuple[np.ndarray, np.ndarray], split: Split, keys: np.ndarray, n: np.ndarray) -> Trie:
    """The trie over ``pairs``, ``split`` and all strings of some parts, for keys of these parts."""
    depth, counts = split.depth(keys), [suffixes(*pairs, 1), pairs]
    for k in range(2, ORDER + 1):
        own, more = depth <= k, split.strings[k - 2] if k < ORDER else (keys[:0], n[:0])
        found = suffixes(keys[own], n[own], k + 1)
        counts.append((np.concatenate([found[0], more[0]]), np.concatenate([found[1], more[1]])))
    return Trie(counts)


def by_part(rows: DataFrame, split: Split) -> DataFrame:
    """``rows`` dealt by the bytes before the symbol of ``key``, two or as many as ``split`` says, counts (without ``row``) first."""
    part = context(5)
    for k in (4, 3, 2):
        large = split.contexts[k - 2].astype(np.int64).tolist()
        part = F.when(context(k).isin(large), part).otherwise(context(k)) if large else context(k)
    dealt = rows.repartition(partitions(rows.sparkSession, rows), part)
    return dealt.sortWithinPartitions(F.col("row").isNotNull())


def string_scores(counts: DataFrame, asked: DataFrame | None, shared: Broadcast, split: Split, least: int) -> DataFrame:
    """(row, score): sums over ``asked`` (row, key, n) by the trie of all strings in ``counts``; without ``asked`` (key, score)
    of each string counted ``least`` times or more."""
    themselves = asked is None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trie = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], None
        for batch in batches:
            key, n = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            known = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                held.append((key[known], n[known]))
            if known.all():
                continue
            if trie is None:
                trie, held = trie_part(*shared.value, *(np.concatenate(x) for x in zip(*held, strict=True))), []
            rows, at = np.unique(batch.column(0).drop_null().to_numpy(), return_inverse=True)
            logs = trie.log_probability(key[~known]) * n[~known]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, logs, minlength=len(rows)))], names=["row", "score"])
        if themselves and len(held) > 1:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            often = keys[n >= least]
            logs = trie_part(*shared.value, keys, n).log_probability(often) if len(often) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(logs)], names=["row", "score"])

    rows = counts.where(F.col("kind") == BYTES).select(F.lit(None).cast("long").alias("row"), "key", "n")
    return by_part(rows if themselves else rows.unionByName(asked), split).mapInArrow(scan, "row long, score double")


def fit(counts: DataFrame) -> Scorer:
    """The frequent strings and words from ``corpus_counts``; what is collected has the bounds of the module's text."""
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tokens, distinct = totals.get(WORDS, (0, 0))
    size = totals.get(BYTES, (0, 0))[0]
    least = max(1, int(np.ceil(SHARE * size)))
    short = counts.where(F.col("kind") == BYTES).groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    pairs = (short.column("key").to_numpy().astype(np.uint64), short.column("n").to_numpy().astype(np.int64))
    split = split_of(counts.where(F.col("kind") == BYTES).select("key", "n"), least)
    frequent = string_scores(counts, None, counts.sparkSession.sparkContext.broadcast((pairs, split)), split, least).toArrow()
    strings = Table(frequent.column("row").to_numpy().astype(np.int64).view(np.uint64))
    often = counts.where((F.col("kind") == WORDS) & (F.col("n") >= max(2, -(-tokens // FREQUENT)))).select("key", "n").toArrow()
    return Scorer(
        pairs, split, strings, frequent.column("score").to_numpy(), Table(often.column("key").to_numpy().view(np.uint64)), often.column("n").to_numpy(), tokens, distinct
    )


def times_in_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times) of every different key of every text."""
    with np.errstate(over="ignore"):
        _, at, times = np.unique(T.mix(keys + owner.astype(np.uint64) * np.uint64(T.ODD)), return_index=True, return_counts=True)
    return owner[at], keys[at], times


def score_block(model: Scorer, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """For each text: log10 probability of its frequent strings, tokens, known tokens and sum of log10(c + 1) of the frequent
    ones; and the rest as (text, word, times) and (text, string, times)."""
    n = len(offsets) - 1
    keys, first, end = coded(data, offsets)
    logs, unsettled = np.zeros(len(keys) + 1), np.ones(len(keys) + 1, bool)
    for at in range(0, len(keys), T.BLOCK):
        place = model.strings.find(keys[at : at + T.BLOCK])
        hit = place >= 0
        logs[at : at + T.BLOCK][: len(hit)][hit] = model.string_logs[place[hit]]
        unsettled[at : at + T.BLOCK][: len(hit)] = ~hit
    score = np.add.reduceat(logs, np.stack([first, end], 1).ravel())[::2] if n else np.zeros(0)
    inside, text = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True)]), np.repeat(np.arange(n), end - first)
    rest = unsettled[inside]
    strings = times_in_text(keys[inside[rest]], text[rest])
    words, owner = text_words(data, offsets)
    words, owner = np.append(words, np.full(n, END, np.uint64)), np.append(owner, np.arange(n))
    tokens = np.bincount(owner, minlength=n)
    place = model.words.find(words)
    often = place >= 0
    known = np.bincount(owner[often], minlength=n)
    base = np.bincount(owner[often], np.log10(model.word_counts[place[often]] + 1.0), minlength=n).astype(float)  # bincount of nothing is whole
    return score, tokens, known, base, times_in_text(words[~often], owner[~often]), strings


def lm_scores(docs: DataFrame, counts: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the trie's log10 probability of the lower-cased text and its end, ``base_score`` the unigram baseline's of
    its words and its end. A zero byte counts as byte 255. Words are told apart by 64-bit hashes. Null counts as empty: its end alone is scored. Rows with one id keep a row each. With nothing
    learned every byte has probability 1 / 256. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "id", "kind", "key", "n_tokens", "n_known", "base", "score"]
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_ids = batch.column(0)
            for at, n, data, offsets in T.blocks(batch.column(2)):
                score, tokens, known, base, *others = score_block(shared.value, data, offsets)
                row, ids = row_ids.slice(at, n), batch.column(1).slice(at, n)
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [row, ids, none(n, pa.int8()), none(n, pa.int64()), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], names=names
                )
                for kind_of, (owner, keys, times) in zip((WORDS, BYTES), others, strict=True):
                    k = len(owner)
                    yield pa.RecordBatch.from_arrays(
                        [
                            row.take(pa.array(owner)), none(k, ids.type), pa.array(np.full(k, kind_of, np.int8)), pa.array(keys.view(np.int64)), pa.array(times),
                            none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64()),
                        ],
                        names=names,
                    )

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    scored = written(source.mapInArrow(scan, f"row long, id {kind}, kind byte, key long, n_tokens long, n_known long, base double, score double"), "lm-rows")
    rare = scored.where(F.col("kind") == WORDS).select("row", "key", "n_tokens")
    c = F.col("n")
    found = rare.join(counts.where(F.col("kind") == WORDS).select("key", "n"), "key").select(
        "row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("n_tokens"), F.col("n_tokens").alias("n_known"), (F.col("n_tokens") * F.log10(c + 1)).alias("base"), F.lit(None).cast("double").alias("score"),
    )
    asked = scored.where(F.col("kind") == BYTES).select("row", "key", F.col("n_tokens").alias("n"))
    strings = string_scores(counts, asked, docs.sparkSession.sparkContext.broadcast((model.pairs, model.split)), model.split, 0)
    per_row = scored.where(F.col("kind").isNull()).drop("kind", "key").unionByName(found).unionByName(strings, True).groupBy("row").agg(
        F.max("id").alias("id"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")),
    )
    norm = float(np.log10(model.tokens + model.distinct + 1))
    return per_row.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score",
    )


def score_corpus(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lm_scores`` of ``docs`` by what ``train`` teaches."""
    counts = written(corpus_counts(train.select(F.col(text_col).cast("binary").alias("text"))), "lm-counts")
    return lm_scores(docs, counts, fit(counts), id_col, text_col)
