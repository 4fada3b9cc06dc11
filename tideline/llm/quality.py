"""Quality by ordinal regression: a cumulative-link model with shared hashed-text weights and ordered thresholds.

P(grade > k) is the logistic function of f(text) - threshold_k, with one f for all grades and thresholds that rise with k. f
sums the weights of the text's hashed byte trigrams (case kept, as shares), of its hashed words (as shares) and of a few
hashed surface marks: bins of the share of distinct words, capitals, digits, punctuation and of the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import learns, require
from .features import Spaced, as_arrow, buckets, segment_sums, spaced, trigram_buckets, with_labels, word_spans

BITS = 13
MARKS = 5
BINS = 16
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[33:48] = PUNCTUATION[58:65] = PUNCTUATION[91:97] = PUNCTUATION[123:127] = True
SIZE = (2 << BITS) + MARKS * BINS
SCALE = 10.0


@dataclass
class Block:
    trigram: np.ndarray
    first: np.ndarray
    end: np.ndarray
    word: np.ndarray  # buckets, by text
    word_first: np.ndarray
    word_end: np.ndarray
    marks: np.ndarray  # texts x MARKS


def read_block(data: np.ndarray, offsets: np.ndarray) -> Block:
    text = spaced(data, offsets)
    n = len(text.starts)
    trigram, first, end = trigram_buckets(text, BITS)
    low = T.LOWER[text.data]
    clean = np.where(T.WORDISH[low], low, np.uint8(32))
    starts, ends, owner = word_spans(Spaced(clean, text.starts, text.ends), T.WORDISH)
    hashes = T.Spans(clean).hash(starts, ends)
    cuts = np.searchsorted(owner, np.arange(n + 1))
    words = np.diff(cuts)
    with np.errstate(over="ignore"):
        once = np.unique(T.mix(hashes + owner.astype(np.uint64) * np.uint64(T.ODD)), return_index=True)[1]
    distinct = np.bincount(owner[once], minlength=n)[:n]
    length = np.maximum(1, offsets[1:] - offsets[:-1])
    part = lambda table: segment_sums(table[text.data].astype(np.float64), text.starts, text.ends) / length
    upper, digit = np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91] = digit[48:58] = True
    shares = np.stack([distinct / np.maximum(1, words), part(upper), part(digit), part(PUNCTUATION)], 1)
    marks = np.concatenate([np.minimum(BINS - 1, shares * BINS).astype(np.int64), np.minimum(BINS - 1, np.log2(length).astype(np.int64))[:, None]], 1)
    return Block(trigram, first, end, buckets(hashes, BITS), cuts[:-1], cuts[1:], marks + np.arange(MARKS) * BINS)


def design(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), SIZE), np.float32)
    side = 1 << BITS
    for at, n, data, offsets in T.blocks(as_arrow(texts)):
        b = read_block(data, offsets)
        for k in range(n):
            for base, hit in ((0, b.trigram[b.first[k] : b.end[k]]), (side, b.word[b.word_first[k] : b.word_end[k]])):
                if len(hit):
                    out[at + k, base : base + side] = np.bincount(hit, minlength=side) * (SCALE / len(hit))
            out[at + k, 2 * side + b.marks[k]] = 1
    return out


@dataclass
class Grades:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray  # one for each grade but the last, rising

    def value(self, b: Block) -> np.ndarray:
        side = 1 << BITS
        tri = segment_sums(self.weights[:side][b.trigram], b.first, b.end) / np.maximum(1, b.end - b.first)
        word = segment_sums(self.weights[side : 2 * side][b.word], b.word_first, b.word_end) / np.maximum(1, b.word_end - b.word_first)
        return SCALE * (tri + word) + self.weights[2 * side :][b.marks].sum(1)

    def tails(self, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each grade but the last."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds, -50, 50)))


def train(texts: list[bytes], grades: list[int], rounds: int = 250, decay: float = 1e-4, rate: float = 0.05) -> Grades:
    """Full-batch Adam on the ordinal likelihood, classes weighted evenly; thresholds are a start and positive steps."""
    names = sorted(set(grades)) or [0]
    y = np.array([names.index(g) for g in grades], int)
    k = len(names) - 1
    if k == 0:
        return Grades(names, np.zeros(SIZE, np.float32), np.zeros(0))
    x = design(texts)
    weight = (1 / np.bincount(y))[y] / len(names)
    state = np.concatenate([np.zeros(SIZE), [0.0], np.full(k - 1, 0.5)])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for r in range(1, rounds + 1):
        w, start, steps = state[:SIZE], state[SIZE], np.exp(state[SIZE + 1 :])
        thresholds = start + np.concatenate([[0.0], np.cumsum(steps)])
        f = x @ w.astype(np.float32)
        edge = 1 / (1 + np.exp(-np.clip(f[:, None] - thresholds, -50, 50)))
        full = np.concatenate([np.ones((len(y), 1)), edge, np.zeros((len(y), 1))], 1)
        rows = np.arange(len(y))
        chance = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), edge * (1 - edge), np.zeros((len(y), 1))], 1)
        upper, lower = slope[rows, y] / chance * weight, slope[rows, y + 1] / chance * weight
        g_f = -(upper - lower)
        g_t = np.zeros((len(y), k + 2))
        g_t[rows, y] += upper
        g_t[rows, y + 1] -= lower
        g_t = g_t[:, 1:-1].sum(0)
        grad = np.concatenate([g_f.astype(np.float32) @ x + decay * w, [g_t.sum()], np.cumsum(g_t[::-1])[::-1][1:] * steps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        state -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    steps = np.exp(state[SIZE + 1 :])
    return Grades(names, state[:SIZE].astype(np.float32), state[SIZE] + np.concatenate([[0.0], np.cumsum(steps)]))


def fit(
    docs: DataFrame, labels: DataFrame, grade: Column, label_cols: list[str], per_grade: int = 1500, max_bytes: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> Grades:
    """Learn from at most ``per_grade`` texts of each combination of ``label_cols``, none held out, none over ``max_bytes``."""
    require(docs, id_col, text_col)
    require(labels, id_col, *label_cols)
    chosen = with_labels(docs.select(id_col, text_col), labels, learns(id_col), per_grade, label_cols, id_col)
    fits = chosen.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= max_bytes)
    rows = sorted((r[0], r[1], bytes(r[2] or b"")) for r in fits.select(id_col, grade.cast("int"), F.col(text_col).cast("binary")).collect())
    return train([r[2] for r in rows], [r[1] for r in rows])


def grade_documents(docs: DataFrame, model: Grades, at_least: int, keep_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with expected_grade, tail_prob = P(grade >= at_least), and kept = tail_prob >= keep_from.

    Columns of these names are replaced. Null and empty texts are scored by their marks alone. A model of one grade gives
    that grade. Equal texts get equal results; an empty table gives an empty result.
    """
    require(docs, text_col)
    made = ["expected_grade", "tail_prob", "kept"]
    keep = [c for c in docs.columns if c != text_col and c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array(model.grades, float)
    at = int(np.searchsorted(names, at_least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [shared.value.tails(shared.value.value(read_block(d, o))) for _, _, d, o in T.blocks(batch.column(len(keep)))]
            tails = np.concatenate(tails) if tails else np.zeros((0, len(names) - 1))
            expected = names[0] + tails @ np.diff(names)
            tail = np.ones(len(tails)) if at == 0 else tails[:, at - 1] if at < len(names) else np.zeros(len(tails))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(expected), pa.array(tail), pa.array(tail >= keep_from)], names=[*keep, *made])

    schema = docs.select(*keep, F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_prob"), F.lit(True).alias("kept")).schema
    return docs.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(scan, schema)
