"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its hashed word embedding, the mean of its hashed character trigrams (boundaries included) and the mean
of its hashed first four and five bytes. The first dimension of an embedding starts as the evidence that its word or n-gram
has in the training texts (a log odds over its standard error), the others start at random. The network reads windows of
``WINDOW`` words every ``STRIDE`` words; a text's score is that of its worst window. It learns from the labels of whole
texts, carried by one window each: first the one with the most evidence, then the worst by the network itself.

Inputs are linear up to the gates, so the gates' input is computed once for each distinct word of a block and gathered;
scoring runs in each task over its own rows, with the weights (about 10 MB, a fixed size) broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import learns, require
from .features import Spaced, as_arrow, buckets, spaced, with_labels, word_spans

WINDOW, STRIDE = 32, 24
WORD_BITS, CHAR_BITS = 18, 16
#: A word or n-gram of fewer training texts than this has a zero embedding, as one that was never seen.
LEAST_TEXTS = 2
WIDTH, HIDDEN = 8, 8
INPUT = 3 * WIDTH
BATCH = 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Words:
    """The words of a block: distinct ones with their feature buckets, and the sequence of each text."""

    word: np.ndarray  # bucket of each distinct word
    lead: np.ndarray  # buckets of its first five and first four bytes
    chars: np.ndarray  # buckets of all their trigrams
    char_of: np.ndarray  # the distinct word of each trigram, non-decreasing
    seq: np.ndarray  # distinct word at each place
    first: np.ndarray  # first place of each text
    count: np.ndarray  # words of each text


def read_words(text: Spaced) -> Words:
    low = T.LOWER[text.data]
    clean = np.where(T.WORDISH[low], low, np.uint8(32))
    n = len(text.starts)
    starts, ends, owner = word_spans(Spaced(clean, text.starts, text.ends), T.WORDISH)
    count = np.bincount(owner, minlength=n)[:n] if len(owner) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    hashes = T.Spans(clean).hash(starts, ends)
    unique, at, seq = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    length = e - s
    char_of = np.repeat(np.arange(len(s)), length)
    place = np.arange(len(char_of)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(s - 1, length)
    grams = T.byte_ngrams(clean, 3)[place]
    five = T.byte_ngrams(clean, 5)[s] if len(s) else np.zeros(0, np.uint64)
    keep = np.uint64(0xFFFFFFFFFF) << (np.uint64(8) * np.maximum(5 - length, 0).astype(np.uint64))
    five &= keep
    four = five & np.uint64(0xFFFFFFFF00)
    lead = np.stack([buckets(five | np.uint64(1 << 41), CHAR_BITS), buckets(four | np.uint64(1 << 42), CHAR_BITS)], 1)
    return Words(buckets(unique, WORD_BITS), lead, buckets(grams, CHAR_BITS), char_of, seq, first, count)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, real, owner): windows over every text; places beyond a short text repeat its last and are not real."""
    count = words.count
    k = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(count)), k)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
    begin = np.minimum(nth * STRIDE, np.maximum(0, count[owner] - WINDOW))
    inner = begin[:, None] + np.arange(WINDOW)
    real = inner < count[owner][:, None]
    return words.first[owner][:, None] + np.minimum(inner, count[owner][:, None] - 1), real, owner


@dataclass
class Model:
    """Weights; direction 0 reads forwards, 1 backwards. Gates: update, reset, candidate."""

    word: np.ndarray
    char: np.ndarray
    inp: list[np.ndarray]
    rec: list[np.ndarray]
    bias: list[np.ndarray]
    attend: np.ndarray
    out: np.ndarray
    offset: float
    prior: float = 0.1
    known: dict = field(default_factory=dict)
    slots: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(
            draw(1 << WORD_BITS, WIDTH), draw(1 << CHAR_BITS, WIDTH), [draw(INPUT, 3 * HIDDEN, by=0.3) for _ in range(2)],
            [draw(HIDDEN, 3 * HIDDEN, by=0.3) for _ in range(2)], [np.zeros(3 * HIDDEN, np.float32) for _ in range(2)],
            draw(2 * HIDDEN, by=0.3), draw(2 * HIDDEN, by=0.3), 0.0,
        )

    def inputs(self, words: Words) -> np.ndarray:
        n = len(words.word)
        if not n:
            return np.zeros((0, INPUT), np.float32)
        cuts = np.searchsorted(words.char_of, np.arange(n))
        per = np.diff(np.concatenate([cuts, [len(words.char_of)]]))[:, None]
        return np.concatenate([self.word[words.word], np.add.reduceat(self.char[words.chars], cuts, axis=0) / per, self.char[words.lead].mean(1)], 1)

    def run(self, x: np.ndarray, real: np.ndarray, d: int, kept: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of direction ``d`` over gate inputs x (steps, windows, 3 * HIDDEN)."""
        steps, n = x.shape[:2]
        h, out, whole = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), real.all()
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = h @ self.rec[d]
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if not whole:
                new *= real[t][:, None]
            if kept is not None:
                kept.append((t, h, z, r, c, g[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(real, states @ self.attend, np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return a, pooled, pooled @ self.out + self.offset

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(logit, owner) of every window."""
        places, real, owner = windows(words)
        got = np.empty(len(owner), np.float32)
        x = self.inputs(words)
        gates = [x @ self.inp[d] + self.bias[d] for d in range(2)]
        for at in range(0, len(owner), BATCH):
            seq, ok = words.seq[places[at : at + BATCH]].T, real[at : at + BATCH].T
            states = np.concatenate([self.run(gates[d][seq], ok, d) for d in range(2)], 2)
            got[at : at + BATCH] = self.pool(states, ok)[2]
        return got, owner

    def step(self, words: Words, places: np.ndarray, real: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One Adagrad step on the windows' logistic loss."""
        x = self.inputs(words)
        seq, ok = words.seq[places].T, real.T
        kept: list[list] = [[], []]
        gates = [x[seq] @ self.inp[d] + self.bias[d] for d in range(2)]
        states = np.concatenate([self.run(gates[d], ok, d, kept[d]) for d in range(2)], 2)
        a, pooled, logit = self.pool(states, ok)
        g = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        d_out, d_offset = pooled.T @ g, g.sum()
        d_pooled = g[:, None] * self.out
        d_a = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_attend = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * self.attend
        d_x = np.zeros((*seq.shape, INPUT), np.float32)
        for d in range(2):
            d_gate = np.empty((*seq.shape, 3 * HIDDEN), np.float32)
            d_rec, back = np.zeros_like(self.rec[d]), np.zeros((len(y), HIDDEN), np.float32)
            for t, h, z, r, c, gc in reversed(kept[d]):
                dh = (d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN] + back) * ok[t][:, None]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                d_gate[t] = np.concatenate([dz, dr, dc], 1)
                into = np.concatenate([dz, dr, dc * r], 1)
                d_rec += h.T @ into
                back = dh * z + into @ self.rec[d].T
            flat = d_gate.reshape(-1, 3 * HIDDEN)
            d_inp = x[seq].reshape(-1, INPUT).T @ flat
            d_x += (flat @ self.inp[d].T).reshape(d_x.shape)
            for name, grad in (("rec", d_rec), ("inp", d_inp), ("bias", flat.sum(0))):
                self.move(getattr(self, name)[d], grad, f"{name}{d}", rate)
        self.move(self.attend, d_attend, "attend", rate)
        self.move(self.out, d_out, "out", rate)
        self.offset -= rate * float(d_offset)
        self.spread(words, seq.ravel(), d_x.reshape(-1, INPUT), rate)

    def move(self, weight: np.ndarray, grad: np.ndarray, name: str, rate: float) -> None:
        seen = self.slots.setdefault(name, np.full(weight.shape, 1e-8, np.float32))
        seen += grad * grad
        weight -= rate * grad / np.sqrt(seen)

    def spread(self, words: Words, seq: np.ndarray, d_x: np.ndarray, rate: float) -> None:
        """Gradients of the words' inputs, down to the rows of the embeddings that took part."""
        n = len(words.word)
        per_word = np.stack([np.bincount(seq, d_x[:, k], n) for k in range(INPUT)], 1).astype(np.float32)
        used = np.bincount(seq, minlength=n) > 0
        grams = used[words.char_of]
        per = np.bincount(words.char_of, minlength=n)
        chars, of = words.chars[grams], words.char_of[grams]
        tri, lead = per_word[of, WIDTH : 2 * WIDTH] / per[of][:, None], per_word[used, 2 * WIDTH :] / 2
        chars, grad = np.concatenate([chars, words.lead[used].T.ravel()]), np.concatenate([tri, lead, lead])
        for name, table, rows, grad in (("word", self.word, words.word[used], per_word[used, :WIDTH]), ("char", self.char, chars, grad)):
            seen_before = self.known[name][rows]
            rows, grad = rows[seen_before], grad[seen_before]
            unique, inverse = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(inverse, grad[:, k], len(unique)) for k in range(WIDTH)], 1).astype(np.float32)
            seen = self.slots.setdefault(name, np.full(table.shape, 1e-8, np.float32))
            seen[unique] += total * total
            table[unique] -= rate * total / np.sqrt(seen[unique])


def evidence(parts: list, kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the log odds of a text's label given that it occurs, over its standard error; and in how many texts it occurs."""
    with_it, texts = np.zeros((2, size)), np.zeros(2)
    for words, _, _, _, truth in parts:
        texts += np.bincount(truth.astype(int), minlength=2)
        owner = np.repeat(np.arange(len(truth)), words.count)
        if kind == "word":
            of, rows = owner, words.word[words.seq]
        else:
            pairs = np.unique(np.stack([owner, words.seq], 1), axis=0)
            begin = np.searchsorted(words.char_of, pairs[:, 1])
            length = np.searchsorted(words.char_of, pairs[:, 1], side="right") - begin
            inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
            of = np.concatenate([np.repeat(pairs[:, 0], length), pairs[:, 0], pairs[:, 0]])
            rows = np.concatenate([words.chars[inner], words.lead[pairs[:, 1], 0], words.lead[pairs[:, 1], 1]])
        once = np.unique(of * size + rows)
        for y in (0, 1):
            with_it[y] += np.bincount(once[truth[once // size] == y] % size, minlength=size)
    a, b = with_it[1] + 0.5, with_it[0] + 0.5
    odds = (np.log(a / (texts[1] + 1)) - np.log(b / (texts[0] + 1))) / np.sqrt(1 / a + 1 / b)
    return np.clip(odds, -5, 5).astype(np.float32), with_it.sum(0)


def train(texts: list[bytes], y: list[int], epochs: int = 7, warm: int = 2, seed: int = 7, rate: float = 0.05) -> Model:
    """Learn from whole texts' labels: ``warm`` epochs on the window with the most evidence, then on the worst window."""
    model, rng = Model.fresh(seed), np.random.default_rng(seed)
    labels = np.array(y, np.float32)
    model.prior = float(np.clip(labels.mean(), 0.01, 0.2)) if len(labels) else 0.1
    parts = []
    for at, n, data, offsets in T.blocks(as_arrow(texts)):
        words = read_words(spaced(data, offsets))
        parts.append((words, *windows(words), labels[at : at + n]))
    if not any(len(p[3]) for p in parts):
        return model
    for name, table in (("word", model.word), ("char", model.char)):
        table[:, 0], seen = evidence(parts, name, len(table))
        model.known[name] = seen >= LEAST_TEXTS
        table[~model.known[name]] = 0
    for epoch in range(epochs):
        for p in rng.permutation(len(parts)):
            words, places, real, owner, truth = parts[p]
            if not len(owner):
                continue
            if epoch < warm:
                per_word = model.word[words.word, 0] + model.char[words.lead, 0].mean(1)
                worst = np.where(real, per_word[words.seq[places]], -9).max(1)
            else:
                worst = model.logits(words)[0]
            noise = rng.random(len(owner))
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            other = np.lexsort((noise, owner))[firsts]  # and another window of the texts that are fine
            pick = rng.permutation(np.concatenate([np.lexsort((noise, -worst, owner))[firsts], other[truth[owner[other]] == 0]]))
            for at in range(0, len(pick), 64):
                w = pick[at : at + 64]
                model.step(words, places[w], real[w], truth[owner[w]], rate if epoch < epochs - 2 else rate / 3)
    model.slots, model.known = {}, {}
    return model


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The worst window's probability of each text; without a word, the prior."""
    n = len(offsets) - 1
    logit, owner = model.logits(read_words(spaced(data, offsets)))
    worst = np.full(n, -np.inf)
    np.maximum.at(worst, owner, logit)
    return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(worst, -50, 50))), model.prior)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 1500, max_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``per_class`` labelled texts of each label of at most ``max_bytes``, none of them held out."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    chosen = with_labels(docs.select(id_col, text_col), labels, learns(id_col), per_class, [label_col], id_col)
    rows = chosen.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= max_bytes).select(id_col, F.col(text_col).cast("binary"), label_col).collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    order = np.random.default_rng(3).permutation(len(rows))
    return train([bytes(rows[i][1] or b"") for i in order], [int(rows[i][2] > 0) for i in order])


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` without the text, with ``score_col`` (0 to 1) of the whole text. A column of that name is replaced.

    Null and empty texts, and those without a word, get the model's prior (under 0.3). Equal texts get equal scores; rows
    with one id keep a row each; an empty table gives an empty result.
    """
    require(docs, text_col)
    keep = [c for c in docs.columns if c not in (text_col, score_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_block(shared.value, data, offsets) for _, _, data, offsets in T.blocks(batch.column(len(keep)))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, score_col])

    source = docs.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    schema = docs.select(*keep, F.lit(0.0).alias(score_col)).schema
    return source.mapInArrow(scan, schema)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, all columns kept, in one pass without a shuffle."""
    require(docs, text_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_block(shared.value, data, offsets) for _, _, data, offsets in T.blocks(batch.column(at))]
            yield batch.filter(pa.array((np.concatenate(scores) if scores else np.zeros(0)) < threshold, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
