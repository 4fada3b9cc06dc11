"""Language identification in two steps: the family first, then one-versus-one linear machines within the family.

Features are hashed byte trigrams of the lower-cased text, boundaries included, as shares of the text. Every machine is a
linear support vector machine (squared hinge, trained in numpy). A score is a sum of weights over the text's trigrams, so
scoring gathers weights and needs no feature table; each task scores its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import learns, require
from .features import as_arrow, labelled_sample, segment_sums, spaced, trigram_buckets

BITS = 13
#: Slope of the logistic function that turns margins into scores.
STEEP = 4.0
#: Families of common languages; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af yi lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru pl cs sk uk bg sr hr sl mk be",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr ne pa gu",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


@dataclass
class Languages:
    langs: list[str]
    families: list[str]
    members: list[list[int]]  # languages of each family
    pairs: list[tuple[int, int]]  # languages of each one-versus-one machine
    weights: np.ndarray  # trigram buckets x (families, then pairs)
    bias: np.ndarray

    def predict(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the family with the largest margin, then most votes; ties go to the larger margins' sum."""
        n, k = len(margin), len(self.families)
        family = margin[:, :k].argmax(1)
        sure = 1 / (1 + np.exp(-STEEP * np.clip(margin[np.arange(n), family], -10, 10)))
        lang, score = np.zeros(n, np.int64), np.zeros(n)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(members)))
            least = np.full((len(rows), len(members)), np.inf)
            for p, (a, b) in enumerate(self.pairs):
                if a in members:
                    m = margin[rows, k + p]
                    for lang_no, won in ((a, m), (b, -m)):
                        at = members.index(lang_no)
                        votes[:, at] += (won > 0) + np.tanh(won) * 1e-3
                        least[:, at] = np.minimum(least[:, at], won)
            best = votes.argmax(1)
            lang[rows] = np.array(members)[best]
            score[rows] = sure[rows] / (1 + np.exp(-STEEP * np.clip(least[np.arange(len(rows)), best], -10, 10)))
        return lang, score


def machine(x: np.ndarray, y: np.ndarray, cost: float = 30.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine: accelerated descent on |w|^2 / 2 + cost * mean(max(0, 1 - y f)^2), classes even."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = np.float32(1 / (1 + 2 * cost * float((share * (np.einsum('ij,ij->i', x, x) + 1)).sum())))
    for k in range(rounds):
        pull = np.float32(k / (k + 3))
        aw, ab = w + pull * vw, b + pull * vb
        gap = np.maximum(0, 1 - y * (x @ aw + np.float32(ab))) * y * share
        nw, nb = aw - rate * (aw - np.float32(2 * cost) * (gap @ x)), ab + rate * 2 * cost * float(gap.sum())
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def shares(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for at, n, data, offsets in T.blocks(as_arrow(texts)):
        bucket, a, b = trigram_buckets(spaced(T.LOWER[data], offsets), BITS)
        for k in range(n):
            if b[k] > a[k]:
                out[at + k] = np.bincount(bucket[a[k] : b[k]], minlength=1 << BITS) / (b[k] - a[k])
    return out


def train(texts: list[bytes], langs: list[str]) -> Languages:
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], int)
    family_of = [FAMILY_OF.get(x, x) for x in names]
    families = sorted(set(family_of))
    members = [[k for k, f in enumerate(family_of) if f == g] for g in families]
    x = shares(texts)
    x *= (scale := 10.0)
    columns = [machine(x, np.where(np.isin(y, m), 1, -1)) if len(families) > 1 else (np.zeros(1 << BITS), 1.0) for m in members]
    pairs = [p for m in members for p in combinations(m, 2)]
    for a, b in pairs:
        rows = (y == a) | (y == b)
        columns.append(machine(x[rows], np.where(y[rows] == a, 1, -1)))
    weights = np.stack([c[0] for c in columns], 1).astype(np.float32) * scale if columns else np.zeros((1 << BITS, 0), np.float32)
    return Languages(names, families, members, pairs, weights, np.array([c[1] for c in columns]))


def score_block(model: Languages, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bucket, a, b = trigram_buckets(spaced(T.LOWER[data], offsets), BITS)
    sums = np.stack([segment_sums(model.weights[:, k][bucket], a, b) for k in range(model.weights.shape[1])], 1)
    return sums / np.maximum(b - a, 1)[:, None] + model.bias


def fit(docs: DataFrame, per_lang: int = 400, max_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Learn from at most ``per_lang`` texts of each language, none of them held out and none over ``max_bytes``."""
    require(docs, id_col, text_col, lang_col)
    rows = labelled_sample(docs, F.col(lang_col), learns(id_col), per_lang, id_col, text_col, max_bytes)
    return train([t for t, _ in rows], [x for _, x in rows])


def predict_languages(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score; columns of these names are replaced.

    A text that is null or has no letter (Unicode category L) is ``und`` with score 0; so is every text if nothing was learned. Equal texts get
    equal results; rows with one id keep a row each; an empty table gives an empty result.
    """
    require(docs, text_col)
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            names, scores = [], []
            for at, n, data, offsets in T.blocks(column):
                letters = [any(map(str.isalpha, column[at + k].as_py() or "")) for k in range(n)]
                if not found.langs:
                    names += ["und"] * n
                    scores += [0.0] * n
                    continue
                lang, score = found.predict(score_block(found, data, offsets))
                names += [found.langs[x] if ok else "und" for x, ok in zip(lang, letters, strict=True)]
                scores += np.where(letters, score, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(scan, schema)
