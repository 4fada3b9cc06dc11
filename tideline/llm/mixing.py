"""Mixing to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier learns hashed-word weights of each domain from a bounded sample of labelled rows and gives every
document a posterior over domains. Nonnegative document rates r then minimise |A r - b|, where A r are the
expected domain shares of the tokens, sum of r * tokens * posterior, and b the targets. Projected gradient steps start from
r = 1, each in the metric of the token-weighted Gram matrix of the posteriors of the documents whose rate is not at zero; there
a document's move is the inner product of its posterior with a vector of one number a domain. So a step is one aggregation to
K * (K + 3) / 2 numbers, and the rates of all steps so far are an expression over a row's posterior. The closest step counts.
Nothing is shuffled but partial sums. Domains without a target keep the share that they have.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, learns, require, written
from .features import with_labels

BUCKETS = 4096
STEPS = 40
CLOSE = 1e-6
#: Shares further from their targets than this are reported.
TOLERANCE = 1e-3
SEED = 11
#: What words are separated by.
GAP = r"[ \t\n\x0B\f\r]+"
#: The word that a text ends in, or nothing; looked for where words start only.
LAST = r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r]*+\z"
#: Characters of a text whose words are in memory at once; a word takes some 25 times its bytes there.
PIECE = 1 << 20


def literal(values: np.ndarray) -> Column:
    """A constant array of doubles, folded by the optimiser."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def word_buckets(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, GAP), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_pieces(text: Column) -> Column:
    """``text`` in pieces of about ``PIECE`` characters that end where a word ends, so that no array of words has a bound beyond that."""

    def add(acc: Column, k: Column) -> Column:
        read = F.concat(acc["last"], F.substring(text, k * PIECE + 1, F.lit(PIECE)))
        cut = lambda s: F.struct(s.alias("s"), F.regexp_extract(s, LAST, 0).alias("last"))
        head = lambda c: F.substring(c["s"], F.lit(1), F.char_length(c["s"]) - F.char_length(c["last"]))
        return bound(bound(read, cut), lambda c: F.struct(c["last"].alias("last"), F.concat(acc["out"], F.array(head(c))).alias("out")))

    none = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(F.sequence(F.lit(0), F.floor(F.char_length(text) / PIECE).cast("int")), none, add, lambda acc: F.concat(acc["out"], F.array(acc["last"])))
    return F.when(F.char_length(text) <= PIECE, F.array(text)).otherwise(cut)


def word_sums(text: Column, tables: list[Column]) -> Column:
    """(n, sums): the number of words, and for each of ``tables`` the sum of their buckets' entries, in the words' order."""

    def total(start: Column, buckets: Column, table: Column) -> Column:
        return F.aggregate(buckets, start, lambda acc, b: acc + F.get(table, b))

    def add(acc: Column, piece: Column) -> Column:
        sums = lambda b: F.array(*(total(F.get(acc["sums"], F.lit(j)), b, t) for j, t in enumerate(tables)))
        return bound(word_buckets(piece), lambda b: F.struct((acc["n"] + F.size(b)).alias("n"), sums(b).cast("array<double>").alias("sums")))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.array(*(F.lit(0.0) for _ in tables)).cast("array<double>").alias("sums"))
    return F.aggregate(word_pieces(text), none, add)


@dataclass
class Domains:
    names: list[str]
    prior: np.ndarray
    weights: np.ndarray  # domains x BUCKETS, log likelihood ratios to the mean


def fit_domains(
    docs: DataFrame, labels: DataFrame, domain: Column, label_cols: list[str], per_label: int = 1500, id_col: str = "doc_id", text_col: str = "text",
) -> Domains:
    """Learn from at most ``per_label`` rows of each combination of ``label_cols`` (of ``docs`` or ``labels``), none held out."""
    require(docs, id_col, text_col)
    chosen = with_labels(docs, labels, learns(id_col), per_label, label_cols, id_col)
    rows = chosen.select(domain.alias("domain"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low")).where("domain is not null")
    counted = rows.select("domain", F.explode(word_pieces(F.col("low"))).alias("piece")).select("domain", F.explode(word_buckets(F.col("piece"))).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n"))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    hits = np.full((len(names), BUCKETS), 0.5)
    for r in counted.collect():  # at most domains x BUCKETS rows
        hits[names.index(r["domain"]), r["bucket"]] += r["n"]
    like = np.log(hits / hits.sum(1, keepdims=True)) if names else hits
    total = max(1, sum(sizes.values()))
    return Domains(names, np.array([log(sizes[x] / total) for x in names]), like - like.mean(0) if names else like)


def memberships(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and posterior (an array, in the order of the model's names).

    Evidence is the mean over the words times the root of their number, so that long texts stay soft. A null or empty text
    has no tokens and the prior as its posterior.
    """
    require(docs, text_col)
    out = docs.drop("n_tokens", "posterior").withColumn("__low", ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    tables = [literal(np.round(w, 6)) for w in model.weights]
    out = out.withColumn("__w", word_sums(F.col("__low"), tables))
    out = out.withColumn("n_tokens", F.col("__w.n"))

    def evidence(k: int) -> Column:
        return F.get("__w.sums", F.lit(k)) / F.sqrt(F.greatest("n_tokens", F.lit(1))) + F.lit(float(model.prior[k]))

    logits = F.array(*(evidence(k) for k in range(len(model.names))))
    out = out.withColumn("__z", logits)
    out = out.withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.array_max("__z"))))
    total = F.aggregate("__e", F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumn("posterior", F.transform("__e", lambda x: x / total)).drop("__low", "__w", "__z", "__e")


@dataclass
class Rates:
    steps: list[np.ndarray]
    reached: np.ndarray  # expected domain shares at the end
    wanted: np.ndarray

    @property
    def gap(self) -> float:
        """The largest difference between a share that was reached and the one that was wanted."""
        return float(np.abs(self.reached - self.wanted).max(initial=0.0))

    def column(self, posterior: str = "posterior") -> Column:
        return rate(self.steps, posterior)


def rate(steps: list[np.ndarray], posterior: str = "posterior") -> Column:
    """max(0, r - posterior . step) over the steps, from r = 1."""
    if not steps:
        return F.lit(1.0)
    k = len(steps[0])
    flat = literal(np.concatenate(steps))

    def move(acc: Column, s: Column) -> Column:
        dot = sum((F.get(flat, s * k + j) * F.get(posterior, F.lit(j)) for j in range(k)), F.lit(0.0))
        return F.greatest(F.lit(0.0), acc - dot)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), move)


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], budget: float = 1.0) -> Rates:
    """Rates for ``members`` (n_tokens, posterior) whose expected domain token totals are ``budget`` times the present total. A
    domain that ``targets`` does not name keeps its present share; the others split the rest as ``targets`` say. What the closest
    of ``STEPS`` steps reached is in the result; a warning tells where that is not the target."""
    k = len(names)
    named = np.array([x in targets for x in names], bool)
    wanted = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
    if not k:
        return Rates([], np.zeros(k), wanted)
    p = [F.get("posterior", F.lit(j)) for j in range(k)]
    t = F.col("n_tokens").cast("double")
    total = members.agg(F.sum(t)).first()[0] or 0.0
    if total <= 0:
        return Rates([], np.zeros(k), wanted)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    steps: list[np.ndarray] = []
    best: tuple[float, int, np.ndarray] | None = None
    for _ in range(STEPS):
        moving = F.col("r") > 0
        sums = [F.sum(F.col("r") * t * p[j]) for j in range(k)] + [F.sum(F.when(moving, t * p[i] * p[j])) for i, j in pairs]
        row = members.select("posterior", "n_tokens", rate(steps).alias("r")).agg(*(x.alias(f"s{n}") for n, x in enumerate(sums))).first()
        reached = np.array([row[f"s{j}"] or 0.0 for j in range(k)]) / total
        gram = np.zeros((k, k))
        for n, (i, j) in enumerate(pairs, k):
            gram[i, j] = gram[j, i] = (row[f"s{n}"] or 0.0) / total
        if not steps:
            wanted = np.where(named, wanted, reached)
            if wanted[named].sum() > 0:
                wanted[named] *= (1 - reached[~named].sum()) / wanted[named].sum()
            wanted *= budget
        gap = reached - wanted
        far = float(np.abs(gap).max())
        if best is None or far < best[0]:
            best = (far, len(steps), reached)
        if far < CLOSE:
            break
        steps.append(np.linalg.pinv(gram, rcond=1e-6, hermitian=True) @ gap)
    rates = Rates(steps[: best[1]], best[2], wanted)
    if rates.gap > TOLERANCE:
        warnings.warn(f"domain shares {np.round(best[2], 4).tolist()} instead of {np.round(wanted, 4).tolist()} for {names}", stacklevel=2)
    return rates


def with_copies(members: DataFrame, rates: Rates, id_col: str = "doc_id") -> DataFrame:
    """``members`` with rate and copies: the rate's whole part, and one more with the chance of the rest (by a hash of the id)."""
    chance = (F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    return members.withColumn("rate", rates.column()).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mix(docs: DataFrame, model: Domains, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` resampled: each row as often as its ``copies`` say, the columns unchanged.

    Memberships are computed once for the rates, from a table of ids' posteriors, and once for the rows that are returned.
    An empty table, or one without a word, comes back as it is. Null texts count as empty and have the prior as their posterior;
    rows with one id, or none, share the chance of one more copy. Columns of any name pass through.
    """
    members = memberships(docs.select(id_col, text_col), model, text_col).select("n_tokens", "posterior")
    rates = fit_rates(written(members, "mix-members"), model.names, targets)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The wall, a nondeterministic column, keeps the filter that explode implies above the copies: pushed below, it would take
    # the whole chain of expressions with it, once for each reference.
    made = with_copies(memberships(rows, model), rates, "id").select("row", "copies", F.monotonically_increasing_id().alias("__wall"))
    return made.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
