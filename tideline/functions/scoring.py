"""Model outputs to predictions: arithmetic on columns, for scorers that bring raw scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divides cosines before the softmax over classes.
TEMPERATURE = 0.1


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def decode(score: Column, mean: Column, std: Column) -> Column:
    """A regression score in units of the labels: a score of zero is the labels' mean."""
    return score * F.coalesce(std, F.lit(1.0)) + mean


def softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def class_by_cosine(feature: Column, classes: Column) -> Column:
    """Of an array of (name, vector) structs in order, the name with the largest cosine to ``feature``; ties to the first."""
    scored = F.transform(classes, lambda c, i: F.struct((-F.coalesce(cosine(feature, c["vector"]), F.lit(-2.0))).alias("d"), i.alias("i"), c["name"].alias("name")))
    return F.array_min(scored)["name"]


def class_probabilities(feature: Column, classes: Column) -> Column:
    return softmax(F.transform(classes, lambda c: cosine(feature, c["vector"]) / TEMPERATURE))


def top_k(candidates: Column, k: int) -> Column:
    """Ids of an array of (p, id) structs by p, ties in the array's order."""
    ranked = F.array_sort(F.transform(candidates, lambda c, i: F.struct((-c["p"]).alias("p"), i.alias("i"), c["id"].alias("id"))))
    return F.transform(F.slice(ranked, 1, k), lambda c: c["id"].cast("string"))
