"""Peers by seeded random walks over the links: other entities that an entity's walks come by most often.

Every row's neighbours (parents and children, as of the anchor) are numbered once. A step draws a number by a hash of the seed, the
walk and the step and looks that neighbour up, so a row with very many neighbours costs a walk no more than one with a few, and the
walks are the same whenever and wherever they run. All walks of all entities take a step together.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExecutionFault
from ..functions.expressions import literal
from ..schema import Catalog
from .context import Policy, assemble, edges


def neighbours(catalog: Catalog, anchor: datetime | None) -> DataFrame:
    """(a, a_id, place, degree, b, b_id): each row's neighbours, numbered from 0."""
    links = edges(catalog)
    if anchor is not None:
        links = links.where(F.col("child_ts").isNull() | (F.col("child_ts") <= literal(anchor)))
    up = links.select(F.col("child").alias("a"), F.col("child_id").alias("a_id"), F.col("parent").alias("b"), F.col("parent_id").alias("b_id"))
    both = up.union(up.select("b", "b_id", "a", "a_id")).distinct()
    around = Window.partitionBy("a", "a_id")
    return both.withColumns({"place": F.row_number().over(around.orderBy("b", "b_id")) - 1, "degree": F.count("*").over(around)})


def walk_peers(cohort: DataFrame, catalog: Catalog, entity: str, anchor: datetime | None, policy: Policy = Policy(), most: int = 8) -> DataFrame:
    """(entity_id, peer_id, visits): the ``most`` peers with the most visits, ties by id. ``policy.num_walks`` walks of
    ``policy.walk_length`` steps start at each entity; one without a neighbour ends."""
    pk = catalog.schema.tables[entity].pk
    known = neighbours(catalog, anchor)
    degrees = known.where("place = 0").select("a", "a_id", "degree")
    next_to = known.drop("degree")
    at = cohort.select(F.col(pk).cast("string").alias("entity_id"), F.explode(F.sequence(F.lit(1), F.lit(policy.num_walks))).alias("walk")).select("entity_id", "walk", F.lit(entity).alias("tbl"), F.col("entity_id").alias("row_id"))
    seen = None
    for step in range(policy.walk_length):
        here = at.join(degrees, (F.col("tbl") == F.col("a")) & (F.col("row_id") == F.col("a_id"))).drop("a", "a_id")
        drawn = here.withColumn("drawn", F.pmod(F.xxhash64(F.lit(policy.seed), "entity_id", "walk", F.lit(step)), F.col("degree")))
        at = drawn.join(next_to, (F.col("tbl") == F.col("a")) & (F.col("row_id") == F.col("a_id")) & (F.col("drawn") == F.col("place")))
        at = at.select("entity_id", "walk", F.col("b").alias("tbl"), F.col("b_id").alias("row_id"))
        visits = at.where((F.col("tbl") == entity) & (F.col("row_id") != F.col("entity_id"))).select("entity_id", F.col("row_id").alias("peer_id"))
        seen = visits if seen is None else seen.union(visits)
    counted = seen.groupBy("entity_id", "peer_id").agg(F.count("*").alias("visits"))
    order = Window.partitionBy("entity_id").orderBy(F.desc("visits"), "peer_id")
    return counted.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def walking(cohort: DataFrame, catalog: Catalog, entity: str, anchor: datetime | None, policy: Policy = Policy()) -> DataFrame:
    """Contexts whose peers are those that walks come by, instead of the first by key; the entity's own part has at most
    ``policy.local_context_cells`` cells."""
    if anchor is None:
        raise ExecutionFault("walks need one anchor for all entities")
    peers = walk_peers(cohort, catalog, entity, anchor, policy, policy.cohort_size or 8)
    made = assemble(cohort, catalog, entity, anchor, replace(policy, cohort_size=0), peers)
    own = Window.partitionBy("entity_id", "anchor_ts", "is_focal").orderBy("hop", F.col("ts").desc_nulls_last(), "tbl", "row_id")
    cells = F.sum("n_cells").over(own)
    return made.withColumn("__own", cells).where((F.col("hop") == 0) | ~F.col("is_focal") | (F.col("__own") <= policy.local_context_cells)).drop("__own")
