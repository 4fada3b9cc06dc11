"""Contexts: the bounded, time-safe neighbourhood of each entity over the links, hop by hop.

The links that a hop can reach are seen as one table of edges, so a hop is one join whatever the schema; what rows hold is looked up at
the end.
Parents of a row are always followed; children newest first, up to the policy's fan-out. Every row is checked against the
entity's anchor at every hop. Rows without a key are named by a hash of all their columns: equal rows are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import literal
from ..schema import Catalog, Link
from .aggregates import ANCHOR

#: A context row: its place, the row and what it holds.
COLUMNS = ["entity_id", "anchor_ts", "tbl", "row_id", "hop", "ts", "is_focal", "cells", "parents", "n_cells"]


#: Parents that a row of a context carries, the first links by declaration.
MOST_PARENTS = 5


@dataclass(frozen=True)
class Policy:
    """Limits of a context. ``cohort_size`` peers: other rows of the entity's table, the first by key. The walking traversal
    reads ``num_walks``, ``walk_length``, ``seed`` and ``local_context_cells`` as well."""

    max_context_cells: int = 2048
    local_context_cells: int = 256
    bfs_width: int = 32
    max_hops: int = 2
    cohort_size: int = 0
    seed: int = 0
    num_walks: int = 10_000
    walk_length: int = 20
    num_history_windows: int = 3


def row_id(catalog: Catalog, table: str) -> Column:
    spec, df = catalog.schema.tables[table], catalog.frame(table)
    if spec.pk:
        return F.col(spec.pk).cast("string")
    return F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")


def nodes(catalog: Catalog, table: str) -> DataFrame:
    """(tbl, row_id, ts, cells, parents, n_cells): cells are the declared features that are there, parents the keys by column."""
    spec = catalog.schema.tables[table]
    cells = [c for c in spec.columns if c != spec.pk]
    links = catalog.schema.links_from(table)
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cells]
    pairs += [F.struct(F.lit(x.fk).alias("key"), F.col(x.fk).cast("string").alias("value")) for x in links if x.feature]
    keys = [F.struct(F.lit(x.fk).alias("key"), F.col(x.fk).cast("string").alias("value")) for x in links]
    none = F.expr("cast(map() as map<string,string>)")
    keys = keys[:MOST_PARENTS]
    there = lambda xs: F.map_from_entries(F.filter(F.array(*xs), lambda x: x["value"].isNotNull())) if xs else none
    time = F.col(spec.time).cast("timestamp_ntz") if spec.time else F.lit(None).cast("timestamp_ntz")
    # counted from the columns: who reads no cells makes no maps
    n_cells = sum((x["value"].isNotNull().cast("long") for x in pairs), F.lit(0).cast("long"))
    return catalog.frame(table).select(
        F.lit(table).alias("tbl"), row_id(catalog, table).alias("row_id"), time.alias("ts"), there(pairs).alias("cells"), there(keys).alias("parents"), n_cells.alias("n_cells"),
    )


def edges(catalog: Catalog, links: list[Link] | None = None) -> DataFrame:
    """(child, child_id, child_ts, parent, parent_id, link) over all links, or those given."""
    parts = []
    for link in catalog.schema.links if links is None else links:
        spec = catalog.schema.tables[link.child]
        time = F.col(spec.time).cast("timestamp_ntz") if spec.time else F.lit(None).cast("timestamp_ntz")
        parts.append(
            catalog.parents(link).select(
                F.lit(link.child).alias("child"), row_id(catalog, link.child).alias("child_id"), time.alias("child_ts"),
                F.lit(link.parent).alias("parent"), F.col("__parent").cast("string").alias("parent_id"), F.lit(f"{link.child}.{link.fk}").alias("link"),
            )
        )
    return reduce(DataFrame.union, parts)


def children(catalog: Catalog, table: str, fk: str, keys: DataFrame, anchor: datetime | None, limit: int) -> DataFrame:
    """The newest ``limit`` child rows of each key (column ``key``), as of the anchor; undated rows last, ties by key."""
    link = next(x for x in catalog.schema.links_from(table) if x.fk == fk)
    spec = catalog.schema.tables[table]
    rows = catalog.parents(link).join(keys, F.col("__parent") == F.col("key"), "left_semi")
    if spec.time and anchor is not None:
        rows = rows.where(F.col(spec.time).isNull() | (F.col(spec.time) <= literal(anchor)))
    newest = ([F.col(spec.time).desc_nulls_last()] if spec.time else []) + [F.col(c) for c in catalog.order_of(table)]
    place = F.row_number().over(Window.partitionBy("__parent").orderBy(*newest))
    return rows.withColumn("place", place).where(F.col("place") <= limit).withColumnRenamed("__parent", "parent_id")


def seeds(cohort: DataFrame, entity: str, pk: str, anchor: datetime | None) -> DataFrame:
    at = F.col(ANCHOR) if anchor is None and ANCHOR in cohort.columns else literal(anchor) if anchor else F.lit(None)
    return cohort.select(F.col(pk).cast("string").alias("entity_id"), at.cast("timestamp_ntz").alias("anchor_ts"), F.lit(entity).alias("tbl"), F.col(pk).cast("string").alias("row_id"))


def reached(catalog: Catalog, entity: str, hops: int) -> list[set[str]]:
    """The tables in which rows can be at 0, 1, ... ``hops`` steps from an entity."""
    out = [{entity}]
    for _ in range(hops):
        at = out[-1]
        out.append({x.parent for x in catalog.schema.links if x.child in at} | {x.child for x in catalog.schema.links if x.parent in at})
    return out


def stored(catalog: Catalog, tables: set[str], entity: str, anchor: datetime | None) -> DataFrame:
    """Nodes of ``tables`` that a context may hold: those of one anchor are as of it, but for the entity's own table, whose seeds stay."""

    def of(table: str) -> DataFrame:
        made = nodes(catalog, table)
        return made if anchor is None or table == entity else made.where(F.col("ts").isNull() | (F.col("ts") <= literal(anchor)))

    return reduce(DataFrame.unionByName, [of(t) for t in catalog.schema.tables if t in tables])


def newest_children(catalog: Catalog, anchor: datetime | None, width: int, links: list[Link] | None = None) -> DataFrame:
    """Edges from each row to its newest children as of the one anchor, ``width`` + 1 of each link at most, with their place."""
    found = edges(catalog, links)
    if anchor is not None:
        found = found.where(F.col("child_ts").isNull() | (F.col("child_ts") <= literal(anchor)))
    newest = Window.partitionBy("parent", "parent_id", "link").orderBy(F.col("child_ts").desc_nulls_last(), "child_id")
    return found.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= width + 1)


def moves(catalog: Catalog, tables: set[str], anchor: datetime | None, shared: bool, width: int, last: bool) -> DataFrame | None:
    """(tbl, row_id, to, to_id, to_ts, link, __n) from rows of ``tables`` to parents (link null) and children (cut to the fan-out if
    all have one anchor). Parents have to be there and have their time, but after the ``last`` step, where rows are looked up anyway."""
    above = [x for x in catalog.schema.links if x.child in tables]
    below = [x for x in catalog.schema.links if x.parent in tables]
    parts = []
    if above:
        up = edges(catalog, above).select(F.col("child").alias("tbl"), F.col("child_id").alias("row_id"), F.col("parent").alias("to"), F.col("parent_id").alias("to_id"))
        if last:
            up = up.withColumn("to_ts", F.lit(None).cast("timestamp_ntz"))
        else:
            there = [nodes(catalog, t).select(F.col("tbl").alias("to"), F.col("row_id").alias("to_id"), F.col("ts").alias("to_ts")) for t in sorted({x.parent for x in above})]
            up = up.join(reduce(DataFrame.union, there), ["to", "to_id"])
        parts.append(up.select("tbl", "row_id", "to", "to_id", "to_ts", F.lit(None).cast("string").alias("link"), F.lit(0).alias("__n")))
    if below:
        down = newest_children(catalog, anchor, width, below) if shared else edges(catalog, below).withColumn("__n", F.lit(0))
        parts.append(down.select(F.col("parent").alias("tbl"), F.col("parent_id").alias("row_id"), F.col("child").alias("to"), F.col("child_id").alias("to_id"), F.col("child_ts").alias("to_ts"), "link", "__n"))
    return reduce(DataFrame.union, parts) if parts else None


def assemble(cohort: DataFrame, catalog: Catalog, entity: str, anchor: datetime | None, policy: Policy = Policy(), peers: DataFrame | None = None) -> DataFrame:
    """The contexts of ``cohort``: COLUMNS and ``truncated``, how often a fan-out cut children off in that context.

    A hop reads the links and tables that it can reach from the entity, no others. With one anchor for all, children are cut to the
    fan-out before any entity meets them, so a row with very many children costs no more than one with a few. With an anchor each,
    children are cut for each anchor. Kept within max_context_cells by (hop, newest, table, row); the entity's own row always stays.
    ``peers``: (entity_id, peer_id) that join at hop 1 beside or instead of the first ``cohort_size`` by key.

    Rows on their way have one ``mark``: 1 if focal. A child that was cut off leaves a row of no table (tbl ''), named by the entity so
    that such rows spread, whose mark counts. One column for both keeps a frontier's shuffle the same for all who read it.
    """
    pk = catalog.schema.tables[entity].pk
    shared = ANCHOR not in cohort.columns or anchor is not None
    own = seeds(cohort, entity, pk, anchor)
    found = own.withColumns({"hop": F.lit(0), "mark": F.lit(1).cast("long"), "step": F.lit(0)})
    others = None
    if policy.cohort_size:
        some = catalog.frame(entity).select(F.col(pk).cast("string").alias("row_id")).orderBy("row_id").limit(policy.cohort_size + 1)
        # cohort_size + 1 rows at most
        near = own.drop("row_id").withColumn("__e", F.col("entity_id")).join(F.broadcast(some), F.col("__e") != F.col("row_id")).drop("__e")
        rank = F.row_number().over(Window.partitionBy("entity_id", "anchor_ts").orderBy("row_id"))
        others = near.withColumn("__n", rank).where(F.col("__n") <= policy.cohort_size).drop("__n")
    if peers is not None:
        near = own.drop("row_id").join(peers.select(F.col("entity_id").cast("string").alias("entity_id"), F.col("peer_id").cast("string").alias("row_id")), "entity_id")
        others = near if others is None else others.unionByName(near)
    if others is not None:
        found = found.unionByName(others.distinct().withColumns({"hop": F.lit(1), "mark": F.lit(0).cast("long"), "step": F.lit(0)}))
    known = ["entity_id", "anchor_ts", "tbl", "row_id"]
    frontier = found.select(*known, "mark")
    tables = reached(catalog, entity, policy.max_hops)
    for hop in range(1, policy.max_hops + 1):
        last = hop == policy.max_hops
        ways = moves(catalog, tables[hop - 1], anchor, shared, policy.bfs_width, last)
        if ways is None:
            break
        went = frontier.join(ways, ["tbl", "row_id"]).where(F.col("to_ts").isNull() | F.col("anchor_ts").isNull() | (F.col("to_ts") <= F.col("anchor_ts")))
        if not shared:
            newest = Window.partitionBy("entity_id", "anchor_ts", "tbl", "row_id", "link").orderBy(F.col("to_ts").desc_nulls_last(), "to_id")
            went = went.withColumn("__n", F.when(F.col("link").isNotNull(), F.row_number().over(newest)).otherwise(0)).where(F.col("__n") <= policy.bfs_width + 1)
        over = F.col("__n") > policy.bfs_width
        went = went.select(
            "entity_id", "anchor_ts", F.when(over, F.lit("")).otherwise(F.col("to")).alias("tbl"), F.when(over, F.col("entity_id")).otherwise(F.col("to_id")).alias("row_id"),
            F.when(over, F.lit(1)).otherwise(F.col("mark")).alias("mark"),
        )
        if last:  # what was known before, and rows reached twice, go where the rows are looked up
            frontier = went
        else:
            before = found.where("tbl <> ''").select(*(F.col(c).alias(f"__{c}") for c in known))
            fresh = went.join(before, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in known]), "left_anti")
            fresh = fresh.groupBy(*known).agg(F.max("mark").alias("__max"), F.sum("mark").alias("__sum"))
            frontier = fresh.select(*known, F.when(F.col("tbl") == "", F.col("__sum")).otherwise(F.col("__max")).alias("mark")).where("row_id IS NOT NULL")
        found = found.unionByName(frontier.withColumns({"hop": F.lit(hop), "step": F.lit(hop)}))
    rows = found.join(stored(catalog, set().union(*tables), entity, anchor), ["tbl", "row_id"], "left")
    in_time = F.col("n_cells").isNotNull() & ((F.col("step") == 0) | F.col("ts").isNull() | F.col("anchor_ts").isNull() | (F.col("ts") <= F.col("anchor_ts")))
    # all windows from here on, and those of what reads a context, are within an entity
    rows = rows.where((F.col("tbl") == "") | in_time).repartition("entity_id")
    same = Window.partitionBy("entity_id", "anchor_ts", "tbl", "row_id").orderBy("step", "hop", F.desc("mark"), "ts")
    cut = F.sum(F.when(F.col("tbl") == "", F.col("mark")).otherwise(0)).over(Window.partitionBy("entity_id", "anchor_ts"))
    # a table without a declared key may hold equal rows under one name; they are interchangeable, and one is taken
    rows = rows.withColumn("__same", F.row_number().over(same)).withColumn("truncated", cut).where("__same = 1 AND tbl <> ''").withColumn("is_focal", F.col("mark") == 1)
    order = Window.partitionBy("entity_id", "anchor_ts").orderBy("hop", F.col("ts").desc_nulls_last(), "tbl", "row_id")
    rows = rows.withColumn("__sum", F.sum("n_cells").over(order)).where((F.col("hop") == 0) | (F.col("__sum") <= policy.max_context_cells))
    return rows.select(*COLUMNS, "truncated")


def report(context: DataFrame) -> DataFrame:
    """(tbl, n_rows, n_cells, min_ts, max_ts) over all contexts."""
    return context.groupBy("tbl").agg(
        F.count("*").alias("n_rows"), F.sum("n_cells").alias("n_cells"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


def health(context: DataFrame, tables: list[str]) -> list[str]:
    """Warnings about contexts: half or more cut off, one table with 60 % of 256 cells or more, tables without a cell."""
    per_entity = context.groupBy("entity_id").agg((F.max("truncated") > 0).alias("cut"))
    row = per_entity.agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("int")).alias("cut")).first()
    cells = {r["tbl"]: r["n_cells"] for r in report(context).collect()}
    total = sum(cells.values())
    out = []
    if row["n"] and 2 * (row["cut"] or 0) >= row["n"]:
        out.append(f"{row['cut']} of {row['n']} contexts were cut off")
    out += [f"{t} holds {n} of {total} cells" for t, n in sorted(cells.items()) if total >= 256 and n >= 0.6 * total]
    return out + [f"no cell of {t} is in any context" for t in tables if not cells.get(t)]
