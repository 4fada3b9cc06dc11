"""Linked tables: what a statement is bound against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import cache, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CatalogFault

NUMBER, TEXT, DATETIME, BOOLEAN = "NUMBER", "TEXT", "DATETIME", "BOOLEAN"


def value_type(kind: T.DataType) -> str | None:
    """The language's type of a Spark type; None for what is no value (arrays, maps, structs)."""
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return {T.StringType: TEXT, T.BooleanType: BOOLEAN}.get(type(kind))


@dataclass(frozen=True)
class Link:
    """child.fk = parent's key; ``feature``: the key's value is a feature too."""

    child: str
    fk: str
    parent: str
    feature: bool = False


@dataclass(frozen=True)
class Table:
    """A table: columns are features with their types; the key and foreign keys are none unless declared."""

    name: str
    columns: dict[str, str]
    pk: str | None = None
    time: str | None = None


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    links: list[Link] = field(default_factory=list)

    def table(self, name: str, columns: dict[str, str], pk: str | None = None, time: str | None = None) -> Schema:
        self.tables[name] = Table(name, dict(columns), pk, time)
        return self

    def link(self, child: str, fk: str, parent: str, feature: bool = False) -> Schema:
        self.links.append(Link(child, fk, parent, feature))
        return self

    def links_from(self, child: str) -> list[Link]:
        return [x for x in self.links if x.child == child]

    def links_between(self, child: str, parent: str) -> list[Link]:
        return [x for x in self.links if (x.child, x.parent) == (child, parent)]

    def foreign_keys(self, table: str) -> set[str]:
        return {x.fk for x in self.links_from(table)}


class Catalog:
    """The data behind a schema: for each table a DataFrame, or a function that gives it when it is first asked for."""

    def __init__(self, schema: Schema, frames: dict[str, DataFrame | Callable[[], DataFrame]]) -> None:
        self.schema, self.frames = schema, dict(frames)

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise CatalogFault(f"table {name} has no data")
        if not isinstance(self.frames[name], DataFrame):
            self.frames[name] = self.frames[name]()
        return self.frames[name]

    def rows(self, table: str, ids: list, anchor: object | None = None) -> DataFrame:
        """The rows with these keys, as of the anchor."""
        return self.bounded(table, anchor).where(F.col(self.schema.tables[table].pk).isin(*ids))

    def parents(self, link: Link) -> DataFrame:
        """The child's rows with ``__parent``: one row for each parent where the key is an array; rows without one are out."""
        df = self.frame(link.child)
        kind = df.schema[link.fk].dataType
        key = F.explode(link.fk) if isinstance(kind, T.ArrayType) else F.col(link.fk)
        return df.withColumn("__parent", key).where(F.col("__parent").isNotNull())

    def order_of(self, table: str) -> list[str]:
        """Columns that settle ties of time: the key, or all columns that can be compared."""
        spec = self.schema.tables[table]
        return [spec.pk] if spec.pk else [f.name for f in self.frame(table).schema if not isinstance(f.dataType, T.MapType)]

    def bounded(self, table: str, anchor: object | None) -> DataFrame:
        """The table's rows as of ``anchor`` (inclusive); rows without a time are always there."""
        df, time = self.frame(table), self.schema.tables[table].time
        if time is None or anchor is None:
            return df
        # written out: a datetime as a literal would be an instant in the driver's zone, and admit rows from after the anchor
        at = F.lit(anchor.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(anchor, datetime) else F.lit(anchor)
        return df.where(F.col(time).isNull() | (F.col(time) <= at))

    def dangling(self) -> DataFrame:
        """(child, fk, parent, n): rows of each link whose key has no parent."""
        parts = []
        for link in self.schema.links:
            pk = self.schema.tables[link.parent].pk
            parent = self.frame(link.parent).select(F.col(pk).alias("__parent"))
            lost = self.parents(link).join(parent, "__parent", "left_anti")
            parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(link.child).alias("child"), F.lit(link.fk).alias("fk"), F.lit(link.parent).alias("parent"), "n"))
        return reduce(DataFrame.union, parts)


def infer(frames: dict[str, DataFrame | T.StructType], keys: dict[str, str], times: dict[str, str], links: list[tuple[str, str, str]]) -> Schema:
    """A schema from the frames' types, or from types alone; keys and foreign keys are not features."""
    schema = Schema()
    for name, frame in frames.items():
        fields = frame if isinstance(frame, T.StructType) else frame.schema
        hidden = {keys.get(name)} | {fk for child, fk, _ in links if child == name}
        columns = {f.name: value_type(f.dataType) for f in fields if f.name not in hidden and value_type(f.dataType)}
        schema.table(name, columns, keys.get(name), times.get(name))
    for child, fk, parent in links:
        schema.link(child, fk, parent)
    return schema


#: The driver tables' keys, times and links.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id",
}
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
LINKS = [
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"),
    ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"), ("events", "user_id", "customer"),
]


#: The driver tables' columns: declared, so that reading them needs no pass over their files.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def shop_features() -> dict[str, dict[str, str]]:
    """Table -> feature -> type of the driver tables, without a session."""
    kinds = {"string": TEXT, "timestamp_ntz": DATETIME}
    keys = {t: {k} for t, k in KEYS.items()}
    for child, fk, _ in LINKS:
        keys.setdefault(child, set()).add(fk)
    pairs = {t: [x.split() for x in ddl.split(", ")] for t, ddl in COLUMNS.items()}
    return {t: {c: kinds.get(kind, NUMBER) for c, kind in cols if c not in keys.get(t, ())} for t, cols in pairs.items()}


@cache
def shop_schema() -> tuple[Schema, dict[str, T.StructType]]:
    types = {n: T.StructType.fromDDL(ddl) for n, ddl in COLUMNS.items()}
    return infer(types, KEYS, TIMES, LINKS), types


def shop(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of the shop tables below ``sf_dir``; a table is looked up when a statement needs it."""
    schema, types = shop_schema()
    return Catalog(schema, {n: partial(spark.read.schema(kind).parquet, f"{sf_dir}/{n}.parquet") for n, kind in types.items()})
