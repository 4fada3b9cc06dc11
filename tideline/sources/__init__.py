"""Catalogs from files and other stores, and results to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Catalog, Schema, infer


def read_tables(
    spark: SparkSession, paths: dict[str, str], keys: dict[str, str], times: dict[str, str], links: list[tuple[str, str, str]],
    format: str = "parquet", schemas: dict[str, str] | None = None, schema: Schema | None = None, **options: str,
) -> Catalog:
    """A catalog of tables in any format that Spark reads; ``schemas`` (DDL) spares text formats an inference pass."""
    frames = {}
    for name, path in paths.items():
        reader = spark.read.format(format).options(**options)
        frames[name] = (reader.schema(schemas[name]) if schemas and name in schemas else reader).load(path)
    return Catalog(schema or infer(frames, keys, times, links), frames)


def read_jdbc(spark: SparkSession, url: str, tables: list[str], keys: dict[str, str], times: dict[str, str], links: list[tuple[str, str, str]], **options: str) -> Catalog:
    frames = {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in tables}
    return Catalog(infer(frames, keys, times, links), frames)


def bucketed(catalog: Catalog, table: str, fk: str, buckets: int, name: str | None = None) -> DataFrame:
    """The child table stored by foreign key and time: later joins and groupings on the key need no shuffle."""
    spec, df = catalog.schema.tables[table], catalog.frame(table)
    name = name or f"{table}_by_{fk}"
    order = [fk, *([spec.time] if spec.time else [])]
    df.write.mode("overwrite").bucketBy(buckets, fk).sortBy(*order).saveAsTable(name)
    catalog.frames[table] = df.sparkSession.table(name)
    return catalog.frames[table]


def write_predictions(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    df.write.format(format).mode(mode).options(**options).save(path)
