"""Pieces that several operators share: checked columns, shared storage and native text normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session that sets none gets a fresh temporary one (tests); on a cluster
    that would be one machine's own folder, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the stored tables that are still there, oldest first.
_stored: list[str] = []


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The table is deleted by ``release``, at the latest when the application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)
    _stored.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; nothing that reads them may run afterwards."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _file_system(spark, path)
    files.delete(place, True)
    if path in _stored:
        _stored.remove(path)


def mark() -> int:
    """A point to give to ``release_since``."""
    return len(_stored)


def release_since(spark: SparkSession, point: int, but: DataFrame | None = None) -> None:
    """Delete every table stored after ``point``, except ``but``."""
    for path in _stored[point:]:
        if but is None or path != but.stored_at:
            remove(spark, path)


#: Stored bytes of an input for each partition of a shuffle of it, at most.
PARTITION_BYTES = 256 << 20
#: Sizes beyond this mean that Spark knows nothing.
UNKNOWN = 1 << 57


def partitions(spark: SparkSession, source: DataFrame | None = None) -> int:
    """Shuffle partitions: the session's number, or more where the tables that ``source`` reads are too large for it."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if source is None:
        return least
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(least, -(-sum(x for x in sizes if x < UNKNOWN) // PARTITION_BYTES))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column | str) -> Column:
    """``text`` with only A-Z lower-cased. lower() would also change other alphabets, so it is used on ASCII texts alone, where
    it is the same and quicker."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def learns(doc_id: Column | str, modulus: int = 4, held: int = 2) -> Column:
    """False for the held-out rows: those whose crc32(doc_id as text) mod ``modulus`` is ``held``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(col.cast("string").cast("binary")) % modulus) != held


def require(df: DataFrame, *names: str) -> None:
    """A clear error for missing columns; other columns are of no concern, whatever their names."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
