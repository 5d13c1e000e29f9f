"""Plumbing that the operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shipped

#: Rows per Arrow batch. Texts are long, so batches are short; Python workers
#: then hold a few MB of text at a time whatever the partition size.
BATCH_ROWS = 256


#: A key with more than this share of a table's rows is hot; there are at most
#: 1 / HOT such keys in any table, so they may be broadcast.
HOT = 1e-4


def session(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches for the Python operators of this session, and let the
    shuffle files of a step go when the step has ended."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return shipped(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor sees.

    Where the setting is absent (tests, a laptop) the session gets a folder of
    its own below the warehouse; a master that is not local is refused then, as
    its executors would not see it. What is left when the driver ends goes.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    own = f"{base.rstrip('/')}/tapeworks/{spark.sparkContext.applicationId}"
    if own not in _LEFT:
        _LEFT.add(own)
        atexit.register(_leave, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


_LEFT: set[str] = set()


def _leave(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone before
        discard(spark, path)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage: write Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``stored`` wrote, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, whose keys are unique; null where it
    has none. A key may hold any share of ``left``: hot ones (see ``HOT``) get
    their row by broadcast, the others by a shuffle in which none is large. Both
    sides must be stored tables; a null key finds nothing."""
    total = left.count()
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > F.lit(total * HOT)).where(F.col(key).isNotNull()).select(key)
    hot = stored(right.join(F.broadcast(hot), key, "left_semi").withColumn("__hot", F.lit(True)))
    extra = [c for c in right.columns if c != key]
    some = left.join(F.broadcast(hot.select(key, "__hot")), key, "left")
    # Rows without a key would meet in one task, so they take the first way as well.
    first = some.where(F.col("__hot") | F.col(key).isNull()).drop("__hot").join(F.broadcast(hot.drop("__hot")), key, "left")
    rest = some.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot").join(right, key, "left")
    return first.select(*left.columns, *extra).unionByName(rest.select(*left.columns, *extra))


def pieces(rows: dict[str, pa.Array], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Equal-length columns as record batches of a bounded size."""
    whole = pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)


def with_columns(df: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns of these names, and its schema with them added:
    an operator's own output replaces an input column of the same name."""
    df = df.drop(*kinds)
    return df, T.StructType([*df.schema, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items())])
