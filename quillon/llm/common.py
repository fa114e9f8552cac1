"""Shared helpers: staging tables in the cluster's shared folder, Arrow access to whole texts, checked broadcasts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of an Arrow batch; one longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
LOCAL_SHARED = "file:///tmp/checkpoints"
_paths: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker holds few whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of a shared store given to
    setCheckpointDir. Without either a local folder does where the driver runs all tasks (tests); on a cluster this raises."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and (made := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        scheme, _, rest = made.get().partition(":")
        given = made.get() if rest and scheme != "file" else None
    if not given:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = LOCAL_SHARED
    return given.rstrip("/")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet (with the writer's options) to the shared folder and read again: cuts lineage, survives lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _paths.append(path)
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Deletes the files of staged frames that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes what this process has staged (from the one numbered since on, but for keep); call it once no other frame made
    from it is needed. Returns the number."""
    kept = getattr(keep, "_staged_at", None)
    gone = [p for p in _paths[since:] if p != kept]
    _paths[since:] = [p for p in _paths[since:] if p == kept]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def n_staged() -> int:
    """How many tables are staged: the number of the next one."""
    return len(_paths)


def broadcast_below(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcasts df if a count proves at most max_rows rows; else leaves the join to Spark (shuffle, skew split)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared without case)."""
    return free(name, {c.lower() for c in df.columns})


def free(name: str, taken: set[str]) -> str:
    """name, with underscores until it isn't among the lower-cased names taken."""
    while name.lower() in taken:
        name += "_"
    return name


def texts(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each row's UTF-8 bytes; null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def arrow_map(df: DataFrame, columns: list[str], extra: str, fn, read: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns (DDL in extra) to df's columns; fn maps a RecordBatch of columns and read to arrays in extra's order.
    What is only read doesn't come back. A new column whose name is taken gets an underscore at its end."""
    only = [c for c in read if c not in columns]
    given = df.select(*[F.col(f"`{c}`") for c in [*columns, *only]])
    kept = StructType(given.schema.fields[: len(columns)])
    more = StructType.fromDDL(extra)
    taken = {f.name.lower() for f in kept.fields}
    names = [free(f.name, taken) for f in more.fields]
    schema = StructType([*kept.fields, *[StructField(n, f.dataType) for n, f in zip(names, more.fields, strict=True)]])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *fn(b)], names=[*b.schema.names[: len(columns)], *names])

    return given.mapInArrow(run, schema)


def spans_of(mask: np.ndarray) -> np.ndarray:
    """Starts and ends (exclusive) of runs of True, as an (n, 2) array."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)
