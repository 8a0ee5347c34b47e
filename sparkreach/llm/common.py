"""What the training-data operators share: tables, shared storage, Arrow maps over whole texts."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where none is set and all is in one process (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


SCRATCH: list[str] = []  # folders of the operators at work on this driver, innermost last


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path in the innermost scratch folder, if there is one and the table need not outlive it."""
    folder = SCRATCH[-1] if SCRATCH and not lasting else f"{shared_dir(spark)}/tables"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in here go when it ends, but for lasting ones: what an operator returns must read those alone."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    try:
        yield
    finally:
        SCRATCH.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # the store's own delete, as Spark names no such call
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, codec: str = "zstd", lasting: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name, lasting)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, name: str, key: str, n: int) -> Iterator[DataFrame]:
    """df as a table in the shared folder, in n buckets of key, so that what joins it by key moves and it does not. The name goes at the end, the files stay."""
    path = new_path(df.sparkSession, name)
    table = f"{name}_{path[-32:]}"
    df.write.bucketBy(n, key).option("path", path).option("compression", "none").saveAsTable(table)
    try:
        yield df.sparkSession.table(table)
    finally:
        df.sparkSession.sql(f"DROP TABLE {table}")


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Each Arrow batch of `columns` as lists through make()'s function, whose lists become the columns of schema.

    make runs once a task, so tables that it builds are shared by the task's batches.
    """
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                got = f(*(b.column(i).to_pylist() for i in range(b.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, out.types, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def row_ids() -> Iterator[int]:
    """Numbers unique over the tasks of a stage; stable once the rows are written."""
    start = TaskContext.get().partitionId() << 40
    while True:
        yield start
        start += 1


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def veiled(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs' columns under names that clash with no operator's, and text beside them; the names, for unveiled."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    return docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)), docs["text"].alias("text")), names


def unveiled(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from those that veiled made of them."""
    return df.select(*(df[f"_in{i}"].alias(c) for i, c in enumerate(docs.columns)))
