"""Tables, written intermediate results and Arrow helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.operators.common import one_machine

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session already does: a batch of long texts is held several times by a task."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(2 << 20))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    short_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; set here only where it is unset on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cladeflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, executors may go.

    The shuffle files of the write are dropped with it, since nothing runs its plan again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cladeflow-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1 << 20     # rows of a few numbers each that may be broadcast once they have been counted


def light(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if a count proves them few; else they are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, forget: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``step`` to every Arrow batch; it returns the columns of ``schema`` by name.

    ``forget`` is called at the end of a task: workers are used again, and what one stage keeps is lost memory to the next.
    """
    kind = to_arrow(schema)
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    columns = step(batch)
                    yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in kind], schema=kind)
        finally:
            if forget:
                forget()

    return df.mapInArrow(run, schema)


def to_arrow(schema: str) -> pa.Schema:
    """Arrow form of a Spark schema string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one by one; null is empty."""
    for value in batch.column(name):
        yield value.as_py() or ""


def raw(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of the texts of a batch one by one; null is empty."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column) -> object:
    """Lower-case A-Z only, as a Spark expression."""
    return F.translate(column, UPPER, LOWER)
