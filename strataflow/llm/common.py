"""Shared helpers of the training-data operators: table access, shared scratch space, Arrow maps."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent in local mode (tests) a temporary folder is made; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_own_shared_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that all of them see")
        found = "file://" + tempfile.mkdtemp(prefix="strataflow-")
        spark.sparkContext._own_shared_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_strataflow_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="strataflow-code-"), "strataflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    context._strataflow_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Before any map in Python: ship the code, and bound the rows of an Arrow batch, since whole texts are long. Spark bounds
    its bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > MAX_ROWS_PER_BATCH:
        spark.conf.set(key, str(MAX_ROWS_PER_BATCH))


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Python workers live on between tasks, several in one executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives its memory back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def free_name(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list[list]]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole texts, batch by batch, in Arrow.

    ``make()`` runs once per task and returns a function from a list of texts to one list per
    field. ``keep`` names the input columns that stay (all of them by default).
    """
    small_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(source.schema[c] for c in keep), *fields])
    kinds = [arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            at = batch.schema.get_field_index(text)
            new = work(batch.column(at).to_pylist())
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*old, *(v if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(new, kinds, strict=True))], names=names)

    return source.mapInArrow(lean(run), schema)


def as_bytes(text: str | None) -> bytes:
    """UTF-8; null is empty."""
    return text.encode() if text else b""


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzipped(packed: bytes) -> bytes:
    return pa.decompress(memoryview(packed)[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def shrunk(docs: DataFrame, keep: list[str], name: str = "z") -> DataFrame:
    """``keep`` and the compressed text: a text that must be shuffled costs two thirds of what it else does."""

    def make():
        return lambda texts: [[zipped(as_bytes(t)) for t in texts]]

    return map_text(docs, make, [T.StructField(name, T.BinaryType())], keep=keep)
