"""What the operators of this subpackage share: the shared folder, stored tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import spread
from ..shipping import ship

#: Bytes of text that a Python worker splits into words at once.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may be without one (tests); a temporary folder is set there. On a cluster
    that is an error, as executors don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quietlake-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """What a stage makes on its way: stored tables and broadcasts, taken away when the stage's result is stored.

    Used as a context; it records what is made inside, and :meth:`clear` removes it. Without one
    nothing is recorded, and nothing is ever removed but what :func:`drop` names.
    """

    current: Scratch | None = None

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []
        self.broadcasts: list = []

    def __enter__(self) -> Scratch:
        self.outer, Scratch.current = Scratch.current, self
        return self

    def __exit__(self, *_) -> None:
        Scratch.current = self.outer

    def clear(self) -> None:
        for b in self.broadcasts:
            b.destroy()
        for p in self.paths:
            delete(self.spark, p)
        self.paths, self.broadcasts = [], []


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless it is to be kept, the stage's scratch takes it away."""
    path = f"{shared_dir(spark)}/quietlake/{name}-{uuid.uuid4().hex}"
    if Scratch.current is not None and not keep:
        Scratch.current.paths.append(path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: whatever is derived from the result survives a lost executor without
    recomputing what lies before, and two readers don't compute it twice.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, keep)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Remove tables that :func:`stored` made, once nothing that is still to be computed reads them."""
    for t in tables:
        if t is not None:
            delete(t.sparkSession, t.stored_at)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, which must be stored, to be sent to all executors if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def broadcast(spark: SparkSession, value):
    """A broadcast that ends with the stage's scratch."""
    b = spark.sparkContext.broadcast(value)
    if Scratch.current is not None:
        Scratch.current.broadcasts.append(b)
    return b


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through the Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of one Arrow batch between the JVM and a worker, where the session has Spark's own default.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches of whole texts."""
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


_kept: tuple[str, object] = ("", None)


def kept(key: str, make: Callable[[], object]):
    """What ``make`` returns, kept by this worker for later tasks until it is asked for another key.

    A worker serves one stage after another; only the last one's tables stay in its memory.
    """
    global _kept
    if _kept[0] != key:
        _kept = ("", None)
        trim()
        _kept = (key, make())
    return _kept[1]


def trim() -> None:
    """Give a worker's free memory back; the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``most`` bytes of text each, and their texts in UTF-8 (null: empty)."""
    texts = batch.column(batch.schema.get_field_index(column))
    start = size = 0
    got: list[bytes] = []
    for i, x in enumerate(texts.cast(pa.binary())):
        x = x.as_py() or b""
        got.append(x)
        size += len(x)
        if size >= most:
            yield batch.slice(start, i + 1 - start), got
            start, size, got = i + 1, 0, []
    if got:
        yield batch.slice(start), got


def map_text(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch, list[bytes]], list]], new: list[T.StructField]) -> DataFrame:
    """``df`` with new columns that ``make()(slice, texts)`` returns as lists or Arrow arrays.

    ``make`` is called once for each task. The other columns pass through unchanged.
    """
    prepare(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *new])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new]
        work = make()
        for batch in batches:
            trim()
            for part, texts in slices(batch, column):
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(work(part, texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch, list[bytes]], list]], new: list[T.StructField], condition: str) -> DataFrame:
    """Rows of ``df`` for which ``condition``, over the new columns of :func:`map_text`, holds.

    All columns of ``df`` are carried in one struct, so that no name of theirs can clash.
    """
    wrapped = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    return map_text(wrapped, "text", make, new).filter(condition).select("row.*")


def utf8_table(rule: Callable[[int], bytes]) -> bytes:
    """A table for bytes.translate from a rule for each byte."""
    return b"".join(rule(i) for i in range(256))


#: A-Z to a-z, all else as it is.
LOWER = utf8_table(lambda i: bytes([i + 32 if 65 <= i <= 90 else i]))
#: The same, and what is neither a digit, a letter nor a byte over 127 becomes a space.
WORDS = utf8_table(lambda i: bytes([i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32]))
