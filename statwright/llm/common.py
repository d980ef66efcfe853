"""What the operators of this folder share: reading, word splitting, stages, fresh names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python read this class alike; a word is a run of characters outside it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row.

    An alias in a select is no guarantee: the optimizer may copy its expression
    into a lambda and so compute it again for every element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(key: str | Column, n: int) -> Column:
    """crc32 of the key's text, modulo ``n``: the split of labelled rows."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def held_out(key: str, n: int, bucket: int) -> Column:
    """Whether a row is in the held-out split; a null key is not."""
    return F.coalesce(bucket_of(key, n) == bucket, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one, but on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stages-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(df_or_path: DataFrame | str, spark: SparkSession):
    path = spark._jvm.org.apache.hadoop.fs.Path(df_or_path if isinstance(df_or_path, str) else df_or_path.stage_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand at most so many rows at once to Python; afterwards the session's own number holds again."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; its Python workers get at most ``rows`` at once.

    It cuts the lineage, survives lost executors, keeps columns prunable and
    gives the optimizer true sizes, which a checkpoint does not. A stage that nobody
    discards goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows) if rows else contextlib.nullcontext():
        df.write.parquet(path)
    fs, at = _path(path, spark)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Deletes written stages that nothing reads any more."""
    for df in stages:
        fs, path = _path(df, df.sparkSession)
        fs.delete(path, True)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a worker process gives the memory it no longer uses back to the system: workers wait for further tasks, beside other stages."""

    def then(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            del batches
            _release()

    return then


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a written stage take in memory: 16 a value, and the texts and arrays in them."""
    of = {"string": lambda c: F.octet_length(c), "array<string>": lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x) + 24)}
    extra = [F.coalesce(of[k](F.col(c)), F.lit(0)) for c, k in df.dtypes if k in of]
    one = F.lit(16 * (len(df.columns) + 1))
    for x in extra:
        one = one + x
    return df.agg(F.sum(one.cast("long"))).first()[0] or 0


def labelled_sample(labels: DataFrame, label: str, held: int, modulus: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out split, by hash order; a repeated id counts once, with its largest label."""
    return (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (bucket_of("id", modulus) != held))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(bound)
    )
