"""What the operators share: table access, the shared scratch folder, and bounded Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of characters other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts handed to a Python worker at once; texts can be long, so few.
ROWS_PER_BATCH = 256

#: Bits of the filter on ids in parted_by_ids().
FILTER_BITS = 1 << 23

#: What empties the memory that an operator keeps in a worker, by the operator's name.
CACHES: dict[str, Callable[[], object]] = {}

_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def _forget_others(name: str) -> None:
    for other, forget in CACHES.items():
        if other != name:
            forget()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(name: str = ""):
    """A decorator of kernels over Arrow batches, for workers that run one operator after another.

    A kernel first empties what operators other than `name` keep in the worker, and gives free memory back to the system
    when its partition ends: allocators would hold it for as long as the worker lives.
    """

    def of(kernel):
        @functools.wraps(kernel)
        def run(*args):
            _forget_others(name)
            try:
                yield from kernel(*args)
            finally:
                _give_back()

        return run

    return of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark (the folder may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Whole texts go to Python in small batches, so that a worker's memory doesn't depend on the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder, kept for the process, and a cluster its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            if not _local:
                _local.append("file://" + tempfile.mkdtemp(prefix="rasterlake-"))
            found = _local[0]
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rasterlake"
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here and lost executors cost nothing.

    The files are deleted when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(discard_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard_all() -> None:
    """Delete what materialize() wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session or its JVM may be gone already at exit
            continue


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parted_by_ids(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, all other rows) of df; ids is a table of one column, nulls allowed.

    A filter of fixed size (FILTER_BITS, 1 MB) over hashes of the ids is broadcast, so that rows without them need no
    shuffle to be joined with what belongs to the ids. It lets some others through: the join decides.
    """
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(FILTER_BITS)).cast("int").alias("p")
    words = ids.select(place).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("m")).toArrow()
    mask = np.zeros(FILTER_BITS // 64, np.int64)
    mask[words["w"].to_numpy()] = words["m"].to_numpy()
    shared = spark.sparkContext.broadcast(mask)

    @F.arrow_udf("boolean")
    def maybe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in batches:
            at = p.to_numpy(zero_copy_only=False)
            yield pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    (flag,) = fresh(df, "maybe")
    marked = df.withColumn(flag, maybe(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS)).cast("int")))
    return marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
