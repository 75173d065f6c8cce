"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a local folder is made and kept for the session.
    """
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docmill.scratch", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("docmill.scratch", at := f"file://{tempfile.mkdtemp(prefix='docmill-')}")
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only the running stage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing lazy reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._docmill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(c, UPPER, LOWER)


def fold(c: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(c.cast("string").cast("binary")) % modulus


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_fold(c: Column, modulus: int) -> Column:
    """Whether the id is in the held-out fold; a null id is not."""
    return F.coalesce(fold(c, modulus) == 0, F.lit(False))


def partition_keys(spark: SparkSession, parts: int, each: int = 1) -> list[int]:
    """``parts * each`` numbers, the k-th of which Spark's hash partitioning sends to partition k modulo ``parts``."""
    n = 32 * parts * (each + 2)
    placed = spark.range(n).select(F.pmod(F.hash("id"), F.lit(parts)).alias("p"), "id").groupBy("p").agg(F.slice(F.sort_array(F.collect_list("id")), 1, each).alias("ids"))
    found = {r["p"]: r["ids"] for r in placed.collect()}
    return [found[k % parts][k // parts] for k in range(parts * each)]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes unless the session sets its own: a worker holds whole texts of one batch at a time."""
    chosen = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")):
        if key not in chosen:
            spark.conf.set(key, value)


def sliced(batch, rows: int = 512):
    """A batch in slices of bounded rows, so that what is made of them stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def worker_store(owner: str) -> dict:
    """A dictionary that lives as long as the Python process: what one task of ``owner`` has read or built, its later tasks reuse.

    What another operator has left is dropped first: a reused worker holds the tables of one operator at a time.
    """
    module = sys.modules.setdefault("_docmill_worker", types.ModuleType("_docmill_worker"))
    held = vars(module).setdefault("held", {})
    if held.get("owner") != owner:
        held.clear()
        gc.collect()
        held["owner"] = owner
    return held


@contextmanager
def no_cycles():
    """Without the collector of cycles, for loops that make millions of small acyclic objects."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
