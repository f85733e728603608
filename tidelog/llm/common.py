"""Shared pieces of the training-data operators.

Nothing here depends on a machine-local folder of a cluster: intermediate
tables go to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the text contracts, as a Java / RE2 character class.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows handed to one Arrow batch; long texts stay far below a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound an Arrow batch by rows and bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a local session where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            folder = set_dir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="tidelog-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor doesn't take the table with it, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``durable`` wrote, once nothing will read it again."""
    _written.remove((df.sparkSession, df.durable_path))
    _delete(df.sparkSession, df.durable_path)


def forget() -> None:
    """Delete all tables that ``durable`` wrote, when their readers are done."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may be gone at exit
            return


atexit.register(forget)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_rest(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def by_size(texts: list, most: int):
    """Consecutive lists of texts with about ``most`` characters or bytes each."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
