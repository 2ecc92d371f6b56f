"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and small column helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.shared import shared_dir

#: The six characters of [\x20\x09-\x0D].
BLANKS = r"[\x20\x09-\x0D]"

_cleanup: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver ends, or by `forget`."""
    path = f"{shared_dir(spark)}/stratalog-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _cleanup:
        atexit.register(_forget_all)
    _cleanup.add(path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _cleanup.discard(path)


def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_cleanup) if spark is not None else []:
        try:
            forget(spark, path)
        except Exception:  # the session may be half closed by now; the folder is a scratch one
            return


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    files: write no more files than these, for small tables under many shuffle partitions; each file costs a task and,
    on local disks, processes that set its mode.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if files is None else df.coalesce(max(1, files))).write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stratalog_path = path
    return back


def done_with(df: DataFrame) -> None:
    """Remove the files of a materialised table that no later plan reads."""
    path = getattr(df, "_stratalog_path", None)
    if path:
        forget(df.sparkSession, path)


def text_of(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name like this one that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def salt_of(key: Column, salts: int) -> Column:
    """The same salt for the same key at every evaluation, on any partitioning."""
    return F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(salts)).cast("int")


def salt_bit(salt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), salt)


def salts_in(mask: Column, salts: int) -> Column:
    """The salts whose bits are set, as an array of ints."""
    return F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0 teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
