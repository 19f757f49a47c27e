"""What the operators of this subpackage share: inputs, the shared folder and written intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources.files import new_path

#: Prefix of helper columns; a table's own columns are never so named.
OWN = "__gl_"
#: Bits of the map of a sieve.
SIEVE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._gl_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no one will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "_gl_path", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def sieved(rows: DataFrame, column: Column, wanted: DataFrame, wanted_column: Column) -> DataFrame:
    """The rows whose 64-bit hash may be among those of a table; it keeps others out of an exchange.

    The table's hashes set bits of a map of ``SIEVE`` bits, whatever its size, so at most SIEVE / 64 rows
    are broadcast. What passes by chance is left to the join that follows.
    """
    bit = lambda c: F.pmod(c, F.lit(SIEVE))
    place = lambda b: (b.bitwiseAND(F.lit(63))).cast("int")
    here = wanted.select(bit(wanted_column).alias("b"))
    bits = here.groupBy(F.shiftright("b", 6).alias(f"{OWN}w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("b")))).alias(f"{OWN}bits"))
    marked = rows.withColumn(f"{OWN}b", bit(column))
    met = marked.join(F.broadcast(bits), F.shiftright(f"{OWN}b", 6) == F.col(f"{OWN}w"))
    return met.where(F.call_function("shiftrightunsigned", F.col(f"{OWN}bits"), place(F.col(f"{OWN}b"))).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small local table; also for no rows."""
    return spark.createDataFrame(rows, schema)
