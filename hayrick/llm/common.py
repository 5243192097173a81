"""Small column helpers shared by the corpus operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hayrick.session import materialize

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of words as BIGINT; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def key_of(col: Column) -> Column:
    """A non-null text key for a nullable column, so that equi-joins keep null groups."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def water_fill(df: DataFrame, total: Column, cap: Column, weight: Column, by: list[str], out: str) -> DataFrame:
    """Share ``total`` by ``weight`` so that no row exceeds ``cap``, the excess going to the others by weight.

    With rows ordered by ``cap / weight`` and all earlier rows at their caps, the level a row would get
    is (total - earlier caps) / remaining weight; the true level is the largest of these.
    """
    order = Window.partitionBy(*by).orderBy(F.col("_ratio"), F.col("_weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    return (
        df.withColumns({"_total": total.cast("double"), "_cap": cap.cast("double"), "_weight": weight.cast("double")})
        .withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(F.lit(0.0)))
        .withColumn("_level", F.when(F.sum("_weight").over(onward) > 0, level))
        .withColumn("_level", F.max("_level").over(Window.partitionBy(*by)))
        .withColumn(out, F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_weight")), F.lit(0.0)))
        .drop("_total", "_cap", "_weight", "_ratio", "_level")
    )


def ranks(values: DataFrame, col: str) -> DataFrame:
    """(col, rank): the place of every distinct value in their order, from 0; null has none.

    Values are dealt by range and sorted within their range; each range is shifted by the number of values before it,
    so that no task sees them all.
    """
    placed = values.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col)
    placed = materialize(placed.select(col, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")), "ranks")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"))  # a row per range
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    return placed.join(F.broadcast(sizes.select("part", "low", before.alias("before"))), "part").select(col, (F.col("before") + F.col("m") - F.col("low")).cast("double").alias("rank"))


def few(df: DataFrame, col: str, rows: int = 100_000, most_bytes: int = 16 << 20) -> bool:
    """Whether a table of strings is small enough to be sent to every task."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(col))).first()
    return n <= rows and (size or 0) <= most_bytes


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver knows, as a DataFrame made inside the JVM (no Python worker is started)."""
    fields = T._parse_datatype_string(schema)
    text = json.dumps([dict(zip(fields.names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(fields))))
