"""Total orders over tables of any size: the places of all rows, and the row before each.

Rows are range-partitioned by the order's columns and stored, each with its part; numbers run within
a part, and what the parts before it hold is added from one small row for each part. No task sees
more than a part, unless rows tie in all the order's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.operators.shared import stored


def _parted(rows: DataFrame, order: list[Column]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ordered")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place in the order, from 1; the order should tell all rows apart."""
    parted = _parted(rows, order)
    sizes = parted.groupBy("__part").count()  # a row for each part
    before = sizes.select("__part", (F.sum("count").over(W.orderBy("__part")) - F.col("count")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return parted.join(F.broadcast(before), "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


def with_previous(rows: DataFrame, column: str, order: list[Column], name: str = "previous") -> DataFrame:
    """The rows with ``column`` of the row before in the order; null for the first."""
    parted = _parted(rows, order)
    place = F.struct(*order)
    last = parted.groupBy("__part").agg(F.max_by(F.struct(F.col(column).alias("v")), place).alias("last"))  # a row for each part
    carried = last.select("__part", F.lag("last").over(W.orderBy("__part")).alias("__carried"))
    w = W.partitionBy("__part").orderBy(*order)
    own = F.lag(F.struct(F.col(column).alias("v"))).over(w)
    return parted.join(F.broadcast(carried), "__part").withColumn(name, F.coalesce(own, "__carried")["v"]).drop("__part", "__carried")


JOINS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def _ends(parted: DataFrame, by: list[str], *totals: Column) -> DataFrame:
    """__part, __group and totals of the first and last group of each part: the only ones that go on in
    another part, two small rows for each part."""
    group = F.struct(*by)
    ends = parted.groupBy("__part").agg(F.min(group).alias("__lo"), F.max(group).alias("__hi"))
    own = parted.join(F.broadcast(ends), "__part").where(group.eqNullSafe(F.col("__lo")) | group.eqNullSafe(F.col("__hi")))
    return own.groupBy("__part", group.alias("__group")).agg(*totals)


def _met(parted: DataFrame, by: list[str], carried: DataFrame) -> DataFrame:
    small = F.broadcast(carried.withColumnRenamed("__part", "__at"))
    return parted.join(small, (F.col("__part") == F.col("__at")) & F.struct(*by).eqNullSafe(F.col("__group")), "left").drop("__at", "__group")


def spread(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows in parts by (by, order), for ``scan``: a group of any size lies over as many parts as it
    fills. ``order`` should tell the rows of a group apart."""
    return _parted(rows, [*map(F.col, by), *order])


def scan(parted: DataFrame, by: list[str], order: list[Column], value: Column, name: str, how: str = "max", before: bool = False, backward: bool = False) -> DataFrame:
    """``name``: the running max, min or sum of ``value`` in each group of ``spread`` rows, up to the row,
    or with ``before`` up to the row before it. Each part runs on its own; what the group held in the parts
    before is added from the small rows of these parts. ``backward`` runs from the end."""
    total, join = JOINS[how]
    rows = parted.withColumn("__value", value)
    place = F.desc("__part") if backward else F.asc("__part")
    past = W.partitionBy("__group").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    carried = _ends(rows, by, total("__value").alias("__total")).select("__part", "__group", total("__total").over(past).alias("__carried"))
    w = W.partitionBy("__part", *by).orderBy(*order)
    if backward:
        w = w.rowsBetween(int(before), W.unboundedFollowing)
    else:
        w = w.rowsBetween(W.unboundedPreceding, -int(before))
    met = _met(rows.withColumn("__running", total("__value").over(w)), by, carried)
    return met.withColumn(name, join(F.col("__carried"), F.col("__running"))).drop("__value", "__running", "__carried")


def scanned(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str, how: str = "max") -> DataFrame:
    """``spread`` and one ``scan``."""
    return scan(spread(rows, by, order), by, order, value, name, how).drop("__part")


def increasing(rows: DataFrame, by: list[str], order: list[Column], column: str) -> DataFrame:
    """``column`` made strictly increasing in each group: each value is at least one more than the one
    before. In place n of a group this is n and the running max of (value - n); a part knows its own
    places, and shifts them and the max by what the parts before it hold."""
    w = W.partitionBy("__part", *by).orderBy(*order)
    parted = spread(rows, by, order).withColumn("__n", F.row_number().over(w)).withColumn("__over", F.col(column) - F.col("__n"))
    ends = _ends(parted, by, F.count(F.lit(1)).alias("__count"), F.max("__over").alias("__best"))
    past = W.partitionBy("__group").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__shift", F.coalesce(F.sum("__count").over(past), F.lit(0)))
    ends = ends.select("__part", "__group", "__shift", F.max(F.col("__best") - F.col("__shift")).over(past).alias("__carried"))
    best = F.max("__over").over(w.rowsBetween(W.unboundedPreceding, 0))
    met = _met(parted.withColumn("__best", best), by, ends).withColumn("__shift", F.coalesce("__shift", F.lit(0)))
    value = F.greatest("__carried", F.col("__best") - F.col("__shift")) + F.col("__n") + F.col("__shift")
    return met.withColumn(column, value.cast("long")).drop("__part", "__n", "__over", "__best", "__shift", "__carried")


def first_two(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first two rows of each group."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("__n", n).where("__n <= 2").drop("__n")
