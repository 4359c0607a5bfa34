"""What a feature tells of a class: mutual information by nearest neighbours, and probabilities from margins.

No feature is ordered in one task: rows are put in order by ranges, numbered within them, and the counts of earlier
ranges are added; neighbours are looked up in chunks that carry a few rows of the next ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochflow.functions import kernels as K
from epochflow.operators.windows import chunked
from epochflow.sources.scratch import staged


def running_count(df: DataFrame, keys: list[str], order: list[str], counted: Column, out: str) -> DataFrame:
    """Adds how many rows up to each (itself included) are `counted` among those of its key, in an order of any type.

    The order must tell rows apart. Rows go to ranges of (keys, order); a range is ordered alone, and a row a key and
    range carries what earlier ranges hold.
    """
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    n = counted.cast("bigint")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_within", within).join(sums, [*keys, "_part"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on, as kernels.digamma."""
    small = F.array(*[F.lit(float(x)) for x in K.digamma(range(1, 16))])
    m = n.cast("double")
    series = F.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6) + 1 / (240 * m**8)
    return F.when(n < 16, F.element_at(small, F.greatest(n, F.lit(1)).cast("int"))).otherwise(series)


def mutual_information(df: DataFrame, feature: str, value: str, label: str, neighbours: int = 3, chunk: int = 10_000) -> DataFrame:
    """(feature, n, mi): nats that each feature tells of the label, as kernels.mutual_information, from one row a value.

    Null values and labels are left out, as are labels with a single value of a feature.
    """
    rows = df.select(F.col(feature).alias("f"), F.col(label).alias("y"), F.col(value).cast("double").alias("v")).where("f IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")
    rows = staged(rows, "values").withColumn("id", F.monotonically_increasing_id())
    sizes = rows.groupBy("f", "y").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    rows = rows.join(F.broadcast(sizes), ["f", "y"])  # a row a feature and class
    # The k-th neighbour of a value's class is among the k before and the k after it.
    placed = running_count(rows, ["f", "y"], ["v", "id"], F.lit(1), "i").withColumn("i", F.col("i") - 1)
    w = Window.partitionBy("f", "y", "chunk").orderBy("i")
    near = [F.struct(F.abs(x - F.col("v")).alias("d"), x.alias("u")) for j in range(1, neighbours + 1) for x in (F.lag("v", j).over(w), F.lead("v", j).over(w))]
    known = F.least(F.lit(neighbours).cast("bigint"), F.col("own") - 1)
    near = chunked(placed, "i", chunk, neighbours, neighbours).withColumn("near", F.array_sort(F.filter(F.array(*near), lambda s: s["u"].isNotNull()))).where("own")
    # chunked() names its mark of own rows `own`, so sizes are joined again by what was placed.
    near = near.drop("own", "chunk").join(F.broadcast(sizes), ["f", "y"])
    near = near.withColumn("k", known).withColumn("at", F.element_at("near", F.col("k").cast("int")))
    # Between these two bounds, both left out, lie the nearer values; a radius of 0 takes the equal ones.
    zero, u = F.col("at.d") == 0, F.col("at.u")
    low, high = F.when(u < F.col("v"), u).otherwise(F.col("v") - F.col("at.d")), F.when(u > F.col("v"), u).otherwise(F.col("v") + F.col("at.d"))
    events = F.array(
        F.struct(F.col("v").alias("x"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
        F.struct(F.when(zero, F.col("v")).otherwise(high).alias("x"), F.when(zero, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
        F.struct(F.when(zero, F.col("v")).otherwise(low).alias("x"), F.when(zero, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
    )
    events = near.select("f", "id", "k", "own", F.explode(events).alias("e")).select("f", "id", "k", "own", "e.*")
    counts = running_count(events, ["f"], ["x", "kind", "id"], F.col("kind") == 1, "c")
    inside = counts.groupBy("f", "id").agg(F.sum(F.col("sign") * F.col("c")).alias("m"), F.first("k").alias("k"), F.first("own").alias("own"))
    m = F.greatest(F.col("m"), F.lit(1))
    out = inside.groupBy(F.col("f").alias(feature)).agg(F.count(F.lit(1)).alias("n"), (F.avg(digamma(F.col("k"))) - F.avg(digamma(F.col("own"))) - F.avg(digamma(m))).alias("_d"))
    return out.select(feature, "n", F.greatest(F.lit(0.0), F.col("_d") + digamma(F.col("n"))).alias("mi"))


class MarginTable:
    """The sums that kernels.platt() asks for, each one aggregation over a table of margins."""

    def __init__(self, df: DataFrame, margin: str, positive: str):
        self.rows = df.select(F.col(margin).cast("double").alias("m"), F.col(positive).cast("boolean").alias("t")).where("m IS NOT NULL AND t IS NOT NULL")
        n, hits = self.rows.agg(F.count(F.lit(1)), F.count_if("t")).first()
        self.high, self.low = (hits + 1) / (hits + 2), 1 / (n - hits + 2)
        self.start = (0.0, math.log((n - hits + 1) / (hits + 1)))

    def __call__(self, a: float, b: float) -> tuple:
        z = F.lit(float(a)) * F.col("m") + F.lit(float(b))
        t, p = F.when(F.col("t"), self.high).otherwise(self.low), 1 / (1 + F.exp(F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
        rows = self.rows.select("m", z.alias("z"), t.alias("goal"), p.alias("p")).withColumns({"d1": F.col("goal") - F.col("p"), "d2": F.col("p") * (1 - F.col("p"))})
        loss = F.col("goal") * F.col("z") + F.greatest(-F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
        return tuple(x or 0.0 for x in rows.agg(F.sum(loss), F.sum(F.col("m") * F.col("d1")), F.sum("d1"), F.sum(F.col("m") ** 2 * F.col("d2")), F.sum("d2"), F.sum(F.col("m") * F.col("d2"))).first())


def platt(df: DataFrame, margin: str, positive: str) -> tuple[float, float]:
    """(a, b) of the probabilities 1 / (1 + exp(a * margin + b)); df should be written or kept, each Newton step reads it."""
    return K.platt(MarginTable(df, margin, positive))


def probability(margin: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * margin + F.lit(b)))
