"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Values of a column up to which one aggregate may hold a group's distinct ones.
IN_ONE_TASK = 5_000_000


def by_group(rows: DataFrame, group: str | None, values: dict[str, list[float]], most: int = IN_ONE_TASK) -> DataFrame:
    """group (if any) and for each column of `values` an array of its quantiles, linear between ranks; nulls left out.

    Few values are counted per distinct one and sorted by group. More are sorted over ranges: counts per range and group tell in which range a rank lies, and only there rows
    are numbered, so no task holds more than a range's rows of one group, however large the group. Both ways give the same numbers, to the last bit those of SQL."""
    few = rows.count() <= most
    out = rows.select(group).distinct() if group else None
    for c, ps in values.items():
        part = rows.where(F.col(c).isNotNull()).select(*([group] if group else []), F.col(c).cast("double").alias("v"))
        one = (_counted if few else _over_ranges)(part, group, ps).withColumnRenamed("q", c)
        if out is None:
            out = one
        elif group:
            out = out.alias("o").join(one.withColumnRenamed(group, "_g"), F.col(f"o.{group}").eqNullSafe(F.col("_g")), "left").drop("_g")
        else:
            out = out.crossJoin(one)  # one row each
    return out


def between(a: Column, b: Column, share: Column) -> Column:
    """a (1 - share) + b share, the first product and the sum rounded once only, as SQL has it: neighbours that differ in their last bit alone otherwise give
    a quantile on the other side of one of them, and all posts of that velocity another state. The product's rounding error is found by Dekker's split, the sum's by Knuth."""
    w, c = 1 - share, b * share
    big = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p = a * w
    ah, wh = big(a), big(w)
    al, wl = a - ah, w - wh
    lost = ((ah * wh - p) + ah * wl + al * wh) + al * wl
    s = p + c
    # equal neighbours too: of a group of a few values SQL's quantile may miss them by a last bit
    return s + (((p - (s - (s - p))) + (c - (s - p))) + lost)


def _counted(rows: DataFrame, group: str | None, ps: list[float]) -> DataFrame:
    g = F.col(group) if group else F.lit(0)
    per = rows.groupBy(g.alias("g"), "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g")
    per = per.withColumn("end", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.sum("c").over(w) - 1)
    at = [F.lit(p) * F.col("last") for p in ps]
    held = lambda rank: F.max(F.when((F.col("end") > rank) & (F.col("end") - F.col("c") <= rank), F.col("v")))
    got = per.groupBy("g").agg(F.max("last").alias("last"), *[held(f(x)).alias(f"{k}{i}") for i, x in enumerate(at) for k, f in (("a", F.floor), ("b", F.ceil))])
    got = got.select("g", F.array(*[between(F.col(f"a{i}"), F.col(f"b{i}"), x - F.floor(x)) for i, x in enumerate(at)]).alias("q"))
    if group:
        return got.withColumnRenamed("g", group)
    return got.agg(F.first("q").alias("q"))  # a row also without any value


def _over_ranges(rows: DataFrame, group: str | None, ps: list[float]) -> DataFrame:
    key = F.col(group) if group else F.lit(0)
    spread = materialize(rows.repartitionByRange("v").select(key.alias("g"), "v", F.spark_partition_id().alias("part")))
    sizes = spread.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range and group
    w = Window.partitionBy("g")
    sizes = materialize(sizes.withColumn("before", F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(w)))
    want = sizes.select("g", "part", "n", "before", "total", F.posexplode(F.array(*map(F.lit, ps))).alias("k", "p")).withColumn("at", F.col("p") * (F.col("total") - 1))
    want = want.select("g", "part", "n", "before", "k", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).withColumn("local", F.col("rank") - F.col("before"))
    want = materialize(want.select("g", "part", "k", "at", "rank", "local").distinct())
    here = spread.join(want.select("g", "part").distinct(), ["g", "part"]).withColumn("local", F.row_number().over(Window.partitionBy("g", "part").orderBy("v")) - 1)
    got = here.join(want, ["g", "part", "local"]).groupBy("g", "k").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"), F.first("at").alias("at"))
    per = got.withColumn("q", between(F.col("a"), F.col("b"), F.col("at") - F.floor("at"))).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))
    return per.withColumnRenamed("g", group) if group else per.drop("g")
