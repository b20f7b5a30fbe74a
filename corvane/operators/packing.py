"""Budgets over ordered rows: prefixes, greedy packing, newest-first history, running means, exact percentiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def prefix_budget(df: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each group as long as the running cost stays within the budget; the first row always stays. The order must be total."""
    w = Window.partitionBy(group).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", running).withColumn("place", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("place") == 1))


#: Items of one group that greedy packing takes at most; more are an error, not a loss.
MAX_ITEMS = 1_000_000


def greedy_pack(df: DataFrame, group: str, key: str, priority: str, cost: str, budget: int) -> DataFrame:
    """group, key, used: rows taken in order of priority, each if it still fits, whether or not those before did; ties go to the smaller
    key. An item that alone exceeds the budget is left out before the groups meet. A group is what one prompt is packed from: of more than
    MAX_ITEMS items it raises an error."""
    items = F.sort_array(F.collect_list(F.struct((-F.col(priority)).alias("p"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c"))))
    kind = f"struct<used:bigint,taken:array<struct<k:{df.schema[key].dataType.simpleString()},used:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().alias("taken")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        total = acc["used"] + x["c"]
        more = F.struct(total.alias("used"), F.concat(acc["taken"], F.array(F.struct(x["k"].alias("k"), total.alias("used")))).alias("taken"))
        return F.when(total <= budget, more).otherwise(acc)

    met = df.where(F.col(cost) <= budget).groupBy(group).agg(items.alias("items"))
    packed = met.withColumn("items", F.when(F.size("items") <= MAX_ITEMS, F.col("items")).otherwise(F.raise_error(F.lit("a group of too many items to pack")))).select(group, F.aggregate("items", start, step)["taken"].alias("taken"))
    return packed.select(group, F.explode("taken").alias("t")).select(group, F.col("t.k").alias(key), F.col("t.used").alias("used"))


def running_mean(df: DataFrame, group: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean after each row; the first value seeds it. The order must be total and the values not null.

    Rows are put into one order over all tasks, which cuts long groups into blocks. In a block the mean is an affine map of the mean before
    it; the maps of a group's blocks (no more than there are tasks) are composed, and applied to the blocks."""
    spark = df.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(blocks, group, *order).sortWithinPartitions(group, *order)
    placed = cut(placed.withColumn("block", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        x = pdf[value].astype(float)
        # As the first block of its group, and as the part that doesn't depend on what was before.
        seeded = x.ewm(alpha=alpha, adjust=False).mean()
        carried = pd.concat([pd.Series([0.0]), x], ignore_index=True).ewm(alpha=alpha, adjust=False).mean().iloc[1:].reset_index(drop=True)
        return pdf.assign(seeded=seeded, carried=carried, kept=(1 - alpha) ** (pdf.index + 1.0))

    folded = cut(placed.groupBy(group, "block").applyInPandas(fold, f"{kinds}, seeded double, carried double, kept double"))
    ends = folded.groupBy(group, "block").agg(F.max_by(F.struct("seeded", "carried", "kept"), "seq").alias("e"))
    chain = ends.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("block", "e"))).alias("c")).where(F.size("c") > 1)
    start = F.struct(F.element_at("c", 1)["e"]["seeded"].alias("m"), F.array().cast("array<struct<block:int,m:double>>").alias("before"))
    step = lambda acc, x: F.struct((x["e"]["kept"] * acc["m"] + x["e"]["carried"]).alias("m"), F.concat(acc["before"], F.array(F.struct(x["block"].alias("block"), acc["m"].alias("m")))).alias("before"))
    before = chain.select(group, F.explode(F.aggregate(F.slice("c", 2, F.size("c")), start, step)["before"]).alias("b")).select(group, "b.block", F.col("b.m").alias("before"))
    out = folded.join(before, [group, "block"], "left")
    mean = F.when(F.col("before").isNull(), F.col("seeded")).otherwise(F.col("kept") * F.col("before") + F.col("carried"))
    return out.select(*df.columns, mean.alias("mean"))


#: Buckets of the values of a group in which exact percentiles are looked for.
BUCKETS = 1_024


def exact_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], interpolate: bool = True) -> DataFrame:
    """groups and a column for each share: the value at that share of each group's ordered values, between two values if need be, or the lower
    of both. Exact, and no group is sorted in one task: equal values are counted first, the counts of buckets of values say in which buckets
    the wanted places lie, and only those are ordered. Null values don't count; a null group is a group."""
    key = F.to_json(F.struct(*groups))
    counts = cut(df.where(F.col(value).isNotNull()).select(key.alias("g"), *groups, F.col(value).cast("double").alias("v")).groupBy("g", *groups, "v").agg(F.count("*").alias("n")))
    whole = counts.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
    each = counts.join(whole, "g").withColumn("bucket", F.when(F.col("hi") > F.col("lo"), bucket).otherwise(0).cast("int"))
    sums = each.groupBy("g", "bucket", "total").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("before", F.sum("held").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held"))
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.col("total") - 1).cast("double").__mul__(F.lit(share)).alias("at")) for name, share in shares.items()))
    wanted = sums.select("g", "bucket", "before", "held", F.explode(places).alias("p")).select("g", "bucket", "before", "held", "p.name", "p.at", F.explode(F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at")))).alias("place"))
    wanted = wanted.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("held")))
    inside = each.join(wanted.select("g", "bucket").distinct(), ["g", "bucket"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("g", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = inside.select("g", "bucket", "v", (upto - F.col("n")).alias("from"), upto.alias("to"))
    at = F.col("place") - F.col("before")
    met = wanted.join(ordered, ["g", "bucket"]).where((at >= F.col("from")) & (at < F.col("to")))
    low, high = F.min("v"), F.max("v")
    found = met.groupBy("g", "name").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at"))) if interpolate else low).alias("v"))
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    return counts.select("g", *groups).distinct().join(wide, "g").select("g", *groups, *shares)
