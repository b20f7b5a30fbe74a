"""Vectors of texts by feature hashing, without a model; all in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def hashed_vectors(df: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """key and unit vector of every key: each token adds, at a place, a weight of a sign and size that come from its hash, as often as it
    stands in the text. Null and empty texts and texts without a word give zeros, which no search finds. Repeated keys are taken together."""
    words = df.where(F.col(key).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    digest = F.md5("w")
    number = lambda at, length: F.conv(F.substring(digest, at, length), 16, 10).cast("long")
    weight = F.when(number(9, 1) % 2 == 1, 1.0).otherwise(-1.0) * (0.5 + number(10, 2) / 255.0) * F.col("n")
    placed = words.select(key, F.pmod(number(1, 8), F.lit(dimension)).cast("int").alias("place"), weight.alias("x")).groupBy(key, "place").agg(F.sum("x").alias("x"))
    sparse = placed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0))
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(sparse, key, "left").select(key, F.coalesce(unit, zeros).alias("vector"))
