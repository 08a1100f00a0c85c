"""The N best items of every group, taken from descending score bands.

The rows are written once, split by score into a few range bands.  The bands are worked
from the top: rows of groups that already have N items are anti-joined away before any
shuffle, the rest are made distinct and ranked exactly, and only the places that a group
still lacks are filled.  Ties on the score go to the lower item, so the result does not
depend on the order of the input.  A hot group is filled by the first bands; within a
band each map task forwards at most N rows of a group to its rank stage.

Defined results: rows with a null group or a null or NaN score take no part; equal
(group, score, item) rows count once; a null item is one item that comes last among ties;
an empty table gives no rows; a group with fewer than N items keeps them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, Scratch

#: Shares of the rows from the top at which one band ends and the next begins.
CUTS = (0.02, 0.08, 0.3)
#: Copies of the filled groups' table when it is too large to broadcast: a hot group's rows spread over so many tasks.
SALTS = 16


def _without(rows: DataFrame, groups: DataFrame, n_groups: int, width: int, limit: int) -> DataFrame:
    """Rows of groups that are not in ``groups``."""
    if n_groups * width <= limit:
        return rows.join(F.broadcast(groups), "g", "left_anti")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("i", "s"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"], "left_anti").drop("salt")


def top_n(
    df: DataFrame, group: str, score: str, item: str, n: int = 10, cuts: tuple[float, ...] = CUTS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``g`` (group), ``rank_no`` 1..n, ``i`` (item) and ``s`` (score) of the best items of each group."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topn")
    rows = df.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(item).alias("i")).filter("g is not null and s is not null and not isnan(s)")
    edges = sorted(set(rows.approxQuantile("s", [1 - c for c in cuts], 0.002)), reverse=True)
    band = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        band = F.when(F.col("s") >= F.lit(edges[k]), k).otherwise(band)
    path = f"{scratch.base}/bands"
    rows.withColumn("band", band).write.option("compression", "zstd").partitionBy("band").parquet(path)
    banded = spark.read.schema(rows.withColumn("band", F.lit(0)).schema).parquet(path)

    ranked = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc_nulls_last())
    done, have = [], None
    for k in range(len(edges) + 1):
        rest = banded.filter(F.col("band") == k).drop("band")
        if have is not None:
            filled = have.filter(F.col("n") >= n)
            size = filled.agg(F.count("*"), F.max(F.octet_length(F.col("g").cast("string")))).first()
            if size[0]:
                rest = _without(rest, filled.select("g"), size[0], 32 + (size[1] or 0), broadcast_bytes)
        best = rest.groupBy("g", "s", "i").agg(F.lit(1).alias("one")).withColumn("rank_no", F.row_number().over(ranked)).filter(F.col("rank_no") <= n)
        if have is not None:
            best = best.join(have, "g", "left").withColumn("rank_no", F.col("rank_no") + F.coalesce("n", F.lit(0))).filter(F.col("rank_no") <= n)
        part = scratch.table(best.select("g", F.col("rank_no").cast("int").alias("rank_no"), "i", "s"), f"band{k}")
        done.append(part)
        counts = part.groupBy("g").agg(F.count("*").alias("n"))
        if k < len(edges):
            older, have = have, scratch.table(counts if have is None else have.unionByName(counts).groupBy("g").agg(F.sum("n").alias("n")), f"have{k}")
            if older is not None:
                scratch.drop(older)
    return reduce(DataFrame.unionByName, done)
