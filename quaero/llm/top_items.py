"""Top N items within every group, by descending score bands.

Each run's scores are cut into range-partitioned bands (quantiles of that
run). The prepared rows are written once, a folder for each band, so that a
band is one scan of its own rows. The bands are processed from the top: the
rows of a band are reduced to the best row of each (group, item), the N best of
each group are kept, and groups that have N distinct items are filled and
leave. The next band is read only for the groups that are left. The last band
takes everything that remains, rows without a score included, so no row is ever
out of reach.
Equal scores share a band, because a band is a condition on the score; ties
at its edge are settled by the exact order inside the band.

Skew: rows are first grouped by (group, item) with sorting partial
aggregation, so one hot group spreads over its items; the per-group cut then
runs as a limit before the shuffle (``WindowGroupLimit``) and only N rows of
a group leave each partition.

Defined results. Item ids are stripped of white space; rows whose id is null
or blank do not count. Order: score descending, null and NaN last; rank
ascending, null and ranks below 1 last; item id ascending. An item counts once,
with its first row in this order. A null group key is a group of its own. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.session import shared_path, there, written

#: White space that strips from an item id.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
LAST_RANK = 2147483647
SALTS = 16
#: Bytes of one group key in a broadcast table.
GROUP_BYTES = 100


def _prepared(df: DataFrame, run: str, query: str, item: str, score: str, rank: str) -> DataFrame:
    s = F.col(score).cast("double")
    r = F.col(rank)
    return df.select(
        F.col(run).alias("g1"),
        F.col(query).alias("g2"),
        F.btrim(F.col(item), F.lit(SPACES)).alias("item"),
        F.when(s.isNotNull() & ~F.isnan(s), -s).alias("minus"),
        F.when(r >= 1, r).otherwise(LAST_RANK).cast("int").alias("pos"),
    ).where("item <> ''")


def _order() -> list[Column]:
    return [F.col("minus").asc_nulls_last(), F.col("pos"), F.col("item")]


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The n first distinct items of each group among ``rows``."""
    key = F.struct(F.col("minus").isNull().alias("none"), F.col("minus"), F.col("pos"))
    once = rows.groupBy("g1", "g2", "item").agg(F.min(key).alias("k")).select("g1", "g2", "item", "k.minus", "k.pos")
    w = Window.partitionBy("g1", "g2").orderBy(*_order())
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def _only(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the listed groups.

    A list of a checked small size is broadcast; beyond it both sides are
    shuffled, salted by the item, so that a hot group is spread.
    """
    spark = rows.sparkSession
    most = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if groups.count() * GROUP_BYTES <= most:
        few = groups.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"))
        return rows.join(F.broadcast(few), rows.g1.eqNullSafe(few.h1) & rows.g2.eqNullSafe(few.h2), "left_semi")
    salted = groups.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("hs"))
    left = rows.withColumn("s", F.pmod(F.hash("item"), F.lit(SALTS)))
    on = left.g1.eqNullSafe(salted.h1) & left.g2.eqNullSafe(salted.h2) & (left.s == salted.hs)
    return left.join(salted.hint("merge"), on, "left_semi").drop("s")


def top_items(
    df: DataFrame,
    n: int = 10,
    run: str = "run_name",
    query: str = "qid",
    item: str = "docid",
    score: str = "score",
    rank: str = "rank",
    shares: tuple[float, ...] = (0.45, 0.8),
) -> DataFrame:
    """(run, query, item, score, rank, place) of the n first items of each group.

    ``shares``: the top shares of a run's scores at which a new band begins.
    """
    spark = df.sparkSession
    rows = _prepared(df, run, query, item, score, rank)
    cuts = written(rows.groupBy("g1").agg(F.percentile_approx("minus", list(shares), 200).alias("cuts")), "cuts")
    banded = rows.join(cuts.withColumnRenamed("g1", "c1"), F.col("g1").eqNullSafe(F.col("c1")), "left")
    band = F.lit(len(shares))
    for b in reversed(range(len(shares))):
        band = F.when(F.col("minus") <= F.col("cuts")[b], b).otherwise(band)
    path = shared_path(spark, "bands")
    schema = rows.schema
    banded.select(*rows.columns, band.alias("band")).write.partitionBy("band").parquet(path)

    def of_band(b: int) -> DataFrame:
        where = f"{path}/band={b}"
        return spark.read.schema(schema).parquet(where) if there(spark, where) else spark.createDataFrame([], schema)

    taken: list[DataFrame] = []
    left: DataFrame | None = None
    for b in range(len(shares) + 1):
        inside = of_band(b) if left is None else _only(of_band(b), left)
        taken.append(written(_best(inside, n), f"band{b}"))
        if b == len(shares):
            break
        so_far = reduce(DataFrame.unionByName, taken)
        filled = so_far.groupBy("g1", "g2").agg(F.countDistinct("item").alias("n")).where(F.col("n") >= n).select("g1", "g2")
        groups = spark.read.schema(schema).parquet(path).select("g1", "g2").distinct() if left is None else left
        f = filled.select(F.col("g1").alias("f1"), F.col("g2").alias("f2"))
        left = written(groups.join(f, groups.g1.eqNullSafe(f.f1) & groups.g2.eqNullSafe(f.f2), "left_anti"), f"left{b}")
    got = reduce(DataFrame.unionByName, taken)
    return _best(got.drop("place"), n).select(
        F.col("g1").alias(run),
        F.col("g2").alias(query),
        F.col("item").alias(item),
        (-F.col("minus")).alias(score),
        F.when(F.col("pos") < LAST_RANK, F.col("pos")).alias(rank),
        "place",
    )
