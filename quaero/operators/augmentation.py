"""Translation caches, back-translation, sampled evaluation groups, and parameter search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions.text import normalize_ws
from quaero.operators.fusion import min_max
from quaero.operators.training import drawn, hash_order


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(direction, source) of requested texts that the cache lacks; each once."""
    return requests.select("direction", "source").where("trim(source) <> ''").distinct().join(cache.select("direction", "source"), ["direction", "source"], "left_anti")


def translated(requests: DataFrame, cache: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The requests with ``target`` from the cache, or from newly translated rows (direction, source, target); null where neither has it."""
    known = cache.select("direction", "source", "target") if fresh is None else cache.select("direction", "source", "target").unionByName(fresh.select("direction", "source", "target"))
    one = known.groupBy("direction", "source").agg(F.min("target").alias("target"))
    return requests.join(one, ["direction", "source"], "left")


def back_translations(texts: DataFrame, forward: DataFrame, backward: DataFrame, most: int | None = None, seed: str = "42") -> DataFrame:
    """(text, variant): each text through a pivot language and back, where the result differs from the text beyond white space; distinct.

    texts: (text); forward and backward: (source, target). Texts that share a
    pivot and the variants of that pivot meet in distinct pairs only. ``most``
    limits the variants of a text, by hash order; a pivot that many texts share
    then sends each of them only its first most + 1 variants (one may be the
    text itself), so the result grows with the texts and not with their square.
    """
    same = lambda c: F.lower(normalize_ws(c))
    f = forward.select(F.col("source").alias("text"), F.col("target").alias("pivot")).join(texts.select("text").distinct(), "text", "left_semi").distinct()
    b = backward.select(F.col("source").alias("pivot"), F.col("target").alias("variant")).where(F.trim("variant") != "").distinct()
    if most is not None:
        # One variant for each normal form, then the first ones of a pivot.
        b = b.groupBy("pivot", same("variant").alias("form")).agg(F.min("variant").alias("variant"))
        w = Window.partitionBy("pivot").orderBy(hash_order(seed, "form"), "form")
        b = b.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1).drop("k", "form")
    j = f.join(b, "pivot").where(same("variant") != same("text")).select("text", "variant").distinct()
    if most is None:
        return j
    v = Window.partitionBy("text").orderBy(hash_order(seed, "variant"), "variant")
    return j.withColumn("k", F.row_number().over(v)).where(F.col("k") <= most).select("text", "variant")


def capped_sample(groups: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """The n keys first in hash order; a sampling operator."""
    return groups.select(key).distinct().withColumn("h", hash_order(seed, key)).orderBy("h", key).limit(n).drop("h")


def topped_up(groups: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """(qid, docid, source): the negatives of each query, filled up to n with positives of other queries, as long as there are any.

    groups: (qid, docid, label). The positives stand on a ring in hash order. A
    query starts at its own place and meets as many as it lacks and as it must
    pass over, which is enough or the whole ring. No pair of every query with
    every positive is made.
    """
    own = groups.where("label = 0").select("qid", "docid", F.lit("own").alias("source")).distinct()
    have = groups.groupBy("qid").agg(F.countDistinct(F.when(F.col("label") == 0, F.col("docid"))).alias("n"), F.countDistinct("docid").alias("held"))
    need = have.where(F.col("n") < n).select("qid", (n - F.col("n") + F.col("held")).alias("steps"))
    fill = drawn(need, groups.where("label = 1"), seed).join(groups.select("qid", "docid"), ["qid", "docid"], "left_anti").select("qid", "docid", F.lit("other").alias("source"), "step")
    w = Window.partitionBy("qid").orderBy(F.col("source") != "own", "step", "docid")
    both = own.withColumn("step", F.lit(-1).cast("bigint")).unionByName(fill)
    return both.withColumn("k", F.row_number().over(w)).where((F.col("k") <= n) | (F.col("source") == "own")).select("qid", "docid", "source")


def weight_search(run: DataFrame, golds: DataFrame, systems: list[str], grid: list[tuple[float, ...]], k: int = 10) -> DataFrame:
    """(trial, weights..., recall, hits): linear fusion under every weight vector of a grid, one plan for all trials; best recall first by ``place``."""
    w = Window.partitionBy("system", "qid")
    scaled = run.where(F.col("system").isin(systems)).where("score is not null").withColumn("x", min_max(F.col("score"), w))
    wide = scaled.groupBy("qid", "docid").agg(*[F.sum(F.when(F.col("system") == s, F.col("x")).otherwise(0.0)).alias(f"x{i}") for i, s in enumerate(systems)])
    trials = F.array(*[F.struct(F.lit(t).alias("trial"), *[F.lit(float(v)).alias(f"w{i}") for i, v in enumerate(ws)]) for t, ws in enumerate(grid)])
    each = wide.select("*", F.explode(trials).alias("t"))
    score = sum((F.col(f"x{i}") * F.col(f"t.w{i}") for i in range(len(systems))), F.lit(0.0))
    each = each.select("qid", "docid", "t.*", F.round(score, 9).alias("score"))
    by = Window.partitionBy("trial", "qid").orderBy(F.col("score").desc(), "docid")
    top = each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    n = run.where(F.col("system").isin(systems)).select("qid").distinct().join(golds.select("qid").distinct(), "qid", "left_semi").agg(F.count("*").alias("n"))
    hits = top.join(golds.select("qid", "docid"), ["qid", "docid"], "left_semi").groupBy("trial").agg(F.countDistinct("qid").alias("hits"))
    names = [f"w{i}" for i in range(len(systems))]
    rows = run.sparkSession.createDataFrame([(t, *map(float, ws)) for t, ws in enumerate(grid)], "trial int, " + ", ".join(f"{c} double" for c in names))
    out = rows.join(hits, "trial", "left").crossJoin(F.broadcast(n))
    recall = F.round(F.coalesce("hits", F.lit(0)) / F.greatest("n", F.lit(1)), 9)
    return out.select("trial", *names, recall.alias("recall"), F.coalesce("hits", F.lit(0)).alias("hits"))
