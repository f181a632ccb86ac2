"""A list-wise learned ranker: boosted trees on the gradients of swapped pairs, weighted by what a swap does to nDCG.

Training data is one row a query (its candidates' features and labels), written
once. A level of a tree is one job: every task scores its queries with the
trees so far, computes their gradients, and sums them into histograms of
(node, feature, bin); these are added up by Spark, and the driver sees at most
nodes x features x bins sums, whatever the data. Scoring is a map over rows.

Only queries with a relevant and an irrelevant candidate train. A list trains
with its relevant and its ``MOST`` first candidates (a documented bound on the
fit; every candidate is scored). Without any such query there is no model.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.session import written

#: Candidates of a list that train besides its relevant ones.
MOST = 1_000


def gradients(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives for one list: each relevant candidate against each irrelevant one."""
    g, h = np.zeros(len(score)), np.zeros(len(score))
    place = np.empty(len(score))
    place[np.argsort(-score, kind="stable")] = np.arange(1, len(score) + 1)
    worth = 1 / np.log2(place + 1)
    good, bad = np.flatnonzero(label > 0), np.flatnonzero(label <= 0)
    ideal = (1 / np.log2(np.arange(1, len(good) + 1) + 1)).sum() if len(good) else 1.0
    for i in good:
        swap = np.abs(worth[i] - worth[bad]) / ideal
        p = 1 / (1 + np.exp(np.clip(score[i] - score[bad], -50, 50)))
        g[i] += (swap * p).sum()
        g[bad] -= swap * p
        curve = swap * p * (1 - p)
        h[i] += curve.sum()
        h[bad] += curve
    return g, h


def leaf_of(tree: dict, x: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The node of each row after ``depth`` levels, counted from the left."""
    at = np.zeros(len(x), int)
    for level in range(tree["depth"] if depth is None else depth):
        node = (1 << level) - 1 + at
        f, t = np.array(tree["feature"])[node], np.array(tree["threshold"])[node]
        right = np.where(f >= 0, x[np.arange(len(x)), np.maximum(f, 0)] > t, False)
        at = 2 * at + right
    return at


def predicted(trees: list[dict], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += np.array(t["value"])[leaf_of(t, x)]
    return out


def _lists(data: DataFrame, names: list[str]) -> DataFrame:
    """(x, y): one row for each query with relevant and irrelevant candidates."""
    kept = data.where((F.col("label") > 0) | (F.col("rank") <= MOST))
    g = kept.groupBy("qid").agg(F.collect_list(F.struct(F.array(*[F.col(n).cast("double") for n in names]).alias("x"), F.col("label").cast("double").alias("y"))).alias("a"), F.max("label").alias("hi"), F.min("label").alias("lo"))
    return g.where("hi > 0 and lo <= 0").select(F.flatten(F.transform("a", lambda r: r["x"])).alias("x"), F.transform("a", lambda r: r["y"]).alias("y"))


def fit(data: DataFrame, names: list[str], trees: int = 12, depth: int = 3, bins: int = 32, rate: float = 0.1, least: float = 1e-3, damp: float = 1.0) -> list[dict]:
    """The trees of a model over (qid, rank, label, features...)."""
    lists = written(_lists(data, names), "lists")
    if lists.isEmpty():
        return []
    shares = [i / bins for i in range(1, bins)]
    cuts = [sorted(set(c)) for c in data.select(*names).approxQuantile(names, shares, 1e-3)]
    width = len(names)
    model: list[dict] = []

    def sums(tree: dict, level: int) -> np.ndarray:
        """(node, feature, bin, 2) of gradients under the model so far."""
        so_far = list(model)

        def run(batches: Iterator) -> Iterator:
            total = np.zeros((1 << level, width, bins + 1, 2))
            for b in batches:
                for x, y in zip(b["x"], b["y"]):
                    x = np.asarray(x, float).reshape(-1, width)
                    g, h = gradients(predicted(so_far, x), np.asarray(y, float))
                    node = leaf_of(tree, x, level)
                    for f in range(width):
                        at = np.searchsorted(cuts[f], x[:, f], side="left")
                        np.add.at(total[:, f, :, 0], (node, at), g)
                        np.add.at(total[:, f, :, 1], (node, at), h)
            some = np.argwhere(total[..., 1] != 0)
            v = total[tuple(some.T)]
            yield pd.DataFrame({"node": some[:, 0], "feature": some[:, 1], "bin": some[:, 2], "g": v[:, 0], "h": v[:, 1]})

        rows = lists.mapInPandas(run, "node int, feature int, bin int, g double, h double").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        out = np.zeros((1 << level, width, bins + 1, 2))
        for r in rows:
            out[r.node, r.feature, r.bin] = r.g, r.h
        return out

    for _ in range(trees):
        tree = {"depth": depth, "feature": [-1] * ((1 << depth) - 1), "threshold": [0.0] * ((1 << depth) - 1), "value": [0.0] * (1 << depth)}
        for level in range(depth):
            hist = sums(tree, level)
            for node in range(1 << level):
                left = hist[node].cumsum(1)
                whole = left[0, -1]
                right = whole - left
                part = lambda s: s[..., 0] ** 2 / (s[..., 1] + damp)
                gain = part(left) + part(right) - part(whole)
                gain[(left[..., 1] < least) | (right[..., 1] < least)] = 0
                f, c = np.unravel_index(int(gain.argmax()), gain.shape)
                sides = (whole, np.zeros(2))
                if gain[f, c] > 1e-12 and c < len(cuts[f]):
                    at = (1 << level) - 1 + node
                    tree["feature"][at], tree["threshold"][at] = int(f), float(cuts[f][c])
                    sides = (left[f, c], right[f, c])
                if level == depth - 1:
                    for i, s in enumerate(sides):
                        tree["value"][2 * node + i] = float(rate * s[0] / (s[1] + damp))
        model.append(tree)
    return model


def scored(df: DataFrame, names: list[str], model: list[dict]) -> DataFrame:
    """``df`` with ``score``, rounded to nine digits; a map over Arrow batches."""
    x = F.array(*[F.col(n).cast("double") for n in names])

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.round(predicted(model, np.array(s.tolist(), float).reshape(-1, len(names))), 9))

    return df.withColumn("score", run(x))


def write_booster(spark: SparkSession, model: list[dict], names: list[str], path: str, mode: str = "errorifexists") -> None:
    """The model as a text file of JSON."""
    spark.createDataFrame([(json.dumps({"features": names, "trees": model}),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_booster(spark: SparkSession, path: str) -> tuple[list[str], list[dict]]:
    m = json.loads(spark.read.text(path, wholetext=True).first().value)
    return m["features"], m["trees"]
