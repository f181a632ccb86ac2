"""Reranking with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions.text import prompt, vocabulary_words
from quaero.functions.vectors import sigmoid, yes_probability


def overlap_scorer(query: Column, text: Column) -> Column:
    """Stand-in scorer: Jaccard similarity of word sets; stays inside the JVM."""
    a, b = vocabulary_words(query), vocabulary_words(text)
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 9)


def model_scorer(score: Callable[[list[str], list[str]], list[float]], fallback: float = 0.5) -> Callable[[Column, Column], Column]:
    """A scorer column of a Python model, called with Arrow batches; a batch that runs out of memory gets ``fallback``."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(score(q.tolist(), t.tolist()), dtype="float64")
        except MemoryError:
            return pd.Series([fallback] * len(q), dtype="float64")

    return lambda q, t: run(q, t)


def prompted_scorer(model: Callable[[list[str]], list], style: str = "question", activation: str = "sigmoid", fallback: float = 0.5) -> Callable[[Column, Column], Column]:
    """A scorer column of a model that reads one prompt of query and passage.

    ``model`` gives a logit for each prompt, or with ``activation`` "yes_no" the
    logits of yes and no. "sigmoid" and "yes_no" end between 0 and 1, "raw" is the
    logit itself. Whatever stops the model on a batch for want of memory gives
    ``fallback``; other errors are raised.
    """
    if activation not in ("sigmoid", "yes_no", "raw"):
        raise ValueError(f"no activation {activation}")

    @F.pandas_udf("struct<a: double, b: double>")
    def run(p: pd.Series) -> pd.DataFrame:
        try:
            out = model(p.tolist())
        except (MemoryError, RuntimeError) as e:
            if isinstance(e, RuntimeError) and "out of memory" not in str(e).lower():
                raise
            return pd.DataFrame({"a": [None] * len(p), "b": [None] * len(p)}, dtype="float64")
        return pd.DataFrame([(x[0], x[1]) if activation == "yes_no" else (x, 0.0) for x in out], columns=["a", "b"], dtype="float64")

    def score(q: Column, t: Column) -> Column:
        r = run(prompt(q, t, style))
        a, b = r["a"], r["b"]
        x = {"sigmoid": sigmoid(a), "yes_no": yes_probability(a, b), "raw": a}[activation]
        return F.coalesce(x, F.lit(fallback))

    return score


def missing_texts(run: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(system, entries, no_query, no_text): how many entries of a run cannot be scored, by what is missing."""
    q = queries.where("trim(query) <> ''").select("qid").distinct().withColumn("_q", F.lit(1))
    d = docs.where("trim(text) <> ''").select("docid").distinct().withColumn("_d", F.lit(1))
    j = run.join(q, "qid", "left").join(d, "docid", "left")
    n = lambda c: F.sum(c.cast("int"))
    return j.groupBy("system").agg(F.count("*").alias("entries"), n(F.col("_q").isNull()).alias("no_query"), n(F.col("_d").isNull()).alias("no_text"))


def rerank(run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, k: int | None = None, on_missing: str = "keep") -> DataFrame:
    """(system, qid, docid, score, rank).

    queries: (qid, query), docs: (docid, text). Candidates without text are
    dropped. A query without text keeps its first-stage order ("keep") or goes
    ("drop"). Ties keep the first-stage order.
    """
    q = queries.select("qid", "query")
    joined = run.select("system", "qid", "docid", F.col("rank").alias("first")).join(q, "qid", "left").join(docs.select("docid", "text"), "docid", "left")
    no_query = F.col("query").isNull() | (F.trim("query") == "")
    no_text = F.col("text").isNull() | (F.trim("text") == "")
    kept = joined.where(~no_query & ~no_text if on_missing == "drop" else no_query | ~no_text)
    scored = kept.withColumn("score", F.when(~no_query, scorer(F.col("query"), F.col("text"))))
    w = Window.partitionBy("system", "qid").orderBy(F.col("score").desc_nulls_last(), "first")
    out = scored.select("system", "qid", "docid", "score", F.row_number().over(w).alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def sanity_gap(scorer: Callable[[Column, Column], Column], examples: DataFrame, least: float = 0.05) -> DataFrame:
    """(relevant, irrelevant, passed): mean scores of labelled examples (query, text, label)."""
    s = examples.withColumn("s", scorer(F.col("query"), F.col("text")))
    m = s.agg(F.avg(F.when(F.col("label") == 1, F.col("s"))).alias("relevant"), F.avg(F.when(F.col("label") == 0, F.col("s"))).alias("irrelevant"))
    return m.withColumn("passed", F.col("relevant") - F.col("irrelevant") >= least)
