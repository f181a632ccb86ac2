"""Postings and BM25 retrieval as joins and one aggregation.

Postings are (field, term, docid, tf, dl). ``stored`` writes them once, as a
table bucketed by document and sorted by term, with the document frequencies
and field statistics beside it. A search then needs no shuffle of postings: the
query terms, which carry their frequencies, are broadcast (Spark's choice, under
its threshold), a document's score is complete inside its bucket, and only the
best k of each query leave a bucket. Feedback joins the same buckets by
document. Documents spread evenly over buckets, however frequent a term is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.session import shared_path, written

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """(field, term, docid, tf, dl) of token lists, one entry of ``fields`` each."""
    lists = F.array(*[F.struct(F.lit(f).alias("field"), t.alias("tokens")) for f, t in fields.items()])
    one = docs.select(F.col(id_).alias("docid"), F.explode(lists).alias("x")).select("docid", "x.field", "x.tokens", F.size("x.tokens").alias("dl"))
    return one.select("field", "docid", "dl", F.explode("tokens").alias("term")).groupBy("field", "term", "docid").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def field_statistics(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n, avgdl): one row for each field; documents without tokens count in n."""
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.size(t).alias("dl")) for f, t in fields.items()])
    return docs.select(F.explode(lists).alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.avg("x.dl").alias("avgdl"))


def statistics_of(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """(field, n, avgdl) from postings that exist already, so that no text is tokenised again."""
    n = docs.agg(F.count("*").alias("n"))
    total = posts.groupBy("field").agg(F.sum("tf").alias("t"))
    return total.crossJoin(F.broadcast(n)).select("field", "n", (F.col("t") / F.col("n")).alias("avgdl"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "term").agg(F.count("*").alias("df"))


@dataclass
class Stored:
    """An index in the shared folder: postings in buckets of documents, document frequencies, field statistics."""

    posts: DataFrame
    frequencies: DataFrame
    statistics: DataFrame
    path: str


#: Documents of a bucket, about.
IN_BUCKET = 100_000


def stored(docs: DataFrame, id_: str, fields: dict[str, Column], buckets: int | None = None) -> Stored:
    """Builds and writes an index; of several rows with the same id one is taken.

    One shuffle by document carries the texts; counting terms and writing the
    buckets reuse it.
    """
    spark = docs.sparkSession
    n = buckets or max(1, min(8, spark.sparkContext.defaultParallelism), -(-docs.count() // IN_BUCKET))
    once = docs.where(F.col(id_).isNotNull()).repartition(n, F.col(id_)).dropDuplicates([id_])
    path, name = shared_path(spark, "postings"), f"quaero_postings_{uuid.uuid4().hex}"
    postings(once, id_, fields).write.bucketBy(n, "docid").sortBy("term").option("path", path).saveAsTable(name)
    posts = spark.table(name)
    total = docs.agg(F.countDistinct(id_).alias("n"))
    lengths = posts.groupBy("field").agg(F.sum("tf").alias("t"))
    statistics = lengths.crossJoin(F.broadcast(total)).select("field", "n", (F.col("t") / F.col("n")).alias("avgdl"))
    return Stored(posts, written(document_frequencies(posts), "frequencies"), written(statistics, "statistics"), path)


def query_terms(queries: DataFrame, id_: str, tokens: Column, weight: float = 1.0) -> DataFrame:
    """(qid, term, qtf, weight) of a query's tokens."""
    t = queries.select(F.col(id_).alias("qid"), F.explode(tokens).alias("term"))
    return t.groupBy("qid", "term").agg(F.count("*").alias("qtf")).withColumn("weight", F.lit(float(weight)))


def bm25_scores(terms: DataFrame, posts: DataFrame, statistics: DataFrame, boosts: dict[str, float] | None = None, k1: float = K1, b: float = B, frequencies: DataFrame | None = None) -> DataFrame:
    """(qid, docid, score): OR over terms, fields added. Rounded to nine digits, so that both ranks and ties are engine-free.

    Without stored ``frequencies`` they are counted here, for the query's terms
    only.
    """
    if frequencies is None:
        frequencies = document_frequencies(posts.join(terms.select("term").distinct(), "term", "left_semi"))
    boost = F.lit(1.0)
    for f, x in (boosts or {}).items():
        boost = F.when(F.col("field") == f, F.lit(float(x))).otherwise(boost)
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(frequencies, "term").join(F.broadcast(statistics), "field")
    asked = asked.select("qid", "field", "term", (F.col("weight") * F.col("qtf") * boost * idf).alias("worth"), "avgdl")
    part = F.col("worth") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return posts.join(asked, ["field", "term"]).groupBy("qid", "docid").agg(F.round(F.sum(part), 9).alias("score"))


def must_hold(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The scored rows whose document meets the query's filters; a filter that is null always holds.

    queries: (qid, venue, author), docs: (docid, venue, authors). The venue must
    be equal, the author a part of the authors, both without regard to case.
    """
    q = queries.select("qid", F.col("venue").alias("_v"), F.col("author").alias("_a"))
    d = docs.select("docid", F.lower("venue").alias("venue"), F.lower("authors").alias("authors")).distinct()
    j = scores.join(q, "qid").join(d, "docid", "left")
    holds = (F.col("_v").isNull() | (F.col("_v") == F.col("venue"))) & (F.col("_a").isNull() | F.contains("authors", "_a"))
    return j.where(holds).select(*scores.columns)


def ranked(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    """Adds ``rank`` and keeps the k first of each qid: score falling, then docid, unless another order is given."""
    w = Window.partitionBy("qid").orderBy(*(order or (F.col("score").desc(), F.col("docid"))))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_clauses(queries: DataFrame, id_: str, clauses: dict[str, tuple[Column, float]]) -> DataFrame:
    """(qid, term, qtf, weight) of several weighted texts of a query; a clause without tokens adds nothing."""
    return reduce(DataFrame.unionByName, [query_terms(queries, id_, t, w) for t, w in clauses.values()])


def feedback_terms(hits: DataFrame, posts: DataFrame, docs_used: int, terms_used: int, own: DataFrame | None = None) -> DataFrame:
    """(qid, term, freq, pos): the most frequent terms of each query's first documents, ties by term; the query's own terms are left out."""
    top = hits.where(F.col("rank") <= docs_used).select("qid", "docid")
    t = top.join(posts, "docid").groupBy("qid", "term").agg(F.sum("tf").alias("freq"))
    if own is not None:
        t = t.join(own.select("qid", "term"), ["qid", "term"], "left_anti")
    w = Window.partitionBy("qid").orderBy(F.col("freq").desc(), "term")
    return t.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= terms_used)


def feedback_text(query: Column, terms: Column) -> Column:
    """The query text of a second search: the original and the new terms, joined by OR."""
    return F.when(F.size(terms) > 0, F.concat(query, F.lit(" OR "), F.array_join(terms, " OR "))).otherwise(query)


def two_pass(terms: DataFrame, posts: DataFrame, statistics: DataFrame, docs_used: int, terms_used: int, k: int, boosts: dict[str, float] | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """Pseudo-relevance feedback: search, add frequent terms of the first hits with weight 1, search again."""
    first = ranked(bm25_scores(terms, posts, statistics, boosts, frequencies=frequencies), docs_used)
    more = feedback_terms(first, posts, docs_used, terms_used, terms).select("qid", "term", F.lit(1).cast("bigint").alias("qtf"), F.lit(1.0).alias("weight"))
    # Both searches read these few rows; written, the first search runs once.
    second = written(terms.select("qid", "term", "qtf", "weight").unionByName(more), "second")
    return ranked(bm25_scores(second, posts, statistics, boosts, frequencies=frequencies), k)


def adaptive(queries: DataFrame, id_: str, text: str, tokens: Column, index: Stored, recall: float = 1.0, precision: float = 1.0) -> DataFrame:
    """(qid, docid, score, rank, preset): each query under the preset its text calls for; one plan a preset that occurs."""
    named = written(queries.select(F.col(id_).alias("qid"), tokens.alias("tokens"), preset_of(F.col(text)).alias("preset")), "presets")
    out = None
    for r in named.select("preset").distinct().orderBy("preset").collect():
        d, t, k = scaled_preset(r.preset, recall, precision)
        mine = query_terms(named.where(F.col("preset") == r.preset), "qid", F.col("tokens"))
        hits = two_pass(mine, index.posts, index.statistics, d, t, k, frequencies=index.frequencies).withColumn("preset", F.lit(r.preset))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("no queries")
    return out


# Feedback presets as (documents, terms, results).
PRESETS = {
    "BALANCED": (5, 10, 100), "HIGH_RECALL": (10, 20, 1000), "HIGH_RECALL_AGGRESSIVE": (15, 30, 2000), "HIGH_PRECISION": (3, 5, 100), "HIGH_PRECISION_CONSERVATIVE": (2, 3, 100),
    "SCIENTIFIC_MEDICAL": (8, 15, 500), "SHORT_QUERY": (3, 8, 100), "LONG_QUERY": (5, 12, 150), "NICHE_DOMAIN": (8, 12, 200), "FAST": (3, 5, 50),
}


def preset_of(text: Column) -> Column:
    """Preset by the number of words, then by domain words."""
    n = F.size(F.split(F.trim(text), r"\s+"))
    domain = F.rlike(F.lower(text), F.lit("vaccine|covid|medical|disease"))
    return F.when(n <= 2, "SHORT_QUERY").when(n >= 5, "LONG_QUERY").when(domain, "SCIENTIFIC_MEDICAL").otherwise("BALANCED")


def scaled_preset(name: str, recall: float = 1.0, precision: float = 1.0) -> tuple[int, int, int]:
    """A preset scaled towards recall (more documents, terms and results) or precision (fewer documents and terms); the parts are truncated to integers, at least 1."""
    if recall <= 0 or precision <= 0:
        raise ValueError("the factors must be positive")
    d, t, k = PRESETS[name]
    return max(1, int(d * recall / precision)), max(1, int(t * recall / precision)), max(1, int(k * recall))


def ordered_union(*runs: DataFrame) -> DataFrame:
    """(qid, docid, rank): the lists one after another, each document at its first place; not cut."""
    u = reduce(DataFrame.unionByName, [r.select("qid", "docid", "rank", F.lit(i).alias("src")) for i, r in enumerate(runs)])
    first = u.groupBy("qid", "docid").agg(F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy("qid").orderBy("at.src", "at.rank", "docid")
    return first.select("qid", "docid", F.row_number().over(w).alias("rank"))


def neighbour_terms(hits: DataFrame, docs: DataFrame, tokens: Column, id_: str, own: DataFrame, pool: int = 30, most: int = 15, scale: float = 5.0) -> DataFrame:
    """(qid, term, weight, pos): terms of similar documents, each worth max(1, round-half-even(scale * score)); the pool is cut before the query's own terms go."""
    worth = F.greatest(F.lit(1), F.bround(F.lit(scale) * F.col("score"), 0).cast("int"))
    t = (
        hits.join(docs.select(F.col(id_).alias("docid"), tokens.alias("tokens")), "docid")
        .select("qid", F.posexplode("tokens").alias("at", "term"), "rank", worth.alias("worth"))
        .groupBy("qid", "term").agg(F.sum("worth").alias("weight"), F.min(F.struct("rank", "at")).alias("first"))
    )
    w = Window.partitionBy("qid").orderBy(F.col("weight").desc(), "first", "term")
    t = t.withColumn("p", F.row_number().over(w)).where(F.col("p") <= pool)
    t = t.join(own.select("qid", "term"), ["qid", "term"], "left_anti")
    v = Window.partitionBy("qid").orderBy("p")
    return t.withColumn("pos", F.row_number().over(v)).where(F.col("pos") <= most).select("qid", "term", "weight", "pos")


def synonym_terms(terms: DataFrame, dictionary: DataFrame, most: int, threshold: float) -> DataFrame:
    """(qid, terms): own terms and their synonyms; the first ``most`` synonyms are taken before the threshold applies.

    dictionary: (term, synonyms array<struct<term, score>>).
    """
    s = terms.select("qid", "term").join(dictionary, "term", "left")
    more = F.transform(F.filter(F.slice(F.coalesce("synonyms", F.array()), 1, most), lambda x: x["score"] >= threshold), lambda x: x["term"])
    return s.select("qid", F.explode(F.concat(F.array("term"), more)).alias("t")).groupBy("qid").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def synonym_dictionary(docs: DataFrame, tokens: Column, size: int = 200, window: int = 10, least: int = 3, passes: int = 10, most: int = 10, threshold: float = 0.6, seed: int = 7, parts: int | None = None, stop: list[str] = ()) -> DataFrame:
    """(term, synonyms) from a Word2Vec model fitted here; similarities are taken among the model's vocabulary.

    The ``most`` nearest words of a term are taken first, then the threshold
    and the stop words apply. Stop words are context in the training, but are
    neither expanded nor given. Scores are rounded to three digits at the end.
    ``parts``: partitions that train side by side; else one a core, but eight
    at most, as a pass waits for a second round of tasks if there are more parts than cores.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from quaero.operators.dense import dense_topk

    parts = parts or min(8, docs.sparkSession.sparkContext.defaultParallelism)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, maxIter=passes, numPartitions=parts, inputCol="tokens", outputCol="v").fit(docs.select(tokens.alias("tokens")).where("size(tokens) > 0"))
    # Written once: the model's rows are in the driver, and each plan over them would send them again.
    v = written(model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec")), "vectors")
    del model
    # The model gives its vectors in one partition, which would compare all words in one task.
    near = dense_topk(v, v.repartition(v.sparkSession.sparkContext.defaultParallelism), "word", "vec", most + 1).where("qid <> docid")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "docid")
    near = near.withColumn("k", F.row_number().over(w)).where((F.col("k") <= most) & (F.col("score") > threshold))
    near = near.where(~F.col("qid").isin(list(stop)) & ~F.col("docid").isin(list(stop))) if stop else near
    return near.groupBy(F.col("qid").alias("term")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("docid").alias("t")))), lambda x: F.struct(x["t"].alias("term"), F.round(-x["m"], 3).alias("score"))).alias("synonyms"))


def first_tokens(hits: DataFrame, docs: DataFrame, text: str, id_: str, most: int = 15) -> DataFrame:
    """(qid, terms): the first distinct white-space tokens of each query's hits, by rank and place."""
    t = hits.join(docs.select(F.col(id_).alias("docid"), F.split(F.trim(text), r"\s+").alias("a")), "docid").select("qid", "rank", F.posexplode("a").alias("at", "term")).where("term <> ''")
    one = t.groupBy("qid", "term").agg(F.min(F.struct("rank", "at")).alias("k"))
    w = Window.partitionBy("qid").orderBy("k", "term")
    top = one.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
