"""Training sets for rankers: negatives, splits, variants, pairs.

Random choices are by a hash both engines share (md5 of seed and key), so
they repeat on any cluster and do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions.text import normalize_ws
from quaero.session import written


def hash_order(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("_", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def split_by_query(queries: DataFrame, seed: str = "42", train: float = 0.8, dev: float = 0.1, least_dev: int = 0, filled: bool = False) -> DataFrame:
    """(qid, split): every query in one split, sizes cut to integers, the rest is test.

    ``least_dev``: a floor of the dev split, taken from train. ``filled``: an empty split is an error.
    """
    if not (0 < train < 1 and 0 < dev < 1 and train + dev < 1):
        raise ValueError("the ratios must be between 0 and 1 and leave a test split")
    q = queries.select("qid").where("qid is not null").distinct()
    n = q.count()
    # A global order of keys only: ranks come from a range sort, not from one task.
    ordered = q.withColumn("h", hash_order(seed, "qid"))
    r = global_rank(ordered, ["h", "qid"])
    a, b = int(n * train), int(n * dev)
    if b < least_dev:
        a, b = max(0, a - (least_dev - b)), min(n, least_dev)
    if filled and not (a and b and n - a - b):
        raise ValueError(f"{n} queries leave a split empty")
    return r.select("qid", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "dev").otherwise("test").alias("split"))


def split_rows(df: DataFrame, keys: list[str], dev: float = 0.1, seed: str = "42") -> DataFrame:
    """The rows with ``split``: int(n * dev) of them in dev, by hash order of the keys, the rest in train; rows, not queries, are split."""
    if not 0 < dev < 1:
        raise ValueError("the ratio must be between 0 and 1")
    r = global_rank(df.withColumn("_h", hash_order(seed, *keys)), ["_h", *keys])
    n = df.count()
    return r.withColumn("split", F.when(F.col("rank") <= int(n * dev), "dev").otherwise("train")).drop("_h", "rank")


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 1 over the whole table without a single-task window: range sort, sizes of the partitions before, ranks inside.

    The range-sorted rows are written once with their partition's number, so that sizes and ranks see the same cut, and no row is sorted by range twice.
    """
    s = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return s.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def hash_number(seed: str, *keys: str) -> Column:
    """A number below 2^32 from the same hash."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def ring(docs: DataFrame, seed: str = "42", digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(docid, place): the distinct documents in hash order from 0, and their number as one row (total).

    Places are counted in parts by the first digits of the hash, so no task sees the whole order.
    """
    d = docs.select("docid").where("docid is not null").distinct().withColumn("h", hash_order(seed, "docid")).withColumn("b", F.substring("h", 1, digits))
    parts = d.groupBy("b").agg(F.count("*").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("b")) - F.col("size"))
    within = F.row_number().over(Window.partitionBy("b").orderBy("h", "docid"))
    # At most 16^digits parts.
    places = d.withColumn("i", within).join(F.broadcast(parts), "b").select("docid", (F.col("before") + F.col("i") - 1).alias("place"))
    return places, parts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))


def drawn(need: DataFrame, docs: DataFrame, seed: str = "42") -> DataFrame:
    """(qid, docid, step): for each (qid, steps) as many documents of the ring as ``steps``, from the query's own place on; the whole ring if it is shorter."""
    places, total = ring(docs, seed)
    q = need.select("qid", "steps").crossJoin(F.broadcast(total)).where("total > 0 and steps > 0")
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("steps", "total") - 1))
    q = q.select("qid", "total", steps.alias("step")).select("qid", "step", F.pmod(F.pmod(hash_number(seed, "qid"), F.col("total")) + F.col("step"), F.col("total")).alias("place"))
    return q.join(places, "place").select("qid", "docid", "step")


def candidate_negatives(run: DataFrame, golds: DataFrame, corpus: DataFrame, depth: int | None = None, per_run: int | None = None) -> DataFrame:
    """(system, qid, docid, rank, pos): a run's documents that are in the corpus and no positives, renumbered; ``depth`` cuts before, ``per_run`` after the filters."""
    r = run if depth is None else run.where(F.col("rank") <= depth)
    r = r.join(corpus.select("docid"), "docid", "left_semi").join(golds.select("qid", "docid"), ["qid", "docid"], "left_anti")
    w = Window.partitionBy("system", "qid").orderBy("rank")
    r = r.withColumn("pos", F.row_number().over(w))
    return r if per_run is None else r.where(F.col("pos") <= per_run)


def offset_negatives(candidates: DataFrame, hard: tuple[int, int] = (1, 5), soft: tuple[int, int] = (10, 5), by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(by..., docid, kind, pos): hard negatives after an offset, soft ones from the middle; a slice that falls short goes back to the head, lists with too few candidates go.

    ``hard`` and ``soft`` are (offset, number); ``by`` names a list: a query of one run, or ("system", "qid") of several.
    """
    (ho, hn), (so, sn) = hard, soft
    n = F.count("*").over(Window.partitionBy(*by))
    c = candidates.withColumn("n", n).where(F.col("n") >= hn + 2)
    start = F.when(F.col("n") >= ho + hn, ho).otherwise(0)
    is_hard = (F.col("pos") > start) & (F.col("pos") <= start + hn)
    is_soft = (F.col("pos") > so) & (F.col("pos") <= so + sn) & ~is_hard
    return c.where(is_hard | is_soft).select(*by, "docid", F.when(is_hard, "hard").otherwise("soft").alias("kind"), "pos")


def merged_negatives(negatives: DataFrame) -> DataFrame:
    """(qid, docid, kind) of negatives of several runs; a document that is hard in one run is hard."""
    return negatives.groupBy("qid", "docid").agg(F.min("kind").alias("kind"))


def text_keys(texts: DataFrame) -> DataFrame:
    """(docid, key): equal keys for texts that are equal but for case and white space."""
    return texts.select("docid", F.md5(F.lower(normalize_ws("text"))).alias("key"))


def fused_negatives(run: DataFrame, golds: DataFrame, texts: DataFrame, n: int, c: int = 60, seed: str = "42", fill: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """(qid, docid, stage, place, support): up to n negatives of each query.

    1: candidates of all runs by fusion evidence; 2: ``base`` negatives (qid,
    docid, pos) of an earlier set; 3 (2 without base): ``fill`` (qid, docid).
    One for each normalised text, none with the text of a positive. texts:
    (docid, text). support: the runs that have the document, null in later stages.
    """
    from quaero.operators.fusion import reciprocal_rank_fusion

    t = text_keys(texts)
    none = F.lit(None).cast("bigint")
    pool = reciprocal_rank_fusion(run, c).select("qid", "docid", F.lit(1).alias("stage"), F.lit("").alias("o"), F.col("place").alias("p"), "support")
    later = 2
    if base is not None:
        pool = pool.unionByName(base.select("qid", "docid", F.lit(2).alias("stage"), F.lit("").alias("o"), F.col("pos").cast("int").alias("p"), none.alias("support")))
        later = 3
    if fill is not None:
        pool = pool.unionByName(fill.select("qid", "docid", F.lit(later).alias("stage"), hash_order(seed, "qid", "docid").alias("o"), F.lit(0).alias("p"), none.alias("support")))
    pool = pool.join(t, "docid")
    positive = golds.join(t, "docid").select("qid", "key").distinct()
    free = pool.join(positive, ["qid", "key"], "left_anti").join(golds.select("qid", "docid"), ["qid", "docid"], "left_anti")
    first = free.withColumn("k", F.row_number().over(Window.partitionBy("qid", "key").orderBy("stage", "p", "o", "docid"))).where("k = 1")
    w = Window.partitionBy("qid").orderBy("stage", "p", "o", "docid")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("qid", "docid", "stage", "place", "support")


def filled_negatives(queries: DataFrame, run: DataFrame, golds: DataFrame, texts: DataFrame, n: int, base: DataFrame | None = None, c: int = 60, seed: str = "42") -> DataFrame:
    """(qid, docid, stage, place, support): exactly n negatives of each query, fewer only where the corpus has no more.

    Stages 1 and 2 as in ``fused_negatives``; stage 3 are random documents of
    the ring, for the queries that are short only. A query that is still short
    (its draws were positives, or equal in text) draws twice as many in the
    next round, until it is full or has met the whole ring.
    """
    keys = written(text_keys(texts), "keys")
    own = golds.select("qid", "docid").distinct()
    positive = own.join(keys, "docid").select("qid", "key").distinct()
    chosen = written(fused_negatives(run, golds, texts, n, c, seed, base=base), "chosen")
    asked = written(queries.select("qid").where("qid is not null").distinct(), "asked")
    total, met, steps = keys.count(), 0, 2 * n + 8
    while True:
        have = chosen.groupBy("qid").agg(F.count("*").alias("have"))
        short = written(asked.join(have, "qid", "left").fillna(0, ["have"]).where(F.col("have") < n), "short")
        if met >= total or short.isEmpty():
            return chosen
        used = chosen.join(short.select("qid"), "qid", "left_semi").join(keys, "docid").select("qid", "key").distinct()
        got = drawn(short.select("qid", F.lit(steps).cast("bigint").alias("steps")), keys, seed).join(keys, "docid")
        got = got.join(own, ["qid", "docid"], "left_anti").join(positive.unionByName(used), ["qid", "key"], "left_anti")
        once = got.withColumn("k", F.row_number().over(Window.partitionBy("qid", "key").orderBy("step"))).where("k = 1")
        more = once.join(short, "qid").withColumn("place", F.col("have").cast("int") + F.row_number().over(Window.partitionBy("qid").orderBy("step"))).where(F.col("place") <= n)
        chosen = written(chosen.unionByName(more.select("qid", "docid", F.lit(3).alias("stage"), "place", F.lit(None).cast("bigint").alias("support"))), "chosen")
        met, steps = steps, 2 * steps


def random_negatives(queries: DataFrame, corpus: DataFrame, golds: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """(qid, docid): n random documents of each query that are no positives; fewer only where the corpus has no more.

    The corpus stands on a ring in hash order. A query starts at its own place
    and meets n documents and as many as it has positives, so that n are left.
    No pair of every query with every document is made.
    """
    q = queries.select("qid").where("qid is not null").distinct()
    own = golds.select("qid", "docid").distinct()
    need = q.join(own.groupBy("qid").agg(F.count("*").alias("own")), "qid", "left").select("qid", (F.coalesce("own", F.lit(0)) + n).cast("bigint").alias("steps"))
    got = drawn(need, corpus, seed).join(own, ["qid", "docid"], "left_anti")
    w = Window.partitionBy("qid").orderBy("step")
    return got.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("qid", "docid")


def query_variants(queries: DataFrame, variants: list[str]) -> DataFrame:
    """(qid, variant, text): one row for each distinct text of a query, the first variant wins."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("variant"), normalize_ws(v).alias("text")) for i, v in enumerate(variants)])
    x = queries.select("qid", F.explode(rows).alias("r")).select("qid", "r.*").where("text is not null and text <> ''")
    return x.groupBy("qid", "text").agg(F.min(F.struct("i", "variant")).alias("v")).select("qid", F.col("v.variant").alias("variant"), "text")


def labelled_pairs(positives: DataFrame, negatives: DataFrame, hard_times: int = 2) -> DataFrame:
    """(qid, docid, label, kind): positives once, hard negatives ``hard_times``, others once."""
    pos = positives.select("qid", "docid", F.lit(1).alias("label"), F.lit("pos").alias("kind"))
    times = F.when(F.col("kind") == "hard", hard_times).otherwise(1)
    neg = negatives.select("qid", "docid", F.lit(0).alias("label"), "kind", F.explode(F.sequence(F.lit(1), times)).alias("i")).drop("i")
    return pos.unionByName(neg)


def positive_weight(pairs: DataFrame) -> DataFrame:
    """One row: negatives by positives."""
    return pairs.agg(F.sum((F.col("label") == 1).cast("int")).alias("positives"), F.sum((F.col("label") == 0).cast("int")).alias("negatives")).withColumn("pos_weight", F.round(F.col("negatives") / F.greatest("positives", F.lit(1)), 9))


def mining_window(neighbours: DataFrame, positive_scores: DataFrame, ranks: tuple[int, int] = (5, 50), most: float = 0.85, margin: float = 0.05, n: int = 5) -> DataFrame:
    """(qid, docid, score, pos): neighbours of a rank window, scored at most ``most`` and at least ``margin`` below the positive, the first n."""
    j = neighbours.where(F.col("rank").between(*ranks)).join(positive_scores.select("qid", F.col("score").alias("p")), "qid")
    j = j.where((F.col("score") <= most) & (F.col("score") <= F.col("p") - margin))
    w = Window.partitionBy("qid").orderBy("rank")
    return j.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("qid", "docid", "score", "pos")


def qrels_of(queries: DataFrame, qid: str = "qid", gold: str = "pubkey") -> DataFrame:
    """(qid, docid, relevance): distinct gold rows."""
    return queries.where(F.col(gold).isNotNull() & F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.col(gold).alias("docid"), F.lit(1).alias("relevance")).distinct()


def interleaved(a: DataFrame, b: DataFrame, key: str, seed: str = "42", window: int = 128) -> DataFrame:
    """(key, src, place): two sets merged in proportion, then put in hash order inside windows of ``window`` places."""
    def spread(df: DataFrame, src: str) -> DataFrame:
        r = global_rank(df.select(key).withColumn("h", hash_order(seed, key)), ["h", key])
        n = r.count()
        return r.select(key, F.lit(src).alias("src"), (F.col("rank") / F.lit(float(max(n, 1)))).alias("at"), "h")

    u = global_rank(spread(a, "a").unionByName(spread(b, "b")), ["at", "src", key]).withColumnRenamed("rank", "r")
    block = F.floor((F.col("r") - 1) / window)
    inner = F.row_number().over(Window.partitionBy("block").orderBy("h", "src"))
    return u.withColumn("block", block).select(key, "src", (F.col("block") * window + inner).cast("bigint").alias("place"))


def reuse_of_negatives(negatives: DataFrame, n: int = 10) -> DataFrame:
    """(docid, uses): the documents used most often as negatives."""
    return negatives.groupBy("docid").agg(F.count("*").alias("uses")).orderBy(F.col("uses").desc(), "docid").limit(n)


def gold_of(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, docid): the query's own gold if the corpus has it, else its first positive in the qrels by id."""
    c = corpus.select("docid").distinct()
    own = queries.where("gold is not null").select("qid", F.col("gold").alias("docid")).join(c, "docid", "left_semi").groupBy("qid").agg(F.min("docid").alias("own"))
    other = qrels.where("relevance > 0").join(c, "docid", "left_semi").groupBy("qid").agg(F.min("docid").alias("other"))
    return queries.select("qid").distinct().join(own, "qid", "left").join(other, "qid", "left").select("qid", F.coalesce("own", "other").alias("docid")).where("docid is not null")


def union_editions(editions: dict[str, DataFrame]) -> DataFrame:
    """(qid, docid, ...) of several editions, query ids prefixed by the edition; each (qid, docid) once."""
    from functools import reduce

    parts = [df.withColumn("qid", F.concat(F.lit(f"{name}_"), F.col("qid"))) for name, df in editions.items()]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["qid", "docid"])


def first_come_negatives(run: DataFrame, golds: DataFrame, order: list[str], n: int) -> DataFrame:
    """(qid, docid, place): negatives run after run in a given order, without fusion; each document once."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("system"))
    r = run.where(F.col("system").isin(order)).join(golds.select("qid", "docid"), ["qid", "docid"], "left_anti")
    one = r.groupBy("qid", "docid").agg(F.min(F.struct(at.alias("a"), "rank")).alias("k"))
    w = Window.partitionBy("qid").orderBy("k.a", "k.rank", "docid")
    return one.select("qid", "docid", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def used_at_most(negatives: DataFrame, most: int, seed: str = "42") -> DataFrame:
    """Each document as a negative of at most ``most`` queries, those first in hash order. The sequential rule of a greedy builder depends on row order; this one does not."""
    w = Window.partitionBy("docid").orderBy(hash_order(seed, "qid", "docid"))
    return negatives.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def sequential_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Adds 0, 1, 2, ... over the whole table in an order."""
    return global_rank(df, order).withColumn(name, (F.col("rank") - 1).cast("bigint")).drop("rank")


def candidate_lists(pairs: DataFrame, most: int) -> DataFrame:
    """(qid, pos array, docs array) of labelled pairs (qid, docid, label): positives, and all documents with the positives first; at most ``most`` documents of a query are listed.

    Ranked before they are collected, so a list never holds more than ``most``.
    """
    once = pairs.groupBy("qid", "docid").agg(F.max("label").alias("label"))
    w = Window.partitionBy("qid").orderBy(F.col("label").desc(), "docid")
    top = once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    a = F.array_sort(F.collect_list(F.struct("k", "docid", "label")))
    g = top.groupBy("qid").agg(a.alias("a"))
    return g.select("qid", F.transform(F.filter("a", lambda x: x["label"] > 0), lambda x: x["docid"]).alias("pos"), F.transform("a", lambda x: x["docid"]).alias("docs"))


def negative_statistics(negatives: DataFrame, golds_run: DataFrame) -> DataFrame:
    """One row (negatives, mean_rank, overlap, overlap_rate): mean rank of the negatives, and how many stand in a second list (qid, docid) too."""
    j = negatives.join(golds_run.select("qid", "docid").distinct().withColumn("_in", F.lit(1)), ["qid", "docid"], "left")
    n = F.count("*")
    return j.agg(n.alias("negatives"), F.round(F.avg("rank"), 9).alias("mean_rank"), F.count("_in").alias("overlap"), F.round(F.count("_in") / F.greatest(n, F.lit(1)), 9).alias("overlap_rate"))
