"""Quality gates: violations and ratios as plans, a check that raises on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import normalize_ws, token_count
from quaero.functions.vectors import ratio


def skip_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(reason, rows): rows by the first rule that holds, the rest as kept."""
    r = F.lit("kept")
    for name, cond in reversed(rules.items()):
        r = F.when(cond, name).otherwise(r)
    return df.groupBy(r.alias("reason")).agg(F.count("*").alias("rows"))


def alignment(run: DataFrame, queries: DataFrame, corpus: DataFrame, golds: DataFrame) -> DataFrame:
    """A row for each system: query overlap, and entries that are usable, missing from the corpus, or positives."""
    q = queries.select("qid").distinct().withColumn("known", F.lit(1))
    c = corpus.select("docid").distinct().withColumn("there", F.lit(1))
    g = golds.select("qid", "docid").distinct().withColumn("gold", F.lit(1))
    j = run.join(q, "qid", "left").join(c, "docid", "left").join(g, ["qid", "docid"], "left")
    known, there, gold = F.col("known").isNotNull(), F.col("there").isNotNull(), F.col("gold").isNotNull()
    usable = known & there & ~gold
    n = lambda x: F.sum(x.cast("int"))
    return j.groupBy("system").agg(
        F.countDistinct("qid").alias("run_qids"), F.countDistinct(F.when(known, F.col("qid"))).alias("overlap_qids"), F.countDistinct(F.when(usable, F.col("qid"))).alias("usable_qids"),
        F.count("*").alias("entries"), n(usable).alias("usable"), n(known & ~there).alias("missing"), n(known & there & gold).alias("positives"),
    ).withColumn("usable_ratio", F.round(ratio(F.col("usable"), F.col("entries")), 9))


def require_runs(aligned: DataFrame, queries: int, least_overlap: float = 0.0, least_usable: float = 0.0) -> None:
    """Raises ValueError with every run of ``alignment`` that lacks queries, overlap or usable candidates; the thresholds are shares of the query set."""
    for x in (least_overlap, least_usable):
        if not 0 <= x <= 1:
            raise ValueError("a threshold is a share between 0 and 1")
    n, issues = max(queries, 1), []
    for r in aligned.orderBy("system").collect():
        if not r.run_qids:
            issues.append(f"{r.system} has no query")
        elif not r.overlap_qids:
            issues.append(f"{r.system} has none of the {queries} queries")
        else:
            if r.overlap_qids / n < least_overlap:
                issues.append(f"{r.system} has {r.overlap_qids} of {queries} queries, less than {least_overlap:.1%}")
            if not r.usable_qids:
                issues.append(f"{r.system} has no usable candidate")
            elif r.usable_qids / n < least_usable:
                issues.append(f"{r.system} has usable candidates for {r.usable_qids} of {queries} queries, less than {least_usable:.1%}")
    if issues:
        raise ValueError("; ".join(issues))


def build_quality(negatives: DataFrame, n: int, pool: DataFrame | None = None, runs: int = 1, per_run: int | None = None) -> DataFrame:
    """One row of measures of a negative set (qid, docid, stage, support): stage 1 are run negatives, later ones fallback.

    ``pool``: (qid, docid, support), the usable candidates of all runs; without
    it the measures of candidates are those of the chosen ones. ``runs`` and
    ``per_run`` say how many run negatives a query can have at all; the rest is
    the least fallback, and what goes beyond it is excess.
    """
    capacity = n if per_run is None else per_run
    per_row = min(n, capacity * runs)
    least = max(0, n - per_row)
    s = negatives if "support" in negatives.columns else negatives.withColumn("support", F.lit(None).cast("bigint"))
    flag = lambda c: F.sum(c.cast("int"))
    first = F.col("stage") == 1
    chosen = s.groupBy("qid").agg(F.count("*").alias("all"), flag(first).alias("run"), flag(~first).alias("fallback"), flag(first & (F.col("support") > 1)).alias("shared"))
    source = s.where(first) if pool is None else pool
    candidates = source.groupBy("qid").agg(F.count("*").alias("candidates"), flag(F.col("support") > 1).alias("overlap"))
    per = chosen.join(candidates, "qid", "left").fillna(0, ["candidates", "overlap", "shared"]).withColumn("excess", F.greatest(F.col("fallback") - least, F.lit(0)))
    rows = F.count("*")
    mean = lambda c: F.round(ratio(F.sum(c), rows), 9)
    share = lambda c: F.round(ratio(flag(c), rows), 9)
    return per.agg(
        rows.alias("rows"), F.lit(capacity).cast("bigint").alias("capacity_per_run"), F.lit(per_row).cast("bigint").alias("capacity_per_row"), F.lit(least).cast("bigint").alias("least_fallback"),
        mean("candidates").alias("avg_candidates"), mean("overlap").alias("avg_overlap_candidates"), mean("all").alias("avg_selected"), mean("run").alias("avg_run_negatives"), mean("fallback").alias("avg_fallback"), mean("excess").alias("avg_excess_fallback"),
        share(F.col("run") > 0).alias("rows_with_run"), share(F.col("overlap") > 0).alias("rows_with_overlap_candidates"), share(F.col("shared") > 0).alias("rows_with_overlap_negatives"),
        share(F.col("fallback") > 0).alias("rows_with_fallback"), share(F.col("excess") > 0).alias("rows_with_excess_fallback"), share((F.col("run") == 0) & (F.col("fallback") > 0)).alias("rows_only_fallback"), share(F.col("all") < n).alias("rows_underfilled"),
    )


def require_quality(measures: DataFrame, runs: int = 1, least_with_run: float = 0.0, most_only_fallback: float = 1.0, most_excess: float = 1.0, least_candidates: float = 0.0, shared: bool = False) -> None:
    """Raises ValueError with every rule that the measures of ``build_quality`` break: no rows, no run negatives, too few rows with run negatives, too many rows of fallback only or of excess fallback, too few candidates, no candidate of several runs, rows that are short."""
    q = measures.first()
    broken = {
        "there is no row": not q.rows,
        "no row has a run negative": q.rows_with_run == 0,
        f"only {q.rows_with_run:.1%} of the rows have a run negative, {least_with_run:.1%} must": q.rows_with_run < least_with_run,
        f"{q.rows_only_fallback:.1%} of the rows have fallback only, {most_only_fallback:.1%} may": q.rows_only_fallback > most_only_fallback,
        f"{q.rows_with_excess_fallback:.1%} of the rows have more fallback than they must, {most_excess:.1%} may": q.rows_with_excess_fallback > most_excess,
        f"{q.avg_candidates:.2f} candidates a row, {least_candidates:.2f} are wanted": q.avg_candidates < least_candidates,
        "no candidate is in several runs": shared and runs > 1 and q.rows_with_overlap_candidates == 0,
        f"{q.rows_underfilled:.1%} of the rows are short": q.rows_underfilled > 0,
    }
    issues = [k for k, v in broken.items() if v]
    if issues:
        raise ValueError("; ".join(issues))


def coverage_warnings(statistics: DataFrame, queries: int, covered: int, least_overlap: float = 0.85, least_rank: float = 2.0) -> list[str]:
    """Warnings about a mined set: too few of the queries covered, negatives that rank too high. ``statistics``: as of ``negative_statistics``."""
    s, out = statistics.first(), []
    if covered < least_overlap * queries:
        out.append(f"{covered} of {queries} queries are covered")
    if s.mean_rank is not None and s.mean_rank < least_rank:
        out.append(f"the mean rank of the negatives is {s.mean_rank:.2f}")
    return out


def violations(groups: DataFrame, texts: DataFrame, least_tokens: float = 5.0, n: int | None = None) -> DataFrame:
    """(qid, issue) of training groups (qid, docid, label): no positive, no negative, a document twice, a positive as negative, short texts, a document without text, equal texts, a negative with a positive's text, and with ``n`` a wrong number of negatives."""
    per = groups.groupBy("qid").agg(
        F.sum((F.col("label") == 1).cast("int")).alias("p"), F.sum((F.col("label") == 0).cast("int")).alias("n"), F.count("*").alias("all"), F.countDistinct("docid").alias("d"),
    )
    both = groups.groupBy("qid", "docid").agg(F.countDistinct("label").alias("l")).where("l > 1").select("qid").distinct()
    joined = groups.join(texts, "docid", "left")
    short = joined.groupBy("qid").agg(F.avg(F.coalesce(token_count("text"), F.lit(0))).alias("m")).where(F.col("m") < least_tokens)
    keyed = joined.where("trim(text) <> ''").groupBy("qid", F.md5(F.lower(normalize_ws("text"))).alias("key")).agg(F.countDistinct("docid").alias("d"), F.countDistinct("label").alias("l"), F.countDistinct(F.when(F.col("label") == 0, F.col("docid"))).alias("dn"))
    parts = [
        per.where("p = 0").select("qid", F.lit("no positive").alias("issue")), per.where("n = 0").select("qid", F.lit("no negative").alias("issue")),
        per.where("d < all").select("qid", F.lit("document twice").alias("issue")), both.select("qid", F.lit("positive as negative").alias("issue")), short.select("qid", F.lit("short texts").alias("issue")),
        joined.where("text is null or trim(text) = ''").select("qid", F.lit("no text").alias("issue")).distinct(),
        keyed.where("dn > 1").select("qid", F.lit("equal negatives").alias("issue")).distinct(), keyed.where("l > 1 and d > 1").select("qid", F.lit("text of a positive").alias("issue")).distinct(),
    ]
    if n is not None:
        parts.append(per.where(F.col("n") != n).select("qid", F.lit("wrong number of negatives").alias("issue")))
    return reduce(DataFrame.unionByName, parts)


def one_gold(queries: DataFrame, qid: str = "qid", gold: str = "pubkey") -> DataFrame:
    """(qid, golds) of queries with several golds."""
    return queries.groupBy(F.col(qid).alias("qid")).agg(F.countDistinct(gold).alias("golds")).where("golds > 1")


def check(table: DataFrame, rules: dict[str, str], most: int = 20) -> None:
    """Raises ValueError with all rules that rows of a table break; rules are SQL conditions that must hold; at most ``most`` issues are shown."""
    cases = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    broken = table.select(F.explode(cases).alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rule").limit(most).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.n} rows" for r in broken))


def vocabulary_drift(a: DataFrame, b: DataFrame, words: Column) -> DataFrame:
    """One row: sizes of two vocabularies, what they share, their Jaccard similarity, and the mean number of distinct words of a row on either side."""
    count = lambda df, n: df.agg(F.round(F.avg(F.size(words)), 6).alias(n))
    va, vb = a.select(F.explode(words).alias("w")).distinct().withColumn("a", F.lit(1)), b.select(F.explode(words).alias("w")).distinct().withColumn("b", F.lit(1))
    j = va.join(vb, "w", "full")
    both = F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int"))
    one = j.agg(F.count("a").alias("size_a"), F.count("b").alias("size_b"), both.alias("shared"), F.round(ratio(both, F.count("*")), 9).alias("jaccard"))
    return one.crossJoin(F.broadcast(count(a, "mean_a"))).crossJoin(F.broadcast(count(b, "mean_b")))


def exact_keys(json_lines: DataFrame, keys: list[str], integer: str | None = None) -> DataFrame:
    """(value, issue) of JSON lines (value) that are no object, lack a key or have one too many, or whose ``integer`` key holds no whole number."""
    found = F.json_object_keys("value")
    want = F.array(*map(F.lit, sorted(keys)))
    issue = F.when(found.isNull(), "no object").when(F.size(F.array_except(want, found)) > 0, "missing key").when(F.size(F.array_except(found, want)) > 0, "unknown key")
    if integer:
        issue = issue.when(~F.coalesce(F.rlike(F.get_json_object("value", f"$.{integer}"), F.lit(r"^-?[0-9]+$")), F.lit(False)), "no whole number")
    return json_lines.select("value", issue.alias("issue")).where("issue is not null")


def exact_records(df: DataFrame, strings: list[str], index: str = "index") -> DataFrame:
    """(index, issue) of output rows whose string columns are null or blank, whose index repeats or is outside 0..n-1."""
    n = df.agg(F.count("*").alias("n"))
    blank = [F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"blank {c}")) for c in strings]
    a = df.select(index, F.explode(F.array_compact(F.array(*blank))).alias("issue"))
    b = df.groupBy(index).agg(F.count("*").alias("c")).where("c > 1").select(index, F.lit("repeated index").alias("issue"))
    c = df.crossJoin(F.broadcast(n)).where((F.col(index) < 0) | (F.col(index) >= F.col("n"))).select(index, F.lit("index outside").alias("issue"))
    return a.unionByName(b).unionByName(c)


def expected_fallback(wanted: int, run_candidates: float) -> float:
    """Negatives of a query that its runs are expected not to give."""
    return max(0.0, wanted - run_candidates)
