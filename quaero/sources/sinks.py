"""Writers; Spark's committers make each write atomic. Parquet in long form is the primary form of a run."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions.text import path_language, path_split, strip


def ranked_lists(run: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, preds array): the documents of a query by rank."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda x: x["docid"])
    kept = run if most is None else run.where(F.col("rank") <= most)
    return kept.groupBy("qid").agg(a.alias("preds"))


def write_run(run: DataFrame, path: str, mode: str = "errorifexists") -> None:
    run.write.mode(mode).partitionBy("system").parquet(path)


def write_rankings_json(run: DataFrame, path: str, mode: str = "errorifexists", most: int | None = None) -> None:
    """One JSON object {qid: [docids]} on each line, one query a line, so that no task holds all queries; ``most`` cuts a list before it is collected."""
    ranked_lists(run, most).select(F.to_json(F.create_map("qid", "preds")).alias("value")).write.mode(mode).text(path)


def rankings_object(run: DataFrame, most: int, limit: int = 100_000) -> str:
    """The text of one JSON object {qid: [docids]}; for exchange with tools that read such a file. More than ``limit`` queries are an error: they belong into lines."""
    rows = ranked_lists(run, most).orderBy("qid").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} queries; use write_rankings_json")
    return json.dumps({r.qid: r.preds for r in rows}, ensure_ascii=False)


def submission_rows(run: DataFrame, k: int = 5) -> DataFrame:
    """(index, preds) with preds as ``[a, b, c]``."""
    return ranked_lists(run, k).select(F.col("qid").alias("index"), F.concat(F.lit("["), F.array_join("preds", ", "), F.lit("]")).alias("preds"))


def write_submission(run: DataFrame, path: str, k: int = 5, mode: str = "errorifexists") -> None:
    submission_rows(run, k).write.mode(mode).csv(path, sep="\t", header=True, quote="")


def corpus_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text with tabs and line breaks as spaces; null as the empty text."""
    return docs.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ").alias(c) for c in columns])


def write_corpus_tsv(docs: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    corpus_rows(docs, columns).write.mode(mode).csv(path, sep="\t", header=True)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines without the columns that begin with an underscore."""
    df.select(*[c for c in df.columns if not c.startswith("_")]).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """A CSV with header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode(mode).csv(path, header=True)
    return True


def append_trial(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=False)


def metrics_document(per: DataFrame, totals: DataFrame, system: str, with_queries: bool = False) -> DataFrame:
    """One row ``value``: JSON of metadata and aggregate metrics of a system; ``with_queries`` adds rows (kind, value) with each query's metrics, one JSON object each."""
    one = totals.where(F.col("system") == system).select(F.to_json(F.struct(F.struct(F.col("system").alias("run"), F.col("queries").alias("queries")).alias("metadata"), F.struct(*[c for c in totals.columns if c not in ("system", "queries")]).alias("metrics"))).alias("value"))
    if not with_queries:
        return one
    each = per.where(F.col("system") == system).select(F.lit("per_query").alias("kind"), F.to_json(F.struct(*[c for c in per.columns if c != "system"])).alias("value"))
    return one.select(F.lit("metrics").alias("kind"), "value").unionByName(each)


def write_checked_json(df: DataFrame, path: str, needed: list[str], mode: str = "errorifexists") -> int:
    """JSON lines of rows whose ``needed`` columns are all filled, else ValueError before anything is written; gives their number. The committer renames whole files only."""
    blank = [F.col(c).isNull() | (strip(F.col(c).cast("string")) == "") for c in needed]
    bad = df.where(reduce(lambda a, b: a | b, blank)).limit(1).count() if blank else 0
    if bad:
        raise ValueError(f"rows without {', '.join(needed)}")
    write_json_lines(df, path, mode)
    return df.count()


def export_set(parts: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, int]:
    """Writes each table as JSON lines below a folder, and a summary with their row counts; gives the counts."""
    spark = next(iter(parts.values())).sparkSession
    counts = {}
    for name, df in parts.items():
        write_json_lines(df, f"{folder}/{name}", mode)
        counts[name] = spark.read.text(f"{folder}/{name}").count()
    rows = spark.createDataFrame([(k, v) for k, v in counts.items()], "part string, rows bigint").coalesce(1)
    rows.write.mode(mode).json(f"{folder}/summary")
    return counts


def manifest(coverage: DataFrame, paths: Column | None = None, statistics: Column | None = None) -> DataFrame:
    """Rows of a run manifest: coverage with six digits, split and language from the ranking file's path, and the path of its metrics."""
    p = paths if paths is not None else F.lit("")
    return coverage.select(
        "system", path_split(p).alias("split"), path_language(p).alias("language"), "ranking_qids", "matched_qids", F.format_string("%.6f", "coverage").alias("coverage"),
        p.alias("ranking_file"), (statistics if statistics is not None else F.lit("")).alias("metrics_file"),
    )


def export_id(c: Column) -> Column:
    """A value that is a number where the id is all digits, else null."""
    return F.when(F.rlike(c, F.lit("^[0-9]+$")), c.try_cast("bigint"))


def free_name(path: str) -> str:
    """The path, or with _1, _2, ... before its suffix, whichever does not exist."""
    stem, ext = os.path.splitext(path)
    i, out = 0, path
    while os.path.exists(out):
        i += 1
        out = f"{stem}_{i}{ext}"
    return out


def default_output(path: str, suffix: str = "_eval") -> str:
    stem, _ = os.path.splitext(path)
    return f"{stem}{suffix}.json"


def report(spark: SparkSession, title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A text report: the first rows of small result tables."""
    out = [title, "=" * len(title)]
    for name, t in tables.items():
        out += ["", name, "\t".join(t.columns)]
        out += ["\t".join("" if v is None else str(v) for v in r) for r in t.limit(most).collect()]
    return "\n".join(out) + "\n"
