"""Readers: explicit schemas, alias lists resolved by coalesce, no inference.

JSON ids may be numbers or strings; all become strings.
"""

from __future__ import annotations

import fnmatch
import json
import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaero.functions.text import first_filled, identifier, path_language, strip

# The names under which records carry a property, first present wins.
QUERY_IDS = ("index", "qid", "id", "position", "query_id", "queryId", "post_id")
DOCUMENT_IDS = ("docid", "doc_id", "document_id", "documentId", "pubkey", "docno", "id", "cord_uid")
RANKS, SCORES = ("rank", "position"), ("score", "similarity", "value")
GOLDS = ("pubkey", "docid", "document_id", "target_pubkey", "cord_uid")
TEXTS = ("expanded", "original", "text", "query")


def _json(spark: SparkSession, path: str | list[str], names: list[str], lines: bool) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in dict.fromkeys(names))
    return spark.read.schema(schema).json(path, multiLine=not lines)


def _ids(names: tuple[str, ...], df: DataFrame) -> Column:
    return F.coalesce(*[identifier(n) for n in names if n in df.columns])


def existing(spark: SparkSession, paths: list[str], needed: bool = True) -> list[str]:
    """The paths that exist and are not empty; the others are an error, or with ``needed`` off a warning."""
    good, bad = [], []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        size = sum(f.getLen() if f.isFile() else 1 for f in found) if found else 0
        (good if size else bad).append(p)
    if bad and needed:
        raise FileNotFoundError(f"missing or empty: {', '.join(bad)}")
    if bad:
        warnings.warn(f"left out, missing or empty: {', '.join(bad)}", stacklevel=2)
    return good


def shape(spark: SparkSession, path: str) -> str:
    """``records``, ``map of lists``, ``map of records``, ``map of values`` or ``lines``, from the beginning of a JSON file: its first values, at most twenty."""
    head = spark.read.text(path, wholetext=True).select(F.ltrim(F.col("value")).alias("v")).first()
    if head is None or not head.v:
        raise ValueError(f"{path} is empty")
    if head.v[0] == "[":
        return "records"
    decoder, at = json.JSONDecoder(), 0
    try:
        first, at = decoder.raw_decode(head.v)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} holds no JSON: {e}") from e
    if head.v[at:].strip():
        return "lines"
    some = list(first.values())[:20]
    for kind, name in ((list, "map of lists"), (dict, "map of records")):
        if some and all(isinstance(x, kind) for x in some):
            return name
    return "map of values"


def any_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of a list of records, JSON lines, or a map from ids to texts or records."""
    kind = shape(spark, path)
    if kind in ("records", "lines"):
        return queries(spark, path, lines=kind == "lines").select("qid", "query")
    return query_map(spark, path)


def first_queries(qs: DataFrame, most: int | None = None, prefix: str = "", order: str | None = None) -> DataFrame:
    """The first ``most`` queries with a text, in the order of a column (of the rows where it is None), with a prefix before each text."""
    q = qs.where("qid is not null and trim(query) <> ''").withColumn("query", F.concat(F.lit(prefix), "query"))
    if most is None:
        return q
    if most < 1:
        raise ValueError("the number of queries must be positive")
    at = F.monotonically_increasing_id() if order is None else F.col(order)
    return q.withColumn("_at", at).orderBy("_at", "qid").limit(most).drop("_at")


def query_ids(qs: DataFrame) -> DataFrame:
    """(qid): the distinct ids; no id is an error."""
    ids = qs.select(identifier("qid").alias("qid")).where("qid is not null").distinct()
    if ids.isEmpty():
        raise ValueError("there is no query id")
    return ids


def papers(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """(docid, title, abstract, venue, authors) of a JSON array or JSON lines; both id dialects; rows without an id go."""
    df = _json(spark, path, [*DOCUMENT_IDS, "title", "abstract", "venue", "authors"], lines)
    return df.select(_ids(("pubkey", "cord_uid", "docid", "doc_id", "id"), df).alias("docid"), "title", "abstract", "venue", "authors").where("docid is not null")


def corpus(docs: DataFrame, text: Column | None = None, order: str | None = None) -> DataFrame:
    """(docid, text): one row for each id; rows without text go; an empty result is an error.

    ``order``: a column that says which row came first, and the first with text
    is kept; a table without one has no first row, so the least text is.
    """
    t = F.concat_ws(" ", F.nullif(strip("title"), F.lit("")), F.nullif(strip("abstract"), F.lit(""))) if text is None else text
    rows = docs.select("docid", t.alias("text"), *([F.col(order).alias("_at")] if order else [])).where("docid is not null and text <> ''")
    out = rows.groupBy("docid").agg((F.min(F.struct("_at", "text"))["text"] if order else F.min("text")).alias("text"))
    if out.isEmpty():
        raise ValueError("the corpus has no document with text")
    return out


def queries(spark: SparkSession, path: str | list[str], lines: bool = False, order: tuple[str, ...] = TEXTS, strict: bool = False) -> DataFrame:
    """(qid, query, gold, language, ...) of a list of records; ``order`` says which text wins; the language comes from the file's name."""
    names = list(dict.fromkeys([*QUERY_IDS, *GOLDS, *TEXTS, "keywords", "sparse", "embedding", "colbert"]))
    df = _json(spark, path, names, lines).withColumn("_file", F.input_file_name())
    ids = ("index", "qid", "query_id", "queryId", "post_id", "id", "position")
    out = df.select(_ids(ids, df).alias("qid"), first_filled(*order).alias("query"), _ids(("pubkey", "target_pubkey", "document_id", "docid", "cord_uid"), df).alias("gold"), path_language("_file").alias("language"), "original", "keywords", "sparse", "embedding", "colbert", "expanded")
    if strict and out.where("qid is null or query is null").limit(1).count():
        raise ValueError("records without an id or a text")
    return out.where("qid is not null and query is not null")


def query_map(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of {qid: text} or {qid: {text: ...}}."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("qid", "v"))
    inner = F.from_json("v", "struct<expanded:string,original:string,text:string,query:string>")
    obj = F.coalesce(*[F.nullif(strip(inner[c]), F.lit("")) for c in TEXTS])
    return t.select("qid", F.when(F.col("v").startswith("{"), obj).otherwise(strip("v")).alias("query")).where("query <> ''")


def view_text(view: str, fallback: tuple[str, ...] = ("expanded", "original", "text")) -> tuple[Column, Column]:
    """Text of a query view with its fallbacks, and the name of the column it came from."""
    order = [view, *[f for f in fallback if f != view]]
    name = F.lit(None).cast("string")
    for c in reversed(order):
        name = F.when(F.coalesce(strip(c), F.lit("")) != "", c).otherwise(name)
    return first_filled(*order), name


def view_chain(view: str) -> Column:
    """The view, else the views that stand for it: colbert, embedding, sparse, expanded."""
    chain = ["colbert", "embedding", "sparse", "expanded"]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in chain[chain.index(view) :]], F.col("sparse"))


def ranking_map(spark: SparkSession, path: str | list[str], system: str | None = None, lines: bool = False) -> DataFrame:
    """(system, qid, docid, rank, score) of {qid: [docid or record]} or {qid: {docid: score or record}}.

    A file is one object, read by one task, or with ``lines`` an object on each
    line, read in parallel (as ``sinks.write_rankings_json`` writes it).
    """
    name = F.lit(system) if system else F.regexp_replace(F.regexp_replace(F.input_file_name(), r"^.*/", ""), r"\.[^.]*$", "")
    t = spark.read.text(path, wholetext=not lines).select(name.alias("system"), F.from_json("value", "map<string,string>").alias("m")).select("system", F.explode("m").alias("qid", "v"))
    record = "struct<" + ",".join(f"{n}:string" for n in dict.fromkeys([*DOCUMENT_IDS, *RANKS, *SCORES])) + ">"

    def parts(x: Column) -> tuple[Column, Column, Column]:
        r = F.from_json(x, record)
        return F.coalesce(*[F.nullif(strip(r[n]), F.lit("")) for n in DOCUMENT_IDS]), F.coalesce(*[r[n] for n in RANKS]).try_cast("int"), F.coalesce(*[r[n] for n in SCORES]).try_cast("double")

    lists = t.where(F.col("v").startswith("[")).select("system", "qid", F.posexplode(F.from_json("v", "array<string>")).alias("p", "x"))
    d, r, s = parts(F.col("x"))
    is_rec = F.col("x").startswith("{")
    a = lists.select("system", "qid", F.when(is_rec, d).otherwise(strip("x")).alias("docid"), F.coalesce(F.when(is_rec & (r > 0), r), F.col("p") + 1).alias("rank"), F.when(is_rec, s).alias("score"))
    maps = t.where(F.col("v").startswith("{")).select("system", "qid", F.explode(F.from_json("v", "map<string,string>")).alias("docid", "x"))
    _, r, s = parts(F.col("x"))
    b = maps.select("system", "qid", strip("docid").alias("docid"), F.when(is_rec & (r > 0), r).alias("rank"), F.when(is_rec, s).otherwise(F.col("x").try_cast("double")).alias("score"))
    return renumbered(a.unionByName(b))


def run_records(spark: SparkSession, path: str | list[str], system: str, lines: bool = True) -> DataFrame:
    """(system, qid, docid, rank, score) of one record for each entry."""
    df = _json(spark, path, ["qid", "query_id", "queryId", *DOCUMENT_IDS, *RANKS, *SCORES], lines)
    return renumbered(df.select(F.lit(system).alias("system"), _ids(("qid", "query_id", "queryId"), df).alias("qid"), _ids(DOCUMENT_IDS, df).alias("docid"), F.coalesce(*[F.col(c).try_cast("int") for c in RANKS]).alias("rank"), F.coalesce(*[F.col(c).try_cast("double") for c in SCORES]).alias("score")))


def record_issues(spark: SparkSession, path: str | list[str], lines: bool = True) -> DataFrame:
    """(reason, rows) of run records: kept, or skipped for want of a query id or a document id."""
    df = _json(spark, path, ["qid", "query_id", "queryId", *DOCUMENT_IDS], lines)
    r = F.when(_ids(("qid", "query_id", "queryId"), df).isNull(), "no query id").when(_ids(DOCUMENT_IDS, df).isNull(), "no document id").otherwise("kept")
    return df.groupBy(r.alias("reason")).agg(F.count("*").alias("rows"))


def trec_run(spark: SparkSession, path: str | list[str], system: str) -> DataFrame:
    """(system, qid, docid, rank, score) of text lines ``qid Q0 doc rank score tag``, ``qid doc rank score`` or ``qid doc``; blank and # lines go."""
    c = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(c.alias("c"), F.monotonically_increasing_id().alias("line"))
    n = F.size("c")
    at = lambda i: F.get("c", F.lit(i))
    six = (n >= 6) & (F.upper(at(1)) == "Q0")
    doc = F.when(six, at(2)).when(n >= 2, at(1))
    rank = F.when(six, at(3).try_cast("int")).when(n >= 4, at(2).try_cast("int"))
    score = F.when(six, at(4).try_cast("double")).when(n >= 4, at(3).try_cast("double"))
    return renumbered(t.select(F.lit(system).alias("system"), at(0).alias("qid"), doc.alias("docid"), rank.alias("rank"), score.alias("score"), "line"))


def renumbered(entries: DataFrame) -> DataFrame:
    """Explicit ranks beat scores inside a query; without ranks, scores fall and ties go by docid; one row for each document, ranks from 1."""
    from pyspark.sql import Window

    e = entries.where("qid is not null and docid is not null and docid <> ''")
    line = F.col("line") if "line" in e.columns else F.lit(0)
    e = e.withColumn("r", F.when(F.col("rank") > 0, F.col("rank"))).withColumn("l", line)
    one = e.groupBy("system", "qid", "docid").agg(F.min("r").alias("r"), F.max("score").alias("score"), F.min("l").alias("l"))
    w = Window.partitionBy("system", "qid").orderBy(F.col("r").asc_nulls_last(), F.col("score").desc_nulls_last(), "l", "docid")
    return one.select("system", "qid", "docid", F.row_number().over(w).alias("rank"), "score")


def read_run(spark: SparkSession, path: str, system: str) -> DataFrame:
    """A run by the suffix of its file: .json, .jsonl, or text."""
    if path.endswith(".jsonl"):
        return run_records(spark, path, system)
    if path.endswith(".json"):
        head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).first()
        return run_records(spark, path, system, lines=False) if head and head[0] == "[" else ranking_map(spark, path, system)
    return trec_run(spark, path, system)


def discover_runs(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(path, length) of run files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line raises ValueError with its file, place and beginning, or with ``strict`` off is kept in ``_corrupt_record``.

    The place is counted in bytes of the lines before it in its part of the
    file, since lines have no number in a file that is read in parts; for a
    file of one part (``bad_lines``) it is the line's number.
    """
    df = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")
    if not strict:
        return df
    bad = bad_lines(spark, path)
    some = bad.orderBy("file", "line").limit(1).collect()
    if some:
        raise ValueError(f"{some[0].file}, line {some[0].line}: {some[0].value[:80]}")
    return df.drop("_corrupt_record")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that hold no JSON, with their number from 1 in the file.

    Only files that have a bad line are numbered, each by counting its lines part by part.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    bad = t.where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))
    few = t.join(bad.select("file").distinct(), "file", "left_semi")
    w = Window.partitionBy("file", "start").orderBy("at")
    inside = few.withColumn("n", F.row_number().over(w))
    sizes = few.groupBy("file", "start").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("file").orderBy("start")) - F.col("size"))
    out = inside.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("n")).alias("line"), "value")
    return out.where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))


def ground_truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, gold) of a tab-separated file with a header."""
    return spark.read.schema("post_id string, tweet_text string, cord_uid string").csv(path, sep="\t", header=True).select(F.col("post_id").alias("qid"), F.col("tweet_text").alias("query"), F.col("cord_uid").alias("gold"))


def qrels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(qid, docid, relevance) of {qid: {docid: relevance}}; one object a file, or with ``lines`` one on each line."""
    t = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    return t.select(F.explode("m").alias("qid", "x")).select("qid", F.explode("x").alias("docid", "relevance"))


def stopwords(spark: SparkSession, path: str | list[str], most: int = 20_000) -> list[str]:
    """Words of stop lists, stripped, lower case, without blank and # lines; a list above ``most`` words is an error; a missing file gives none."""
    paths = [path] if isinstance(path, str) else path
    there = [p for p in paths if "://" in p or "*" in p or os.path.exists(p)]
    if not there:
        return []
    rows = spark.read.text(there).select(F.lower(F.trim("value")).alias("w")).where("w <> '' and not startswith(w, '#')").distinct().orderBy("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} stop words")
    return [r.w for r in rows]


# Other names of the metrics of such files.
METRIC_NAMES = {"map": "ap", "recall@1": "hit@1", "mrr": "mrr@5", "ndcg": "ndcg@10", "f1": "f1@1", "p@1": "precision@1"}


def metric_rows(spark: SparkSession, path: str | list[str], metrics: list[str], system: str | None = None) -> DataFrame:
    """(system, qid, metric, score, first_rank) of metric files with a ``per_query`` list; a missing f1@1 is made of precision and recall at 1."""
    metrics = [METRIC_NAMES.get(m.lower(), m.lower()) for m in metrics]
    fields = ",".join(f"`{m}`:double" for m in dict.fromkeys([*metrics, "precision@1", "hit@1"]))
    name = F.lit(system) if system else F.regexp_replace(F.regexp_replace(F.input_file_name(), r"^.*/", ""), r"\.[^.]*$", "")
    df = spark.read.schema(f"per_query array<struct<qid:string,first_relevant_rank:int,{fields}>>").json(path, multiLine=True)
    r = df.select(name.alias("system"), F.explode("per_query").alias("r"))
    p, h = F.col("r.`precision@1`"), F.col("r.`hit@1`")
    f1 = F.when(p + h > 0, 2 * p * h / (p + h)).otherwise(0.0)
    vals = [F.struct(F.lit(m).alias("metric"), (F.coalesce(F.col(f"r.`{m}`"), f1) if m == "f1@1" else F.col(f"r.`{m}`")).alias("score")) for m in metrics]
    return r.select("system", F.col("r.qid").alias("qid"), F.col("r.first_relevant_rank").alias("first_rank"), F.explode(F.array(*vals)).alias("v")).select("system", "qid", "v.metric", "v.score", "first_rank")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonyms) of {word: [{term, score}]}."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<term:string,score:double>>>").alias("m"))
    return t.select(F.explode("m").alias("term", "synonyms"))


def translation_cache(spark: SparkSession, path: str) -> DataFrame:
    """(direction, source, target) of {direction: {text: text}}; anything else in it is an error."""
    t = spark.read.text(path, wholetext=True).select("value", F.from_json("value", "map<string,map<string,string>>").alias("m"), F.from_json("value", "map<string,string>").alias("outer"))
    odd = t.where(F.col("m").isNull() | F.exists(F.map_values("outer"), lambda v: v.isNull() | ~v.startswith("{")) | F.exists(F.map_values("m"), lambda v: v.isNull() | F.exists(F.map_values(v), lambda x: x.isNull())))
    if not odd.isEmpty():
        raise ValueError("the cache is no map of directions to maps of texts")
    return t.select(F.explode("m").alias("direction", "x")).select("direction", F.explode("x").alias("source", "target"))


def seen_trials(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The distinct settings of earlier trials, without header (as ``sinks.append_trial`` writes them); a missing file gives none."""
    schema = ", ".join(f"`{n}` double" for n in names)
    there_ = existing(spark, [path], needed=False)
    return spark.read.schema(schema).csv(there_).distinct() if there_ else spark.createDataFrame([], schema)


def discover_inputs(root: str, glob: str = "*.json", outputs: tuple[str, ...] = ("expanded_", "results_", "metrics_")) -> list[str]:
    """Input files below a folder, without those whose names say that they are results."""
    found = [os.path.join(d, f) for d, _, files in os.walk(root) for f in fnmatch.filter(files, glob)]
    return sorted(p for p in found if not os.path.basename(p).startswith(outputs))


def training_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(qid, query, pos, neg, hard_neg, pos_ids, neg_ids, variant) of JSON lines in either dialect (positive/negatives or pos/neg/hard_neg); rows without a query or a positive are an error."""
    a = "array<string>"
    schema = f"qid string, query string, variant string, pos {a}, neg {a}, hard_neg {a}, positive string, negatives {a}, pos_pubkeys {a}, neg_pubkeys {a}, gold_pubkey string"
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    none = F.array().cast("array<string>")
    filled = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    out = df.select(
        identifier("qid").alias("qid"), strip("query").alias("query"), filled(F.coalesce("pos", F.array("positive"))).alias("pos"), filled(F.coalesce("neg", "negatives")).alias("neg"), filled(F.col("hard_neg")).alias("hard_neg"),
        filled(F.coalesce("pos_pubkeys", F.array("gold_pubkey"))).alias("pos_ids"), filled(F.col("neg_pubkeys")).alias("neg_ids"), "variant",
    )
    bad = out.where("query is null or query = '' or size(pos) = 0").limit(1).count()
    if bad:
        raise ValueError("a training row has no query or no positive")
    return out


def search_filters(text: Column) -> Column:
    """struct(text, venue, author) of a query that names ``venue:"..."`` or ``author:...``; the filters leave the text; the author goes on to the end."""
    venue = F.nullif(F.lower(F.regexp_extract(text, r'(?i)venue:\s*"([^"]+)"', 1)), F.lit(""))
    venue = F.coalesce(venue, F.nullif(F.lower(F.regexp_extract(text, r"(?i)venue:\s*([^\s\"]\S*)", 1)), F.lit("")))
    author = F.nullif(F.lower(strip(F.regexp_extract(text, r"(?i)author:\s*(.+)$", 1))), F.lit(""))
    rest = strip(F.regexp_replace(F.regexp_replace(text, r"(?i)author:\s*.+$", ""), r'(?i)venue:\s*(?:"[^"]*"|\S+)', ""))
    return F.struct(rest.alias("text"), venue.alias("venue"), author.alias("author"))


def compatible(a: Column, b: Column) -> Column:
    """Equal, or at least one unknown."""
    return a.isNull() | b.isNull() | (a == b)
