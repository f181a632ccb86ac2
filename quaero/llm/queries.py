"""The pN_ queries and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm.bpe import encode_documents
from quaero.llm.formatting_dups import one_per_paper, same_papers
from quaero.llm.language import contents, mislabelled, post_languages, post_segments
from quaero.llm.lookalikes import changed_records, forms
from quaero.llm.packing import pack_documents
from quaero.llm.pair_defects import pair_defects
from quaero.llm.residue import residue, without_residue
from quaero.llm.split_overlap import overlaps
from quaero.llm.top_items import top_items
from quaero.session import table

N = 10
CAPACITY = 2048


def _dictionaries(spark: SparkSession, d: str) -> dict[str, bytes]:
    return contents(table(spark, d, "lang_samples"), table(spark, d, "documents").select("doc_id", "lang", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    by = _dictionaries(spark, d)
    fr = mislabelled(table(spark, d, "final_fr_test"), by, "final_fr_test")
    return fr.unionByName(mislabelled(table(spark, d, "final_de_test"), by, "final_de_test"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every post with its language and confidence."""
    by = _dictionaries(spark, d)
    fr = post_segments(table(spark, d, "final_fr_test"), by)
    return fr.unionByName(post_segments(table(spark, d, "final_de_test"), by)).distinct()


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every language of every post with its confidence."""
    by = _dictionaries(spark, d)
    fr = post_languages(table(spark, d, "final_fr_test"), by)
    return fr.unionByName(post_languages(table(spark, d, "final_de_test"), by))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("place = 1").select("qid", "defect")


def p3_all(spark: SparkSession, d: str) -> DataFrame:
    """Every defect type that fires, in order."""
    return _defects(spark, d)


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(table(spark, d, "final_fr_tradottoen_test"), _dictionaries(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_papers(table(spark, d, "collection_data"))


def p2_papers(spark: SparkSession, d: str) -> DataFrame:
    return one_per_paper(table(spark, d, "collection_data"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_items(table(spark, d, "run_entries"), N).select("run_name", "qid", "docid")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(table(spark, d, "en_train"), table(spark, d, "en_eval"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("train_qid"), F.greatest("train_id", "eval_id").alias("eval_qid")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and records that overlap, for each split and source, with the number of training sources, and the merged matches of the pairs: their spans and the words they cover."""
    e = table(spark, d, "en_eval").select(F.col("qid").alias("eval_id"), "split", "source").dropDuplicates(["eval_id"])
    t = table(spark, d, "en_train").select(F.col("qid").alias("train_id"), F.col("source").alias("train_source")).dropDuplicates(["train_id"])
    return (
        _overlaps(spark, d).join(e, "eval_id").join(t, "train_id").groupBy("split", "source")
        .agg(
            F.count("*").alias("pairs"), F.sum((F.col("distance") == 0).cast("int")).alias("exact"), F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"),
            F.countDistinct("train_source").alias("train_sources"), F.sum("spans").alias("spans"), F.sum("covered").alias("covered_words"),
        )
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    posts = changed_records(table(spark, d, "en_train"), "qid", "text", "en_train")
    return posts.unionByName(changed_records(table(spark, d, "collection_data"), "pubkey", "abstract", "collection_data"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every post and every abstract in one form."""
    posts = forms(table(spark, d, "en_train"), "qid", "text", "en_train")
    return posts.unionByName(forms(table(spark, d, "collection_data"), "pubkey", "abstract", "collection_data"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, the least possible number, and the share of space used."""
    c = p8_packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return c.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("used") / CAPACITY).alias("least_containers"),
        F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("fill"),
        F.max("used").alias("fullest"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents to exclude by kind of residue."""
    return residue(table(spark, d, "documents")).groupBy("kind").agg(F.count("*").alias("documents"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(table(spark, d, "documents"))


QUERIES = [p1_found, p1_segments, p1_languages, p3_found, p3_all, p2_found, p2_papers, p4_found, p5_found, p5_report, p6_found, p6_forms, p7_ids, p8_packed, p8_fill, p9_found, p9_kinds, p9_clean]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


P4_SQL = """
WITH r AS (
  SELECT run_name, qid, trim(docid, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8199) || chr(8239) || chr(12288)) AS docid,
         CASE WHEN isnan(score) THEN NULL ELSE score END AS s,
         CASE WHEN rank >= 1 THEN rank ELSE 2147483647 END AS p
  FROM run_entries
), d AS (
  SELECT *, row_number() OVER (PARTITION BY run_name, qid, docid ORDER BY s DESC NULLS LAST, p) AS k
  FROM r WHERE docid <> ''
), t AS (
  SELECT *, row_number() OVER (PARTITION BY run_name, qid ORDER BY s DESC NULLS LAST, p, docid) AS place FROM d WHERE k = 1
)
SELECT run_name, qid, docid FROM t WHERE place <= 10
"""


P2_STRIP = "regexp_replace(nfc_normalize(replace(upper({}), 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+|[\\x{{FE00}}-\\x{{FE0F}}\\x{{34F}}\\x{{E0100}}-\\x{{E01EF}}]+', '', 'g')"
P2_KEYS = f"""
WITH s AS (SELECT pubkey, {P2_STRIP.format("title")} AS a, {P2_STRIP.format("abstract")} AS b FROM collection_data),
k AS (SELECT pubkey, least(a, b) || ' ' || greatest(a, b) AS paper FROM s WHERE regexp_matches(a, '[\\p{{L}}\\p{{N}}]') AND regexp_matches(b, '[\\p{{L}}\\p{{N}}]'))
"""
P2_SQL = P2_KEYS + """, h AS (SELECT paper, min(pubkey) AS head FROM k GROUP BY paper)
SELECT DISTINCT head AS pubkey_a, pubkey AS pubkey_b FROM k JOIN h USING (paper) WHERE pubkey <> head
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p4_found": P4_SQL}
