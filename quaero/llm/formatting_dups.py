"""Duplicates hidden by formatting, by progressive partition refinement.

Two records are copies when two text fields hold the same letters and digits
in the same order (letter case, white space, punctuation and symbols
ignored), the fields possibly exchanged. Combining marks belong to their
letters: they count, and composed and decomposed letters are one.

1. Class by the cheapest invariant: how often four frequent letters and digits
   stand in both fields together, in upper case. Nothing is stripped for that.
2. Rows in classes of several keys meet a histogram of ten more characters.
3. Rows still in classes of several keys meet the costly key, a SHA-256 of the
   two stripped fields in sorted order, and are grouped by it.

Every level counts its classes with map-side partial sums (least and largest
key), and classes of one key are done. The rows that pass the first level are
written once, with the histogram; the last level reads them there.

The smallest id of a class is its representative. The group of a third of all
rows costs partial sums only: minima, maxima, counts and the join of members to
their representative (split by the adaptive skew join), never a list of
members.

Defined results: rows with a null or blank field, or a field without any
letter or digit, are no copies of anything; a null id is ignored; re-delivered
rows count once as a key and each as a row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.session import written

#: Characters of the first level, and those of the histogram; all are one byte long.
FIRST, HISTOGRAM = "ETS1", "AOINRHL059"


def upper(c: Column | str) -> Column:
    """Upper case (which also folds sharp s and final sigma); letters with combining marks are composed."""
    c = F.upper(c)
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when((F.octet_length(c) > F.length(c)) & F.rlike(c, F.lit(r"\p{M}")), composed).otherwise(c)


def stripped(c: Column) -> Column:
    """The letters, digits and marks of a text in upper case; variation selectors and the grapheme joiner show nothing and go."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]+|[\x{FE00}-\x{FE0F}\x{34F}\x{E0100}-\x{E01EF}]+", "")


def _counts(c: Column, letters: str) -> Column:
    """How often each of the letters stands in a text, folded to one number; lengths in bytes are read, not counted."""
    return F.xxhash64(*[F.octet_length(c) - F.octet_length(F.replace(c, F.lit(x), F.lit(""))) for x in letters])


def _crowded(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` whose class has several keys."""
    several = df.groupBy(*by).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select(*by)
    return df.join(written(several, "classes"), list(by), "left_semi")


def paper_classes(df: DataFrame, key: str = "pubkey", first: str = "title", second: str = "abstract") -> DataFrame:
    """(key, rows, paper): the members of classes of several keys, with the digest that names their class."""
    base = df.select(F.col(key).alias("id"), F.col(first).alias("x"), F.col(second).alias("y")).where("id is not null and x is not null and y is not null")
    base = base.select("id", upper("x").alias("a"), upper("y").alias("b"))
    both = base.withColumn("ab", F.concat("a", "b"))
    counted = both.select("id", "a", "b", "ab", _counts(F.col("ab"), FIRST).alias("few"))
    passed = written(_crowded(counted, "few").select("id", "a", "b", "few", _counts(F.col("ab"), HISTOGRAM).alias("many")), "passed")
    left = _crowded(passed, "few", "many").select("id", stripped(F.col("a")).alias("a"), stripped(F.col("b")).alias("b"))
    shown = left.where(F.rlike("a", F.lit(r"[\p{L}\p{N}]")) & F.rlike("b", F.lit(r"[\p{L}\p{N}]")))
    digest = F.sha2(F.concat_ws(" ", F.least("a", "b"), F.greatest("a", "b")), 256)
    return written(shown.groupBy(digest.alias("paper"), "id").agg(F.count("*").alias("rows")), "keyed")


def same_papers(df: DataFrame, key: str = "pubkey", first: str = "title", second: str = "abstract") -> DataFrame:
    """(key_a, key_b): the smallest key of a paper with each other key of it."""
    members = paper_classes(df, key, first, second)
    heads = members.groupBy("paper").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last")
    return members.join(heads, "paper").where("id <> head").select(F.col("head").alias(f"{key}_a"), F.col("id").alias(f"{key}_b")).distinct()


def one_per_paper(df: DataFrame, key: str = "pubkey", first: str = "title", second: str = "abstract") -> DataFrame:
    """(key, copies, rows): one row for each paper, with the number of its keys and of its delivered rows.

    Records with a blank field are their own papers.
    """
    members = paper_classes(df, key, first, second)
    papers = members.groupBy("paper").agg(F.min("id").alias(key), F.count("*").alias("copies"), F.sum("rows").alias("rows"))
    alone = (
        df.select(F.col(key).alias("id")).where("id is not null")
        .join(members.select("id").distinct(), "id", "left_anti")
        .groupBy(F.col("id").alias(key)).agg(F.lit(1).cast("bigint").alias("copies"), F.count("*").alias("rows"))
    )
    return papers.select(key, "copies", "rows").unionByName(alone)
