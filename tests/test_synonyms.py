"""The synonym dictionary: what it reads and what it gives."""

from pyspark.sql import functions as F

from quaero.functions.text import STOPWORDS
from quaero.operators import index
from quaero.plans import catalog


def test_titles_and_stop_words_are_read_and_entries_given(spark, tmp_path, monkeypatch):
    """Titles and stop words are part of the training; every entry is given, not only how many a term has."""
    rows = [(f"k{i}", "Onlytitle the words", "We saw [3] that the words were in the Abstract", "v", "a") for i in range(12)] + [("k99", None, None, "v", "a")]
    spark.createDataFrame(rows, "pubkey string, title string, abstract string, venue string, authors string").write.parquet(f"{tmp_path}/collection_data.parquet")
    seen, made = [], index.synonym_dictionary

    def small(docs, tokens, **more):
        seen.extend(sorted(r.t) for r in docs.select(tokens.alias("t")).distinct().collect())
        return made(docs, tokens, size=8, window=3, passes=1, parts=1, threshold=-1.0, **more)

    monkeypatch.setattr(index, "synonym_dictionary", small)
    got = catalog.queries()["synonym_dictionary"](spark, str(tmp_path))
    assert sorted(seen) == [[], sorted("onlytitle the words we saw that the words were in the abstract".split())]
    assert got.columns == ["term", "pos", "synonym", "score"]
    terms = {"onlytitle", "words", "saw", "abstract"} - set(STOPWORDS)
    assert {(r.term, r.synonym) for r in got.collect()} == {(a, b) for a in terms for b in terms if a != b}


def test_stop_words_are_not_expanded(spark):
    docs = spark.createDataFrame([("one two three the",)] * 9, "text string")
    rows = index.synonym_dictionary(docs, F.split("text", " "), size=8, window=3, passes=1, parts=1, threshold=-1.0, stop=["the"]).collect()
    assert {r.term: {s.term for s in r.synonyms} for r in rows} == {"one": {"two", "three"}, "two": {"one", "three"}, "three": {"one", "two"}}
    assert all(s.score == round(s.score, 3) for r in rows for s in r.synonyms)


def test_parts_are_not_more_than_cores(spark, monkeypatch):
    """A pass is one round of tasks: no part waits for a core until the others are through."""
    from pyspark.ml import feature

    seen, fit = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, df: seen.append(self.getNumPartitions()) or fit(self, df))
    docs = spark.createDataFrame([("one two three",)] * 9, "text string")
    index.synonym_dictionary(docs, F.split("text", " "), size=8, window=3, passes=1, threshold=-1.0).collect()
    assert seen == [min(8, spark.sparkContext.defaultParallelism)]


def test_vectors_are_written_before_they_are_compared(spark, monkeypatch):
    """Both sides of the comparison read files; the model's rows are not kept in the plans of the driver, nor collected as Python floats."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quaero.operators import dense

    seen, topk, collect = [], dense.dense_topk, DataFrame.collect
    monkeypatch.setattr(dense, "dense_topk", lambda q, d, *a: seen.extend((q.inputFiles(), d.inputFiles())) or topk(q, d, *a))
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append([]) if "v" in df.columns else collect(df))
    docs = spark.createDataFrame([("one two three",)] * 9, "text string")
    rows = index.synonym_dictionary(docs, F.split("text", " "), size=8, window=3, passes=1, parts=1, threshold=-1.0).collect()
    assert len(rows) == 3 and len(seen) == 2 and all(seen)
