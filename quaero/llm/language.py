"""Languages of posts and of their segments, by compression.

For each language a zstandard raw-content dictionary is made of labelled
sentences. A chunk of text belongs to the language whose dictionary gives the
smallest encoding; the chunk is rejected when the margin to the second is
narrow. Links, mentions, hashtags and digits are masked first.

Labelled rows: at most ``REFERENCE`` clean sentences of each language, and at
most ``SAMPLE`` texts of each declared language of a feed (those with the
smallest hash of their key, of ``LENGTHS`` characters), of which only those are used that the reference
dictionaries too give to the declared language, first as whole texts, then
chunk by chunk. This bounded sample fits the classifier only; every post is
classified whole.

A post is cut into chunks at sentence ends, line ends, separators, quotation
marks and brackets. Neighbouring chunks of one language form a segment;
chunks without a language of their own join the segment around them and count
no words. A language counts in a post from ``RUN`` words in a row.

Defined results: posts that are null, blank or without words have no segment;
repeated rows give equal rows; very long posts are cut into as many chunks as
they have, each read whole; extra columns are ignored; empty tables give no
rows; if a language has no labelled sentence, it is never assigned. No
shuffle but for the distinct at the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "fr", "de", "es", "it")
#: Texts of a feed and of the reference table, for each language, that may fit the dictionaries, and the characters of such a text of the feed.
SAMPLE, REFERENCE, LENGTHS = 400, 1_000, (80, 4_000)
#: Search of the compressor: a binary tree that finds matches of four bytes in the whole dictionary.
SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 7, "min_match": 4}
#: Least share by which the second best encoding must be longer, and the words below which a chunk has no language of its own.
MARGIN, SHORT = 0.03, 3
#: Words in a row from which a language counts in a post.
RUN = 6
#: Bytes of encoding that lower the odds of a language to 1/e.
TEMPERATURE = 3.0

# The usual spellings of the labels.
SPELLINGS = {
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french"],
    "de": ["de", "deu", "ger", "german"],
    "es": ["es", "spa", "spanish"],
    "it": ["it", "ita", "italian"],
}

_LINK = re.compile(r"https?://\S+|www\.\S+|[@#]\w+|&\w+;", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CUT = re.compile(r"(?<=[.!?…])[\s\"'”»)]+(?=\S)|\n+|\s[/|—–\-]+\s|[«»“”„\"()\[\]¿¡]+|(?<=[:;])\s+(?=[A-ZÀ-ÝÄÖÜ])")


def chunks(text: str | None) -> list[str]:
    """Pieces of a post between the places where a language may change."""
    if not text:
        return []
    return [c for c in _CUT.split(_LINK.sub(" ", text)) if c and not c.isspace()]


def words(chunk: str) -> int:
    return len(_WORD.findall(chunk))


def masked(chunk: str) -> bytes:
    return (" " + re.sub(r"\s+", " ", re.sub(r"\d+(?:[.,]\d+)*", "0", chunk)).strip().lower() + " ").encode("utf-8", "replace")


class Classifier:
    """One compressor for each language."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        import zstandard

        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
        self.by = {}
        for lang, content in sorted(contents.items()):
            if content:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self.by[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        self.known: dict[bytes, tuple[str | None, float]] = {}

    def language(self, chunk: str) -> tuple[str | None, float]:
        """The language with its confidence, or (None, 0) when the margin is narrow."""
        text = masked(chunk)
        if text not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[text] = self._language(text)
        return self.known[text]

    def _language(self, text: bytes) -> tuple[str | None, float]:
        sizes = sorted((len(c.compress(text)), lang) for lang, c in self.by.items())
        if not sizes or len(sizes) > 1 and sizes[1][0] - sizes[0][0] < MARGIN * sizes[1][0]:
            return None, 0.0
        best = sizes[0][0]
        return sizes[0][1], 1 / sum(math.exp((best - s) / TEMPERATURE) for s, _ in sizes)


def segments(text: str | None, c: Classifier) -> list[tuple[str, int, int, float, str]]:
    """(language, words, longest run of words, confidence, text) of each segment of a post."""
    out: list[list] = []
    for chunk in chunks(text):
        n = words(chunk)
        lang, sure = c.language(chunk) if n >= SHORT else (None, 0.0)
        if lang is None:
            if out:
                out[-1][4] += " " + chunk.strip()
        elif out and out[-1][0] == lang:
            o = out[-1]
            o[3] = (o[3] * o[1] + sure * n) / (o[1] + n)
            o[1] += n
            o[4] += " " + chunk.strip()
        else:
            out.append([lang, n, n, sure, chunk.strip()])
    return [(o[0], o[1], o[1], o[3], o[4]) for o in out]


def contents(reference: DataFrame, feed: DataFrame | None = None, sample: int = SAMPLE, key: str = "doc_id", lengths: tuple[int, int] = LENGTHS) -> dict[str, bytes]:
    """The dictionary content of each language, from at most ``sample`` texts of it in the feed and ``REFERENCE`` in the reference table.

    reference: (lang, text), right. feed: (key, lang, text) as declared; texts
    of other ``lengths`` (characters, from and to) do not fit the dictionaries.
    """

    def some(df: DataFrame, n: int, *order: Column | str) -> list:
        """The first n rows of each language: a limit inside each partition, then one sort of what is left."""
        w = Window.partitionBy("lang").orderBy(*order)
        return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).orderBy("lang", "k").select("lang", "text").collect()

    known = reference.where(F.col("text").isNotNull() & F.col("lang").isin(*LANGUAGES)).select("lang", "text").distinct()
    clean: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for r in some(known, REFERENCE, F.xxhash64("text"), "text"):
        clean[r.lang].extend(chunks(r.text))
    base = {k: b"".join(sorted({masked(x) for x in v})) for k, v in clean.items()}
    if feed is None:
        return base
    usable = feed.where(F.length("text").between(*lengths) & F.col("lang").isin(*LANGUAGES)).select(F.col(key).alias("key"), "lang", "text")
    declared = [(r.lang, r.text) for r in some(usable, sample, F.xxhash64("key"), "key", "text")]
    declared.sort(key=lambda x: LANGUAGES.index(x[0]))
    # First by whole texts, as the reference is small: a text must be shortest in its declared language. Then chunk by chunk.
    c = Classifier(base)
    kept: dict[str, dict[bytes, None]] = {k: dict.fromkeys(sorted({masked(x) for x in v})) for k, v in clean.items()}
    more = {k: dict(v) for k, v in kept.items()}
    agreed = []
    for lang, text in declared:
        parts = [x for x in chunks(text) if words(x) >= RUN]
        total = {k: sum(len(z.compress(masked(x))) for x in parts) for k, z in c.by.items()}
        if parts and min(total, key=lambda k: (total[k], k)) == lang:
            agreed.append((lang, parts))
            more[lang].update(dict.fromkeys(masked(x) for x in parts if c.language(x)[0] in (lang, None)))
    c = Classifier({k: b"".join(v) for k, v in more.items()})
    for lang, parts in agreed:
        kept[lang].update(dict.fromkeys(masked(x) for x in parts if c.language(x)[0] == lang))
    return {k: b"".join(v) for k, v in kept.items()}


def label_language(label: Column | str) -> Column:
    """The language that a label denotes in any usual spelling, else null."""
    c = F.regexp_replace(F.lower(F.trim(label)), r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", "$1")
    out = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(c.isin(names), lang).otherwise(out)
    return out


def post_segments(df: DataFrame, dictionaries: dict[str, bytes], key: str = "qid", text: str = "text") -> DataFrame:
    """(key, segment, lang, words, confidence, part) of every segment of every post; a map without a shuffle."""
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        c = Classifier(held.value)
        for b in batches:
            rows = [(k, i, s[0], s[1], s[3], s[4]) for k, t in zip(b[key], b[text]) for i, s in enumerate(segments(t, c))]
            yield pd.DataFrame(rows, columns=[key, "segment", "lang", "words", "confidence", "part"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, segment int, lang string, words int, confidence double, part string")


def post_languages(df: DataFrame, dictionaries: dict[str, bytes], key: str = "qid", text: str = "text") -> DataFrame:
    """(key, lang, confidence) of every language that counts in a post: at least RUN words in a row."""
    s = post_segments(df, dictionaries, key, text).where(F.col("words") >= RUN)
    return s.groupBy(key, "lang").agg(F.round(F.max("confidence"), 4).alias("confidence"))


def mislabelled(df: DataFrame, dictionaries: dict[str, bytes], src: str, key: str = "qid", text: str = "text", label: str = "lang") -> DataFrame:
    """(src, key, lang): the languages of each post whose label is missing or wrong or that has several.

    The label goes through the map next to the key and the text, so no join is
    needed.
    """
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        c = Classifier(held.value)
        for b in batches:
            rows = []
            for k, t, said in zip(b[key], b[text], b["said"]):
                langs = {s[0] for s in segments(t, c) if s[1] >= RUN}
                if langs != {said}:
                    rows += [(k, x) for x in sorted(langs)]
            yield pd.DataFrame(rows, columns=[key, "lang"])

    out = df.select(key, text, label_language(label).alias("said")).mapInPandas(run, f"`{key}` {kind}, lang string")
    return out.select(F.lit(src).alias("src"), key, "lang").distinct()
