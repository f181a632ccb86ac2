"""Text analysis as Column expressions; Python only for NFKD folding and stemming.

Every function takes a column (or name) and gives a column. Null in, null out,
unless stated. Patterns are Unicode-aware where it matters (``(?U)``).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.functions.vectors import once

C = Column | str
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{E0020}-\x{E007F}]"
# A short English stop list for the simple analyzers (a parameter everywhere).
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his how i if in into is it its may more no not of on or our she so than that the their them then there "
    "these they this those to up was we were what when where which who will with would you your"
).split()
# Abbreviations with their long form.
SLANG = {
    "gr8": "great", "lol": "laugh", "omg": "oh my god", "idk": "i do not know", "btw": "by the way",
    "tbh": "to be honest", "smh": "shaking my head", "afaik": "as far as i know", "imo": "in my opinion", "fyi": "for your information",
}
# Organisation and venue words, and title-case words that are no names.
ORGANISATIONS = (
    "University College Institute Institutes Hospital Hospitals Center Centre Centers Centres Foundation Association Society School Schools Department Departments "
    "Laboratory Laboratories Lab Labs Clinic Clinics Agency Ministry Office Council Academy Administration Commission Committee Consortium Trial Group Network Project "
    "Programme Program Oxford Harvard Stanford Cambridge Yale MIT Imperial Johns Hopkins Mayo Cleveland Karolinska Lancet Nature Science JAMA BMJ NEJM CDC FDA NIH WHO NHS OECD UNICEF UNESCO"
).split()
PLAIN_TITLECASE = (
    "A An The This That These Those While With Without For From Into Onto Over Under Of In On At To And Or But If It Its They We Our Their There Here What Why How When "
    "Where Not No Yes Fact Study Studies Results Finding Findings Background Objective Methods Conclusion Conclusions Evidence Report Research Open Access Significant Recent New First"
).split()


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_ws(c: C) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def identifier(c: C) -> Column:
    """String form, stripped; blank gives null."""
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def first_filled(*cs: C) -> Column:
    """The first column that is not blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs])


def no_emoji(c: C) -> Column:
    return F.regexp_replace(col(c), EMOJI, "")


def clean_query(c: C) -> Column:
    """Mentions and hashtags become bare words, emoji go, white space collapses."""
    x = F.regexp_replace(col(c), r"(?U)\B[@#](\w+)", "$1")
    return normalize_ws(no_emoji(x))


def clean_post(c: C, mention: str = "") -> Column:
    """Links go, mentions become ``mention``, hashtags are unwrapped, emoji go."""
    x = F.regexp_replace(col(c), r"http\S+|www\S+", "")
    x = F.regexp_replace(x, r"(?U)@\w+", mention)
    x = F.regexp_replace(x, r"(?U)#(\w+)", "$1")
    return normalize_ws(no_emoji(x))


def unescape_entities(c: C) -> Column:
    """The five basic HTML entities, the ampersand first."""
    pairs = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def clean_by_category(c: C, mention: str | None = None) -> Column:
    """Links go, hashtags are unwrapped, entities decoded, symbol and surrogate characters go; mentions stay or become ``mention``."""
    x = F.regexp_replace(col(c), r"http\S+|www\S+", "")
    if mention is not None:
        x = F.regexp_replace(x, r"(?U)@\w+", mention)
    x = F.regexp_replace(x, r"(?U)#(\w+)", "$1")
    return normalize_ws(F.regexp_replace(unescape_entities(x), r"[\p{So}\p{Cs}\p{Sk}]", ""))


# The patterns of ``clean_post``, ``reference_tokens``, ``entity_cues`` and ``path_language`` must match as they are.
def reference_tokens(c: C) -> Column:
    """Tokens of an article: reference marks, database names and links go; lower-case letters, digits and hyphens stay."""
    x = F.regexp_replace(col(c), r"\[\d+\]|\(\d+\)|Google Scholar|Crossref|PubMed", " ")
    x = F.lower(F.regexp_replace(x, r"https?://\S+|www\.\S+", " "))
    return _words(F.split(F.regexp_replace(x, r"[^a-z0-9\-]", " "), r"\s+"))


def clean_translation(c: C) -> Column:
    """Removes echoed prompts up to a role marker, a leading label, an echoed instruction, and blank lines."""
    x = strip(c)
    x = strip(F.regexp_replace(x, r"(?s)^.*?\bassistant\b\s*", ""))
    x = strip(F.regexp_replace(x, r"(?i)^(?:english|en|translation|traduction|übersetzung)\s*:\s*", ""))
    x = strip(F.regexp_replace(x, r"(?s)^.*?nothing else\.\s*", ""))
    return strip(F.regexp_replace(x, r"(?m)^\s*\n", ""))


def ascii_folded(c: C) -> Column:
    """NFKD, then only ASCII; Arrow batches, as there is no built-in."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    return fold(col(c))


def _words(a: Column) -> Column:
    return F.filter(a, lambda w: w != "")


def _without(a: Column, stop: list[str]) -> Column:
    return F.filter(a, lambda w: ~w.isin(stop)) if stop else a


def corpus_tokens(c: C, stop: list[str] = STOPWORDS, fold: bool = True) -> Column:
    """Lower case, mentions go, hashtags unwrapped, folded to ASCII, words with an inner apostrophe, possessive off, stop words and words under three letters out."""
    x = F.regexp_replace(F.lower(strip(c)), r"(?U)@\w+", " ")
    x = F.regexp_replace(x, r"(?U)\B#(\w+)", "$1")
    x = ascii_folded(x) if fold else x
    t = F.transform(F.regexp_extract_all(x, F.lit(r"(\b\w+(?:'\w+)?\b)")), lambda w: F.regexp_replace(w, "'s$", ""))
    return F.filter(_without(t, stop), lambda w: F.length(w) >= 3)


def simple_tokens(c: C, stop: list[str] = STOPWORDS) -> Column:
    """Links, mentions and # go; lower case; runs of a-z, 0-9 and hyphen; stop words out. Null gives the empty list."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"https?://\S+\s?", "")
    x = F.regexp_replace(x, r"@\w+\s?", "")
    x = F.lower(F.replace(x, F.lit("#"), F.lit("")))
    return _without(F.regexp_extract_all(x, F.lit(r"([a-z0-9\-]+)")), stop)


def _porter(word: str) -> str:
    """Porter's 1980 suffix stripping."""
    vowels = "aeiou"

    def cons(w: str, i: int) -> bool:
        return w[i] not in vowels and (w[i] != "y" or i == 0 or not cons(w, i - 1))

    def measure(w: str) -> int:
        shape = "".join("c" if cons(w, i) else "v" for i in range(len(w)))
        return sum(1 for a, b in zip(shape, shape[1:]) if a == "v" and b == "c")

    def vowel(w: str) -> bool:
        return any(not cons(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w: str) -> bool:
        return len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, to in rules:
            if w.endswith(end):
                s = w[: len(w) - len(end)]
                return s + to if measure(s) > least else w
        return w

    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            s = w[: -len(end)]
            if measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if measure(s) > 1 or measure(s) == 1 and not cvc(s):
            w = s
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stemmed(tokens: C) -> Column:
    """Porter stems of a token list; Arrow batches with a memo of distinct words."""

    @F.pandas_udf("array<string>")
    def stem(s: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in memo:
                memo[w] = _porter(w)
            return memo[w]

        return s.map(lambda ts: None if ts is None else [one(w) for w in ts])

    return stem(col(tokens))


def analyzed(c: C, stop: list[str] = STOPWORDS, keep_mentions: bool = True, split_words: bool = False, stem: bool = False, fold: bool = False) -> Column:
    """The search analyzers: optional link, mention and # removal, word tokens, folding, lower case, possessive, stop words, stem.

    ``split_words`` also adds the parts of words at case changes, digits and hyphens, after the word itself.
    """
    x = col(c)
    if not keep_mentions:
        x = F.regexp_replace(x, r"https?://\S+\s?|(?U)@\w+\s?|#", "")
    x = ascii_folded(x) if fold else x
    pattern = r"((?U)[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*+)" if split_words else r"((?U)[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*+)"
    t = F.regexp_extract_all(x, F.lit(pattern))
    if split_words:
        parts = lambda w: F.split(F.regexp_replace(F.regexp_replace(w, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " "), r"[_'’\-]", " "), " ")
        t = F.flatten(F.transform(t, lambda w: F.array_distinct(F.concat(F.array(w), _words(parts(w))))))
    t = F.transform(t, lambda w: F.regexp_replace(F.lower(w), "['’]s$", ""))
    t = _without(t, stop)
    return stemmed(t) if stem else t


def multilingual_tokens(c: C, stop: list[str] = STOPWORDS) -> Column:
    """Latin words with inner apostrophe or hyphen, lower case, possessive off, three letters at least, stop words out."""
    t = F.regexp_extract_all(col(c), F.lit(r"([A-Za-zÀ-ÿ0-9]+(?:['\-][A-Za-zÀ-ÿ0-9]+)*+)"))
    t = F.transform(t, lambda w: F.regexp_replace(F.lower(w), "'s$", ""))
    return F.filter(_without(t, stop), lambda w: F.length(w) >= 3)


def first_by_lower(a: Column) -> Column:
    """Distinct without regard to case; the first spelling stays."""
    both = F.struct(a.alias("a"), F.transform(a, lambda w: F.lower(w)).alias("low"))
    return once(both, lambda s: F.filter(s["a"], lambda w, i: F.array_position(s["low"], F.lower(w)) == i + 1))


def query_terms(c: C, stop: list[str] = STOPWORDS, most: int = 12) -> Column:
    """Terms with a digit, hyphen, capital or more than five letters first, the others after; distinct without case; at most ``most``."""
    t = F.regexp_extract_all(col(c), F.lit(r"([A-Za-zÀ-ÿ0-9]+(?:['\-][A-Za-zÀ-ÿ0-9]+)*+)"))
    t = F.filter(t, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(stop or [""]))
    t = first_by_lower(t)
    primary = lambda w: F.rlike(w, F.lit(r"[0-9\-]|^[A-ZÀ-ÖØ-Þ]")) | (F.length(w) > 5)
    return F.slice(F.concat(F.filter(t, primary), F.filter(t, lambda w: ~primary(w))), 1, most)


def term_variants(term: Column, lang: str = "en") -> Column:
    """Spelling, lower case, without and with spaced hyphen, and a plural ending off."""
    low = F.lower(term)
    hyphen = F.translate(term, "‑–", "--")
    has = hyphen.contains("-")
    long_ = F.length(low) > 4
    if lang.startswith("en"):
        plural = F.when(long_ & low.endswith("ies"), F.regexp_replace(low, "ies$", "y"))
        plural = plural.when(long_ & low.endswith("es"), F.regexp_replace(low, "es$", "")).when(long_ & low.endswith("s"), F.regexp_replace(low, "s$", ""))
    elif lang.startswith(("de", "fr")):
        plural = F.when(long_ & low.endswith("s"), F.regexp_replace(low, "s$", ""))
    else:
        plural = F.lit(None).cast("string")
    every = F.array(term, F.when(low != term, low), F.when(has, F.replace(hyphen, F.lit("-"), F.lit(""))), F.when(has, F.replace(hyphen, F.lit("-"), F.lit(" "))), plural)
    return F.array_distinct(F.filter(F.array_compact(every), lambda w: w != ""))


def filled_strings(a: Column) -> Column:
    """The values of a list that are not blank, stripped."""
    return _words(F.transform(F.array_compact(a), lambda w: strip(w.cast("string"))))


def expansion_views(c: C, lang: str = "en", doc_terms: Column | None = None) -> Column:
    """The five views of a query: keywords, sparse, embedding, colbert and expanded text."""
    q = normalize_ws(c)
    t = query_terms(q, most=12)
    docs = doc_terms if doc_terms is not None else F.array().cast("array<string>")
    or_query = lambda x: F.coalesce(F.nullif(x, F.lit("")), q)
    keywords = or_query(F.array_join(t, "; "))
    sparse = or_query(F.array_join(F.array_distinct(F.concat(F.flatten(F.transform(t, lambda w: term_variants(w, lang))), F.slice(docs, 1, 18))), " ; "))
    focus = or_query(F.array_join(F.slice(t, 1, 8), ", "))
    context = F.array_join(F.slice(docs, 1, 8), ", ")
    # The sentence frames of the embedding view, by language.
    head, tail, end = {
        "de": ("Relevantes Dokument zu ", " mit Kontext zu ", "; es behandelt die Suchintention und passende wissenschaftliche oder faktische Belege."),
        "fr": ("Document pertinent sur ", " avec contexte sur ", "; il décrit l'intention de recherche et des éléments scientifiques ou factuels associés."),
    }.get(lang[:2], ("Relevant document discussing ", " with context about ", "; it addresses the search intent and related scientific or factual evidence."))
    embedding = F.concat(F.lit(head), focus, F.when(context != "", F.concat(F.lit(tail), context)).otherwise(""), F.lit(end))
    colbert = F.array_join(_words(F.array(q, F.array_join(F.array_distinct(F.concat(t, F.slice(docs, 1, 10))), " "))), " ; ")
    expanded = normalize_ws(F.concat(keywords, F.lit(". "), embedding, F.lit(" Lexical hints: "), sparse, F.lit(". Token hints: "), colbert, F.lit(".")))
    return F.struct(keywords.alias("keywords"), sparse.alias("sparse"), embedding.alias("embedding"), colbert.alias("colbert"), expanded.alias("expanded"))


def split_hashtag(c: C) -> Column:
    """Lower-case words of a hashtag, cut at capitals and underscores."""
    x = F.regexp_replace(col(c), "^#+", "")
    return F.transform(F.regexp_extract_all(x, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$))")), lambda w: F.lower(w))


def long_form(token: Column) -> Column:
    """The long form of an abbreviation, else the token."""
    m = F.create_map(*[F.lit(x) for kv in SLANG.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(token)), token)


def emoji_names(c: C) -> Column:
    """Emoji become their Unicode names between spaces; Arrow batches."""

    @F.pandas_udf("string")
    def name(s: pd.Series) -> pd.Series:
        import unicodedata

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            return "".join(f" {unicodedata.name(ch, '').lower().replace(' ', '_')} " if ord(ch) >= 0x2600 and unicodedata.category(ch) == "So" else ch for ch in t)

        return s.map(one)

    return name(col(c))


def entity_cues(c: C) -> Column:
    """Score of signs of named entities: organisations and author patterns +2 each, acronyms +1, title-case words not at the start +1, pairs of them +2."""
    x = col(c)
    orgs = reduce(lambda a, b: a + b, [F.when(F.rlike(x, F.lit(rf"\b{w}\b")), 2).otherwise(0) for w in ORGANISATIONS])
    authors = F.when(F.rlike(x, F.lit(r"\b[A-Z][a-z]+\s+et\s+al\b|\bby\s+[A-Z][a-z]+|\bfrom\s+[A-Z][a-z]+")), 2).otherwise(0)
    acronyms = F.size(F.filter(F.regexp_extract_all(x, F.lit(r"(\b[A-Z]{2,}(?:[-/]?\d+)?\b|\b[A-Z]\.[A-Z](?:\.)?\b)")), lambda a: a != "RT"))
    tokens = F.transform(F.regexp_extract_all(x, F.lit(r"([@#]?[A-Za-z][A-Za-z0-9.'-]*(?:-[A-Za-z0-9.'-]+)?)")), lambda t: F.regexp_replace(t, "^[@#]+|[@#]+$", ""))
    plain = PLAIN_TITLECASE
    titled = lambda t: F.rlike(t, F.lit(r"^[A-Z]")) & (F.upper(t) != t) & ~t.isin(plain)
    single = F.size(F.filter(tokens, lambda t, i: (i > 0) & (F.length(t) > 2) & titled(t)))
    both = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: titled(a) & titled(b))
    pairs = F.size(F.filter(both, lambda p: p)) * 2
    return orgs + authors + acronyms + single + pairs


def token_count(c: C) -> Column:
    return F.size(_words(F.split(strip(c), r"(?U)\s+")))


def compact_name(c: C) -> Column:
    """Short name of a run file: known prefixes off, other characters to underscores."""
    x = F.regexp_replace(F.regexp_replace(col(c), r"^.*/", ""), r"\.[^.]*$", "")
    # The ordered replacements of run names.
    for a, b in (("reranked_results_", ""), ("res_rer_", "rer_"), ("res_", ""), ("FTAarsen20252026_Lora_", "lora_"), ("FTAarsen2526_Lora_", "lora_"), ("BASELINE", "baseline"), ("onbiEncoder", "on_biencoder")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", "")


def path_split(c: C) -> Column:
    """train, dev or test, from a path."""
    p = F.lower(col(c))
    stem = F.regexp_replace(F.regexp_replace(p, r"^.*/", ""), r"\.[^.]*$", "")
    return F.when(p.contains("train_set") | stem.contains("train"), "train").when(p.contains("dev_set") | stem.contains("dev"), "dev").when(p.contains("test_set") | stem.contains("test") | stem.contains("final"), "test")


def path_language(c: C) -> Column:
    """de, fr or en, from the stem of a path."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"^.*/", ""), r"\.[^.]*$", "")
    out = F.lit(None).cast("string")
    for lang in ("en", "fr", "de"):
        here = F.rlike(stem, F.lit(rf"(^|[_-]){lang}(train|dev|final|_|$)")) | stem.contains(f"{lang}dev") | stem.contains(f"{lang}final")
        if lang == "en":
            here = here | (stem == "expanded_queries_en")
        out = F.when(here, lang).otherwise(out)
    return out


def slug(c: C) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def vocabulary_words(c: C) -> Column:
    """Distinct lower-case words of three or more letters a to z and nothing else."""
    w = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"))
    return F.array_distinct(F.filter(w, lambda x: F.rlike(x, F.lit("^[a-z]{3,}$"))))


def document_text(title: C, abstract: C, authors: C | None = None, style: str = "plain", other: C | None = None, most: int | None = None) -> Column:
    """The text of a paper, white space folded; blank parts are left out, and without any part it is empty.

    ``plain``: title abstract. ``dotted``: title. abstract. ``authors`` and
    ``dotted_authors``: the same with ``Authors: ...`` behind; a dotted text needs
    both parts, else it is the one there is, else ``other``. ``trimmed``: dotted,
    without dots and spaces at its ends. ``merged``: plain, a part that repeats
    another but for case is left out. ``most``: the characters that a model takes.
    """
    filled = lambda c: F.nullif(normalize_ws(c), F.lit(""))
    a, b = filled(title), filled(abstract)
    by = F.concat(F.lit("Authors: "), filled(authors)) if authors is not None else F.lit(None).cast("string")
    dotted = F.coalesce(F.concat(a, F.lit(". "), b), a, b, filled(other) if other is not None else F.lit(None))
    if style == "plain":
        out = F.concat_ws(" ", a, b)
    elif style == "authors":
        out = F.concat_ws(" ", a, b, by)
    elif style == "dotted":
        out = F.coalesce(dotted, F.lit(""))
    elif style == "dotted_authors":
        out = F.concat_ws(" ", dotted, F.when(a.isNotNull() & b.isNotNull(), by))
    elif style == "trimmed":
        out = F.regexp_replace(F.coalesce(F.concat(F.coalesce(a, F.lit("")), F.lit(". "), F.coalesce(b, F.lit(""))), F.lit("")), r"^[. ]++|[. ]+$", "")
    elif style == "merged":
        out = F.array_join(first_by_lower(F.array_compact(F.array(a, b))), " ")
    else:
        raise ValueError(f"no style {style}")
    return out if most is None else F.substring(out, 1, most)


def keywords(c: C, stop: list[str] = STOPWORDS, tagger=None) -> Column:
    """Keywords of a text, distinct and in order, joined by spaces.

    ``tagger``: a function from the text column to a list of lower-case lemmas
    of nouns and names (a model behind a pandas UDF). Without one, the terms
    that ``query_terms`` puts first stand for nouns, with their plural ending off.
    """
    if tagger is not None:
        lemmas = tagger(col(c))
    else:
        t = F.regexp_extract_all(col(c), F.lit(r"([A-Za-zÀ-ÿ0-9]+(?:['\-][A-Za-zÀ-ÿ0-9]+)*+)"))
        t = F.filter(t, lambda w: (F.length(w) > 2) & (F.rlike(w, F.lit(r"[0-9\-]|^[A-ZÀ-ÖØ-Þ]")) | (F.length(w) > 5)))
        lemmas = F.transform(t, lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), "(?<=[a-z]{3})ies$", "y"), "(?<=[a-z]{3}[^s])s$", ""))
    return F.array_join(F.array_distinct(_without(lemmas, stop)), " ")


def format_bytes(c: C) -> Column:
    x = col(c).cast("double")
    out = F.format_string("%.1f TiB", x / 1024**4)
    for i, u in reversed(list(enumerate(["B", "KiB", "MiB", "GiB"]))):
        out = F.when(x < 1024 ** (i + 1), F.format_string("%.0f B" if i == 0 else f"%.1f {u}", x / 1024**i)).otherwise(out)
    return out


def format_duration(c: C) -> Column:
    s = F.round(col(c)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def p_label(c: C) -> Column:
    p = col(c)
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def prompt(query: C, passage: C, style: str = "question") -> Column:
    """Model input of a query and passage."""
    q, p = col(query), col(passage)
    if style == "instruct":
        return F.concat(F.lit("<Instruct>: Given a web search query, retrieve relevant passages that answer the query\n<Query>: "), q, F.lit("\n<Document>: "), p)
    return F.concat(F.lit("question:"), q, F.lit(" \n \n passage:"), p)


def expansion_request(query: C, lang: str, previous_error: C | None = None) -> Column:
    """Prompt that asks a model for the five views of a query as JSON; an error of the last try is echoed."""
    ask = F.format_string(
        "Expand the search query below (language: %s). Answer with one JSON object with exactly the keys keywords, sparse, embedding, colbert, expanded; each value is a string that is not empty.\nQuery: %s", F.lit(lang), col(query)
    )
    if previous_error is None:
        return ask
    e = col(previous_error)
    return F.when(e.isNull(), ask).otherwise(F.concat(ask, F.lit("\nThe last answer was rejected: "), e))


def translation_request(query: C, source: str, target: str = "English") -> Column:
    return F.concat(F.lit(f"Translate the following {source} text to {target}. Output the translation and nothing else.\n"), col(query))
