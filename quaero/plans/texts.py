"""Queries of the scalar text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.functions import text as x
from quaero.operators import quality
from quaero.plans import tables as t
from quaero.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# White space as Java's Unicode class has it, for RE2.
S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
W = r"[\p{L}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
EMOJI = x.EMOJI


def ws(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '{S}+', ' ', 'g'), '^ | $', '', 'g')"


def lists(e: str) -> str:
    return f"array_to_string({e}, ' ')"


def _posts(spark, d):
    return t.posts(spark, d)


@query(f"WITH {t.POSTS} SELECT qid, {ws('text')} AS text FROM posts")
def text_normalize_ws(spark, d):
    return _posts(spark, d).select("qid", x.normalize_ws("text").alias("text"))


def post_sql(mention: str) -> str:
    return ws(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\\S+|www\\S+', '', 'g'), '@{W}+', '{mention}', 'g'), '#({W}+)', '\\1', 'g'), '{EMOJI}', '', 'g')")


@query(f"WITH {t.POSTS} SELECT qid, {post_sql('')} AS text FROM posts")
def text_clean_post(spark, d):
    return _posts(spark, d).select("qid", x.clean_post("text").alias("text"))


@query(f"WITH {t.POSTS} SELECT qid, {post_sql('@user')} AS text FROM posts")
def text_clean_post_user(spark, d):
    return _posts(spark, d).select("qid", x.clean_post("text", "@user").alias("text"))


CAT = "regexp_replace(regexp_replace(text, 'http\\S+|www\\S+', '', 'g'), '#(" + W + "+)', '\\1', 'g')"
CAT = f"replace(replace(replace(replace(replace({CAT}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


@query(f"WITH {t.POSTS} SELECT qid, {ws(f'regexp_replace({CAT}, $a$[\\p{{So}}\\p{{Sk}}]$a$, $a$$a$, $a$g$a$)')} AS text FROM posts")
def text_clean_by_category(spark, d):
    return _posts(spark, d).select("qid", x.clean_by_category("text").alias("text"))


# A mention or hashtag counts where no word character stands before it (ASCII for the boundary, any script inside).
BARE = "regexp_replace(text, '(^|[^A-Za-z0-9_])[@#](" + W + "+)', '\\1\\2', 'g')"


@query(f"WITH {t.POSTS} SELECT qid, {ws(f'regexp_replace({BARE}, $a${EMOJI}$a$, $a$$a$, $a$g$a$)')} AS text FROM posts")
def text_clean_query(spark, d):
    return _posts(spark, d).select("qid", x.clean_query("text").alias("text"))


@query(f"WITH {t.POSTS} SELECT qid, {lists(t.tokens_sql('text'))} AS tokens FROM posts")
def tokens_simple(spark, d):
    return _posts(spark, d).select("qid", F.array_join(x.simple_tokens("text"), " ").alias("tokens"))


@query()
def tokens_stemmed(spark, d):
    return _posts(spark, d).select("qid", F.array_join(x.stemmed(x.simple_tokens("text")), " ").alias("tokens"))


MULTI = "regexp_extract_all(text, '[A-Za-zÀ-ÿ0-9]+(?:[''\\-][A-Za-zÀ-ÿ0-9]+)*')"


MULTI_TOKENS = f"list_filter(list_transform({MULTI}, lambda w: regexp_replace(lower(w), '''s$', '')), lambda w: length(w) >= 3 AND NOT list_contains({t.STOP_SQL}, w))"


@query(f"WITH {t.POSTS} SELECT qid, {lists(MULTI_TOKENS)} AS tokens FROM posts")
def tokens_multilingual(spark, d):
    return _posts(spark, d).select("qid", F.array_join(x.multilingual_tokens("text"), " ").alias("tokens"))


@query()
def tokens_analyzed(spark, d):
    return _posts(spark, d).select("qid", F.array_join(x.analyzed("text", keep_mentions=False), " ").alias("tokens"), F.array_join(x.analyzed("text", split_words=True, stem=True, fold=True), " ").alias("split_stems"))


@query()
def tokens_corpus(spark, d):
    return t.corpus(spark, d).select("docid", F.array_join(x.corpus_tokens("abstract"), " ").alias("tokens"))


@query(f"""WITH tt AS (SELECT qid, list_filter({MULTI}, lambda w: length(w) >= 3 AND NOT list_contains({t.STOP_SQL}, lower(w))) AS a FROM shared_topics),
dd AS (SELECT qid, list_filter(a, lambda w, i: list_position(list_transform(a, lambda v: lower(v)), lower(w)) = i) AS a FROM tt)
SELECT qid, array_to_string(list_slice(list_concat(list_filter(a, lambda w: regexp_matches(w, '[0-9\\-]|^[A-ZÀ-ÖØ-Þ]') OR length(w) > 5), list_filter(a, lambda w: NOT (regexp_matches(w, '[0-9\\-]|^[A-ZÀ-ÖØ-Þ]') OR length(w) > 5))), 1, 12), '; ') AS terms FROM dd""")
def query_terms_priority(spark, d):
    return t.topics(spark, d).select("qid", F.array_join(x.query_terms("query"), "; ").alias("terms"))


TERMS = f"""tt AS (SELECT qid, list_filter({MULTI}, lambda w: length(w) >= 3 AND NOT list_contains({t.STOP_SQL}, lower(w))) AS a FROM shared_topics),
dd AS (SELECT qid, list_filter(a, lambda w, i: list_position(list_transform(a, lambda v: lower(v)), lower(w)) = i) AS a FROM tt),
tl AS (SELECT qid, list_slice(list_concat(list_filter(a, lambda w: regexp_matches(w, '[0-9\\-]|^[A-ZÀ-ÖØ-Þ]') OR length(w) > 5), list_filter(a, lambda w: NOT (regexp_matches(w, '[0-9\\-]|^[A-ZÀ-ÖØ-Þ]') OR length(w) > 5))), 1, 12) AS a FROM dd)"""
PLURAL = "CASE WHEN length(w) > 4 AND lower(w) LIKE '%ies' THEN regexp_replace(lower(w), 'ies$', 'y') WHEN length(w) > 4 AND lower(w) LIKE '%es' THEN regexp_replace(lower(w), 'es$', '') WHEN length(w) > 4 AND lower(w) LIKE '%s' THEN regexp_replace(lower(w), 's$', '') END"
SPELLINGS = f"list_filter([w, CASE WHEN lower(w) <> w THEN lower(w) END, CASE WHEN w LIKE '%-%' THEN replace(w, '-', '') END, CASE WHEN w LIKE '%-%' THEN replace(w, '-', ' ') END, {PLURAL}], lambda x: x IS NOT NULL AND x <> '')"


def distinct_in_order(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


@query(f"""WITH {TERMS}, u AS (SELECT DISTINCT unnest(a) AS w FROM tl), v AS (SELECT w, {SPELLINGS} AS s FROM u)
SELECT w AS term, array_to_string({distinct_in_order('s')}, ' | ') AS variants FROM v""")
def term_variants(spark, d):
    w = t.topics(spark, d).select(F.explode(x.query_terms("query")).alias("term")).distinct()
    return w.select("term", F.array_join(x.term_variants(F.col("term")), " | ").alias("variants"))


VIEWS = f"""WITH {TERMS}, q AS (SELECT qid, {ws('text')} AS q, a FROM tl JOIN shared_topics USING (qid)),
sp AS (SELECT qid, list(s ORDER BY i, j) AS s FROM (SELECT qid, i, unnest(s) AS s, generate_subscripts(s, 1) AS j FROM (SELECT qid, i, {distinct_in_order(SPELLINGS)} AS s FROM (SELECT qid, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM tl))) GROUP BY qid),
v AS (SELECT qid, q, a, coalesce(nullif(array_to_string(a, '; '), ''), q) AS keywords, coalesce(nullif(array_to_string({distinct_in_order('s')}, ' ; '), ''), q) AS sparse,
 'Relevant document discussing ' || coalesce(nullif(array_to_string(list_slice(a, 1, 8), ', '), ''), q) || '; it addresses the search intent and related scientific or factual evidence.' AS embedding,
 array_to_string(list_filter([q, array_to_string({distinct_in_order('a')}, ' ')], lambda x: x <> ''), ' ; ') AS colbert FROM q LEFT JOIN sp USING (qid))
SELECT qid, keywords, sparse, embedding, colbert, {ws("keywords || '. ' || embedding || ' Lexical hints: ' || sparse || '. Token hints: ' || colbert || '.'")} AS expanded FROM v"""


@query(VIEWS)
def query_views(spark, d):
    v = t.topics(spark, d).select("qid", x.expansion_views("query").alias("v"))
    return v.select("qid", "v.*")


VOC = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))))"


@query(f"WITH {t.POSTS} SELECT qid, {lists(VOC)} AS words FROM posts")
def tokens_vocabulary(spark, d):
    return _posts(spark, d).select("qid", F.array_join(F.array_sort(x.vocabulary_words("text")), " ").alias("words"))


def cues_sql(c: str) -> str:
    """The score of signs of named entities of a text."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    tokens = f"list_transform(regexp_extract_all({c}, '[@#]?[A-Za-z][A-Za-z0-9.''-]*(?:-[A-Za-z0-9.''-]+)?'), lambda k: regexp_replace(k, '^[@#]+|[@#]+$', '', 'g'))"
    titled = lambda k: f"(regexp_matches({k}, '^[A-Z]') AND upper({k}) <> {k} AND NOT list_contains({quoted(x.PLAIN_TITLECASE)}, {k}))"
    orgs = f"2 * len(list_filter({quoted(x.ORGANISATIONS)}, lambda o: regexp_matches({c}, '\\b' || o || '\\b')))"
    authors = f"CASE WHEN regexp_matches({c}, '\\b[A-Z][a-z]+\\s+et\\s+al\\b|\\bby\\s+[A-Z][a-z]+|\\bfrom\\s+[A-Z][a-z]+') THEN 2 ELSE 0 END"
    acronyms = f"len(list_filter(regexp_extract_all({c}, '\\b[A-Z]{{2,}}(?:[-/]?\\d+)?\\b|\\b[A-Z]\\.[A-Z](?:\\.)?\\b'), lambda k: k <> 'RT'))"
    single = f"len(list_filter({tokens}, lambda k, i: i > 1 AND length(k) > 2 AND {titled('k')}))"
    pairs = f"2 * len(list_filter(list_zip({tokens}, list_slice({tokens}, 2, len({tokens}))), lambda p: p[2] IS NOT NULL AND {titled('p[1]')} AND {titled('p[2]')}))"
    return f"{orgs} + {authors} + {acronyms} + {single} + {pairs}"


@query(f"WITH {t.POSTS} SELECT qid, CAST({cues_sql('text')} AS BIGINT) AS score FROM posts")
def entity_cue_score(spark, d):
    return _posts(spark, d).select("qid", x.entity_cues("text").cast("bigint").alias("score"))


@query(f"WITH {t.POSTS}, h AS (SELECT qid, unnest(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS tag FROM posts) SELECT lower(tag) AS tag, count(*) AS uses, count(DISTINCT qid) AS posts FROM h GROUP BY 1")
def hashtag_counts(spark, d):
    h = _posts(spark, d).select("qid", F.explode(F.regexp_extract_all("text", F.lit("(#[A-Za-z0-9_]+)"))).alias("tag"))
    return h.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("uses"), F.countDistinct("qid").alias("posts"))


@query(f"""WITH {t.POSTS}, h AS (SELECT DISTINCT unnest(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS tag FROM posts)
SELECT tag, lower(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(tag, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z]*)[A-Z]([0-9_])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+'), ' ')) AS words FROM h""")
def hashtag_words(spark, d):
    h = _posts(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("(#[A-Za-z0-9_]+)"))).alias("tag")).distinct()
    return h.select("tag", F.array_join(x.split_hashtag("tag"), " ").alias("words"))


@query(f"""WITH {t.CORPUS}, k AS (SELECT docid, nullif({ws('title')}, '') AS a, nullif({ws('abstract')}, '') AS b, nullif({ws('authors')}, '') AS c FROM corpus)
SELECT docid, concat_ws(' ', a, b) AS plain, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || '. ' || b ELSE coalesce(a, b, '') END AS dotted, concat_ws(' ', a, b, CASE WHEN c IS NOT NULL THEN 'Authors: ' || c END) AS with_authors,
CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN concat_ws(' ', a || '. ' || b, 'Authors: ' || c) ELSE coalesce(a, b, '') END AS dotted_authors, left(regexp_replace(coalesce(a, '') || '. ' || coalesce(b, ''), '^[. ]+|[. ]+$', '', 'g'), 200) AS trimmed,
CASE WHEN lower(a) = lower(b) THEN a ELSE concat_ws(' ', a, b) END AS merged FROM k""")
def doc_text_variants(spark, d):
    v = {"plain": "plain", "dotted": "dotted", "with_authors": "authors", "dotted_authors": "dotted_authors", "merged": "merged"}
    return t.corpus(spark, d).select("docid", *[x.document_text("title", "abstract", "authors", s).alias(n) for n, s in v.items()], x.document_text("title", "abstract", style="trimmed", most=200).alias("trimmed"))


@query(f"""WITH {t.POSTS}, w AS (SELECT qid, list_filter({MULTI}, lambda k: length(k) > 2 AND (regexp_matches(k, '[0-9\\-]|^[A-ZÀ-ÖØ-Þ]') OR length(k) > 5)) AS a FROM posts),
l AS (SELECT qid, list_filter(list_transform(a, lambda k: regexp_replace(regexp_replace(lower(k), '([a-z]{{3}})ies$', '\\1y'), '([a-z]{{3}}[^s])s$', '\\1')), lambda k: NOT list_contains({t.STOP_SQL}, k)) AS a FROM w)
SELECT qid, array_to_string({distinct_in_order('a')}, ' ') AS keywords FROM l""")
def keyword_terms(spark, d):
    return _posts(spark, d).select("qid", x.keywords("text").alias("keywords"))


@query(f"""WITH q AS (SELECT DISTINCT qid, text FROM en_eval WHERE trim(text) <> ''), g AS (SELECT DISTINCT qid, pubkey FROM en_eval WHERE pubkey IS NOT NULL), {t.CORPUS},
p AS (SELECT qid, 'question:' || text || chr(32) || chr(10) || chr(32) || chr(10) || ' passage:' || coalesce(title, '') AS prompt FROM q JOIN g USING (qid) JOIN corpus ON docid = pubkey) SELECT qid, prompt FROM p""")
def rerank_prompts(spark, d):
    e = table(spark, d, "en_eval")
    q = e.where("trim(text) <> ''").select("qid", "text").distinct()
    g = e.where("pubkey is not null").select("qid", F.col("pubkey").alias("docid")).distinct()
    j = q.join(g, "qid").join(t.corpus(spark, d).select("docid", F.coalesce("title", F.lit("")).alias("title")), "docid")
    return j.select("qid", x.prompt("text", "title").alias("prompt"))


@query("SELECT DISTINCT run_name, regexp_replace(regexp_replace(run_name, '_b\\d+$', ''), '[^A-Za-z0-9_.\\-]+', '_', 'g') AS short FROM run_entries")
def run_short_names(spark, d):
    r = table(spark, d, "run_entries").select("run_name").distinct()
    return r.select("run_name", x.compact_name(F.regexp_replace("run_name", r"_b\d+$", "")).alias("short"))


@query("""SELECT CASE WHEN text IS NULL THEN 'no text' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = '' THEN 'blank text' WHEN pubkey IS NULL THEN 'no gold' ELSE 'kept' END AS reason, count(*) AS rows FROM en_train GROUP BY 1""")
def skip_reasons(spark, d):
    rules = {"no text": F.col("text").isNull(), "blank text": x.strip("text") == "", "no gold": F.col("pubkey").isNull()}
    return quality.skip_reasons(table(spark, d, "en_train"), rules)


VA, VB = VOC.replace("text", "abstract"), VOC


@query(f"""WITH {t.CORPUS}, {t.POSTS}, a AS (SELECT DISTINCT unnest({VA}) AS w FROM corpus), b AS (SELECT DISTINCT unnest({VB}) AS w FROM posts), j AS (SELECT a.w AS a, b.w AS b FROM a FULL JOIN b ON a.w = b.w)
SELECT count(a) AS size_a, count(b) AS size_b, CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS shared, round(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS jaccard, (SELECT round(avg(len({VA})), 6) FROM corpus) AS mean_a, (SELECT round(avg(len({VB})), 6) FROM posts) AS mean_b FROM j""")
def vocab_jaccard(spark, d):
    a = t.corpus(spark, d).select(F.col("abstract").alias("text"))
    v = quality.vocabulary_drift(a, _posts(spark, d).select("text"), x.vocabulary_words("text"))
    return v.withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT lang, kind, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY lang, kind")
def documents_by_language(spark, d):
    return table(spark, d, "documents").groupBy("lang", "kind").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@query("SELECT source_kind, count(*) AS documents, count(DISTINCT d.source) AS sources FROM documents d JOIN source_catalog USING (source) GROUP BY source_kind")
def documents_by_source_kind(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "source_catalog").select("source", "source_kind"), "source").groupBy("source_kind").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
