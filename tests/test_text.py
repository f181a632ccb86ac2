"""Text functions against literal values."""

import pytest
from pyspark.sql import functions as F

from quaero.functions import json_text
from quaero.functions import text as x

POST = "RT @User_1: #LongCovid study 🦠 https://t.co/x by Smith et al. &amp; WHO's"


def one(spark, expr, value=POST):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "f, want",
    [
        (lambda: x.clean_query("t"), "RT User_1: LongCovid study https://t.co/x by Smith et al. &amp; WHO's"),
        (lambda: x.clean_post("t"), "RT : LongCovid study by Smith et al. &amp; WHO's"),
        (lambda: x.clean_post("t", "@user"), "RT @user: LongCovid study by Smith et al. &amp; WHO's"),
        (lambda: x.clean_by_category("t"), "RT @User_1: LongCovid study by Smith et al. & WHO's"),
        (lambda: x.simple_tokens("t"), ["rt", "longcovid", "study", "smith", "et", "al", "amp", "s"]),
        (lambda: x.multilingual_tokens("t", []), ["user", "longcovid", "study", "https", "smith", "amp", "who"]),
        (lambda: x.entity_cues("t"), 2 + 2 + 1 + 4 + 2),
        (lambda: x.slug("t"), "rt-user-1-longcovid-study-https-t-co-x-by-smith-et-al-amp-who-s"),
        (lambda: x.ascii_folded(F.lit("Café ﬁn")), "Cafe fin"),
        (lambda: x.split_hashtag(F.lit("#LongCovid_study")), ["long", "covid", "study"]),
        (lambda: x.long_form(F.lit("BTW")), "by the way"),
        (lambda: x.reference_tokens(F.lit("See [12] PubMed IL-6 (3) rises")), ["see", "il-6", "rises"]),
        (lambda: x.clean_translation(F.lit("user\nx\nassistant\nEnglish: A b.\n\n\nC d.")), "A b.\nC d."),
        (lambda: x.corpus_tokens(F.lit("@a The #Big café's 12 new-ish")), ["big", "cafe", "new", "ish"]),
        (lambda: x.stemmed(F.array(*map(F.lit, ["relational", "hopping", "caresses", "ponies", "sky", "generalization"]))), ["relat", "hop", "caress", "poni", "sky", "gener"]),
        (lambda: x.analyzed(F.lit("PowerShot's 2ndWave"), [], split_words=True), ["powershot", "power", "shot", "s", "2ndwave", "2", "nd", "wave"]),
        (lambda: x.term_variants(F.lit("IL-6")), ["IL-6", "il-6", "IL6", "IL 6"]),
        (lambda: x.term_variants(F.lit("studies")), ["studies", "study"]),
        (lambda: x.query_terms(F.lit("the COVID vaccine and covid risk of mRNA-1273 use"), ["the", "and", "of"]), ["COVID", "vaccine", "mRNA-1273", "risk", "use"]),
        (lambda: x.compact_name(F.lit("a/res_rer_x y.json")), "rer_x_y"),
        (lambda: x.path_split(F.lit("data/dev_set/q.json")), "dev"),
        (lambda: x.path_language(F.lit("data/final_de_test.json")), "de"),
        (lambda: x.path_language(F.lit("x/queries_fr_train.json")), "fr"),
        (lambda: x.format_bytes(F.lit(1536)), "1.5 KiB"),
        (lambda: x.format_duration(F.lit(3725)), "01:02:05"),
        (lambda: x.p_label(F.lit(0.0004)), "<0.001"),
        (lambda: x.vocabulary_words(F.lit("Le café IS big, big x1")), ["big"]),
        (lambda: x.prompt(F.lit("q"), F.lit("p")), "question:q \n \n passage:p"),
        (lambda: x.emoji_names(F.lit("a 🦠")), "a  microbe "),
        (lambda: json_text.balanced_object(F.lit('x {"a": "}", "b": {"c": 1}} y')), '{"a": "}", "b": {"c": 1}}'),
        (lambda: json_text.valid_payload(F.lit('{"keywords":"a","sparse":"b","embedding":"c","colbert":"d","expanded":"e"}')), True),
        (lambda: json_text.valid_payload(F.lit('{"keywords":"a"}')), False),
    ],
)
def test_literal(spark, f, want):
    assert one(spark, f()) == want


def test_null_and_long_texts(spark):
    for v in (None, "", "a-" * 200_000, "#a " * 50_000, "1.2" * 100_000):
        df = spark.createDataFrame([(v,)], "t string")
        df.select(*[f("t").alias(str(i)) for i, f in enumerate([x.clean_query, x.clean_post, x.clean_by_category, x.simple_tokens, x.multilingual_tokens, x.vocabulary_words, x.analyzed, x.normalize_ws, x.token_count])]).collect()


def test_views(spark):
    v = one(spark, x.expansion_views(F.lit("Vaccine efficacy in adults")))
    assert v.keywords == "Vaccine; efficacy; adults" and v.sparse.endswith("adults ; adult")
    assert v.embedding.startswith("Relevant document discussing Vaccine, efficacy, adults;")


def test_payload_with_noise(spark):
    v = one(spark, json_text.parsed_payload(F.lit('Sure!\n{"keywords": "a"} thanks')))
    assert v is not None
    assert one(spark, json_text.parsed_payload(F.lit("no json"))) is None


def test_first_object():
    f = json_text.first_object
    assert f('say {x} and {"a": "{", "b": [{"c": 1}]} and {"d": 2}') == '{"a": "{", "b": [{"c": 1}]}'
    assert [f(v) for v in (None, "", "no", "{", '{"a": {"b": 1}', '{"a": "x', '{"a":' * 100_000, "{" * 300_000)] == [None] * 8
    assert f("{}") == "{}" and f('```json\n{"a": "q\\"}"}\n```') == '{"a": "q\\"}"}'


def test_title_pairs_of_long_texts(spark):
    assert one(spark, x.entity_cues("t"), "We saw " + "ab " * 30_000 + "Ann Lee") == one(spark, x.entity_cues("t"), "We saw ab Ann Lee")
