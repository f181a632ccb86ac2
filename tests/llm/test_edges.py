"""The dealt operators on nulls, empty and very long texts, ties, repeats, empty tables and clashing names."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.llm import bpe, formatting_dups, language, lookalikes, packing, pair_defects, residue, split_overlap, top_items

CLASH = ["w", "c", "h", "id", "key", "item", "g1", "minus", "_seen", "_masked", "row", "size", "curve", "piece", "said", "form", "changed", "n", "k", "place", "few", "many", "letters", "a", "b", "_m", "_s", "_w", "_low"]


def clashing(df):
    """Extra columns with names the operators use inside."""
    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- 4: top items

RUN = "run_name string, qid string, docid string, rank int, score double"


def brute_top(rows, n):
    inf = float("inf")
    best = {}
    for run, q, d, r, s in rows:
        d = (d or "").strip()
        if d:
            k = (inf if s is None or s != s else -s, r if r is not None and r >= 1 else 2147483647, d)
            if (run, q, d) not in best or k < best[run, q, d]:
                best[run, q, d] = k
    out = collections.defaultdict(list)
    for (run, q, d), k in best.items():
        out[run, q].append((k, d))
    return sorted(((run, q, d) for (run, q), v in out.items() for _, d in sorted(v)[:n]), key=str)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_top_items(spark, threshold):
    r = random.Random(5)
    rows = [("a", "hot", f"d{r.randrange(900)}", r.randrange(-1, 9), round(r.random(), 1)) for _ in range(1500)]
    rows += [(r.choice("ab"), f"q{r.randrange(60)}", r.choice([" d1 ", "d2", "d3", "", None, "d4\t", f"x{r.randrange(30)}"]), r.choice([None, 0, 1, 2, 3]), r.choice([None, float("nan"), 0.0, 0.5, 0.5, 1.0, -1.0])) for _ in range(2500)]
    rows += [(None, None, "d", 1, 1.0), ("n", "none", "d1", None, None), ("n", "none", "d2", 5, float("nan"))]
    rows += rows[:200]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = clashing(spark.createDataFrame(rows, RUN))
        assert got(top_items.top_items(df, 4), "run_name", "qid", "docid") == brute_top(rows, 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_top_items_empty(spark):
    assert top_items.top_items(spark.createDataFrame([], RUN), 3).count() == 0
    assert top_items.top_items(spark.createDataFrame([("a", "q", None, 1, 1.0)], RUN), 3).count() == 0


# --- 7: encoding

TEXTS = [None, "", " ", "x", "Hello  world'll 12345 é ﬁ 測定 👩‍🔬\n\n<|endoftext|>", "a" * 50_000, "ab " * 30_000, "\u0000�"]


def test_encoding(spark):
    import tiktoken

    v = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t.encode("latin-1"): i for t, i in v.ids.items()}, special_tokens={})
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("abcdeé 1.,'\n测🦠ß") for _ in range(r.randrange(80))) for _ in range(300)]
    df = clashing(spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id long, text string"))
    rows = bpe.encode_documents(df).collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        assert x.ids == (own.encode_ordinary(texts[x.doc_id]) if texts[x.doc_id] else [])
        assert v.decode(x.ids) == (texts[x.doc_id] or "")
    back = bpe.decode_documents(bpe.encode_documents(df.limit(9))).collect()
    assert all(b.text == (texts[b.doc_id] or "") for b in back)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_merges_in_order(spark):
    """The backtracking encoder gives what merging the earliest pair, again and again, gives."""
    v = bpe.vocabulary()

    def merge(t):
        parts = [v.ids[c] for c in t]
        while True:
            best = min(((v.ids.get(v.text[a] + v.text[b], 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return tuple(parts)
            parts[best[1] : best[1] + 2] = [best[0]]

    r = random.Random(4)
    for _ in range(400):
        t = "".join(r.choice("aeiountrs hlm") for _ in range(r.randrange(1, 24)))
        assert v.piece(t) == merge(t), t


# --- 8: packing


def test_packing(spark):
    r = random.Random(1)
    texts = [None, "", "word " * 700, "a b " * 3000] + [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(1, 60))) for _ in range(600)] + ["same text here"] * 300
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = packing.pack_documents(df, 256, per_task=20).collect()
    v = bpe.vocabulary()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_bin[x.container].append(x)
    for i, t in enumerate(texts):
        n = len(v.encode(t))
        parts = sorted(by_doc[i], key=lambda x: x.piece)
        assert sum(p.n_tokens for p in parts) == n and (len(parts) == 1 or n > 256) and [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.start_token == 256 * p.piece for p in parts)
    total = sum(x.n_tokens for x in rows)
    assert all(sum(x.n_tokens for x in b) <= 256 and sorted(x.position for x in b) == list(range(len(b))) for b in by_bin.values())
    assert total / (256 * len(by_bin)) > 0.96
    assert packing.pack_documents(df.limit(0), 256).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(None, None), (None, "x"), (1, "y"), (1, "y")], "doc_id long, text string")).count() == 4


def test_hilbert_neighbours():
    import numpy as np

    g = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    k = packing.hilbert_keys(g, 3)
    assert sorted(k) == list(range(512))
    path = g[np.argsort(k)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- 2: formatting duplicates

PAPER = "pubkey string, title string, abstract string"


def test_formatting_dups(spark):
    rows = [
        ("5", "Straße A-1", "The end. Of it"), ("3", "STRASSE A1", "the end of it"), ("4", "the END, of it", " strasse a 1"), ("9", "strasse a2", "the end of it"),
        ("8", "strasse 1a", "the end of it"), ("7", None, "x"), ("6", " ", "x"), ("1", "--", "x"), (None, "STRASSE A1", "the end of it"), ("3", "STRASSE A1", "the end of it"),
        ("20", "x" * 300_000, "y"), ("21", "Y", "X" * 300_000),
    ]
    df = clashing(spark.createDataFrame(rows, PAPER))
    assert got(formatting_dups.same_papers(df), "pubkey_a", "pubkey_b") == [("20", "21"), ("3", "4"), ("3", "5")]
    marks = spark.createDataFrame([("1", "की दवा", "x y"), ("2", "कि दवा", "x y"), ("3", "Cafe\u0301 noir", "x y"), ("4", "CAFÉ noir", "X-Y"), ("5", "Cafe noir", "x y"), ("6", "की, दवा", "(x y)"), ("7", "a\ufe0fb", "❤\ufe0f c"), ("8", "ab", "C")], PAPER)
    assert got(formatting_dups.same_papers(marks), "pubkey_a", "pubkey_b") == [("1", "6"), ("3", "4"), ("7", "8")]
    one = {r.pubkey: (r.copies, r.rows) for r in formatting_dups.one_per_paper(df).collect()}
    assert one["3"] == (3, 4) and one["9"] == (1, 1) and one["7"] == (1, 1) and "4" not in one
    assert formatting_dups.same_papers(df.limit(0)).count() == 0


# --- 6: look-alikes

ALIKE = [
    ("ok café", "ok café"), ("café", "café"), ("ﬁnd ｗｉｄｅ！", "find wide!"), ("zero​width so­ft", "zerowidth soft"), ("no break", "no break"), ("Аccording іs", "According is"),
    ("gives а ratio", "gives a ratio"), ("he said «вопрос закрыт».", "he said «вопрос закрыт»."), ("«ΝΕΡΟ ΚΑΙ ΦΩΣ»", "«ΝΕΡΟ ΚΑΙ ΦΩΣ»"), ("α-helix, Δ and β-sheet", "α-helix, Δ and β-sheet"),
    ("👩‍🔬 ❤️ 🧑🏽‍⚕️ 👨‍👩‍👧 1️⃣", "👩‍🔬 ❤️ 🧑🏽‍⚕️ 👨‍👩‍👧 1️⃣"), ("m² at 10⁻³ “so” – more…", "m² at 10⁻³ “so” – more…"), ("測定は二回、行われた。はい！", "測定は二回、行われた。はい！"), ("tha‍t", "that"),
    ("said «вопрос закрыт». А naïve", "said «вопрос закрыт». A naïve"), ("ɡive օne ӏink", "give one link"), ("𝔘𝔫𝔦 𝟙𝟚", "Uni 12"), ("ｱｲｳ ｶﾞ", "アイウ ガ"), ("type Ⅱ, 5 ㎏, ￥9, ①", "type II, 5 kg, ¥9, 1"), ("Ꭰpple ꓚell", "Dpple Cell"), ("Ꭰ Ꭱ", "Ꭰ Ꭱ"), ("a\U000F0010b \U000F0000 \U000F0001 \U000F0100", "a\U000F0010b \U000F0000 \U000F0001 \U000F0100"), ("\U000F0002 ﬁn\u200bd \U000F0021", "\U000F0002 find \U000F0021"),
    ("витамин-D и рак", "витамин-D и рак"), ("а-level раtient-rероrted", "a-level patient-reported"), ("µ-opioid, ϕ, № 5 at 3 ℃ ½ ™", "µ-opioid, ϕ, № 5 at 3 ℃ ½ ™"), ("⼀⽇", "一日"), ("", ""), (None, None), ("می‌خواهم", "می‌خواهم"), ("a" * 300_000 + "​", "a" * 300_000),
]


def test_lookalikes(spark):
    df = clashing(spark.createDataFrame([(str(i), a) for i, (a, _) in enumerate(ALIKE)], "qid string, text string"))
    for r in lookalikes.one_form(df, "qid", "text").collect():
        a, b = ALIKE[int(r.qid)]
        assert r.form == b and r.changed == (a != b), a
    twice = df.unionByName(df)
    assert got(lookalikes.changed_records(twice, "qid", "text", "s"), "src", "rec_key") == sorted(("s", str(i)) for i, (a, b) in enumerate(ALIKE) if a != b)
    again = spark.createDataFrame([(str(i), b) for i, (_, b) in enumerate(ALIKE)], "qid string, text string")
    assert lookalikes.changed_records(again, "qid", "text", "s").count() == 0
    assert lookalikes.one_form(df.limit(0), "qid", "text").count() == 0


# --- 9: residue

RESIDUE = [
    ("Abstract of {{ title }} and more real text about mice.", True), ("Real text %doi% inside", True), ("see <your title here>", True), ("[INSERT name HERE]", True), ("x ${a.b} y", True), ("<<a_b>>", True), ("__title__", True), ("{doi}", True),
    ("Journal of X\nPlease enable JavaScript to view this abstract.\n\nHome | About | Contact", True), ("ERROR 404: NOT FOUND. PLEASE TRY AGAIN LATER OR CONTACT THE SITE OWNER.", True), ("Ceci est un texte de remplissage.", True), ("TBD TBD TBD", True),
    ("Lorem ipsum dolor sit amet, donec nunc. Morbi arcu tellus.", True), ("Traceback (most recent call last):\n  File \"a.py\", line 3, in view\nKeyError: 'x'", True),
    ("We measured how often a link answered with 404 Not Found.", False), ("Let S = {a, b, c} and \\frac{x}{y} under ${\\alpha} = 0.05$.", False), ("The macro __init__ and $HOME are discussed.", False), ('The record {"arm": 2} was parsed.', False), ("Format %s and <b>kept</b> [1], [2]", False),
    ("x", False), ("12345", False), ("", False), (" \n", False), (None, False), ("Forms filled with lorem ipsum were rated as less credible than real abstracts by 83 readers.", False), ("diet; lung; heart", False),
    ("?!?!...---===", False), ("日本語の要旨", False),
]
LONG = ["a.b." * 60_000, "1.2" * 80_000, "{{ a " * 30_000, "tbd " * 60_000, "a|b" * 60_000, "x@" * 60_000, "word " * 60_000, "[ " * 60_000, "xxx xx " * 40_000, "_" * 100_000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 else f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def spread(spark, texts, copies=4):
    """Every text in some copies from two sources; the number of a text is doc_id % 1000."""
    return spark.createDataFrame([(i + 1000 * k, t, None if k % 2 else "s") for i, t in enumerate(texts) for k in range(copies)], "doc_id long, text string, source string")


def numbers_of(df):
    return {r.doc_id % 1000 for r in df.collect()}


def test_residue(spark):
    df = clashing(spread(spark, [t for t, _ in RESIDUE]))
    want = {i for i, (_, y) in enumerate(RESIDUE) if y}
    assert numbers_of(residue.residue(df)) == want and residue.residue(df).count() == 4 * len(want)
    clean = residue.without_residue(df)
    assert clean.columns == df.columns and numbers_of(clean) == set(range(len(RESIDUE))) - want and clean.count() == 4 * (len(RESIDUE) - len(want))
    assert residue.residue(df.limit(0)).count() == 0


def test_recurrence_decides(spark):
    """The same texts once each: only placeholders, mock Latin, traces, status lines and dummy words are left."""
    once = {r.doc_id: r.rule for r in residue.residue(docs(spark, [t for t, _ in RESIDUE])).collect()}
    form = {i for i, (t, y) in enumerate(RESIDUE) if y and not re.search("JavaScript|remplissage", t)}
    assert set(once) == form and set(once.values()) == {"placeholder", "mock latin", "shape"}
    a, b, c = "Please enable JavaScript to go on.", "The page could not be found.", "Access denied."
    texts = [(1, a + " " + b, "s"), (2, a + " " + b, "t"), (3, a + " " + b, None), (4, b.upper(), "s"), (5, b + " " + a + " " + b, "s"), (6, a + " " + c, "s"), (7, a + " " + c, "s"), (8, a + " It rained.", "u")]
    got_ = {r.doc_id: (r.rule, r.kind) for r in residue.residue(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert got_ == {1: ("recurring text", "notice"), 2: ("recurring text", "notice"), 3: ("recurring text", "notice"), 4: ("recurring sentences", "message"), 5: ("recurring sentences", "notice")}


def test_residue_recurs_and_is_linear(spark):
    odd = "The page cannot be displayed by this server"
    few = docs(spark, [odd] * 2)
    many = spark.createDataFrame([(i, f"{odd}", f"s{i % 2}") for i in range(4)], "doc_id long, text string, source string")
    assert residue.residue(few).count() == 0 and residue.residue(many).count() == 4
    flagged = {r.doc_id for r in residue.residue(docs(spark, LONG)).collect()}
    assert 3 in flagged and 6 not in flagged


NAMES = ["title", "claim.text", "main_claim", "paper.first_author.name", "a" * 45, "part." * 30 + "name", "x" * 50_000]
FORMS = ["{{ %s }}", "{%% %s %%}", "<%%= %s %%>", "${%s}", "[[%s]]", "<<%s>>", "@@%s@@", "{%s}", "%%%s%%", "__%s__", "[insert %s]", "[%s here]", "<your %s>"]


def test_every_placeholder_form_passes_the_cheap_test(spark):
    assert len(FORMS) == len(residue.PLACEHOLDERS)
    rows = [(i, f"Peer review is still open, {f % n} but the ratio stayed.") for i, f in enumerate(FORMS) for n in NAMES]
    df = spark.createDataFrame(rows, "i int, text string")
    alone = F.element_at(F.array(*[F.rlike("text", F.lit(p)) for p in residue.PLACEHOLDERS]), F.col("i") + 1)
    seen = df.select("text", alone.alias("alone"), F.rlike("text", F.lit(residue.MARKS)).alias("marked"), residue.has_placeholder("text").alias("found")).collect()
    assert [r.text for r in seen if not (r.alone and r.marked and r.found)] == []


PHRASES = [
    ("We could not load the article. Please try again later.", True), ("Access denied\nYou do not have permission to view this record.", True), ("Access denied\nRef: 8123", True), ("Our team has been notified.", True), ("The upstream host did not answer in time.", True),
    ("Some parts of the archive will not work.", True), ("at org.site.view(page.java:12)", True), ("(12)", False), ("We could not find the gene. It was notified to the registry.", False), ("Patients were asked to try again.", False), ("See ref: 12 for the request 3 of the board.", False),
]


def test_whole_phrases_are_residue(spark):
    assert numbers_of(residue.residue(spread(spark, [t for t, _ in PHRASES]))) == {i for i, (_, y) in enumerate(PHRASES) if y}


def test_every_phrase_holds_a_sign(spark):
    """A text leaves by its signs before its phrases are looked at; no phrase may be lost by that."""
    texts = ["please turn on scripts in the browser", "requires cookies", "javascript is disabled", "checking your browser", "texte de remplissage", "blindtext", "platzhalter", "texto de relleno", "testo di riempimento", "segnaposto", "sample text", "dummy text", "goes here", "coming soon", "lorem ipsum", "replace this", "appear in this", "appear here", "tbd", "tba", "todo", "not found", "introuvable", "nicht gefunden", "no se ha encontrado", "non trovata", "access denied", "accès refusé", "zugriff verweigert", "acceso denegado", "accesso negato", "forbidden", "permission to", "session has expired", "unavailable", "try again later", "too many requests", "went wrong", "error 0", "erreur 0", "fehler 0", "timeout", "not answer", "could not be loaded", "could not load", "cannot be displayed", "moved or deleted", "been notified", "will not work", "traceback", "nullpointerexception", "server error", "bad gateway", "bad request, error", "unauthorized"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = df.select("t", F.rlike("t", F.lit(residue.SIGNS)).alias("s"), F.rlike("t", F.lit(residue.PHRASES)).alias("p")).collect()
    assert [r.t for r in seen if not (r.s and r.p)] == []


BRACKETS = [
    ("[Insert a short description of the main findings of this study and its limitations here]", True), ("[a summary of the main findings of this study and of all its limitations goes here]", True), ("see <your full title as it should stand in the printed list of all accepted papers>", True),
    ("[the abstract of the second study, which is longer than all others, to be added]", True), ("[insert " + "a long note " * 20_000 + "]", True), ("[" + "word " * 50_000 + "here]", True), ("<your " + "word " * 50_000 + ">", True), ("[x here]", True),
    ("[ here]", False), ("[here]", False), ("[insert " * 30_000, False), ("[" + "word here " * 40_000, False), ("<your " * 30_000, False), ("[insert " + "word " * 50_000, False), ("here] and [1] there", False),
    ("A longer remark [which says that the samples were kept apart from each other over here, and more] stays.", False),
]


def test_brackets_of_any_length(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in BRACKETS)), "i int, text string")
    assert [r.i for r in df.where(residue.has_placeholder("text")).sort("i").collect()] == [i for i, (_, y) in enumerate(BRACKETS) if y]


# --- 1: languages

SENT = {
    "en": "The authors of the study asked many people for a second visit, and the ratio stayed the same in older adults.",
    "fr": "Les auteurs de l'étude ont demandé une seconde visite à de nombreuses personnes, et le rapport est resté le même chez les adultes.",
    "de": "Die Autoren der Studie baten viele Menschen um einen zweiten Besuch, und das Verhältnis blieb bei älteren Menschen gleich.",
    "es": "Los autores del estudio pidieron una segunda visita a muchas personas, y la razón se mantuvo igual en los adultos mayores.",
    "it": "Gli autori dello studio hanno chiesto una seconda visita a molte persone, e il rapporto è rimasto uguale negli anziani.",
}


@pytest.fixture(scope="module")
def dictionaries(spark):
    d = "/root/testdata/sf0.01"
    return language.contents(spark.read.parquet(f"{d}/lang_samples.parquet"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"))


def test_languages(spark, dictionaries):
    rows = [(k, v, k) for k, v in SENT.items()]
    rows += [("names", SENT["fr"], "FRENCH"), ("region", SENT["de"], "de_AT"), ("wrong", SENT["fr"], "de"), ("none", SENT["it"], None), ("blank", SENT["es"], " "), ("mixed", SENT["fr"] + " / " + SENT["de"], "fr")]
    rows += [("null", None, None), ("empty", "", "xx"), ("link", "https://a.example/b 🧪 @x #y", None), ("borrowed", SENT["fr"] + " « peer review »", "fra"), ("quote", "Dans le résumé on lit ceci : « " + SENT["en"] + " », et cela me laisse sans voix.", "fr"), ("long", (SENT["fr"] + " ") * 3000, "fr")]
    rows += rows[:3]
    df = clashing(spark.createDataFrame(rows, "qid string, text string, lang string"))
    want = sorted([("wrong", "fr"), ("none", "it"), ("blank", "es"), ("mixed", "de"), ("mixed", "fr"), ("quote", "en"), ("quote", "fr")])
    assert got(language.mislabelled(df, dictionaries, "t"), "qid", "lang") == want
    seg = [r for r in language.post_segments(df, dictionaries).where("qid = 'quote'").orderBy("segment").collect()]
    assert [s.lang for s in seg] == ["fr", "en", "fr"] and all(0 < s.confidence <= 1 for s in seg)
    assert language.mislabelled(df.limit(0), dictionaries, "t").count() == 0


def test_held_out_accuracy(spark, dictionaries):
    """Posts of another size whose label is right and whose function words agree."""
    c = language.Classifier(dictionaries)
    marks = {"fr": " les ", "de": " und "}
    n = right = 0
    for t, k in (("final_fr_test", "fr"), ("final_de_test", "de")):
        for r in spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where(F.col("lang") == k).select("text").distinct().collect():
            for x in language.chunks(r.text):
                if language.words(x) >= 8 and marks[k] in x:
                    n += 1
                    right += c.language(x)[0] == k
    assert n > 500 and right / n > 0.99


# --- 3: pairs

FR = "Les auteurs de Moluna ont demandé une seconde visite à 1200 personnes de Barin. Le rapport est resté à 2,50 chez les adultes. #science https://a.example/x"
EN = "The authors of Moluna asked 1200 people from Barin for a second visit. The ratio stayed at 2.50 in adults. #science https://a.example/x"
PAIRS = [
    (FR, EN, []), (FR, None, ["empty"]), (FR, " ", ["empty"]), (FR, "English:", ["empty"]), (FR, "assistant\n", ["empty"]), (FR, '""', ["empty"]), (FR, "https://a.example/x", ["empty"]),
    (FR, "I'm sorry, but I can't translate this claim.", ["refusal"]), (FR, "Lo siento, no puedo ayudar con un texto sobre esto.", ["refusal"]), (FR, "Note: Ich kann bei dieser Anfrage leider nicht helfen.", ["refusal"]),
    (FR, FR, ["copy"]), (FR, "Translation: " + FR.upper(), ["copy"]), (FR, '"' + FR.split(" #")[0] + '"', ["copy"]), (EN, EN, []), (FR, "English: " + EN, []),
    (FR, "Los autores de Moluna pidieron una segunda visita a 1200 personas de Barin. La razón se mantuvo en 2,50 en adultos.", ["wrong_language"]),
    (FR, FR.split(". ")[0] + ". The ratio stayed at 2.50 in adults.", ["wrong_language"]),
    (FR, EN.split(". ")[0] + ".", ["truncated"]), (FR, EN[:60], ["truncated"]), (FR, EN[:60] + "…", ["truncated"]), (None, EN, []), ("", EN, []), (None, None, ["empty"]),
    ("Désolé, mais je ne peux pas y croire. " + FR, "Sorry, but I cannot believe it. " + EN, []),
    (FR, "I cannot translate this text about 40 patients and 12 weeks.", ["refusal"]), (FR, FR + " And this is what the model adds.", ["copy"]), (FR, FR[:60], ["copy"]), (FR, "Output: « " + FR.split(". ")[0].lower() + " »", ["copy"]),
    (EN, EN.split(". ")[0] + ".", ["truncated"]), (EN + " " + EN, EN, ["truncated"]),
    ("Une étude montre que 40 % des patients ont guéri après 3 semaines de traitement.", "A study shows that forty percent of patients recovered after three weeks of treatment.", []),
    ("Une étude montre que 40 % des patients ont guéri après 3 semaines. Les autres patients ont gardé des symptômes pendant des mois.", "A study shows that forty percent of patients recovered after three weeks.", ["truncated"]),
    ("Les auteurs n'ont pas pu fournir de données sur 40 patients.", "The authors could not provide data on 40 patients.", []), ("Nous ne pouvons pas traiter ce cas à Barin.", "We cannot process this case in Barin.", []), (FR, "Sorry, unable to process this one.", ["refusal"]),
]
EVERY = [(FR, FR[:60], ["copy", "wrong_language", "truncated"]), (FR, FR, ["copy", "wrong_language"]), (FR, "Ich kann diesen Text leider nicht übersetzen, denn er ist zu lang (", ["refusal", "wrong_language", "truncated"])]


def test_pairs(spark, dictionaries):
    rows = [(str(i), p, a) for i, (p, a, _) in enumerate(PAIRS)] + [("long", FR * 2000, EN * 2000), ("tags", FR, EN + " #x" * 20_000)]
    df = clashing(spark.createDataFrame(rows + rows[:4], "qid string, text_original string, text string"))
    found = collections.defaultdict(dict)
    for r in pair_defects.pair_defects(df, dictionaries).collect():
        found[r.qid][r["place"]] = r.defect
    for i, (p, a, want) in enumerate(PAIRS):
        assert [found[str(i)].get(1)] == (want or [None]), (p, a)
    assert "long" not in found and "tags" not in found
    c = language.Classifier(dictionaries)
    assert [pair_defects.defects(p, a, c) for p, a, _ in EVERY] == [w for _, _, w in EVERY]
    assert all(sorted(v.values(), key=pair_defects.TYPES.index) == [v[k] for k in sorted(v)] for v in found.values())
    assert pair_defects.pair_defects(df.limit(0), dictionaries).count() == 0


# --- 5: overlap across splits


def brute_pairs(a, b):
    out = set()
    for i, x in a:
        for j, y in b:
            if x and y and lev(x, y) <= 3:
                out.add((i, j))
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance():
    r = random.Random(6)
    for _ in range(2000):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        assert split_overlap.distance(a, b, 3) == min(4, lev(a, b))


@pytest.mark.parametrize("rare, shard", [(8, 32_000), (1, 7)])
def test_overlap(spark, monkeypatch, rare, shard):
    monkeypatch.setattr(split_overlap, "RARE", rare)
    monkeypatch.setattr(split_overlap, "SHARD", shard)
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 9, 20]))] for _ in range(60)]

    def edited(x):
        x = list(x)
        for _ in range(r.randrange(6)):
            k = r.randrange(3)
            at = r.randrange(len(x) + 1)
            if k == 0:
                x.insert(at, r.choice(vocab))
            elif x and k == 1:
                x.pop(min(at, len(x) - 1))
            elif x:
                x[min(at, len(x) - 1)] = r.choice(vocab)
        return x

    dress = lambda x: " ".join(f"#{w.upper()}!" if r.random() < 0.2 else w for w in x) + r.choice(["", " https://a.example/b", " @me", "…"])
    train = [(f"t{i}", edited(r.choice(base))) for i in range(150)]
    ev = [(f"v{i}", edited(r.choice(base))) for i in range(120)]
    mk = lambda rows: clashing(spark.createDataFrame([(i, dress(x)) for i, x in rows] + [("nul", None), ("bl", " \n"), ("pu", "!!"), (None, "w1 w2 w3 w4")], "qid string, text string"))
    a, b = mk(train), mk(ev)
    want = brute_pairs([(i, tuple(x)) for i, x in train], [(i, tuple(x)) for i, x in ev])
    rows = split_overlap.overlaps(a.unionByName(a), b).collect()
    assert {(x.train_id, x.eval_id) for x in rows} == want and len(rows) == len(want)


def test_overlap_of_short_texts(spark):
    """At most three changed words, however short the texts; either side may be the short one."""
    texts = ["trial shows benefit", "trial shows clear benefit", "vaccine works well today", "vaccine works well", "masks reduce transmission indoors", "masks", "it is known that masks reduce transmission", "a b c d", "mask use", "we saw masks here today", "x y masks z v w q", "one two three four five six", "one seven"]
    a = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "qid string, text string")
    b = spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(texts)], "qid string, text string")
    rows = split_overlap.overlaps(a, b).collect()
    want = {(f"t{i}", f"v{j}"): lev(x.split(), y.split()) for i, x in enumerate(texts) for j, y in enumerate(texts)}
    assert {(r.train_id, r.eval_id): r.distance for r in rows} == {k: d for k, d in want.items() if d <= 3}
    assert len(rows) == len({(r.train_id, r.eval_id) for r in rows}) and ("t0", "v1") in {(r.train_id, r.eval_id) for r in rows}


def test_overlap_many_copies_and_long(spark):
    schema = T.StructType([T.StructField("qid", T.StringType()), T.StructField("text", T.StringType())])
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    a = spark.createDataFrame([(f"t{i}", "one two three four five six") for i in range(50)] + [("L", long_)], schema)
    b = spark.createDataFrame([(f"v{i}", "One two, three four FIVE seven") for i in range(40)] + [("M", long_ + " end")], schema)
    rows = split_overlap.overlaps(a, b).collect()
    assert len(rows) == 2001 and {x.distance for x in rows} == {1}
    assert split_overlap.overlaps(a.limit(0), b).count() == 0 and split_overlap.overlaps(a, b.limit(0)).count() == 0
