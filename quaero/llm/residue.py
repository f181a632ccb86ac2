"""Template residue and error-page text: what to exclude, and the corpus without it.

1. Numbers, addresses, dates and hexadecimal codes are masked, case and white
   space folded, a page heading and menu lines taken off. The masked text is
   cut into sentences.
2. A text is a candidate if every sentence carries a sign (``SIGNS``: words of
   messages, notices and filler) and none reports (``ABOUT``), and the text holds
   a phrase (``PHRASES``). Candidates are
   grouped by exact hashes, of the whole text (its distinct sentences in order)
   and of each sentence, and the copies and sources of each group are counted,
   pre-aggregated by (text, source).
3. Recurrence decides: a candidate is residue if its text, or each of its
   sentences, stands in at least ``RECURS`` candidates from ``SOURCES`` sources.
   Phrases alone decide nothing and name the kind.
4. Three forms need no recurrence, as no content has them: a placeholder
   anywhere in a text, mock Latin, and texts that begin with a status line, a
   stack trace or nothing but dummy words (``SHAPES``).

A text without a sign is no candidate, so masking and grouping are left out
for it; that loses no group, as equal masked texts carry equal signs.

Defined results: null, empty and blank texts are never residue; repeated texts
share their verdict; very long texts are read whole, and no name, bracket or
heading is bounded in length; a null source is a source of its own; an empty
table gives no rows; extra columns stay in the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.session import written

#: Copies and sources from which a masked text or sentence recurs widely.
RECURS, SOURCES = 3, 2

# Names between marks that templates use, as regular expressions; possessive, so that names of any length stay linear.
NAME = r"[A-Za-z][A-Za-z0-9]*+(?:[._\- ][A-Za-z0-9]++)*+"
SNAKE = r"[A-Za-z][A-Za-z0-9]*+(?:[._][A-Za-z0-9]++)*+"
DUNDER = "init|main|name|file|doc|dict|class|call|new|str|repr|len|iter|next|enter|exit|all|version|slots|eq|hash|del|getattr|setattr|getitem|setitem|contains|future|import|builtins|module|annotations"
PLACEHOLDERS = [
    r"\{\{\s*+" + NAME + r"\s*+\}\}",
    r"\{%\s*+" + NAME + r"\s*+%\}",
    r"<%=?\s*+" + NAME + r"\s*+%>",
    r"\$\{\s*+" + NAME + r"\s*+\}",
    r"\[\[\s*+" + NAME + r"\s*+\]\]",
    r"<<\s*+" + NAME + r"\s*+>>",
    r"@@" + SNAKE + r"@@",
    r"(?<![A-Za-z0-9_$\\}])\{\s*+[A-Za-z][A-Za-z0-9]++(?:[._][A-Za-z0-9]++)*+\s*+\}(?![A-Za-z{])",
    r"(?<![A-Za-z0-9%])%[A-Za-z]{2,}+(?:[._][A-Za-z0-9]++)*+%(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_])__(?!(?:" + DUNDER + r")__)" + SNAKE + r"__(?![A-Za-z0-9_])",
    r"(?i)\[\s*(?:insert|enter|add|your|put)\s[^\]\[]++\]",
    r"(?i)\[[^\]\[]++(?<=[^\]\[]\s(?:to be added|to be completed|to be announced|goes here|here))\]",
    r"(?i)<\s*(?:your|insert|enter)\s[^<>]++>",
]
#: What every placeholder holds; a cheap test before the patterns. Names between percent signs hold dots too.
MARKS = r"[{\[<]|@@\w|%[\w.]+%|__\w"
# The words of the usual mock-Latin filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor tempus incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi "
    "aliquip aliquam ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla nullam pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia "
    "deserunt mollit anim id est laborum arcu vestra donec porta semper sodales nunc mauris rutrum morbi viverra tellus facilis facilisis integer pretium odio vestibulum pellentesque habitant tristique senectus netus "
    "malesuada fames ac turpis egestas vitae ultrices posuere cubilia curae proin sapien massa augue lectus ligula libero justo urna vel diam risus nibh leo purus eros ante felis metus orci neque fusce praesent "
    "suspendisse interdum cursus gravida lacinia sollicitudin blandit condimentum fermentum phasellus etiam at eget nec per vivamus maecenas quisque cras"
).split()
# Signs of messages, notices and filler, on lower-case text, masked or not.
SIGNS = (
    r"\b(?:javascript|scripts?\b|cookie|browser|navigateur|navegador|captcha|error|erreur|fehler|exception|traceback|timeout|timed out|gateway|server|page|seite\b|p[aá]gina|not found|introuvable|nicht gefunden|encontrad|trovat"
    r"|acc[eè]s|zugriff|denied|refus|verweiger|denegad|negato|forbidden|unauthori[sz]ed|permission|session|sign in|log ?in|unavailable|try again|requests|went wrong|oops|reload|notified|moved or deleted"
    r"|not work|not answer|could not|cannot be|wait [0-9]|(?:request|reference|code|ref|id)[ :#]*+[0-9a-f\-]*[0-9]"
    r"|placeholder|platzhalter|blindtext|relleno|remplissage|riempimento|segnaposto|(?:sample|dummy|filler) text|goes here|coming soon|lorem ipsum|replace this|appear (?:in this|here)|(?:tbd|tba|todo)\b)"
    r"|(?:error|exception)\b|\", line [0-9]"
)
# Phrases, one of which a message, notice or filler text must hold, on masked text (0 stands for a number or code).
NOTICE = r"(?:enable|turn on|activate|require[sd]?|need|disabled|support|run|activer|aktivieren|activ[ae]r?|attiv\w+|abilit\w+)\b.{0,60}(?:script|cookie|browser)|(?:script|cookie)s?\b.{0,40}(?:disabled|required|turned off)|checking your browser"
FILLER = r"placeholder|platzhalter|blindtext|relleno|remplissage|riempimento|segnaposto|(?:sample|dummy|filler) text|goes here|coming soon|lorem ipsum|replace this|appear (?:in this|here)|\b(?:tbd|tba|todo)\b"
ERROR = (
    r"not found|introuvable|nicht gefunden|encontrad|non .{0,10}trovat|access denied|acc[eè]s refus|zugriff verweiger|acceso denegad|accesso negato|forbidden|permission to|session (?:has )?expired|unavailable|try again later|too many requests"
    r"|went wrong|(?:error|erreur|fehler|errore) 0|timeout|not answer|could not (?:be )?(?:load|retrieve|find|found)|cannot be (?:displayed|shown|found|loaded)|moved or deleted|been notified|will not work|traceback|exception|server error|bad gateway|bad request|unauthori[sz]ed"
)
PHRASES = f"{NOTICE}|{FILLER}|{ERROR}"
# The reason phrases of HTTP status codes that error pages show.
REASONS = "bad request|unauthorized|payment required|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout"
#: Beginnings of a masked text that no content has: a status line or a stack trace.
SHAPES = (
    r"^(?:http(?:/0)? ?)?(?:(?:error|status) ?)?0 ?[:\-]? ?(?:" + REASONS + r")\b(?= ?[.!\n]|$)|^(?:http )?error ?:? ?0 ?[:\-]? ?(?:" + REASONS + r")\b(?= ?[.!\n]|$)"
    r"|^traceback \(most recent call last\)|^(?:[a-z_]\w*+\.)+\w*?(?:exception|error)\b(?=\s*(?:at|:|\n|$))|^at (?:[a-z_]\w*+\.)++\w++\(\w++\.[a-z]++:0\)"
)
#: Words of a sentence that reports on such things instead of showing them.
ABOUT = r"\b(?:we\b(?! could not| can ?not| can't| are sorry)|(?:was|were)\b(?! not found| not available)|rated|measured|asked to|percent|participants|patients|readers|study|studies)\b"
#: White space of any kind.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Nothing but dummy words.
DUMMY = r"^\s*+(?:tbd|tba|todo|asdf|qwerty|xxx++|foo bar)(?:[\s.,;]++(?:tbd|tba|todo|asdf|qwerty|xx++|foo bar))*+[\s.]*+$"


def masked(text: Column | str) -> Column:
    """Lower case, heading and menu lines off, addresses, codes, dates and numbers as 0, white space folded."""
    c = F.lower(text)
    c = F.regexp_replace(c, r"(?U)^\s++|\s++$", "")
    c = F.regexp_replace(c, r"(?m)^[^\n|.!?]++(?:\|[^\n|.!?]++)++$", "")
    c = F.regexp_replace(c, r"^[^\n.!?:;,0-9(\"]{3,}+\n++(?=\S)", "")
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+|[\w.+\-]{1,64}@[\w\-]{1,64}\.[\w.]{1,64}", "0")
    c = F.regexp_replace(c, r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b|\d+(?:[.,:/\-]\d+)*+", "0")
    c = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$|(?<=\n) | (?=\n)", "")


def sentences(m: Column) -> Column:
    """The distinct sentences of a masked text that hold a letter, in order, without their end; words repeated on end once."""
    s = F.transform(F.split(m, r"(?<=[.!?])\s+|\n+"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s.!?:;]+$", ""), r"\b(\w++)(?: \1\b)++", "$1"))
    return F.array_distinct(F.filter(s, lambda x: F.rlike(x, F.lit(r"\p{L}"))))


def has_placeholder(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    some = reduce(lambda x, y: x | y, [c.contains(m) for m in ("{", "[", "<", "%", "@@", "__")])
    return F.when(some & F.rlike(c, F.lit(MARKS)), F.rlike(c, F.lit("|".join(f"(?:{p})" for p in PLACEHOLDERS)))).otherwise(False)


def _mock_latin(words: Column) -> Column:
    """Whether at least four fifths of at least four words, cut at what is no letter from a to z, are of the mock Latin."""
    n = F.size(words) - (F.element_at(words, 1) == "").cast("int") - (F.element_at(words, -1) == "").cast("int")
    return (n >= 4) & (F.size(F.filter(words, lambda w: w.isin(LATIN))) >= 0.8 * n)


def _last(low: Column) -> Column:
    """A piece of a text that holds its last sentence, or the whole text if that is a menu line or without a letter.

    Every sentence of a candidate carries a sign, so does the last; most texts leave by this short test."""
    trimmed = F.rtrim(low, F.lit(SPACES))
    tail = F.substring_index(F.substring_index(trimmed, "\n", -1), ". ", -1)
    return F.when(tail.contains("|") | ~F.rlike(tail, F.lit(r"\p{L}")), low).otherwise(tail)


def with_evidence(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """All columns of ``df`` and a struct ``_seen``: what the rules see in a text, and the hashes of a candidate; null for a blank text and one without any sign."""
    t = df.withColumn("_low", F.lower(text)).withColumn("_w", F.split("_low", r"[^a-z]+")).withColumn("_t", _last(F.col("_low")))
    t = t.withColumn("_m", F.when(F.rlike("_t", F.lit(SIGNS)), masked(text)))
    t = t.withColumn("_s", sentences(F.col("_m")))
    signed = (F.size("_s") > 0) & F.forall("_s", lambda x: F.rlike(x, F.lit(SIGNS)) & ~F.rlike(x, F.lit(ABOUT)))
    t = t.withColumn("_signed", F.coalesce(signed, F.lit(False)))
    phrase = F.col("_signed") & (F.rlike("_m", F.lit(PHRASES)) | F.rlike("_low", F.lit(PHRASES)))
    kind = F.when(F.rlike("_m", F.lit(NOTICE)), "notice").when(F.rlike("_m", F.lit(FILLER)), "filler").otherwise("message")
    shape = F.coalesce(F.col("_signed") & F.rlike("_m", F.lit(SHAPES)), F.lit(False)) | F.rlike("_low", F.lit(DUMMY))
    seen = F.struct(
        has_placeholder(text).alias("placeholder"), F.coalesce(_mock_latin(F.col("_w")), F.lit(False)).alias("latin"), shape.alias("shape"),
        F.when(phrase, F.xxhash64("_s")).alias("hash"), F.when(phrase, F.transform("_s", lambda x: F.xxhash64(x))).alias("units"),
        F.when(phrase, kind).when(shape, F.coalesce(F.when(F.col("_signed"), kind), F.lit("filler"))).alias("kind"), F.col(source).alias("source"),
    )
    t = t.withColumn("_seen", F.when(F.rlike(text, F.lit(r"(?U)\S")), seen))
    some = F.col("_seen.placeholder") | F.col("_seen.latin") | F.col("_seen.shape") | F.col("_seen.hash").isNotNull()
    return t.withColumn("_seen", F.when(some, F.col("_seen"))).drop("_low", "_w", "_t", "_m", "_s", "_signed")


def recurring_groups(seen: DataFrame) -> DataFrame:
    """(hash, rule, copies, sources) of the candidates' groups that recur, as a whole text or sentence by sentence."""
    s = seen.where("_seen.hash is not null").select("_seen.hash", "_seen.units", "_seen.source")
    per = written(s.groupBy("hash", "source").agg(F.count("*").alias("n"), F.first("units").alias("units")), "candidates")
    texts = per.groupBy("hash").agg(F.sum("n").alias("copies"), F.count("*").alias("sources"), F.first("units").alias("units"))
    wide = lambda n: (F.col(n) >= RECURS) & (F.col("sources") >= SOURCES)
    units = per.select(F.explode("units").alias("unit"), "source", "n").groupBy("unit", "source").agg(F.sum("n").alias("n"))
    known = units.groupBy("unit").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).where(wide("n")).select("unit")
    parts = texts.select("hash", F.explode("units").alias("unit")).join(known, "unit").groupBy("hash").agg(F.count("*").alias("known"))
    rule = F.when(wide("copies"), "recurring text").when(F.col("known") == F.size("units"), "recurring sentences")
    return texts.join(parts, "hash", "left").select("hash", rule.alias("rule"), "copies", "sources").where("rule is not null")


def _judged(seen: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of ``seen`` with the rule that takes them; ``candidates`` are the written evidence of the same rows."""
    groups = recurring_groups(candidates).select(F.col("hash").alias("_hash"), F.col("rule").alias("_group"), F.col("copies").alias("_copies"), F.col("sources").alias("_sources"))
    joined = seen.join(groups, F.col("_seen.hash") == F.col("_hash"), "left")
    x = F.col("_seen")
    return joined.withColumn("_rule", F.when(x["placeholder"], "placeholder").when(x["latin"], "mock latin").when(F.col("_group").isNotNull(), F.col("_group")).when(x["shape"], "shape"))


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The texts are read once; what the rules saw in the few that show anything is written out and judged.

    (key, kind, rule, copies, sources) of the documents to exclude. ``rule`` says
    what took a row: placeholder, mock latin, shape, recurring text or recurring
    sentences; copies and sources count the texts of the same masked form, where
    the group recurs."""
    # The condition stands behind the written table: pushed into the map, it would compute what the rules saw twice.
    seen = written(with_evidence(df.select(key, text, source), text, source).select(key, "_seen"), "seen").where("_seen is not null")
    kind = F.when(F.col("_rule") == "placeholder", "placeholder").when(F.col("_rule") == "mock latin", "filler").otherwise(F.col("_seen.kind"))
    return _judged(seen, seen).where("_rule is not null").select(key, kind.alias("kind"), F.col("_rule").alias("rule"), F.col("_copies").alias("copies"), F.col("_sources").alias("sources"))


def without_residue(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df`` that are not residue, with all their columns, whatever their names."""
    seen = written(with_evidence(df.select(F.col(text).alias("text"), F.col(source).alias("source"))).select("_seen"), "seen").where("_seen is not null")
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"), F.col(source).alias("source"))
    return _judged(with_evidence(held), seen).where("_rule is null").select("row.*")
