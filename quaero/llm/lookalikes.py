"""One consistent form of texts that look alike, computed by DuckDB inside Arrow partitions.

The embedded SQL of ``form_sql`` applies, in this order: compatibility forms
(full-width and half-width forms, ligatures, styled, squared and circled
letters, Roman numerals, presentation forms, radicals), invisible characters,
spaces that look like a space, look-alike letters of other scripts, and NFC. A
text that differs from its form holds a character in the place of a usual one.

What stays: emoji sequences (joiners and selectors inside them), joiners
inside scripts that use them, words of another script in that script, Greek
letters used as symbols, superscripts, typographic quotes, dashes, ellipses.

The compatibility forms come from the Unicode character database by a rule
(``_compatibility``); the look-alike letters are the listed ones and, inside
words with a Latin letter, all that the public confusables data give one Latin
letter for (``confusables``, from the ICU library in Spark).

Look-alike letters are read by word (hyphens and slashes part words): in a word
with a Latin letter each look-alike is replaced. Words without Latin letters are
taken in runs (cut at closing marks); a run with a letter that has no listed
look-alike is genuine text and stays, any other run is replaced.

The private characters that the SQL uses as marks are escaped first where a
text holds them, and come out as they went in.

Defined results: null gives null and is never changed; the empty text stays;
repeated rows give the same form; very long texts are processed whole; extra
columns are ignored. No shuffle: a map over Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһӏԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhldqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")
ARMENIAN = ("օՕ", "oO")
VARIANT = ("ɡſ", "gs")
#: Letters of these scripts make a word foreign.
FOREIGN = r"\p{Greek}\p{Cyrillic}\p{Armenian}"
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2460}-\x{27BF}\x{2900}-\x{297F}\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}"
#: Scripts that are written with joiners.
JOINED = r"\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Mongolian}\p{Myanmar}"
WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\x{3001}\x{3002}"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{1D173}-\x{1D17A}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}]"

#: Rows that DuckDB holds at a time.
SLICE = 2048


#: Tags of the compatibility forms that look like other characters; superscripts, subscripts and fractions do not.
TAGS = ("<wide>", "<narrow>", "<font>", "<compat>", "<square>", "<circle>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
#: Blocks without such forms: spacing accents, general punctuation, Greek symbol letters, pictographs, phrases in one Arabic letter.
APART = ((0x00A0, 0x00BF), (0x02B0, 0x02FF), (0x037A, 0x03FF), (0x1FBD, 0x1FFE), (0x2000, 0x206F), (0x20A8, 0x20A8), (0x24C2, 0x24C2), (0x3000, 0x3000), (0x3297, 0x3299), (0xFDF0, 0xFDFD), (0x1F000, 0x1FAFF))
#: Full-width punctuation that is usual after a character of a wide script.
WIDE_MARKS = "！（），：；？"


@lru_cache
def _compatibility() -> dict[str, str]:
    """Characters of compatibility forms with their usual characters."""
    out = {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]):
        k = unicodedata.normalize("NFKC", c)
        letterlike = 0x2100 <= ord(c) <= 0x214F
        if k == c or not unicodedata.decomposition(c).startswith(TAGS) or any(lo <= ord(c) <= hi for lo, hi in APART):
            continue
        # Of the letter-like symbols only styled single letters are read as letters; a form that begins with a space is a spacing accent.
        if k[0] == " " or letterlike and not (len(k) == 1 and k.isascii()) or not letterlike and "\u2044" in k:
            continue
        out[c] = k
    return out


#: Scripts whose look-alikes count in words with a Latin letter; Greek letters there are symbols, but for the listed ones.
SCRIPTS = ((0x0400, 0x052F), (0x0531, 0x058F), (0x10D0, 0x10FF), (0x13A0, 0x13FF), (0x2C80, 0x2CFF), (0x2D30, 0x2D7F), (0xA4D0, 0xA4FF), (0xA640, 0xA69F), (0xAB70, 0xABBF))
_SEEN: dict[str, str] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of SCRIPTS that the confusables data take for one Latin letter. The data have one form for l, I and 1: a letter that is not lower case is I."""
    if not _SEEN:
        chars = [c for c in (chr(x) for lo, hi in SCRIPTS for x in range(lo, hi + 1)) if unicodedata.category(c).startswith("L")]
        # One call for all letters: a skeleton is made letter by letter, and a line end has none of its own.
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars))
        for c, k in zip(chars, skeleton.split("\n"), strict=True):
            if len(k) == 1 and k.isascii() and k.isalpha():
                _SEEN[c] = "I" if k == "l" and not c.islower() else k
    return _SEEN


def _class(chars: str) -> str:
    """A character class of RE2, in ranges."""
    codes, out = sorted(map(ord, set(chars))), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


#: First private character that serves as a mark, the number of marks, and where escaped ones stand.
MARK, MARKS, ESCAPED = 0xF0000, 0x30, 0xF0100


def form_sql(more: dict[str, str]) -> str:
    """The SQL over a table ``batch`` (k, x); ``more``: look-alikes inside words with a Latin letter."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    mark = lambda i: chr(MARK + i)
    forms_ = _compatibility()
    single = {c: k for c, k in forms_.items() if len(k) == 1}
    long_ = {c: k for c, k in forms_.items() if len(k) > 1}
    src = CYRILLIC[0] + GREEK[0] + ARMENIAN[0] + VARIANT[0]
    dst = CYRILLIC[1] + GREEK[1] + ARMENIAN[1] + VARIANT[1]
    more = {c: k for c, k in more.items() if c not in src}
    letters = src
    # Marks that a text holds itself become the first mark and a character far from all marks.
    held = f"[{mark(0)}-{mark(MARKS - 1)}]"
    e = f"regexp_replace(x, '({held})', '{mark(0)}\\1', 'g')"
    pairs = f"regexp_extract_all({e}, '{mark(0)}{held}|[^{mark(0)}]+')"
    s0 = f"CASE WHEN regexp_matches(x, '{held}') THEN array_to_string(list_transform({pairs}, lambda p: CASE WHEN p[1] = '{mark(0)}' THEN '{mark(0)}' || chr(unicode(p[2]) + {ESCAPED - MARK}) ELSE p END), '') ELSE x END"
    back = f"regexp_extract_all(x, '{mark(0)}.|[^{mark(0)}]+')"
    s6 = f"CASE WHEN contains(x, '{mark(0)}') THEN array_to_string(list_transform({back}, lambda p: CASE WHEN p[1] = '{mark(0)}' THEN chr(unicode(p[2]) - {ESCAPED - MARK}) ELSE p END), '') ELSE x END"
    # Full-width punctuation after a character of a wide script is usual there: moved aside to marks.
    aside = "".join(mark(1 + i) for i in range(len(WIDE_MARKS)))
    t = "x"
    for p, a in zip(WIDE_MARKS, aside):
        t = f"regexp_replace({t}, '([{WIDE}]){p}', '\\1{a}', 'g')"
    t = f"translate({t}, {q(''.join(single))}, {q(''.join(single.values()))})"
    # Forms of several characters: the text is cut at them, each piece that is one is looked up.
    names = "[" + ", ".join(map(q, long_)) + "]"
    values = "[" + ", ".join(map(q, long_.values())) + "]"
    t = f"regexp_replace({t}, '([^{WIDE}])\\x{{3000}}', '\\1 ', 'g')"
    t = f"translate({t}, {q(aside)}, {q(WIDE_MARKS)})"
    s1 = f"CASE WHEN regexp_matches(x, '{_class(''.join(single) + chr(0x3000))}') THEN {t} ELSE x END"
    cut = f"regexp_extract_all(x, '{_class(''.join(long_))}|{_class(''.join(long_)).replace('[', '[^', 1)}+')"
    s2 = f"CASE WHEN regexp_matches(x, '{_class(''.join(long_))}') THEN array_to_string(list_transform({cut}, lambda p: coalesce({values}[list_position({names}, p)], p)), '') ELSE x END"
    # Joiners and selectors of emoji and joining scripts are moved aside, the other invisible characters dropped.
    zwj, zwnj, vs, vt = (mark(0x10 + i) for i in range(4))
    mods = r"\x{1F3FB}-\x{1F3FF}" + vs + vt
    u = "x"
    u = f"regexp_replace({u}, '([{EMOJI}0-9#*]|[\\x{{1F3FB}}-\\x{{1F3FF}}])\\x{{FE0F}}', '\\1{vs}', 'g')"
    u = f"regexp_replace({u}, '([{EMOJI}])\\x{{FE0E}}', '\\1{vt}', 'g')"
    for _ in range(2):
        u = f"regexp_replace({u}, '([{EMOJI}{mods}])\\x{{200D}}([{EMOJI}])', '\\1{zwj}\\2', 'g')"
        u = f"regexp_replace({u}, '([{JOINED}]\\pM*)\\x{{200D}}', '\\1{zwj}', 'g')"
        u = f"regexp_replace({u}, '([{JOINED}]\\pM*)\\x{{200C}}', '\\1{zwnj}', 'g')"
    u = f"regexp_replace({u}, '{INVISIBLE}', '', 'g')"
    u = f"translate({u}, {q(zwj + zwnj + vs + vt)}, {q(chr(0x200D) + chr(0x200C) + chr(0xFE0F) + chr(0xFE0E))})"
    s3 = f"CASE WHEN regexp_matches(x, '{INVISIBLE}') THEN {u} ELSE x END"
    s4 = f"regexp_replace(x, '{SPACES}', ' ', 'g')"
    # Words with a Latin letter are marked, which cuts the text into marked words and spans without Latin letters.
    on, off = mark(0x20), mark(0x21)
    marked = f"regexp_replace(x, '([^\\s/‐‑–—-]*\\p{{Latin}}[^\\s/‐‑–—-]*)', '{on}\\1{off}', 'g')"
    spans = f"regexp_extract_all({marked}, '{on}[^{off}]*{off}|[^{on}.!?»”\")]+|[.!?»”\")]+')"
    words = f"translate(translate(s, {q(src)}, {q(dst)}), {q(''.join(more))}, {q(''.join(more.values()))})"
    one = f"CASE WHEN s[1] = '{on}' THEN {words} WHEN regexp_matches(regexp_replace(s, '[{letters}]', '', 'g'), '[{FOREIGN}]') THEN s ELSE translate(s, {q(src)}, {q(dst)}) END"
    v = f"translate(array_to_string(list_transform({spans}, lambda s: {one}), ''), '{on}{off}', '')"
    s5 = f"CASE WHEN regexp_matches(x, '{_class(letters + ''.join(more))}') THEN {v} ELSE x END"
    sql = "SELECT k, x AS original, x FROM batch"
    for s in (s0, s1, s2, s3, s4, s5, s6, "nfc_normalize(x)"):
        sql = f"SELECT k, original, {s} AS x FROM ({sql})"
    return sql


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, changed) of every row."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_type

    kind, df_type = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)
    sql = f"SELECT k, x AS form, coalesce(x <> original, false) AS changed FROM ({form_sql(confusables(df.sparkSession))})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        schema = pa.schema([(key, df_type), ("form", pa.string()), ("changed", pa.bool_())])
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                con.register("batch", pa.Table.from_arrays([part.column(0), part.column(1).cast(pa.string())], names=["k", "x"]))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from out.rename_columns([key, "form", "changed"]).cast(schema).combine_chunks().to_batches()

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, form string, changed boolean")


def changed_records(df: DataFrame, key: str, text: str, src: str) -> DataFrame:
    """(src, rec_key) of the records whose text had to change; no row twice."""
    return one_form(df, key, text).where("changed").select(F.lit(src).alias("src"), F.col(key).alias("rec_key")).distinct()


def forms(df: DataFrame, key: str, text: str, src: str) -> DataFrame:
    """(src, rec_key, form, changed) of every record; no row twice."""
    return one_form(df, key, text).select(F.lit(src).alias("src"), F.col(key).alias("rec_key"), "form", "changed").distinct()
