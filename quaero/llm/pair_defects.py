"""Defects of prompt and answer pairs, by ordered rules that all report.

Rules, in order: ``empty`` (no words, or nothing but a label or role marker),
``refusal`` (declines, in several languages, and gives little besides), ``copy``
(the prompt, the prompt with more after it, or a beginning of it, up to case,
spacing, punctuation, a leading label or role marker, and closing links and
hashtags), ``wrong_language`` (a full sentence in another language or script),
``truncated`` (unclosed, abrupt, or without the end of the prompt's content).
Every rule that fires is emitted; the first is the pair's defect.

The end of the content is found by anchors: names and numbers that stand in
both texts, paired in order. What follows the prompt's last paired anchor must
have a counterpart after the same anchor in the answer. An anchor that is
missing (a number written out, a name left out) proves nothing by itself.

A prompt wholly in the target language may be repeated. The languages of
sentences come from the compression classifier of ``language``.

Defined results: a null, empty or blank answer is ``empty``, whatever the
prompt; a null or blank prompt has no content, so its answer cannot be a copy
or truncated; repeated pairs give equal rows; very long texts are read whole;
extra columns are ignored; an empty table gives no rows. No shuffle but for
the distinct at the end.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm import language as lang

TYPES = ("empty", "refusal", "copy", "wrong_language", "truncated")
#: Words from which a sentence is a full one.
SENTENCE = 4
#: Confidence from which a sentence shorter than SURE words is taken as foreign.
SURE, CONFIDENT = 6, 0.95
#: Least share of the letters of a prompt that an answer has.
SHORT = 0.6
#: The same share where the texts share no anchor and the answer has fewer sentences than the prompt.
FEWER = 0.75
#: Letters after the last anchor of a prompt that count, and the share of them below which the answer has lost its end.
TAIL, LOST = 30, 0.5
#: Letters and digits from which a copied beginning counts.
COPIED = 25
#: Share of the prompt's letters below which the sentences beside a refusal are no answer.
BESIDE = 0.5

# Labels and role markers that models leave before an answer.
_LABEL = re.compile(
    r"^[\s\"'“”«»*#_>\-–—]*(?:(?:<\|?\s*)?(?:assistant|model|system|user|bot|ai)(?:\s*\|?>)?\s*(?::|\n|$)|"
    r"(?:(?:here is|this is|voici|hier ist|aquí está|ecco) )?(?:the |la |die |il )?(?:english(?: (?:translation|version|text))?|translation(?: (?:in|into|to) english)?|translated text|note|answer|output|response|result|traduction|übersetzung|traducción|traduzione|anglais|englisch|inglés|inglese)\s*(?:\([a-z]+\))?\s*[*_]*\s*(?::|\n|$))[\s*_]*",
    re.I,
)
_TAIL = re.compile(r"(?:https?://\S+|www\.\S+|#\w+)", re.I)
_QUOTES = "\"'“”„«»‘’`*_ \t\r\n​"
#: Who declines: the first person or the assistant shortly before, or nobody at the beginning of a sentence.
_WHO = r"(?:^\W*(?:(?:sorry|note|unfortunately|regrettably|apologies)\W+)*|\b(?:i|i'm|i'd|i'll|we|we're|we'd|we'll|assistant|model|system)\b[^.!?]{0,40}?)"
# Phrases that decline, on lower-case text with plain apostrophes.
_REFUSALS = re.compile(
    "|".join(
        [
            _WHO + r"(?:can(?:no|')t|cannot|can not|could not|am unable to|'m unable to|not able to|unable to|am not going to|will not|won't|won't be able to|must decline to|have to decline to|decline to|refuse to|rather not|not allowed to|not permitted to|prefer not to|not comfortable) (?:be able to )?(?:translat|render|provid|process|assist|comply|fulfil|fulfill|complet|help (?:with|you with)|produc|answer|do that|do this|respond|offer)",
            r"(?:i'm|i am|we are|the assistant is) (?:sorry|afraid|not permitted|not allowed|unable|not able)(?:,| to| but)? (?:but )?(?:i |we )?(?:can(?:no|')t|cannot|am unable|won't|translat|process|assist|provide|help)",
            r"i (?:must|have to|need to) (?:refuse|decline|pass)", r"no translation (?:can|could|will|may) be", r"request (?:declined|denied|refused|rejected)", r"i cannot comply", r"have to pass on this", r"isn't something i'm allowed to", r"against (?:my|our) (?:policy|policies|guidelines)", r"as an? (?:ai|large )?(?:language )?model,? i",
            r"(?:je|nous) (?:ne )?(?:peux|pouvons|suis|sommes)(?: malheureusement)? pas (?:en mesure de |autorisée? à |capable de )?(?:vous )?(?:traduire|aider (?:avec|pour)|répondre|donner suite|fournir|traiter)", r"je (?:dois|préfère) (?:refuser|décliner|ne pas traduire)", r"je refuse de", r"demande refusée",
            r"(?:kann|darf|möchte|werde) (?:ich )?(?:bei )?(?:dieser |diese |diesen |dieses |ihnen |dabei |hierbei |den |das )?(?:anfrage |text |nachricht |inhalt )?(?:leider )?(?:nicht|keine) (?:helfen|übersetzen|behilflich|bearbeiten|übersetzung|weiterhelfen)", r"ich (?:kann|darf) .{0,40}(?:nicht|keine) (?:helfen|übersetz\w*|bearbeiten|anbieten)", r"ich muss (?:das |dies |diese anfrage )?ablehnen", r"anfrage abgelehnt",
            r"no (?:puedo|podemos|me es posible|estoy autorizado a)(?: lamentablemente)? (?:ayudar|traducir|ofrecer|proporcionar|procesar|atender|responder)", r"(?:debo|tengo que) (?:rechazar|negarme|declinar)", r"solicitud rechazada",
            r"non (?:posso|possiamo|sono in grado di|mi è possibile)(?: purtroppo)? (?:aiutar\w*|tradurre|fornire|elaborare|rispondere|assistere)", r"(?:devo|preferisco) (?:rifiutar\w*|non tradurre|declinare)", r"richiesta (?:rifiutata|respinta)",
        ]
    )
)
#: Words about the task itself; with nothing of the prompt's content they decline too.
_TASK = re.compile(r"translat|render|consult|\bclaims?\b|statement|\bmessage\b|request|\bcontent\b|english version|traduc|tradu[ir]|übersetz|anfrage|solicitud|richiesta|demande\b")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_NAME = re.compile(r"(?<![\w#@])[A-ZÀ-Ý][\w]{3,}")
_ENDS = re.compile(r"[.!?。！？»”\")\]…]$")


def without_label(text: str) -> str:
    t = text.strip()
    for _ in range(3):
        s = _LABEL.sub("", t, count=1)
        if s == t:
            break
        t = s.strip()
    return t


def body(text: str) -> str:
    """Without closing links and hashtags, outer quotes and spaces."""
    t = text.strip(_QUOTES)
    end = len(t)
    for m in reversed(list(re.finditer(r"\S+", t))):
        if not _TAIL.fullmatch(m.group().rstrip(".,;")):
            break
        end = m.start()
    return t[:end].strip(_QUOTES)


def key(text: str) -> str:
    return "".join(c for c in body(text).casefold() if c.isalnum())


def anchors(text: str) -> list[tuple[str, int]]:
    """(form, end) of the numbers and names of a text, in order; decimal commas as points."""
    found = [(re.sub(r"[.,]", ".", m.group()), m.end()) for m in _NUMBER.finditer(text)]
    found += [(m.group().casefold(), m.end()) for m in _NAME.finditer(text)]
    return sorted(found, key=lambda x: x[1])


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def tails(prompt: str, answer: str) -> tuple[int, int]:
    """Letters after the prompt's last anchor that the answer has too, and after its counterpart; of the whole texts if they share none."""
    there: dict[str, deque[int]] = {}
    for form, end in anchors(answer):
        there.setdefault(form, deque()).append(end)
    last = (0, 0)
    for form, end in anchors(prompt):
        if there.get(form):
            last = (end, there[form].popleft())
    return letters(prompt[last[0] :]), letters(answer[last[1] :])


def sentences(text: str) -> list[str]:
    return [c for c in lang.chunks(text) if lang.words(c) >= SENTENCE]


def foreign(text: str, c: lang.Classifier, target: str = "en") -> bool:
    """Whether a full sentence is in another language or script."""
    for s in sentences(text):
        other = sum(1 for ch in s if ch.isalpha() and ord(ch) > 0x24F)
        if other > 0.5 * sum(map(str.isalpha, s)):
            return True
        got, sure = c.language(s)
        if got is not None and got != target and (lang.words(s) >= SURE or sure >= CONFIDENT):
            return True
    return bool(re.search(r"[一-鿿぀-ヿ가-힯]{8,}", text))


def truncated(prompt: str, answer: str) -> bool:
    p, a = body(prompt), body(answer)
    if not any(map(str.isalpha, p)):
        return False
    if re.search(r"(?:…|\.\.\.)$", a) and not re.search(r"(?:…|\.\.\.)$", p):
        return True
    if _ENDS.search(p) and not _ENDS.search(a):
        return True
    for o, e in (("(", ")"), ("“", "”"), ("«", "»"), ("[", "]")):
        if a.count(o) > a.count(e) and p.count(o) <= p.count(e):
            return True
    rest, left = tails(p, a)
    whole = letters(p)
    share = FEWER if rest == whole and len(sentences(a)) < len(sentences(p)) else SHORT
    return rest >= TAIL and left < LOST * rest or letters(a) < share * whole


def refuses(prompt: str, answer: str) -> bool:
    """Whether an answer declines: a sentence says so that the prompt does not say, and little stands beside it; or it speaks of the task, is short and holds nothing of the prompt."""
    plain = lambda t: t.replace("’", "'").lower()
    parts = [plain(c).strip() for c in lang.chunks(answer)]
    said = [c for c in parts if _REFUSALS.search(c)]
    if said and not any(_REFUSALS.search(plain(c).strip()) for c in lang.chunks(prompt)):
        beside = sum(letters(c) for c in parts if not _REFUSALS.search(c) and not _TASK.search(c))
        return beside < BESIDE * max(1, letters(prompt))
    own = {f for f, _ in anchors(prompt)}
    return bool(own) and not own & {f for f, _ in anchors(answer)} and letters(answer) < SHORT * letters(prompt) and bool(_TASK.search(plain(answer)))


def copies(prompt: str, answer: str) -> bool:
    """Whether one text begins with the other, which must be long enough to be no chance."""
    p, a = key(prompt), key(answer)
    return bool(p) and (p == a or min(len(p), len(a)) >= COPIED and (a.startswith(p) or p.startswith(a)))


def defects(prompt: str | None, answer: str | None, c: lang.Classifier, target: str = "en") -> list[str]:
    """Every defect type that fires, in order."""
    if answer is None:
        return ["empty"]
    a = without_label(answer)
    if not any(map(str.isalnum, lang._LINK.sub(" ", a))):
        return ["empty"]
    out = []
    p = prompt or ""
    if refuses(lang._LINK.sub(" ", p), lang._LINK.sub(" ", a)):
        out.append("refusal")
    if copies(p, a):
        if foreign(min(p, a, key=lambda t: len(key(t))), c, target):
            out.append("copy")
        elif key(p) == key(a):
            return out
    if foreign(a, c, target):
        out.append("wrong_language")
    if truncated(p, a):
        out.append("truncated")
    return out


def pair_defects(df: DataFrame, dictionaries: dict[str, bytes], id_: str = "qid", prompt: str = "text_original", answer: str = "text", target: str = "en") -> DataFrame:
    """(id, place, defect) of every rule that fires; place 1 is the pair's first."""
    kind = df.schema[id_].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        c = lang.Classifier(held.value)
        for b in batches:
            rows = [(k, i, d) for k, p, a in zip(b[id_], b[prompt], b[answer]) for i, d in enumerate(defects(p, a, c, target), 1)]
            yield pd.DataFrame(rows, columns=[id_, "place", "defect"])

    return df.select(id_, prompt, answer).mapInPandas(run, f"`{id_}` {kind}, place int, defect string").distinct()
