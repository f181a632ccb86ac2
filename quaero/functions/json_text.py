"""Tolerant JSON: the first object of a text, and exact-key checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.functions.text import C, col, strip

#: Keys an expansion payload must have, no more and no fewer.
VIEWS = ("keywords", "sparse", "embedding", "colbert", "expanded")


_DECODER = json.JSONDecoder()


def first_object(text: str | None) -> str | None:
    """The first JSON object that stands in a text; None if there is none, or if the text ends inside it.

    The decoder itself says where an object that begins at a brace ends. Where
    it fails before the end of the text, the next brace is tried.
    """
    found = re.finditer(r"\{(?=\s*[\"}])", text or "")
    for brace in found:
        try:
            return text[brace.start() : _DECODER.raw_decode(text, brace.start())[1]]
        except RecursionError:
            return None
        except json.JSONDecodeError as e:
            if e.pos >= len(text.rstrip()) or e.msg.startswith("Unterminated"):
                return None
    return None


def balanced_object(c: C) -> Column:
    """``first_object`` of a column, over Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    return run(col(c))


def parsed_payload(c: C) -> Column:
    """VARIANT of a model's JSON answer: code fence off, else the first balanced object; null if there is none."""
    bare = F.regexp_replace(strip(c), r"(?s)^```(?:json)?\s*|\s*```$", "")
    whole = F.try_parse_json(bare)
    whole = F.when(bare.startswith("{"), whole)
    return F.coalesce(whole, F.try_parse_json(balanced_object(F.when(whole.isNull(), col(c)))))


def valid_payload(json_text: Column, keys: tuple[str, ...] = VIEWS) -> Column:
    """Whether the object has exactly the keys, each with a string that is not blank."""
    found = F.json_object_keys(json_text)
    same = F.array_sort(found) == F.array(*[F.lit(k) for k in sorted(keys)])
    m = F.from_json(json_text, "map<string,string>")
    return F.coalesce(same & F.forall(F.map_values(m), lambda v: v.isNotNull() & (strip(v) != "")), F.lit(False))
