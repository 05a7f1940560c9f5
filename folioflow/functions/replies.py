"""Replies of models as rows: thoughts and fences go, and what is no JSON is repaired where that can be told."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: What matters in a string: escapes, quotes, and control characters that JSON does not allow.
_MARK = re.compile(r'\\.|["\n\t]', re.S)
#: A quote ends its string if the text ends after it, or a bracket, a colon, or a comma and the next key or value of brackets follows.
_CLOSES = re.compile(r'[ \t\r\n]*(?:\Z|[}\]:]|,\s*(?:"(?:[^"\\]|\\.)*"\s*:|[{\[]))')
_ESCAPED = {"\n": "\\n", "\t": "\\t"}


def repaired(raw: str) -> str:
    """raw with quotes and control characters inside of strings escaped."""
    out, at, inside = [], 0, False
    for mark in _MARK.finditer(raw):
        token = mark[0]
        out.append(raw[at : mark.start()])
        at = mark.end()
        if not inside:
            inside = token[-1] == '"'
        elif token == '"':
            inside = not _CLOSES.match(raw, at)
            token = token if not inside else '\\"'
        out.append(_ESCAPED.get(token, token) if inside else token)
    return "".join([*out, raw[at:]])


def repair_json(c: Column) -> Column:
    """The scan keeps a state from quote to quote, so that it is a pandas UDF."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else repaired(x))

    return run(c)


def without_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.strip(c), r"^```\w*\s*", ""), r"\s*```$", "")


def parsed(c: Column, schema: str = "array<struct<id: int, text: string, src: string>>") -> Column:
    """The rows of a reply: as it stands, else its widest list, else that repaired; null if none of them can be read."""
    read = lambda x: F.from_json(T.without_commas_at_ends(without_fence(x)), schema)
    own = T.strip(T.without_thoughts(c))
    widest = F.coalesce(F.nullif(T.widest_list(own), F.lit("")), own)
    rows = F.coalesce(read(own), read(widest), read(repair_json(widest)))
    return F.transform(rows, lambda r: F.struct(r["id"].alias("id"), T.clean_spaces(r["text"]).alias("text"), T.clean_spaces(r["src"]).alias("src")))
