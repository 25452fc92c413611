"""Text as columns: normal form, terms, tokens, lines, answers, digests.

Expressions are built in and stay in generated code. Where Spark has none (NFKC with full case folding, cutting at a
token of the normal form) an Arrow function stands beside them, and ``exact`` chooses it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters and digits of any script, joined by single apostrophes or hyphens. Java's ``\w`` differs; these classes don't.
TERM = r"[\p{L}\p{N}]+(?:[\x27-][\p{L}\p{N}]+)*"
#: A term, or one character that is neither of a term nor an underscore nor white space.
SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F"
TOKEN = TERM + r"|[^\p{L}\p{N}_" + SPACES + "]"
#: Line ends: those of str.splitlines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

_PY_TOKEN = re.compile(r"[^\W_]+(?:['-][^\W_]+)*|[^\w\s]")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def normal_form(text: Column, exact: bool = False) -> Column:
    """NFKC and full case folding. The built-in form lower-cases and writes sharp s as two; it is equal on text
    without compatibility characters or other letters that fold to several."""
    return _folded(text) if exact else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def terms(text: Column, exact: bool = False) -> Column:
    """Search terms in order, repeats and stop words included."""
    return F.regexp_extract_all(normal_form(text, exact), F.lit(TERM), F.lit(0))


def tokens(text: Column, exact: bool = False) -> Column:
    return F.regexp_extract_all(normal_form(text, exact), F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column, exact: bool = False) -> Column:
    return F.regexp_count(normal_form(text, exact), F.lit(TOKEN))


def lines(text: Column) -> Column:
    """Lines without their ends; a line end at the text's end opens no line, and an empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normal_answer(text: Column, exact: bool = False) -> Column:
    """The normal form, white space run together, without full stops, question and exclamation marks at the end."""
    one_spaced = F.regexp_replace(normal_form(text, exact), f"[{SPACES}]+", " ")
    return F.regexp_replace(F.btrim(one_spaced), r"[.?!]+$", "")


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or n is None else cut_to_tokens(t, int(n)) for t, n in zip(texts, most, strict=True)], dtype=object)


def cut_to_tokens(text: str, most: int) -> str:
    """The longest prefix that ends with a token and counts at most ``most`` of them in normal form."""
    if most <= 0:
        return ""
    count = lambda s: len(_PY_TOKEN.findall(fold(s)))
    if count(text) <= most:
        return text
    ends = [m.end() for m in _PY_TOKEN.finditer(text)][:most]
    # the normal form may have more tokens than the text: step back until it fits
    while ends and count(text[: ends[-1]]) > most:
        ends.pop()
    return text[: ends[-1]] if ends else ""


def truncate_to_tokens(text: Column, most: Column) -> Column:
    return _cut(text, most)


def canonical_message(role: Column, content: Column, tool_calls: Column | None = None, tool_call_id: Column | None = None) -> Column:
    """One chat message as compact JSON with sorted keys and nulls."""
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(json_string(c))
    calls = F.lit("null") if tool_calls is None else F.coalesce(tool_calls, F.lit("null"))
    call_id = F.lit("null") if tool_call_id is None else quoted(tool_call_id)
    return F.concat(F.lit('{"content":'), quoted(content), F.lit(',"role":'), quoted(role), F.lit(',"tool_call_id":'), call_id, F.lit(',"tool_calls":'), calls, F.lit("}"))


def json_string(text: Column) -> Column:
    """A JSON string of ``text``: what is not ASCII stays as it is."""
    named = F.to_json(F.struct(text.alias("s")))
    return F.substring(named, 6, 1 << 30).substr(F.lit(1), F.length(named) - 6)


def count_messages(messages: Column, exact: bool = False) -> Column:
    """Tokens of a request: 2, and 4 more than those of each canonical message in the array."""
    return F.aggregate(messages, F.lit(2).cast("long"), lambda n, m: n + 4 + count_tokens(m, exact))


def child_seed(seed: Column, stage: Column, ordinal: Column) -> Column:
    """The first eight bytes of the SHA-256 of ``seed:stage:ordinal`` as an unsigned number."""
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), stage, ordinal.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def canonical_json(value: Column) -> Column:
    """Compact JSON of a struct whose fields are given in the order of their names; nulls are written."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
