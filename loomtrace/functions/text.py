"""Text functions: terms, sentences, citation marks, budgets, chunks and HTML."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns whose matches define results.
MARK_OUTER = "(?=[^]*[A-Za-z]+\\d+[A-Za-z]+\\d+(?:|))[^]*"
MARK_INNER = "[A-Za-z]+(\\d+)[A-Za-z]+(\\d+)(?=|)"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[`'*_\"(\[]*[A-Z0-9])"
TOKEN = r"\p{L}+|\d+"


def term_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters or digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def last_chars(c: Column, n: int) -> Column:
    return F.trim(F.right(F.trim(c), F.lit(n)))


def token_estimate(c: Column, per: int = 3) -> Column:
    return F.ceil(F.length(c) / per)


def sentences(c: Column) -> Column:
    """Sentences of at least eight characters with a letter."""
    cut = F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_GAP), lambda s: F.regexp_replace(s, r"^[ \-*\t\n]+|[ \-*\t\n]+\z", ""))
    return F.filter(cut, lambda s: (F.length(s) >= 8) & s.rlike(r"\p{L}"))


def citation_refs(c: Column) -> Column:
    """(turn_index, ref_index) pairs of the first citation mark."""
    outer = F.regexp_extract(c, f"({MARK_OUTER})", 1)
    return F.zip_with(
        F.regexp_extract_all(outer, F.lit(MARK_INNER), F.lit(1)),
        F.regexp_extract_all(outer, F.lit(MARK_INNER), F.lit(2)),
        lambda t, r: F.struct(t.try_cast("int").alias("turn_index"), r.try_cast("int").alias("ref_index")),
    )


def percent(part: Column, whole: Column) -> Column:
    """``12.5%`` with one digit, NA where the whole is nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "NA").otherwise(F.format_string("%.1f%%", part * 100.0 / whole))


def bracketed(n: Column) -> Column:
    """A number rounded half to even to two digits, in brackets."""
    return F.concat(F.lit("("), F.format_string("%.2f", F.bround(n, 2)), F.lit(")"))


def refs_key(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda r: F.concat_ws("::", r["turn_index"].cast("string"), r["ref_index"].cast("string"))), ";")


def claims(c: Column) -> Column:
    """Distinct claims of at least eight characters with a letter, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (F.length(x) >= 8) & x.rlike(r"\p{L}")))


def file_part(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9\-_.]", "_")


def recent_within(history: Column, budget: int | Column) -> Column:
    """Newest entries whose characters fit a budget of tokens (four characters each), in their order; the newest always stays."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    state = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        cost = F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("int")
        over = a["full"] | ((a["used"] + cost > limit) & (F.size(a["kept"]) > 0))
        text = F.when((F.size(a["kept"]) == 0) & (cost > limit), F.right(x, (limit * 4).cast("int"))).otherwise(x)
        return F.struct(F.when(over, a["used"]).otherwise(a["used"] + cost).alias("used"), over.alias("full"), F.when(over, a["kept"]).otherwise(F.array_prepend(a["kept"], text)).alias("kept"))

    return F.aggregate(F.reverse(F.filter(history, lambda x: x.isNotNull())), state, step, lambda a: a["kept"])


def py_sentences(text: str) -> list[str]:
    out = []
    for s in re.split(SENTENCE_GAP, text or ""):
        s = s.strip(" -*\t\n")
        if len(s) >= 8 and any(c.isalpha() for c in s):
            out.append(s)
    return out


def chunks(text: str | None, claims_of=None, latest_only: bool = False) -> list[tuple[str, list[tuple[int, int]], str]]:
    """(text, refs, marks) of the pieces of an answer that citation marks close.

    Without ``claims_of`` the sentences before a mark form one piece; with it each claim is its own piece, or with
    ``latest_only`` the last one before each mark, where a run of equal refs keeps its newest claim.
    """
    out: list[tuple[str, list, str]] = []
    at = 0
    text = text or ""

    def split(part: str) -> list[str]:
        return claims_of(part) if claims_of else py_sentences(part)

    for m in re.finditer(MARK_OUTER, text):
        said, mark = split(text[at : m.start()]), m.group()
        refs = [(int(a), int(b)) for a, b in re.findall(MARK_INNER, mark)]
        at = m.end()
        if latest_only:
            if not said:
                continue
            if refs and out and out[-1][1] == refs:
                out[-1] = (said[-1], refs, out[-1][2] + mark)
            else:
                out.append((said[-1], refs, mark))
        elif refs and said:
            out += [(s, refs, mark) for s in said] if claims_of else [(" ".join(said), refs, mark)]
        elif refs:
            if out:
                text_, old, marks = out[-1]
                out[-1] = (text_, old + [r for r in refs if r not in old], marks + mark)
        else:
            out += [(s, [], mark) for s in said]
    if not latest_only:
        out += [(s, [], "") for s in split(text[at:])]
        if not out:
            out = [(s, [], "") for s in split(text)]
    return out


_REF = T.StructType([T.StructField("turn_index", T.IntegerType()), T.StructField("ref_index", T.IntegerType())])
_CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("refs", T.ArrayType(_REF)), T.StructField("marks", T.StringType())])


@F.pandas_udf(T.ArrayType(_CHUNK))
def answer_chunks(c: pd.Series) -> pd.Series:
    return c.map(lambda t: [{"text": a, "refs": [{"turn_index": x, "ref_index": y} for x, y in r], "marks": m} for a, r, m in chunks(t)])


def nested_text(value) -> str:
    """Text of nested JSON: lists line by line, of an object its content, text or q, else all its values."""
    lines, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            if v.strip():
                lines.append(v.strip())
        elif isinstance(v, bool) or v is None:
            continue
        elif isinstance(v, dict):
            named = next((v[k] for k in ("content", "text", "q") if v.get(k)), None)
            stack.extend([named] if named is not None else reversed(v.values()))
        elif isinstance(v, (list, tuple)):
            stack.extend(reversed(v))
        else:
            lines.append(str(v))
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def json_text(c: pd.Series) -> pd.Series:
    """``nested_text`` of JSON text; what is no JSON is itself the text, null is empty."""

    def one(t: str | None) -> str:
        try:
            return nested_text(json.loads(t)) if t is not None else ""
        except (ValueError, RecursionError):
            return t.strip()

    return c.map(one)


class _Text(HTMLParser):
    SKIP = ("script", "style", "noscript", "template")
    INLINE = frozenset(("a", "abbr", "b", "cite", "code", "em", "font", "i", "mark", "small", "span", "strong", "sub", "sup", "u", *SKIP))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.parts.append("" if tag in self.INLINE else "\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        self.parts.append("" if tag in self.INLINE else "\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(source: str | None) -> str:
    """Visible text of an HTML page, one block a line."""
    if not source:
        return ""
    p = _Text()
    p.feed(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", source))
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_to_text(c: pd.Series) -> pd.Series:
    return c.map(html_text)
