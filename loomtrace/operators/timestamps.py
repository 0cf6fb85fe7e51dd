"""Problem 5: mixed timestamp formats and time zones, normalised to UTC microseconds.

Each text is turned into a shape mask (digit -> 9, letter -> a). Every distinct mask is matched with the
shapes below once, which gives the places of its fields; all texts of that mask are then converted together
with array arithmetic. Wall times go through the transition table of their zone.

Defined results: null, blank and unreadable texts and impossible dates give null (no row);
fractions beyond microseconds are cut off; parts that are not written count as 0; a null or unknown platform
falls back to the platform that begins ``conv_id``, and where none is known a wall time gives null while a
time with its own zone is still converted.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.zones import ZoneTable, zone_table

KEEP_MASK = 128
MAX_CLOCKS = 10_000

# Month names and zone abbreviations with a settled offset (minutes).
MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_TIME = r"(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<w>a{1,4})| ?(?:aaa)?(?P<o>[+-]99?(?::?99)?))?(?: ?\(a+\))?"
_CLOCK = rf"(?:(?:,? +|a|, ?a+ ){_TIME}(?: (?P<p>aa(?!a)|a\.a\.))?{_ZONE})?"
_NUM = r"(?P<e>-?9{1,20})(?:\.(?P<f>9+))?"
_QUOTE = r"[\"']?"
SHAPES = [
    re.compile(x)
    for x in (
        r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?:a(?P<h>99)(?P<m>99)(?P<s>99)?(?:[.,](?P<f>9+))?" + _ZONE + ")?",
        r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?P<h>99)(?P<m>99)(?P<s>99)" + _ZONE,
        _NUM,
        rf"\{{ ?{_QUOTE}\$?a+{_QUOTE} ?: ?\{{ ?{_QUOTE}\$?a+{_QUOTE} ?: ?{_QUOTE}(?P<ms>-?9{{1,20}}){_QUOTE} ?\}} ?\}}",
        rf"\{{ ?{_QUOTE}\$?a+{_QUOTE} ?: ?(?P<ms>-?9{{1,20}}) ?\}}",
        rf"(?:\{{ ?{_QUOTE}\$?a+{_QUOTE} ?: ?)?{_QUOTE}(?P<Y>9999)(?P<sep>[-/.])(?P<M>99?)[-/.](?P<D>99?){_CLOCK}{_QUOTE}(?: ?\}})?",
        r"(?P<A>99?)(?P<sep>[-/.])(?P<B>99?)[-/.](?P<Y>9999)" + _CLOCK,
        r"(?:a{2,9}\.?,? )?(?P<D>99?)(?:aa)?\.?[ -](?P<N>a{3,9})\.?,?[ -](?P<Y>9999)" + _CLOCK,
        r"(?:a{2,9}\.?,? )?(?P<N>a{3,9})\.? (?P<D>99?)(?:aa)?,? (?P<Y>9999)" + _CLOCK,
        rf"a{{3,9}},? (?P<N>a{{3,9}}) +(?P<D>99?) {_TIME}{_ZONE} (?P<Y>9999)",
    )
]
_MASK = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}, " ": " ", " ": " ", "\t": " "})


def shape_mask(text: str) -> str:
    return text.translate(_MASK)


def places(mask: str) -> dict[str, tuple[int, int]] | None:
    """Places of the fields in any text of this mask, or None if no shape fits; the answers for long masks are not kept."""
    return _short_places(mask) if len(mask) <= KEEP_MASK else _places(mask)


def _places(mask: str) -> dict[str, tuple[int, int]] | None:
    for shape in SHAPES:
        m = shape.fullmatch(mask)
        if m:
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


_short_places = lru_cache(maxsize=65_536)(_places)


def _digits(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for c in codes[:, span[0] : span[1]].T:
        out = out * 10 + (c.astype(np.int64) - 48)
    return out


def _words(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    cut = np.ascontiguousarray(codes[:, span[0] : span[1]])
    return np.char.upper(cut.view(f"U{span[1] - span[0]}").ravel())


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    following = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= following - first)


def _micros(codes: np.ndarray, at: dict[str, tuple[int, int]]) -> np.ndarray:
    if "f" not in at:
        return np.zeros(len(codes), dtype=np.int64)
    a, b = at["f"]
    n = min(b - a, 6)
    return _digits(codes, (a, a + n)) * 10 ** (6 - n)


def _epoch(codes: np.ndarray, at: dict[str, tuple[int, int]], field: str) -> tuple[np.ndarray, np.ndarray]:
    a, b = at[field]
    sign = 1
    negative = codes[:, a] == 45
    if negative.any():
        a, sign = a + 1, np.where(negative, -1, 1)
    n = b - a
    if n > 18 and field == "e":  # nanoseconds and finer: cut before they overflow
        return sign * _digits(codes, (a, b - 3)), np.ones(len(codes), dtype=bool)
    value = sign * _digits(codes, (a, b))
    if field == "ms" or 12 <= n <= 14:
        value = value * 1_000
    elif n > 17:
        value = value // 1_000
    elif n < 12:
        value = value * 1_000_000 + sign * _micros(codes, at)
    return value, np.ones(len(codes), dtype=bool)


def convert(texts: list[str | None], zones: list[str | None], orders: list[str | None], tables: dict[str, ZoneTable]) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds and their validity for aligned lists of texts, zone names and day-month orders."""
    n = len(texts)
    out, valid = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    clean = [t.strip(" \t\r\n  ﻿​") if t else "" for t in texts]
    rows: dict[str, list[int]] = {}
    for i, t in enumerate(clean):
        if t:
            rows.setdefault(t.translate(_MASK), []).append(i)
    for mask, idx in rows.items():
        at = places(mask)
        if at is None:
            continue
        codes = np.array([clean[i] for i in idx], dtype=f"U{len(mask)}").view(np.uint32).reshape(len(idx), len(mask))
        ix = np.array(idx)
        if "e" in at or "ms" in at:
            out[ix], valid[ix] = _epoch(codes, at, "e" if "e" in at else "ms")
            continue
        y = _digits(codes, at["Y"])
        if "A" in at:
            first, second = _digits(codes, at["A"]), _digits(codes, at["B"])
            monthly = np.array([orders[i] == "MDY" for i in idx]) & (codes[:, at["sep"][0]] != 46)
            monthly = (monthly & (first <= 12)) | (second > 12)
            mo, d = np.where(monthly, first, second), np.where(monthly, second, first)
        else:
            d = _digits(codes, at["D"])
            mo = _digits(codes, at["M"]) if "M" in at else np.array([MONTHS.get(x[:3], 0) for x in _words(codes, at["N"])])
        day, ok = _days(y, mo, d)
        h, mi, s = (_digits(codes, at[k]) if k in at else np.zeros(len(idx), dtype=np.int64) for k in "hms")
        words = _words(codes, at["w"]) if "w" in at else None
        half = np.array([x.replace(".", "") for x in _words(codes, at["p"])]) if "p" in at else None
        if half is None and words is not None and at["w"][1] - at["w"][0] == 2:
            half, words = (words, None) if np.isin(words, ["AM", "PM"]).all() else (None, words)
        if half is not None:
            known = np.isin(half, ["AM", "PM"])
            ok &= ~known | ((h >= 1) & (h <= 12))
            h = np.where(known, h % 12 + np.where(half == "PM", 12, 0), h)
        ok &= (h <= 24) & (mi <= 59) & (s <= 60)
        wall = day * 86_400 + h * 3_600 + mi * 60 + s
        utc = wall.copy()
        if "o" in at:
            a, b = at["o"]
            colon = 1 if ":" in mask[a:b] else 0
            hours_end = a + 3 if b - a != 2 else b
            off = _digits(codes, (a + 1, hours_end)) * 60
            if b > hours_end:
                off = off + _digits(codes, (hours_end + colon, b))
            ok &= off <= 18 * 60
            utc = wall - np.where(codes[:, a] == 45, -off, off) * 60
        elif words is not None:
            for k, (i, w) in enumerate(zip(idx, words)):
                table = tables.get(zones[i] or "")
                own = dict(table.names).get(str(w)) if table else None
                off = own if own is not None else ABBREVIATIONS[str(w)] * 60 if str(w) in ABBREVIATIONS else None
                ok[k] &= off is not None
                utc[k] = wall[k] - (off or 0)
        else:
            names = np.array([zones[i] or "" for i in idx])
            for z in np.unique(names):
                here = names == z
                if z in tables:
                    utc[here] = tables[z].wall_to_utc(wall[here])
                else:
                    ok &= ~here
        out[ix], valid[ix] = utc * 1_000_000 + _micros(codes, at), ok
    return out, valid


def utc_micros(text: Column, zone: Column, order: Column, zone_names: list[str]) -> Column:
    """Column of UTC microseconds (null where the text denotes no instant); the tables of ``zone_names`` travel with it."""
    tables = {z: t for z in zone_names if (t := zone_table(z)) is not None}

    @F.pandas_udf("long")
    def run(t: pd.Series, z: pd.Series, o: pd.Series) -> pd.Series:
        value, ok = convert(t.tolist(), z.tolist(), o.tolist(), tables)
        return pd.Series(value).astype("Int64").where(pd.Series(ok))

    return run(text, zone, order)


def normalise_times(rows: DataFrame, clock: DataFrame, time: str = "time", platform: str = "platform", conv_id: str = "conv_id") -> DataFrame:
    """``rows`` plus ``utc_us``; rows without an instant are left out.

    ``clock`` (platform, wall_zone, date_order) is a settings table; it is collected after a check of its size.
    """
    known = clock.select("platform", "wall_zone", "date_order").limit(MAX_CLOCKS + 1).collect()
    if len(known) > MAX_CLOCKS:
        raise ValueError(f"the clock table has more than {MAX_CLOCKS} rows")
    by = {str(r.platform).strip().lower(): (r.wall_zone, (r.date_order or "").strip().upper()) for r in reversed(known) if r.platform}

    def pick(key: Column, i: int) -> Column:
        pairs = [F.lit(x) for k, v in sorted(by.items()) if v[i] for x in (k, v[i])]
        return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")

    named = F.lower(F.regexp_replace(F.col(platform), r"(?U)^\s+|\s+$", ""))
    begun = F.lower(F.regexp_extract(F.col(conv_id), r"^\s*([A-Za-z]+)", 1))
    key = F.when(named.isin(sorted(by)), named).otherwise(begun)
    zones = sorted({v[0] for v in by.values() if v[0]})
    out = rows.withColumn("utc_us", utc_micros(F.col(time).cast("string"), pick(key, 0), pick(key, 1), zones))
    return out.filter(F.col("utc_us").isNotNull())
