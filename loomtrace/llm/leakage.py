"""Problem 9: held-out passages inside the corpus, by pigeonhole edit matching on words.

Every item is cut into windows of half its words. A window with an error budget of E words is divided into E + 1
pieces, so a text within that distance holds at least one piece unchanged. The pieces of all items form one
small index; exact piece hits in a document give the places where a window may lie, and Myers' bit-parallel edit
distance verifies these places only. Confirmed places are aligned once more: the words in runs of two or more
that lie close together must make up half of the item.

Words are compared after removing markup, entities, citation marks, hyphens at line ends, case and punctuation.

Defined results: null and empty texts and items give no row; items of fewer than ``LEAST_WORDS`` words
have pieces of ``SHORT_PIECE`` words, those of fewer than ``WHOLE_WORDS`` must stand there as a whole, word by word; each (document, item) is given once, repeated document rows each give their row.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4
LEAST_WORDS = 16
SHORT_PIECE = 2
WHOLE_WORDS = 4
SHARE = 0.5
NEAR = 10
#: Characters of evaluation items in one broadcast index (about 40 bytes a character in memory).
BLOCK_CHARS = 4_000_000

_MARKUP = re.compile(r"<[^<>]{0,300}>|[^]*|[­​-‏⁠﻿]|\]\([^()\s]*\)|https?://\S+")
_HYPHEN = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?=[a-zß-ÿ])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    t = unicodedata.normalize("NFKC", html.unescape(text) if "&" in text else text)
    return _WORD.findall(_MARKUP.sub(" ", _HYPHEN.sub("", t)).replace("'", "").replace("’", "").lower())


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance between the pattern and any stretch of the text."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & mask
        hn = (hn << 1) & mask
        vp = hn | (mask & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best = score
    return best


def held_share(item: list[int], text: list[int]) -> float:
    """Share of the item's words that stand in the text in order, in runs of at least two and close together."""
    best = here = 0
    last = None
    for b in difflib.SequenceMatcher(None, item, text, autojunk=False).get_matching_blocks():
        if b.size < 2:
            continue
        near = last is not None and b.b - (last.b + last.size) <= NEAR and b.a - (last.a + last.size) <= NEAR
        here = here + b.size if near else b.size
        best, last = max(best, here), b
    return best / max(1, len(item))


@dataclass
class Item:
    key: int
    words: list[int]
    window: int
    budget: int
    starts: list[int]
    piece: int


class Index:
    """Pieces of all items: piece -> [(item, offset)]."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.items: list[Item] = []
        self.pieces: dict[tuple, list[tuple[int, int]]] = {}
        self.firsts: dict[int, tuple[int, ...]] = {}
        for key, text in items:
            w = [self.ids.setdefault(x, len(self.ids)) for x in words_of(text)]
            if not w:
                continue
            piece = PIECE if len(w) >= LEAST_WORDS else SHORT_PIECE if len(w) >= WHOLE_WORDS else len(w)
            h = -(-len(w) // 2) if len(w) >= WHOLE_WORDS else len(w)
            starts = sorted({*range(0, len(w) - h + 1, 2 if len(w) >= LEAST_WORDS else 1), len(w) - h})
            n = len(self.items)
            self.items.append(Item(key, w, h, max(0, h // piece - 1), starts, piece))
            for at in range(len(w) - piece + 1):
                if any(s <= at and at + piece <= s + h and (at - s) % piece == 0 for s in starts):
                    self.pieces.setdefault(tuple(w[at : at + piece]), []).append((n, at))
                    self.firsts[w[at]] = tuple({*self.firsts.get(w[at], ()), piece})

    def leaks(self, text: str | None) -> list[int]:
        """Keys of the items that a text holds."""
        if not text:
            return []
        ids = self.ids
        words = [ids.get(w, -1) for w in words_of(text)]
        hits: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            for piece in self.firsts.get(w, ()):
                for n, at in self.pieces.get(tuple(words[i : i + piece]), ()):
                    hits.setdefault(n, []).append((at, i))
        return [self.items[n].key for n, at in hits.items() if self._confirmed(self.items[n], at, words)]

    def _confirmed(self, item: Item, hits: list[tuple[int, int]], words: list[int]) -> bool:
        if len(item.words) < WHOLE_WORDS:
            return True
        tried: set[tuple[int, int]] = set()
        for at, i in hits:
            for s in item.starts:
                if not (s <= at and at + item.piece <= s + item.window and (at - s) % item.piece == 0):
                    continue
                begin = i - (at - s) - item.budget
                if (s, begin // 2) in tried:
                    continue
                tried.add((s, begin // 2))
                part = words[max(0, begin) : begin + item.window + 2 * item.budget]
                if myers(item.words[s : s + item.window], part) <= item.budget:
                    n = len(item.words)
                    if held_share(item.words, words[max(0, begin - n) : begin + item.window + 2 * item.budget + n]) >= SHARE:
                        return True
        return False


def _block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    index = Index(items)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = dict(docs.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, item) for k, t in zip(f["doc_id"].tolist(), f["text"].tolist()) for item in dict.fromkeys(shared.value.leaks(t))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return docs.select(F.col("doc_id"), F.col("text")).filter("text is not null").mapInPandas(run, f"doc_id {kind}, item_id bigint")


def leaked(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage.

    The characters of the items are summed first. Up to ``block_chars`` they make one index that is broadcast; more
    are cut into blocks of that size, and all documents are searched for one block after the other.
    """
    known = items.select("item_id", "text").filter("text is not null and item_id is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    if blocks > 1:
        known = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        rows = (known.filter(F.col("block") == b) if blocks > 1 else known).collect()
        part = _block(docs, [(r.item_id, r.text) for r in rows])
        found = part if found is None else found.unionByName(part)
    return found
