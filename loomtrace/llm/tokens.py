"""Problem 8: the corpus encoded with a public byte-level BPE by replaying its merges over a block's words.

A block of texts is cut into words; its distinct words form one small corpus. An inverted index leads from
each adjacent token pair to the places where it stands, and the merges present are applied in rank order to
all their places at once, each application touching only the neighbours of that place. Words never influence
one another, so the replay over a block gives the same ids as one over all texts, and no word has to be
shuffled; encoded words are kept for the following blocks of the same worker up to a bound.

Defined results: an empty text and a null text give an empty list; strings of special tokens are ordinary
text; one row per input row, repeated rows included.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_WORDS = 200_000
KEEP_BYTES = 64
BLOCK_CHARS = 2_000_000


def default_paths() -> tuple[str, str]:
    """Path of the 50k byte-level vocabulary and its word pattern, as installed."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class Replay:
    """Merge replay over batches of words for one vocabulary of byte sequences by rank."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}

    def merge(self, a: int, b: int) -> int:
        """Id of the token made of two, which is also the merge's rank; -1 if there is none."""
        m = self.merged.get((a, b))
        if m is None:
            m = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
            if len(self.merged) < 1_000_000:
                self.merged[(a, b)] = m
        return m

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        tokens: list[int] = []
        bounds = [0]
        for w in words:
            whole = self.ranks.get(w)
            if whole is None:
                tokens.extend(map(self.single.__getitem__, w))
            else:
                tokens.append(whole)
            bounds.append(len(tokens))
        n = len(tokens)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        for end in bounds[1:]:
            if end:
                following[end - 1] = -1
        for start in bounds[:-1]:
            if start < n:
                previous[start] = -1
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            j = following[i]
            if j >= 0:
                pair = (tokens[i], tokens[j])
                at = places.get(pair)
                if at is None:
                    places[pair] = [i]
                else:
                    at.append(i)
        queue = []
        for pair in places:
            m = self.merge(*pair)
            if m >= 0:
                queue.append((m, pair))
        heapq.heapify(queue)
        while queue:
            m, pair = heapq.heappop(queue)
            at = places.pop(pair, None)
            if at is None:
                continue
            a, b = pair
            at.sort()
            for i in at:
                j = following[i]
                if j < 0 or tokens[i] != a or tokens[j] != b:
                    continue  # an earlier merge took one of the two
                tokens[i] = m
                tokens[j] = -1
                k = following[j]
                following[i] = k
                if k >= 0:
                    previous[k] = i
                    self._note(places, queue, (m, tokens[k]), i)
                h = previous[i]
                if h >= 0:
                    self._note(places, queue, (tokens[h], m), h)
        return [[t for t in tokens[a:b] if t >= 0] for a, b in zip(bounds, bounds[1:])]

    def _note(self, places: dict, queue: list, pair: tuple[int, int], at: int) -> None:
        m = self.merge(*pair)
        if m < 0:
            return
        known = places.get(pair)
        if known is None:
            places[pair] = [at]
            heapq.heappush(queue, (m, pair))
        else:
            known.append(at)


class Encoder:
    def __init__(self, vocabulary: str, pattern: str):
        import regex

        self.replay, self.cut, self.known = Replay(vocabulary), regex.compile(pattern), {}

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, block by block of bounded size."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end] or "") <= BLOCK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            cut = [self.cut.findall(t) if t else [] for t in texts[start:end]]
            known = self.known
            if len(known) > KEEP_WORDS:
                known.clear()
            fresh = list({w for words in cut for w in words if w not in known})
            block = dict(zip(fresh, self.replay.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])))
            look = {**known, **block} if len(known) < len(block) else None
            known.update((w, ids) for w, ids in block.items() if len(w) <= KEEP_BYTES)
            for words in cut:
                out: list[int] = []
                for w in words:
                    out.extend(look[w] if look is not None else known[w] if w in known else block[w])
                yield np.array(out, dtype=np.int32)
            start = end


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids) for every row of ``docs``; no shuffle."""
    path, own = default_paths() if vocabulary is None or pattern is None else (vocabulary, pattern)
    path, own = vocabulary or path, pattern or own
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, own)
        for f in frames:
            keys, ids, held, start = f["k"].tolist(), [], 0, 0
            for x in e.encode(f["t"].tolist()):
                ids.append(x)
                held += len(x)
                if held > 1_000_000:
                    yield pd.DataFrame({key: keys[start : start + len(ids)], "ids": ids})
                    start, ids, held = start + len(ids), [], 0
            yield pd.DataFrame({key: keys[start : start + len(ids)], "ids": ids})

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, ids array<int>")
