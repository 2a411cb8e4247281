"""Token counts by byte-pair merging, without making token ids.

A piece of text starts as its bytes in a linked list. A heap holds the ranks of
adjacent pairs; the lowest is popped again and again and its two symbols become
one. The count is the number of bytes less the number of merges.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelark.llm.common import map_texts

#: Counts of pieces a worker remembers; beyond it the memory starts anew. Results don't depend on it.
CACHE_PIECES = 400_000

#: GPT-2's pieces over Unicode, and the same over ASCII and Latin letters alone, where plain classes do.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LATIN_TEXT = re.compile("[\x00-\x7f\xa0-ɏ]*")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
LATIN_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], tuple[str, ...]]:
    """Ranks of the merged byte strings of a byte-level BPE .json, and its special strings."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    letters = byte_letters()
    pairs = (m.split(" ") if isinstance(m, str) else m for m in x["model"]["merges"])
    ranks: dict[bytes, int] = {}
    for rank, pair in enumerate(pairs):
        ranks.setdefault(bytes(letters[c] for c in "".join(pair)), rank)
    return ranks, tuple(sorted((t["content"] for t in x.get("added_tokens", [])), key=len, reverse=True))


def count_piece(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols left of a piece when no adjacent pair can be merged any more."""
    n = len(piece)
    if n < 2:
        return n
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    after = list(range(1, n + 1))  # where the symbol that begins here ends, and the next one begins; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, end = pop(heap)
        middle = after[i]
        if not middle or middle >= n or after[middle] != end:
            continue  # one of the two has been merged since
        after[i], after[middle] = end, 0
        left -= 1
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                push(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
            push(heap, (r, p, end))
    return left


class Counts(dict):
    """Piece of text -> number of tokens, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = 1 if raw in self.ranks else count_piece(raw, self.ranks)
        if len(piece) < 64:
            self[piece] = n
        return n


@lru_cache(maxsize=1)
def counter(path: str):
    """f(text) -> number of tokens; kept for all tasks of a worker."""
    ranks, special = vocabulary(path)
    counts = Counts(ranks)
    cut = re.compile("|".join(map(re.escape, special))) if special else None

    def plain(text: str) -> int:
        if len(counts) > CACHE_PIECES:
            counts.clear()
        pieces = LATIN_PIECES if LATIN_TEXT.fullmatch(text) else PIECES
        return sum(map(counts.__getitem__, pieces.findall(text)))

    def count(text: str | None) -> int:
        if not text:
            return 0
        if cut is None or not cut.search(text):
            return plain(text)
        parts = cut.split(text)
        return len(parts) - 1 + sum(plain(x) for x in parts if x)

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8) and n_tokens, as the library counts them for a byte-level BPE .json.

    `path` must exist on every executor. Null and empty texts have 0 bytes and
    tokens. Special strings inside a text count as one token each. Repeated
    rows and null ids are kept; no other column is read.
    """

    def make():
        count = counter(path)

        def f(texts):
            return [pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())]

        return f

    return map_texts(docs, make, "n_bytes long, n_tokens long", id_col, text_col)
