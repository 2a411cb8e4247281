"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary learned from natural text and code spends few tokens on
what people write and many on random characters. A run of secret-like
characters is random if it takes a token for every two characters or fewer,
unless it is a known digest (hexadecimal of a usual digest length), an
identifier (UUID, numbers, or words in snake, kebab or camel case, told from
random letters by the same test), or overlaps what a pattern has found.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame

from tidelark.llm.spans import Span, marks, ordered, span_table

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
#: Fixed values of the contract.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ and a length test: runs are maximal

#: Characters per token at which a string counts as random, and its least length. Shorter runs say little: from 16
#: characters on, four of a thousand documents of invented prose had a word that was taken for random, from 20 on none.
RATIO, LEAST = 2.0, 20
#: Words of an identifier are lower-cased, have more characters per token than this, and hold so much of its letters and digits.
WORD_RATIO, WORD_SHARE = 2.4, 0.5
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
GROUP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[A-Z]")
NUMBERS = re.compile("[0-9_/=+-]+")


@lru_cache(maxsize=8)
def runs(least: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{least},}}")


@lru_cache(maxsize=1)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a .tiktoken file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def are_words(run: str, tokens) -> bool:
    """Whether groups of three or more letters hold half of a run at least, and take few tokens as words."""
    groups = GROUP.findall(run)
    words = [g.lower() for g in groups if len(g) > 2 and g[0] > "9"]
    letters = sum(map(len, words))
    return letters >= WORD_SHARE * sum(map(len, groups)) and letters > WORD_RATIO * sum(len(tokens(" " + w)) for w in words)


def is_known(run: str, tokens) -> bool:
    """A digest or an identifier."""
    return bool(DIGEST.fullmatch(run) or UUID.fullmatch(run.strip("-_=+/")) or NUMBERS.fullmatch(run)) or are_words(run, tokens)


def random_spans(text: str, base: list[Span], tokens, ratio: float = RATIO, least: int = LEAST) -> list[Span]:
    found, mark = [], marks(len(text), base) if base else b""
    for m in runs(least).finditer(text):
        run = m[0]
        if mark.find(1, *m.span()) < 0 and len(run) <= ratio * len(tokens(run)) and not is_known(run, tokens):
            found.append(("random", *m.span()))
    return found


def find_secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """One row per document: id and spans, by start and then kind (assign, access, hex, random).

    `path` is a .tiktoken vocabulary that every executor can read; `ratio` and
    `least` bound random runs. Null and empty texts have no spans; long ones
    are read whole, in linear time. Spans of different patterns may overlap,
    and stay in the order of their kinds where they begin alike; random ones
    overlap none. An empty table gives an empty table. Repeated rows and null
    ids are kept; other columns, whatever their names, aren't read.
    """

    def make():
        tokens = encoding(path).encode_ordinary

        def find(text: str) -> list[Span]:
            base = base_spans(text)
            return ordered(base + random_spans(text, base, tokens, ratio, least), KINDS)

        return find

    return span_table(docs, make, id_col, text_col)
