"""Personal data: four fixed patterns, and a skip-chain conditional random field over each document.

The nodes of a document's graph are the spans that a pattern found (observed)
and other tokens that look like numbers or addresses. Neighbours in the text
share a chain potential. Tokens that repeat or resemble each other, however
far apart (the same last digits, the same mailbox), share a skip potential.
Loopy message passing carries the observed labels along both, so that a
number once written as +1 (988) 555-2485 is also found as 988.555.2485.

Potentials are learned piecewise from a bounded sample of documents: unary
ones by regularised logistic regression on shapes, chain and skip ones as log
ratios of label pairs to their chance. A token is added if its marginal is
sure and a skip path joins it to an observed span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm.common import slices
from tidelark.llm.spans import Span, marks, ordered, span_table
from tidelark.session import ship

BASE = ["email", "ip", "card", "phone"]
LABELS = ["other", *BASE]
#: Kinds that the field adds, one for each pattern.
ADDED = [f"linked_{k}" for k in BASE]
KINDS = [*BASE, *ADDED]

#: Documents for learning, about; chosen by a hash of their id and text.
SAMPLE_DOCS = 20_000
NEAR = 16  # characters between neighbours, at most
SURE, DAMPING, RIDGE = 0.75, 0.3, 1e-2
#: Messages are passed until none changes by more; a graph whose loops never settle is left after so many rounds.
TOLERANCE, ROUNDS = 1e-3, 60

#: Fixed values of the contract. The look-behinds and the search from @ only spare a run from being tried at each of its characters.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ANY = re.compile("[0-9@]|[(\\[]at[)\\]]")
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
MAILBOX = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]+)+")
WORD = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+(?![A-Za-z0-9._%+@-])")


def emails(text: str) -> list[Span]:
    """As the pattern [A-Za-z0-9._%+-]+@domain: what precedes an @ is a maximal run, back to the last match."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]


class Node:
    """A span with its label (0 unless a pattern found it), its shape and the keys that link it."""

    __slots__ = ("keys", "label", "shape", "start", "stop")

    def __init__(self, text: str, label: int, start: int, stop: int):
        self.label, self.start, self.stop = label, start, stop
        own = text[start:stop]
        d = digits_of(own)
        mail = "@" in own or bool(MAILBOX.fullmatch(own))
        self.shape = (mail, min(4, own.count(".")), 0 if mail else (len(d) > 3) + (len(d) > 6) + (len(d) > 9) + (len(d) > 13) + (len(d) > 19), any(c.isalpha() for c in own))
        if mail:
            address = re.sub(r"[(\[]at[)\]]", "@", re.sub(r"[(\[]dot[)\]]", ".", own)).replace(" ", "").lower()
            self.keys = [address, address.split("@")[0]]
        elif self.shape[3]:
            self.keys = [own.lower()]
        else:
            self.keys = [f"#{d[-n:]}" for n in (7, 10) if len(d) >= n]


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """In order of place; tokens that touch a base span are left out."""
    found = [Node(text, LABELS.index(k), a, b) for k, a, b in base]
    mark = marks(len(text), base)
    new = [m.span() for m in MAILBOX.finditer(text)]
    new += [m.span() for m in NUMBER.finditer(text) if len(digits_of(m[0])) <= 20]
    mailboxes = {n.keys[1] for n in found if n.label == 1 and len(n.keys[1]) > 4 and not n.keys[1].isalpha()}
    if mailboxes:
        spans = [(m.start(), m.start() + len(m[0].rstrip(".-"))) for m in WORD.finditer(text)]
        new += [s for s in spans if text[s[0] : s[1]].lower() in mailboxes]
    for start, stop in sorted(set(new), key=lambda x: (x[0], -x[1])):
        if mark.find(1, start, stop) < 0:
            mark[start:stop] = b"\x01" * (stop - start)
            found.append(Node(text, 0, start, stop))
    return sorted(found, key=lambda n: (n.start, n.stop))


def edges_of(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between close neighbours. Skip edges between successive nodes of a key, and between each other token and the nearest observed span of its key: a token repeated often isn't paired with itself all over, and no label is many links away."""
    by_key: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        for k in n.keys:
            by_key.setdefault(k, []).append(i)
    skips = {}
    for own in by_key.values():
        skips |= dict.fromkeys(zip(own, own[1:]))
        seen = [i for i in own if nodes[i].label]
        for i in own if seen else ():
            if not nodes[i].label:
                at = bisect_left(seen, i)
                near = min(seen[max(0, at - 1) : at + 1], key=lambda j: abs(j - i))
                skips[min(i, near), max(i, near)] = None
    return [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].stop <= NEAR], list(skips)


def one_hot(shape: tuple) -> np.ndarray:
    mail, dots, digits, letters = shape
    out = np.zeros(14)
    out[[0, 1 + int(mail), 3 + int(dots), 8 + min(4, int(digits))]] = 1
    out[13] = letters
    return out


class Field:
    """Log-potentials: unary (features x labels), chain and skip (labels x labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """By loopy sum-product message passing; observed labels are fixed."""
        chains, skips = edges_of(nodes)
        local = np.stack([one_hot(n.shape) for n in nodes]) @ self.unary
        for i, n in enumerate(nodes):
            if n.label:
                local[i] = -50.0
                local[i, n.label] = 0.0
        pairs = np.array(chains + skips, np.int64).reshape(-1, 2)
        links = np.concatenate([np.repeat(self.chain[None], len(chains), 0), np.repeat(self.skip[None], len(skips), 0)])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        links = np.concatenate([links, links.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, sent)
            x = (belief[source] - sent[back])[:, :, None] + links
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            new -= np.log(np.exp(new - new.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + new.max(axis=1, keepdims=True)
            change = np.abs(new - sent).max(initial=0)
            sent = DAMPING * sent + (1 - DAMPING) * new
            if change < TOLERANCE:
                break
        belief = local.copy()
        np.add.at(belief, target, sent)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if not base:
            return []  # without an observed span, no path can lead to one
        nodes = nodes_of(text, base)
        if len(nodes) == len(base):
            return []
        above = list(range(len(nodes)))
        for i, j in edges_of(nodes)[1]:
            a, b = _top(above, i), _top(above, j)
            above[max(a, b)] = min(a, b)
        observed = {_top(above, i) for i, n in enumerate(nodes) if n.label}
        waiting = [i for i, n in enumerate(nodes) if not n.label and _top(above, i) in observed]
        if not waiting:
            return []
        p = self.marginals(nodes)
        return [(ADDED[k - 1], nodes[i].start, nodes[i].stop) for i in waiting if (k := int(p[i].argmax())) and p[i, k] >= SURE]


def _top(above: list[int], i: int) -> int:
    while above[i] != i:
        above[i] = above[above[i]]
        i = above[i]
    return i


def statistics(text: str) -> Counter:
    """Shapes by label, and pairs of labels of neighbours and of like tokens."""
    nodes = nodes_of(text, base_spans(text))
    chains, skips = edges_of(nodes)
    out = Counter(("shape", *map(int, n.shape), n.label) for n in nodes)
    out.update(("chain", nodes[i].label, nodes[j].label, 0, 0, 0) for i, j in chains)
    # A like token that no pattern finds isn't known to be harmless; such pairs teach nothing.
    out.update(("skip", nodes[i].label, nodes[j].label, 0, 0, 0) for i, j in skips if bool(nodes[i].label) == bool(nodes[j].label))
    return out


def fit(counts: dict[tuple, int]) -> Field:
    """Potentials from counts; uninformed ones from none."""
    n = len(LABELS)
    shapes = [(k[1:5], k[5], c) for k, c in counts.items() if k[0] == "shape"]
    # Each label has a pseudo-count in all, so a label that never occurs stays possible.
    x = np.stack([one_hot(s) for s, _, _ in shapes] + [np.eye(14)[0]] * n)
    y = np.array([k for _, k, _ in shapes] + list(range(n)))
    w = np.array([c for _, _, c in shapes] + [1.0] * n, float)
    w /= w.sum()
    unary = np.zeros((14, n))
    for _ in range(400):
        p = np.exp(x @ unary - (x @ unary).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        unary -= 1.0 * (x.T @ (p * w[:, None]) + RIDGE * unary)

    # The priors: labels of neighbours are independent; tokens that repeat are a hundred times as likely to agree.
    def pairs(kind: str, prior: np.ndarray) -> np.ndarray:
        table = prior.copy()
        for k, c in counts.items():
            if k[0] == kind:
                table[k[1], k[2]] += c
        table = (table + table.T) / 2
        share = table / table.sum()
        return np.clip(np.log(share / np.outer(share.sum(1), share.sum(0))), -4, 4)

    return Field(unary, pairs("chain", np.full((n, n), 20.0)), pairs("skip", np.full((n, n), 0.01) + np.eye(n)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field, from about `sample_docs` documents chosen by a hash of id and text, that of the least hash at any rate (all, if there are fewer)."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    draw = F.pmod(F.xxhash64(F.lit("pii"), F.col(id_col), text), F.lit(1 << 30)) / float(1 << 30)
    n, least = docs.agg(F.count("*"), F.min(draw)).first()
    sample = docs.where(draw <= max(min(1.0, sample_docs / max(1, n)), least or 0.0)).select(text.alias("text"))

    def count(batches):
        total = Counter()
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                if text and ANY.search(text):
                    total.update(statistics(text))
        yield pa.RecordBatch.from_arrays([pa.array([list(map(str, k)) for k in total], pa.list_(pa.string())), pa.array(list(total.values()), pa.int64())], names=["k", "n"])

    rows = sample.mapInArrow(count, "k array<string>, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return fit({(r["k"][0], *map(int, r["k"][1:])): r["n"] for r in sorted(rows)})


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, by start and then kind (email, ip, card, phone, then the linked ones).

    Null and empty texts have none; long ones are read whole. Spans of different
    patterns may overlap, and stay in the order of their kinds where they begin
    alike; added ones overlap none, and stand only in documents where a pattern
    has found something, to which a skip path leads. Repeated rows and null ids
    are kept. An empty table gives an empty table. Other columns, whatever
    their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col))

    def make():
        field = shared.value

        def find(text: str) -> list[Span]:
            if not ANY.search(text):
                return []
            base = base_spans(text)
            return ordered(base + field.added(text, base), KINDS)

        return find

    return span_table(docs, make, id_col, text_col)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, gives way to the kind of its first in angle brackets."""
    out, end, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        kind, start, stop = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < stop:
            stop = max(stop, spans[i][2])
            i += 1
        out += [text[end:start], f"<{kind.removeprefix('linked_')}>"]
        end = stop
    return "".join([*out, text[end:]])
