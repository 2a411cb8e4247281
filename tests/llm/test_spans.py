import hashlib
import os
import random
import re
import string
import uuid
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import by_id
from tidelark.llm import pii, secrets
from tidelark.llm.common import span_digest

TIKTOKEN = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_secrets(t):
    """The contract's patterns as they are written."""
    out = [("assign", *m.span()) for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def soup(rng, parts, n):
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_patterns_are_those_of_the_contract():
    rng = random.Random(1)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "ſecret", "=", ": ", "'", '"', " ", "abc123", "AKIA", "QWERTY0123456789", "0123456789abcdef", "f00d", "é", ".", "\n"]
    for _ in range(3000):
        t = soup(rng, parts, rng.randint(0, 14))
        assert secrets.ordered(secrets.base_spans(t), secrets.BASE) == plain_secrets(t), t
    parts = ["a", "b.c", "@", "@x.y", ".", "_", "1", "12", "255", "256", "007", "4111111111111111", "4111 1111", " ", "-", "+", "+1 (988) 555-2485", "(", ")", "é", "\n"]
    for _ in range(6000):
        t = soup(rng, parts, rng.randint(0, 12))
        assert pii.ordered(pii.base_spans(t), pii.BASE) == plain_personal(t), t


def test_hostile_texts_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1 " * 50_000, "token " * 30_000, "((" * 50_000 + "1", "0123456789abcdef" * 10_000):
        secrets.base_spans(t), pii.base_spans(t), pii.nodes_of(t, [])


def test_random_strings_are_found_and_known_ones_are_not():
    tokens = secrets.encoding(TIKTOKEN).encode_ordinary
    found = lambda t: [t[a:b] for _, a, b in secrets.random_spans(t, secrets.base_spans(t), tokens)]
    assert found("key q7Zx9LmP2vKt8RwY4nBc6HdF end") == ["q7Zx9LmP2vKt8RwY4nBc6HdF"]
    for known in ("d41d8cd98f00b204e9800998ecf8427e", "D41D8CD98F00B204E9800998ECF8427E", "123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name_here", "getLongIdentifierNameHere", "keitlichenlichkeitbereinst", "12345678901234567890123"):
        assert found(f"a {known} b") == []
    t = "token = q7Zx9LmP2vKt8RwY4nBc6HdF"  # a pattern has it already
    assert secrets.base_spans(t) and found(t) == []


def test_random_keys_of_one_case_and_in_groups_are_found():
    tokens = secrets.encoding(TIKTOKEN).encode_ordinary
    found = lambda t: [t[a:b] for _, a, b in secrets.random_spans(t, [], tokens)]
    rng = random.Random(8)
    of = lambda letters, n: "".join(rng.choices(letters, k=n))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for one in (lower, upper):
        keys = [of(one, 24) for _ in range(200)]
        assert sum(found(f"a {k} b") == [k] for k in keys) >= 195
        for joint in "-_/+=":
            grouped = [joint.join(of(one, 5) for _ in range(4)) for _ in range(40)] + [joint.join(of(x, 4) for _ in range(3) for x in (one, "0123456789")) for _ in range(40)]
            assert all(found(f"a {k} b") == [k] for k in grouped)
    assert found("a QZXKV-BNMWR-TPLKJ-HGFDS b") == ["QZXKV-BNMWR-TPLKJ-HGFDS"]
    for known in ("MAXIMUM_CONNECTION_TIMEOUT_SECONDS", "x_min_y_max_z_min_z_max", "2024-01-02_03-04-05-678", "internationalization-and-localization"):
        assert found(f"a {known} b") == []


ALPHABETS = {
    "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters, "alphanumeric": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits,
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_planted_random_strings(name):
    """Of each alphabet and length, 95 % at least are found, whole."""
    tokens, rng = secrets.encoding(TIKTOKEN).encode_ordinary, random.Random(11)
    for n in (20, 24, 32, 40, 64):
        keys = ["".join(rng.choices(ALPHABETS[name], k=n)) for _ in range(300)]
        found = sum(secrets.random_spans(f"id {k} end", [], tokens) == [("random", 3, 3 + n)] for k in keys)
        assert found >= 0.95 * len(keys), (n, found)


def test_planted_words_identifiers_and_digests_are_left_alone():
    """Names of the standard library, digests, numbers: 99 % at least."""
    tokens, rng = secrets.encoding(TIKTOKEN).encode_ordinary, random.Random(13)
    names = set()
    for f in sorted(Path(os.__file__).parent.glob("*.py")):
        names.update(re.findall(r"(?<![A-Za-z0-9+/=_-])[A-Za-z_][A-Za-z0-9_]{19,}(?![A-Za-z0-9+/=_-])", f.read_text(encoding="utf-8", errors="ignore")))
    digests = [h(str(i).encode()).hexdigest() for i in range(200) for h in (hashlib.md5, hashlib.sha1, hashlib.sha224, hashlib.sha256, hashlib.sha512)]
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(200)] + [f"{rng.getrandbits(80)}" for _ in range(200)] + [f"2024-0{i % 9 + 1}-11_10-{i}-00-{i:06}" for i in range(200)]
    for known in (sorted(names), digests, [d.upper() for d in digests], ids):
        alarms = [x for x in known if secrets.random_spans(f"a {x} b", secrets.base_spans(f"a {x} b"), tokens)]
        assert len(known) > 500 and len(alarms) <= 0.01 * len(known), alarms[:20]


def test_least_length_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "key q7Zx9LmP2vKt8R end")], "doc_id long, text string")
    assert [len(secrets.find_secrets(docs, TIKTOKEN, least=n).first().spans) for n in (14, 15)] == [1, 0]


def test_secrets_query_columns(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(9, "é password=abc123XYZ ", None, "x", 1, 2, "y", 3)], odd_docs.schema))
    found = secrets.find_secrets(docs, TIKTOKEN).select("doc_id", *[c.alias(k) for k, c in span_digest(F.col("spans"), secrets.BASE).items()])
    rows = by_id(found)
    assert len(rows[7]) == 2 and len(rows[None]) == 2
    assert (rows[9][0].n_assign, rows[9][0].n_access, rows[9][0].n_hex) == (1, 0, 0)
    assert rows[9][0].spans == "assign:2:20" and rows[9][0].base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()
    assert rows[2][0].spans == "" and rows[2][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(no_docs, TIKTOKEN).count() == 0


FIELD = pii.fit({("shape", 0, 0, 3, 0, 4): 319, ("shape", 0, 0, 4, 0, 3): 307, ("shape", 1, 3, 0, 1, 1): 294, ("shape", 0, 3, 3, 0, 2): 236, ("shape", 0, 3, 2, 0, 2): 80})


def test_skip_chain_carries_labels_to_repeats():
    def added(t):
        return [(k, t[a:b]) for k, a, b in FIELD.added(t, pii.base_spans(t))]

    filler = "word " * 200
    assert added(f"call +1 (988) 555-2485 {filler} or 988.555.2485") == [("linked_phone", "988.555.2485")]
    assert added(f"bosbt.42@mail8.example.com {filler} bosbt.42 (at) mail8.example.com") == [("linked_email", "bosbt.42 (at) mail8.example.com")]
    assert added("call +1 (988) 555-2485 or 12.345.6789 or 2024-01-02 03:04") == []
    assert added("988.555.2485 and 988.555.2485") == []


def test_a_label_reaches_any_distance():
    filler = "word " * 20
    text = "call +1 (988) 555-2485 " + "".join(f"{filler} or 988.555.2485 " for _ in range(80))
    assert len(FIELD.added(text, pii.base_spans(text))) == 80


def test_planted_links():
    """Of tokens written otherwise far from what a pattern found, 95 % are added; of numbers and words that aren't like it, 1 % at most."""
    rng = random.Random(21)
    filler = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 120)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    planted = found = alarms = others = 0
    for _ in range(300):
        area, mid, end = str(rng.randint(201, 989)), digits(3), digits(4)
        user, host = "".join(rng.choices("abcdefgh", k=5)) + f".{rng.randint(10, 99)}", "mail8.example.com"
        seen, hidden = rng.choice([
            (f"+1 ({area}) {mid}-{end}", rng.choice([f"{area}.{mid}.{end}", f"{area}-{mid}-{end}", f"({area}) {mid}-{end}", f"{area} {mid} {end}"])),
            (f"{user}@{host}", rng.choice([f"{user} (at) {host}", f"{user}[at]{host}", f"{user} (at) mail8 (dot) example (dot) com"])),
        ])
        unlike = [f"{digits(3)}.{digits(3)}.{digits(4)}", f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 10:{digits(2)}", digits(16), f"v{digits(1)}.{digits(2)}", f"{digits(6)}"]
        parts = [seen, hidden, *unlike]
        rng.shuffle(parts)
        text = " . ".join(f"{filler()} {p}" for p in parts)
        got = {text[a:b] for _, a, b in FIELD.added(text, pii.base_spans(text))}
        planted += 1
        found += hidden in got
        others += len(unlike)
        alarms += len(got - {hidden})
    assert found >= 0.95 * planted and alarms <= 0.01 * others, (found, planted, alarms, others)


def test_fields_are_learned_where_ids_are_alike(spark):
    docs = spark.createDataFrame([(None, "call +1 (988) 555-2485"), (None, "mail a.42@b.example.com")] * 30, "doc_id long, text string")
    assert pii.learn(docs, sample_docs=2).unary.any()


def test_marginals_are_exact_on_a_tree():
    """On a chain, message passing equals summing over all labelings."""
    import itertools

    import numpy as np

    t = "+1 (988) 555-2485 or 988.555.2485, 1234567"
    nodes = pii.nodes_of(t, pii.base_spans(t))
    chains, skips = pii.edges_of(nodes)
    got = FIELD.marginals(nodes)
    local = np.stack([pii.one_hot(n.shape) for n in nodes]) @ FIELD.unary
    want = np.zeros_like(got)
    for labels in itertools.product(range(5), repeat=len(nodes)):
        if any(n.label and n.label != k for n, k in zip(nodes, labels)):
            continue
        score = sum(local[i, k] for i, k in enumerate(labels) if not nodes[i].label)
        score += sum(FIELD.chain[labels[i], labels[j]] for i, j in chains) + sum(FIELD.skip[labels[i], labels[j]] for i, j in skips)
        for i, k in enumerate(labels):
            want[i, k] += np.exp(score)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_personal_rows(spark, odd_docs, no_docs):
    rows = by_id(pii.find_personal(odd_docs))
    assert sum(map(len, rows.values())) == odd_docs.count() and rows[2][0].spans == []
    assert pii.find_personal(no_docs).count() == 0


def test_redact():
    t = "a x@y.zz b +1 (988) 555-2485."
    assert pii.redact(t, pii.base_spans(t)) == "a <email> b <phone>."
