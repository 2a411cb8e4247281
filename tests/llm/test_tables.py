import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import by_id
from tidelark.llm import decontaminate, nearest, simhash, url_filter
from tidelark.llm.url_filter import Rule


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


@pytest.mark.parametrize("limit", [0, url_filter.BROADCAST_RULES])
def test_urls_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rng = random.Random(2)
    hosts = ["com", "example.com", "A.Example.COM", "net", "x.example.net", "notexample.com", "", "org.", "a.b.c.d.org", "é.com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/70x", "/de/8", "/de/", "/es/?q", "/es#f", "/a?b://c"]
    urls = [rng.choice(["http://", "https://", "", "x"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(300)] + [None, "", "://", "a://b?c/d"]
    pages = spark.createDataFrame([(i if i % 7 else None, u, "r") for i, u in enumerate(urls)] + [(1, urls[1], "r")] * 3, "page_id long, url string, rule string")
    for rules in (url_filter.RULES, [], [*url_filter.RULES, Rule("block", "example.com", ""), Rule("allow", "com", "/en/7"), Rule("block", "example.com", "/en/7"), Rule("block", "", "/x")]):
        got = sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
        want = [brute_url(u, [r for r in rules if r.host]) for u in urls]
        want = sorted([(i if i % 7 else -1, h, p, r or "", v) for i, (h, p, r, v) in enumerate(want)] + [(1, *(x or "" for x in want[1]))] * 3)
        assert got == want
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_urls_meet_rules_by_prefix_alone(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    plan = url_filter.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [prefix#" in plan and "SortAggregate" not in plan
    assert all("digest" not in keys for keys in re.findall(r"HashJoin (\[[^\]]*\], \[[^\]]*\])", plan))
    # Rules whose prefixes collide are told apart by their full digests.
    monkeypatch.setattr(url_filter, "PREFIX_BYTES", 0)
    test_urls_against_brute_force(spark, monkeypatch, 50_000)


def words8(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_benchmark_against_brute_force(spark, words, block_bytes):
    rng = random.Random(4)
    few = words[:12]  # many windows share words
    items = [(i, " ".join(rng.choices(few if i % 2 else words, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(40)]
    items += [(40, None), (41, " .,"), (None, "a b c"), (None, " ".join(words[20:31])), (3, "other TEXT-of the same id"), (43, "É日 ñ"), (44, items[0][1])]
    docs = []
    for i in range(300):
        w = rng.choices(few if i % 3 == 0 else words, k=rng.randint(0, 60))
        if rng.random() < 0.4 and (t := rng.choice(items)[1]):
            part = t.split()
            cut = rng.choice([0, 0, 1])
            at = rng.randint(0, len(w))
            w[at:at] = part[: len(part) - cut]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).title() if i % 2 else " ".join(w)))
    docs += [(903, " ".join(words[18:40])), (900, None), (901, ""), (902, "é日 ñ"), (902, "É日 ñ"), (None, docs[0][1])]
    windows = {}
    for i, t in items:
        w = words8(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).update({i} - {None})
    want = []
    for i, t in docs:
        w, hit, named = words8(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    named |= windows[x]
        want.append((-1 if i is None else i, len(w), len(hit), sorted(named)))
    a = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, n_hit int, item_ids int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_benchmark(a, b, block_bytes=block_bytes).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(want)
    assert sum(1 for x in want if x[2]) > 60
    carried = decontaminate.find_benchmark(a, b, block_bytes=block_bytes, carry=True)
    assert carried.columns == ["doc_id", "text", "n_words", "n_hit", "item_ids"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in carried.collect()) == sorted(want)
    assert decontaminate.find_benchmark(a.where("false"), b).count() == 0
    assert {r.n_hit for r in decontaminate.find_benchmark(a, b.where("false")).collect()} == {0}


def plain_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def test_fingerprints(words):
    rng = random.Random(8)
    for t in [None, "", " \t", "One", "one two", "A b C", "É à ß x y", "a\x1cb c\x85d e", *(" ".join(rng.choices(words, k=50)) for _ in range(20))]:
        assert simhash.fingerprint(t.encode() if t is not None else None) & (1 << 64) - 1 == plain_fingerprint(t), t


def union_find(fps):
    least = {}
    for i, f in fps:
        if f not in least or i < least[f]:
            least[f] = i
    keys = sorted(least)
    root = {f: f for f in keys}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    group = {}
    for f in keys:
        group.setdefault(top(f), []).append(least[f])
    return {f: min(group[top(f)]) for f in keys}


def test_components_of_clusters_and_chains(spark, monkeypatch):
    rng = random.Random(6)
    fps = []
    for _ in range(6):  # chains, two bits a step, and clusters around a centre
        x = rng.getrandbits(64)
        for _ in range(25):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(x)
        centre = rng.getrandbits(64)
        fps += [centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for _ in range(60)]
        centre = rng.getrandbits(64)  # a large posting: they differ in two bytes alone
        fps += [centre ^ rng.getrandbits(16) for _ in range(150)]
    fps += [0, 0, 3, (1 << 64) - 1]
    want = union_find(list(enumerate(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    edges = simhash.staged(simhash.links(table), "links")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(roots.get(f, f), []).append(i)
    got = {fps[i]: min(g) for g in groups.values() for i in g}
    assert got == want
    assert len(set(want.values())) < len(set(fps)) * 0.7


def test_pairs_of_postings_against_brute_force(monkeypatch):
    rng = random.Random(9)
    for pairs in (1 << 20, 64):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        sizes = [rng.choice([1, 1, 2, 3, 3, 7, 30]) for _ in range(60)]
        centres = [rng.getrandbits(64) for _ in sizes]
        members = [c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for c, n in zip(centres, sizes) for _ in range(n)]
        want, at = set(), 0
        for n in sizes:
            want |= {(i, j) for i in range(at, at + n) for j in range(i + 1, at + n) if (members[i] ^ members[j]).bit_count() <= 2}
            at += n
        got = simhash.matches(np.array(members, np.uint64), np.array(sizes))
        assert set(zip(*(x.tolist() for x in got))) == want and len(want) > 100


@pytest.mark.parametrize("positions", range(1, 7))
def test_any_pair_that_qualifies_meets(positions):
    """Of any n + 2 positions two can differ, so each pair within two bits has a key in common, and its own alone."""
    rng, mask = random.Random(positions), (1 << 64) - 1
    of = lambda x: {(x & m & mask) ^ (s & mask) for m, s in simhash.choices(positions)}
    for _ in range(300):
        x = rng.getrandbits(64)
        assert of(x) & of(x ^ (1 << rng.randrange(64) | 1 << rng.randrange(64)))
    assert [simhash.positions_for(n) for n in (0, 1, 8192, 8193, 2**21, 2**29 + 1, 2**60)] == [1, 1, 1, 2, 2, 4, 6]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_large_postings_are_indexed_anew(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(simhash, "HOT", 3)
    rng = random.Random(16)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = simhash.staged(spark.createDataFrame([(f,) for f in signed], "fp long"), "fps")
    roots = {r.node: r.root for r in simhash.components(simhash.staged(simhash.links(table, large=16), "links")).collect()}
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(roots.get(f, f), []).append(i)
    assert {fps[i]: min(g) for g in groups.values() for i in g} == union_find(list(enumerate(fps)))


def test_hot_fingerprints_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    docs = [(i, "the same text here") for i in range(40)] + [(100 + i, f"text number {i} of some others") for i in range(20)] + [(200, None)] * 9
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = union_find([(i, plain_fingerprint(t)) for i, t in docs])
    assert got == {i: want[plain_fingerprint(t)] for i, t in docs}


def test_near_duplicates_against_brute_force(spark, words, odd_docs, no_docs):
    rng = random.Random(7)
    docs = []
    for i in range(120):
        w = rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 300]))
        docs.append((i, " ".join(w)))
        for j in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            if v and j:
                v[rng.randrange(len(v))] = rng.choice(words)
            docs.append((len(docs) + 1000, " ".join(v)))
    want = union_find([(i, plain_fingerprint(t)) for i, t in docs])
    rng.shuffle(docs)
    got = simhash.near_duplicates(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, component_id int, root int")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: want[plain_fingerprint(t)] for i, t in docs}
    rows = by_id(simhash.near_duplicates(odd_docs))
    assert {rows[i][0].component_id for i in (2, 3, 4)} == {2} and len(rows[7]) == 2 and rows[7][0].component_id == 1
    assert rows[None][0].component_id in (None, 2)
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_nearest(vectors, k):
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 10 == 0:
            far = sorted({(float(np.sqrt(((u - v) ** 2).sum())), j) for j, u in ok if j != i and len(u) == len(v)})
            out[i] = far[:k]
    return out


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(5000 + i, base[1].tolist()) for i in range(60)]  # many copies: ties go to the smaller id
    vectors += [(6000, None), (6010, []), (6020, [0.0] * 16), (6030, [float("nan")] * 16), (6040, [float("inf")] + [1.0] * 15), (6050, [None] + [1.0] * 15), (None, base[2].tolist())]
    vectors += [(6060, [1.0, 2.0]), (6061, [1.0, 3.0]), (6062, [0.5, 3.0]), vectors[0], vectors[10]]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in vectors], "vec_id long, embedding array<float>, score double, rank int")
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 10 = 0"), shard_rows=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute_nearest(vectors, 10)
    assert set(got) == set(want)
    hit = total = 0
    for q, rows in got.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, len(rows) + 1)) and len(rows) == len(want[q])
        near = dict((j, d) for d, j in want[q])
        hit += sum(1 for _, _, j in rows if j in near)
        total += len(near)
        assert [(s, j) for _, s, j in sorted(rows)] == sorted((s, j) for _, s, j in rows)
    assert hit / total > 0.95
    assert [j for _, _, j in sorted(got[5000])] == [1, *range(5001, 5010)]
    assert [j for _, _, j in sorted(got[6060])] == [6061, 6062]
    assert nearest.nearest(df.where("false"), df.where("false")).count() == 0


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "vec_id long, embedding array<double>")
    rows = lambda: sorted(map(tuple, nearest.nearest(df, df.where("vec_id % 10 = 0"), shard_rows=300).collect()))
    whole = rows()
    monkeypatch.setattr(nearest, "QUERY_BYTES", 8 * 8 * 25)
    assert rows() == whole and len(whole) == 900


def test_neither_queries_nor_graphs_are_shuffled(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id long, embedding array<double>")
    plan = nearest.nearest(df, df.where("vec_id % 10 = 0"), shard_rows=100)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert len(exchanges) == 2 and exchanges[0].startswith("query_id") and exchanges[1].startswith("dim") and "CoGroup" not in plan


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
