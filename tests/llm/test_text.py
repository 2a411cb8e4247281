import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import by_id
from tidelark.llm import html_text, language, packing, token_count

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
TEXTS = st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["the ", " and", "'ll", "<|endoftext|>", "  ", "\n\n", "12", "é", "½", "　", "\x1c", "\x85"])), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_and_ids_are_the_library_s(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert token_count.counter(JSON)(text) == len(ids)
    assert list(packing.encoder(JSON)(text)) == ids


def test_counts_of_long_pieces():
    assert token_count.counter(JSON)("ab1" * 20_000) == len(LIBRARY.encode("ab1" * 20_000).ids)
    assert token_count.counter(JSON)("a" * 50_001) == len(LIBRARY.encode("a" * 50_001).ids)


def test_count_rows(odd_docs, no_docs):
    rows = by_id(token_count.count_tokens(odd_docs, JSON))
    assert [(r.n_bytes, r.n_tokens) for r in rows[2]] == [(0, 0)] and len(rows[7]) == 2 and len(rows[None]) == 2
    assert rows[8][0].n_bytes == len("É日本語 ñandú".encode())
    assert token_count.count_tokens(no_docs, JSON).count() == 0


def check_packing(rows, texts, capacity):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        assert sum(r.length for r in mine) == len(ids) and all(r.length == capacity for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_round_trip(spark, words, no_docs):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 20, 60, 120, 900]))) for i in range(400)} | {1000: None, 1001: ""}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, part string")
    rows = packing.pack(docs, JSON, capacity=256, with_ids=True).collect()
    used = check_packing(rows, texts, 256)
    total = sum(r.length for r in rows)
    assert used <= 1.03 * total / 256 + 1
    for r in rows[:50]:
        assert len(r.ids) == r.length
    assert packing.pack(no_docs, JSON).count() == 0


def test_packing_odd_rows(odd_docs):
    rows = packing.pack(odd_docs, JSON).collect()
    assert sum(1 for r in rows if r.doc_id == 7) == 2
    assert {r.length for r in rows if r.doc_id in (2, 3)} == {1}


def test_plans_place_every_piece():
    rng = random.Random(9)
    for case in range(60):
        capacity = rng.choice([16, 64, 1024])
        counts = {n: rng.randint(1, 10 ** rng.randint(0, 3)) for n in rng.sample(range(1, capacity + 1), rng.randint(0, min(40, capacity)))}
        plan, n = packing.make_plan(dict(counts), capacity)
        placed = {}
        for length, first, m, sequence, offset in plan.tolist():
            assert first == placed.get(length, 0) and offset + length <= capacity and sequence + m <= n
            placed[length] = first + m
        assert placed == counts
        assert n <= 1.05 * best_fit(counts, capacity) + 2


def test_configurations_are_the_optimum():
    """Against a search over all multisets: at integral optima nothing is left over, and the value is the bound's."""
    rng = random.Random(4)
    for _ in range(20):
        capacity = rng.choice([20, 30, 50])
        sizes = sorted(rng.sample(range(capacity // 4 + 1, capacity), rng.randint(1, 6)), reverse=True)
        wanted = [rng.randint(1, 400) for _ in sizes]
        used = packing.configurations(sizes, wanted, capacity)
        held = [sum(n * slots.count(s) for n, slots in used) for s in sizes]
        assert all(sum(slots) <= capacity for _, slots in used) and all(h <= w for h, w in zip(held, wanted))
        # Weak duality: no prices under which every multiset costs one at most can be worth more than the plan.
        sets = [x for k in range(1, 4) for x in itertools.combinations_with_replacement(sizes, k) if sum(x) <= capacity]
        for _ in range(20):
            price = np.array([rng.random() for _ in sizes])
            price /= max(sum(price[sizes.index(s)] for s in x) for x in sets)
            assert sum(n for n, _ in used) + len(sizes) >= float(price @ wanted) - 1e-6
        assert sum(w - h for w, h in zip(wanted, held)) <= 4 * len(sizes)


def test_few_sizes_pack_nearly_as_tight_as_tokens_allow():
    """A broad histogram: within 0.2 % of the sum of tokens."""
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(5.6, 0.9, 60_000).astype(int) + 1, 1, 1024)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    _, n = packing.make_plan(counts, 1024)
    assert n <= 1.002 * -(-int(lengths.sum()) // 1024)


def best_fit(counts, capacity):
    """Sequences that best fit takes, piece by piece."""
    room, n = [0] * (capacity + 1), 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            free = next((r for r in range(size, capacity + 1) if room[r]), None)
            if free is None:
                n, free = n + 1, capacity
            else:
                room[free] -= 1
            room[free - size] += 1
    return n


def test_language_held_out_accuracy(spark, no_docs, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(language.is_held_out(F.col("doc_id"))).collect()
    assert len(found) > 150 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    rows = by_id(language.identify(odd_docs))
    assert {rows[i][0].lang_pred for i in (2, 3, 4, 5)} == {"und"} and len(rows[7]) == 2
    assert language.identify(no_docs).count() == 0


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "hidden letters", "xx") for i in ids], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}


def test_mixture_recovers_proportions():
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.full(language.BUCKETS, 0.01), size=3).T + 1e-9).astype(np.float32)
    truth = [0] * 70 + [2] * 30
    like = np.stack([logs[rng.choice(language.BUCKETS, 12, p=np.exp(logs[:, k]) / np.exp(logs[:, k]).sum())].sum(0) for k in truth]).astype(float)
    share = language.mixture(np.concatenate([like, like[:70]]), np.repeat([0, 1], [100, 70]), 2)
    assert np.allclose(share[0], [0.7, 0, 0.3], atol=0.02) and np.allclose(share[1], [1, 0, 0])


def brute_mixture(like, penalty=language.PENALTY, rounds=language.ROUNDS):
    """One document: expectation-maximisation over every subset of languages."""
    best, out = -np.inf, None
    like = like - like.max(axis=1, keepdims=True)
    for k in range(1, like.shape[1] + 1):
        for chosen in itertools.combinations(range(like.shape[1]), k):
            p, share = np.exp(like[:, chosen]), np.full(k, 1 / k)
            for _ in range(rounds):
                part = share * p
                share = (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
            value = np.log(np.maximum((share * p).sum(axis=1), 1e-300)).sum() - penalty * 0.5 * k * np.log(len(like) + 1)
            if value > best + 1e-9:
                best, out = value, dict(zip(chosen, share))
    return [out.get(i, 0.0) for i in range(like.shape[1])]


def test_mixture_against_all_subsets():
    rng = np.random.default_rng(5)
    docs, want = [], []
    for _ in range(150):
        n, n_langs, k = rng.integers(1, 60), 5, rng.integers(1, 4)
        truth = rng.choice(rng.choice(n_langs, k, replace=False), n)
        like = rng.normal(-40, 3, (n, n_langs))
        like[np.arange(n), truth] += rng.normal(6, 3, n)
        docs.append(like)
        want.append(brute_mixture(like))
    got = language.mixture(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), len(docs))
    same = [np.allclose(g, w, atol=1e-6) for g, w in zip(got, want)]
    assert np.mean(same) >= 0.99 and sum(np.count_nonzero(w) > 1 for w in want) > 40


def test_a_second_language_need_not_be_second_alone():
    """Language 1 is second by itself, as it is like 0; the other half of the document is written in 2."""
    like = np.full((40, 3), -60.0)
    like[:, 0], like[:, 1] = -50, -51
    like[20:, 0], like[20:, 1], like[20:, 2] = -58, -57, -50
    like[:20, 2] = -75
    assert like.sum(axis=0).argsort().tolist()[0] == 2
    assert np.allclose(language.mixture(like, np.zeros(40, int), 1), [[0.5, 0, 0.5]], atol=1e-3)


def test_languages_are_learned_from_rows_with_like_or_missing_ids(spark):
    rows = [(None, "der hund und die katze", "de"), (None, "the dog and the cat", "en")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = language.learn(docs, sample_docs=3)
    assert langs == ["de", "en"] and language.predict(["und die katze", "and the cat"], langs, logs)[0] == ["de", "en"]


def test_html_layout():
    t = html_text.extract("<head><title>no</title></head><body>a<ul><li>one<li>two<ol start=3><li>x<li>z</ol></ul>tail<p hidden>no<p>yes &amp; <b>bold</b> text<br>line<div style='display: none'>no</div><script>no</script>")
    assert t == "a\n\n- one\n- two\n  3. x\n  4. z\n\ntail\n\nyes & bold text\nline"
    assert html_text.extract("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>") == "Name  | N\nalpha | 1"
    assert html_text.extract("1 < 2 &lt; 3 <!-- never closed") == "1 < 2 < 3"
    assert html_text.extract("<pre> a\n  b</pre>") == " a\n  b"


def test_html_hostile():
    """A megabyte takes under five seconds; a quarter of one under two, of whatever is repeated."""
    parts = ["<", "<!--", "<a ", '<a b="', "<a b='\"", "<div>", "<p>", "</p>", "<li>", "<table><tr><td>", "<table>", "<ul><li>", "<blockquote>a", "<td colspan=1000>x", "<svg ====\"/>", "<math><mi>", "<tr>", "<b><p>", "&#11111111111111111111"]
    for part in parts:
        size, bound = (1_000_000, 5) if part in ("<a ", '<a b="', "<div>") else (250_000, 2)
        took = time.process_time()
        html_text.extract(part * (size // len(part)) + "end")
        assert time.process_time() - took < bound, part


def test_html_hides_at_any_depth():
    for depth in (1, 100, 600, 5000):
        for opening in ("<div>", "<table><tr><td>", "<ul><li>", "<blockquote>"):
            assert html_text.extract(opening * depth + "<p hidden>SECRET</p><noscript>NO</noscript>yes").split()[-1:] == ["yes"]
            assert not {"SECRET", "NO"} & set(html_text.extract(opening * depth + "<p hidden>SECRET</p><noscript>NO</noscript>yes").split())
    assert html_text.extract("<table><tr><td>a<td>b" + "<table><tr><td>c<td>" * 50 + "d" + "</table>" * 51) == "a | b" + " c |" * 50 + " d"


def random_tree(rng, depth, words, inside="flow"):
    """Markup and its visible words, by a recursion of its own."""
    if depth == 0 or rng.random() < 0.2:
        w = f"w{next(words)}"
        return f" {w} ", [w]
    if inside == "inline":
        name = rng.choice(["b", "span", "em", "hidden"])
    else:
        name = rng.choice(["b", "div", "p", "ul", "ol", "table", "blockquote", "hidden", "none", "section"])
    if name in ("hidden", "none"):
        inner, _ = random_tree(rng, depth - 1, words, inside)
        return (f"<span hidden>{inner}</span>" if inside == "inline" else f"<div style='color: red; display:none'>{inner}</div>"), []
    if name == "table":
        n, rows, seen = rng.randint(1, 3), "", []
        for _ in range(rng.randint(1, 3)):
            cells = [random_tree(rng, depth - 1, words) for _ in range(n)]
            rows += "<tr>" + "".join(f"<td>{m}" + rng.choice(["</td>", ""]) for m, _ in cells) + rng.choice(["</tr>", ""])
            seen += [w for _, x in cells for w in x]
        return f"<table>{rows}</table>", seen
    parts = [random_tree(rng, depth - 1, words, "inline" if inside == "inline" or name in ("p", "b") else "flow") for _ in range(rng.randint(1, 4))]
    if name in ("ul", "ol"):
        return f"<{name}>" + "".join(f"<li>{m}" + rng.choice(["</li>", ""]) for m, _ in parts) + f"</{name}>", [w for _, x in parts for w in x]
    return f"<{name}>" + "".join(m for m, _ in parts) + f"</{name}>", [w for _, x in parts for w in x]


def test_html_words_of_random_trees():
    rng = random.Random(12)
    for _ in range(800):
        markup, want = random_tree(rng, rng.randint(1, 6), itertools.count())
        got = [w for w in html_text.extract(markup).split() if w.startswith("w")]
        assert got == want, markup


def test_html_tags_are_read_as_browsers_do():
    of = html_text.extract
    assert of("<p it's>a</p><p title='x > y'>b</p>") == "a\n\nb"
    assert of("a <!--> b <!-- c --!> d </> e </?x> f <3 g") == "a b d e f <3 g"
    assert of("<script>if (a </scripty> b) {}</script>x<style>y</STYLE >z") == "xz"
    assert of("x <a href=y") == "x" and of('x <a href="y>z</a> w') == "x z w"
    assert of("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"


def test_html_wide_cells_and_deep_indents_lose_nothing():
    wide = "x" * 5000
    assert html_text.extract(f"<table><tr><td>{wide}<td>b<tr><td>a<td>c</table>").split() == [wide, "|", "b", "a", "|", "c"]
    assert html_text.extract("<blockquote>" * 300 + "deep").strip() == "deep"


def test_html_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>", "a", 2)], "page_id long, html string, text string, id int")
    assert [tuple(r) for r in html_text.html_text(pages).collect()] == [(1, "x")]
    assert html_text.html_text(pages.where("false")).count() == 0


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, 0), (None, "<p>x", 1), (2, "", 2), (2, "", 2)], "page_id long, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in html_text.html_text(pages).collect()) == [(0, "x"), (1, ""), (2, ""), (2, "")]


def test_html_tables_with_open_colgroups_and_captions():
    for rows in ("<tr><td>text", "<tbody><tr><td>text", "<thead><tr><th>text", "<tfoot><tr><td>text", "<td>text", "<th>text"):
        assert html_text.extract(f"<table><colgroup><col>{rows}</table>") == "text"
        assert html_text.extract(f"<table><colgroup><col><colgroup>{rows}</table>") == "text"
        assert html_text.extract(f"<table><caption>c{rows}</table>") == "c\ntext"
    assert html_text.extract("<table><colgroup><col><caption>c<tr><td>a<td>b</table>z") == "c\na | b\n\nz"
    assert html_text.extract("<table><colgroup><col>loose <b>words</b><tr><td>t</table>") == "loose\nwords\nt"


def test_html_text_of_controls_drawings_and_formulas():
    of = html_text.extract
    assert of("a<textarea rows=2>\none &amp;\n  two</textarea>b") == "a\none &\n  two\nb"
    assert of("a<select><option>x<option selected>y<optgroup label=G><option label=Z>no</select>b") == "a\nx\ny\nG\nZ\nb"
    assert of("so <math><mi>x</mi><mo>=</mo><mn>7</mn><annotation>no</annotation></math> holds") == "so x=7 holds"
    assert of("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>") == "1 2"
    assert of("<p>see <svg><title>no</title><path d=x /><defs><text>no</text></defs><g>no<text x=1>Label <tspan>one</tspan></text><text>two</text></g></svg> end") == "see\nLabel one\ntwo\nend"
    assert of("<svg><foreignObject><div>in</div></foreignObject></svg><svg><title/><text>on</text></svg>") == "in\non"
    assert of("<svg><path d=1><p>after</p>tail") == "after\n\ntail"
    assert of("<datalist><option>no</datalist><svg hidden><text>no</text></svg>yes") == "yes"
