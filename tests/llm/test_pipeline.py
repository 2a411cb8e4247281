import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from tests.llm.test_spans import plain_personal  # noqa: E402
from tests.llm.test_tables import plain_fingerprint, union_find, words8  # noqa: E402
from tests.llm.test_text import check_packing  # noqa: E402
from tidelark.llm import stages  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "1234 5678", "en", "s", 9), (10**6 + 2, "", "en", "s", 0)], docs.schema))
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stages.staged(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "packing"]
    for df in results[1:-1]:
        assert df.dtypes == results[0].dtypes


def test_language_keeps_all_texts_with_letters(results):
    before, after = texts(results[0]), texts(results[1])
    assert set(before) - set(after) == {10**6, 10**6 + 1, 10**6 + 2}


def test_one_of_each_group_stays(results):
    before, after = texts(results[1]), texts(results[2])
    group = union_find([(i, plain_fingerprint(t)) for i, t in before.items()])
    assert set(after) == set(group.values())


def test_benchmark_documents_go(spark, results):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words8(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {i for i, t in texts(results[2]).items() if not any(tuple(w[k : k + n]) in windows for w in [words8(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert set(texts(results[3])) == clean and len(clean) < results[2].count()


def test_personal_data_are_replaced(results):
    before, after = texts(results[3]), texts(results[4])
    assert set(before) == set(after)
    for i, t in before.items():
        if plain_personal(t):
            assert not plain_personal(after[i])
        else:
            assert after[i] == t
    assert all(r.n_chars == len(r.text) for r in results[4].collect() if r.text != before[r.doc_id])


def test_packing_is_whole(results):
    check_packing(results[5].collect(), texts(results[4]), 1024)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_one_of_each_with_repeated_and_missing_ids(spark):
    rng = random.Random(1)
    t = [" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(30)) for _ in range(4)]
    docs = spark.createDataFrame([(1, t[0], "x"), (1, t[0], "x"), (2, t[0], "x"), (3, t[1], "x"), (None, t[2], "x"), (None, t[2], "x"), (4, t[3], "x")], "doc_id long, text string, root string")
    kept = stages.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]  # copies without an id are one group as well


def test_one_row_of_each_group_stays_where_an_id_names_several_texts(spark):
    rng = random.Random(2)
    t = [" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(30)) for _ in range(6)]
    rows = [(1, t[0], "x"), (1, t[1], "x"), (1, t[1], "y"), (1, t[2], "x"), (2, t[0], "x"), (3, t[1], "x"), (2, t[3], "x"), (3, t[3], "x"), (4, t[4], "x"), (4, t[4], "x"), (4, t[5], "x")]
    kept = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id long, text string, source string").repartition(parts)
        kept.append(sorted((r.doc_id, r.text, r.source) for r in stages.keep_one_of_each(docs).collect()))
    assert kept[0] == kept[1]
    assert sorted((i, x) for i, x, _ in kept[0]) == sorted([(1, t[0]), (1, t[1]), (1, t[2]), (2, t[3]), (4, t[4]), (4, t[5])])


CLASHING = ["n_words", "n_hit", "item_ids", "component_id", "fp", "id", "part", "rank", "_key", "n", "spans", "lang_pred", "count"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "no id but words in a text", None, None, 3), (10**6 + 2, "call +1 (988) 555-2485 " + "word " * 40_000, "en", "s", 7)], docs.schema))
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, stages.F.lit(700 + i))
    return stages.staged(docs, "clashing")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns_and_take_empty_tables(spark, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, clashing, SF).collect()
    empty = stage(spark, clashing.where("false"), SF)
    assert rows and empty.count() == 0
    if name != "packing":
        assert empty.columns == clashing.columns
        assert all([r[c] for c in CLASHING] == list(range(700, 700 + len(CLASHING))) for r in rows)


def test_no_setting_differs_after_a_stage_and_nothing_is_left(spark, clashing):
    before, held = dict(spark.conf.getAll), set(stages.staged_paths())
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, clashing, SF).count()
    assert dict(spark.conf.getAll) == before
    stages.release(set(stages.staged_paths()) - held)
    assert set(stages.staged_paths()) == held


def test_run_deletes_what_it_no_longer_reads(spark):
    held = set(stages.staged_paths())
    out = corpus_pipeline.run(spark, SF)
    assert len(set(stages.staged_paths()) - held) == 1 and out.count() > 100


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    from tidelark import session

    class Far:
        master = "spark://far:7077"

    class Other:
        sparkContext = Far()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Other())
