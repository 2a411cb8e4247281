"""Recordings, caches and artifacts. There is no h5py here: trees come from pickles."""

import pickle

import numpy as np
import pytest

from tidelark.operators import trees
from tidelark.sources import artifacts, recordings


def opener(content):
    return pickle.loads(content)


class Stored(np.ndarray):
    """An array that reads like a stored one: x[()] is its values."""


def stored(a):
    return np.asarray(a, float)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("rec")
    nested = {}
    for idx in (4, 1, 3, 0, 2):
        nested[f"subjectA_session1_w{idx}_1"] = {"ppg": stored(np.full((6, 300), 300_000 + idx)), "emg": stored(np.full((2, 3000), idx)), "acc": stored(np.full((3, 300), idx + 0.01))}
    mixed = {"m_w0_1": nested["subjectA_session1_w0_1"], "m_w1_0": nested["subjectA_session1_w1_1"]}
    cut = {"ppg": stored(np.full((2, 6, 300), 300_000)), "emg": stored(np.ones((2, 2, 3000))), "acc": stored(np.full((2, 3, 300), 0.01))}
    long = {"ppg": stored(np.arange(6 * 550).reshape(6, 550)), "emg": stored(np.zeros((2, 4800)))}
    tree = {"subjectA_session1": nested, "mixed": mixed, "sample_1": cut, "long_0": long, "unnamed": cut, "dumb_1": {"ppg": cut["ppg"]}}
    (top / "a.h5").write_bytes(pickle.dumps(tree))
    (top / "b.h5").write_bytes(pickle.dumps({"c_0": {"ppg": stored(np.zeros((300, 6))), "emg": stored(np.zeros((3000, 2)))}}))
    return top


def test_scan(spark, folder):
    rows = recordings.windows(recordings.files(spark, str(folder)), opener).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sample"], []).append(r)
    a = sorted(by["subjectA_session1"], key=lambda r: r.window_index)
    assert [r.window_index for r in a] == [3, 4] and [r.start for r in a] == [300, 400] and [r.window for r in a] == ["subjectA_session1_w3_1", "subjectA_session1_w4_1"]
    assert a[0].ppg[5][0] == 300_003 and len(a[0].emg) == 2 and len(a[0].emg[0]) == 3000 and a[1].acc[0][0] == 4.01 and {r.target for r in a} == {1}
    assert [r.start for r in sorted(by["sample_1"], key=lambda r: r.window_index)] == [0, 300]
    assert {k: by[k][0].reject for k in ("mixed", "unnamed", "dumb_1")} == {"mixed": "invalid_target", "unnamed": "invalid_target", "dumb_1": "no_emg"}
    long = sorted(by["long_0"], key=lambda r: r.start)
    assert [r.start for r in long] == [0, 100, 200] and len(long[2].emg[0]) == 2800 and long[1].ppg[0][0] == 100 and long[0].acc is None
    assert by["c_0"][0].target == 0 and len(by["c_0"]) == 1


def test_broken_files_are_rows_not_failures(spark, tmp_path):
    (tmp_path / "x.h5").write_bytes(b"junk")

    def bad(content):
        raise OSError("no")

    rows = recordings.windows(recordings.files(spark, str(tmp_path)), bad).collect()
    assert [(r["sample"], r.reject) for r in rows] == [(None, "unreadable: OSError")]


def test_shapes():
    assert recordings.has_two_channels((2, 3000)) and recordings.has_two_channels((5, 3000, 2)) and not recordings.has_two_channels((2, 3000, 7)) and not recordings.has_two_channels((2,))
    assert recordings.oriented(np.zeros((6, 300)), 6).shape == (300, 6) and recordings.oriented(np.zeros((4, 6, 300)), 6).shape == (4, 300, 6)
    with pytest.raises(ValueError):
        recordings.oriented(np.zeros((4, 5, 300)), 6)


def test_caches_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1, i, 0.1 * i, 1.0, 0.5) for i in range(4)] + [("c", 0, 0, 0.9, 0.0, 1.0)], "sample string, target int, window_index long, prob_raw double, stage1_enabled double, quality double")
    written = recordings.write_window_caches(df, str(tmp_path / "caches")).collect()
    assert sorted(r.n_windows for r in written) == [1, 4]
    back = recordings.read_window_caches(spark, str(tmp_path / "caches"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert back.where("ood_rate is null").count() == 5
    np.savez(tmp_path / "caches" / "z.npz", prob_raw=[1.0])
    with pytest.raises(Exception, match="lacks stage1_enabled, target"):
        recordings.read_window_caches(spark, str(tmp_path / "caches")).count()


def test_names(spark):
    assert recordings.safe_name("a b/c:d") == "a_b_c_d" and recordings.safe_name("///") == "sample"
    df = spark.createDataFrame([("a b/c:d",), ("///",)], "n string")
    assert [r[0] for r in df.select(recordings.safe_name_column("n")).collect()] == ["a_b_c_d", "sample"]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for name, frame in (("full", df), ("empty", df.where("false"))):
        artifacts.write_csv(frame, str(tmp_path / name))
        back = artifacts.read_csv(spark, str(tmp_path / name), "a int, b string")
        assert back.columns == ["a", "b"] and back.count() == frame.count()
    assert any("a,b" in p.read_text() for p in (tmp_path / "empty").glob("*.csv"))
    artifacts.write_json(spark, '{"k": 1}', str(tmp_path / "j"))
    assert artifacts.read_json(spark, str(tmp_path / "j")) == '{"k": 1}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(b"abc")
    assert artifacts.fingerprint(spark, str(tmp_path / "in"))["inputs"]["f.bin"].startswith("ba7816bf")
    model = trees.Ensemble([trees.Tree([trees.Split("x", 1.0, 1, 2, 1, 0.5, 3.0), trees.Leaf(0.1, 2.0), trees.Leaf(-0.1, 1.0)])])
    rows = [r.asDict() | {"Feature": r["FeatureName"]} for r in artifacts.node_table(spark, model).collect()]
    assert trees.from_rows(rows) == model


def test_deploy_package(spark, tmp_path):
    from tidelark.sources import deploy

    model = trees.Ensemble([trees.Tree([trees.Split("PPG_mean", 1.0, 1, 2, 1), trees.Leaf(0.1), trees.Leaf(-0.1)])])
    bundle = artifacts.Bundle(["PPG_mean"], {"PPG_mean": 0.5}, {"PPG_mean": (0.0, 1.0)}, model, 0.4)
    names = deploy.export(spark, bundle, (0.0, 1.0), str(tmp_path / "d"))
    assert len(names) == 7 and all((tmp_path / "d" / n).exists() for n in names)
    assert artifacts.Bundle.from_json(artifacts.read_json(spark, str(tmp_path / "d" / "bundle.json"))) == bundle
    bundle.features = ["nothing"]
    with pytest.raises(ValueError):
        deploy.export(spark, bundle, (0.0, 1.0), str(tmp_path / "e"))
