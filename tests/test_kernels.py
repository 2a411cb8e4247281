"""Signal kernels against known responses, and array functions against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelark.functions import arrays as A
from tidelark.functions import features as X
from tidelark.functions import kernels as K

T = np.arange(3000) / 1000


def response(b, a, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


@pytest.mark.parametrize(("kind", "order", "cuts", "fs"), [("band", 4, (0.4, 6.0), 100), ("high", 2, (20.0,), 1000), ("stop", 2, (49.8, 50.2), 1000), ("low", 3, (10.0,), 100)])
def test_filters_are_3_db_down_at_their_cuts(kind, order, cuts, fs):
    b, a = K.butterworth(order, tuple(2 * c / fs for c in cuts), kind)
    for c in cuts:
        assert response(b, a, c, fs) == pytest.approx(np.sqrt(0.5), rel=1e-5)
    assert np.abs(np.roots(a)).max() < 1


def test_notch():
    b, a = K.notch(50.0, 100.0, 1000.0)
    assert response(b, a, 50, 1000) < 1e-9 and response(b, a, 60, 1000) == pytest.approx(1, abs=1e-3)


def test_zero_phase_keeps_what_passes_and_constants():
    x = np.sin(2 * np.pi * 1.5 * np.arange(1000) / 100)[None] + 1000
    y = K.band_pass(x, 100.0, 0.4, 6.0, 2)
    assert np.abs(y[0, 200:800] - (x[0, 200:800] - 1000)).max() < 0.02
    assert np.allclose(K.both_ways(*K.butterworth(3, (0.2,), "low"), np.full((2, 200), 7.0)), 7.0)
    assert np.array_equal(K.high_pass(x[:, :12], 100.0, 20.0), x[:, :12])


def test_chain_removes_400_hz():
    x = np.random.default_rng(123).normal(0, 1, 3000) + 80 * np.sin(2 * np.pi * 400 * T)
    _, clean = X.preprocessed_muscle(x[None])
    power = lambda v: (lambda f, p: p[:, (f >= 395) & (f <= 405)].sum())(*K.welch(v, 1000.0, 512))
    assert power(clean) < 0.1 * power(x[None])


def muscle(x, other=None):
    rng = np.random.default_rng(1)
    emg = np.stack([x, x if other is None else other], axis=-1)[None]
    return {k: v[0] for k, v in X.extract(rng.normal(50_000, 4000, (1, 300, 6)), emg, rng.normal(0, 1, (1, 300, 3))).items()}


def test_leak_mains_and_clean_bands():
    rng = np.random.default_rng
    assert muscle(rng(42).normal(0, 1, 3000) + 50 * np.sin(2 * np.pi * 100 * T))["EMG0_LEAK_100_RATIO"] > 0.1
    base = rng(11).normal(0, 0.5, 3000)
    a, b = muscle(base + 20 * np.sin(2 * np.pi * 120 * T)), muscle(base + 20 * np.sin(2 * np.pi * 100 * T))
    for k in ("CLEAN_105_145_RATIO", "CLEAN_TO_NOISE_RATIO"):
        assert a[f"EMG0_{k}"] > 5 * b[f"EMG0_{k}"]
    quiet = rng(5).normal(0, 1, 3000)
    assert muscle(quiet + 20 * np.sin(2 * np.pi * 49.6 * T))["EMG0_40_60HZ_RATIO"] > 5 * muscle(quiet)["EMG0_40_60HZ_RATIO"]


def test_missing_signals_are_zero_and_all_names_are_there():
    ppg = np.random.default_rng(7).normal(50_000, 4000, (2, 300, 6))
    f = X.extract(ppg)
    assert list(f) == [*X.NAMES, X.INVALID] and len(X.NAMES) == 241
    assert all((v == 0).all() for k, v in f.items() if k.startswith(("EMG", "ACC")))
    one = X.extract(ppg, np.random.default_rng(1).normal(0, 1, (2, 3000, 1)))
    assert (one["EMG1_RMS"] == 0).all() and (one["EMG0_RMS"] > 0).all() and (one["EMG_consensus_RMS_min"] == 0).all()
    with pytest.raises(ValueError):
        X.extract(ppg[:, :50])


def test_batches_don_t_mix_windows():
    rng = np.random.default_rng(17)
    ppg, emg, acc = rng.normal(50_000, 4000, (3, 300, 6)), rng.normal(0, 1, (3, 3000, 2)), rng.normal(0, 1, (3, 300, 3))
    whole = X.extract(ppg, emg, acc)
    for i in range(3):
        alone = X.extract(ppg[i : i + 1], emg[i : i + 1], acc[i : i + 1])
        for k in whole:
            assert alone[k][0] == pytest.approx(whole[k][i], rel=1e-9, abs=1e-12), k


def test_sine_pulse_is_found():
    beat = 2000 * np.sin(2 * np.pi * 1.25 * np.arange(300) / 100)
    f = X.extract(np.repeat((100_000 + beat)[None, :, None], 6, axis=2))
    assert f["PPG_DOM_FREQ"][0] == pytest.approx(1.25, abs=0.2)
    assert f["PPG_ch_bp_corr_min"][0] == pytest.approx(1) and f["PPG_ch_imbalance_mean"][0] == pytest.approx(0, abs=1e-9)


def test_peaks_and_prominences():
    x = np.array([0, 2, 2, 2, 0, 5, 1, 3, 0.0])
    at = K.peaks(x)
    assert at.tolist() == [2, 5, 7] and K.prominences(x, at).tolist() == [2, 5, 2]
    assert K.spaced(x, at, 3).tolist() == [2, 5]


def test_welch_conserves_power_and_coherence_of_itself_is_one():
    x = np.random.default_rng(0).normal(0, 2, (4, 8192))
    f, p = K.welch(x, 1000.0, 512)
    assert p.sum(axis=1) * (f[1] - f[0]) == pytest.approx(np.full(4, 4.0), rel=0.1)
    assert np.allclose(K.coherence(x, 3 * x, 1000.0, 512)[1], 1)


def test_moving_average_and_median_shrink_at_the_edges():
    x = np.full((1, 9), 3.0)
    assert K.moving_average(x, 3)[0].tolist() == pytest.approx([2, *[3] * 7, 2])
    assert K.moving_average(np.arange(6.0)[None], 2)[0].tolist() == np.convolve(np.arange(6.0), [0.5, 0.5], "same").tolist()
    assert K.median_filter(np.array([[5.0, 1, 9, 2, 8]]), 3)[0].tolist() == [1, 5, 2, 8, 2]


def test_sample_entropy_by_brute_force():
    x = np.random.default_rng(2).normal(size=60)
    r = 0.2 * x.std()
    count = lambda m: sum(np.abs(x[i : i + m] - x[j : j + m]).max() <= r for i in range(60 - m) for j in range(60 - m) if i != j)
    assert K.sample_entropy(x) == pytest.approx(-np.log(count(3) / count(2)))


def test_array_functions_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = [rng.normal(size=n).round(3).tolist() for n in (1, 2, 5, 9, 40)] + [[1.0] * 12]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, a array<double>")
    a = F.col("a")
    rows = df.select("i", A.mean(a).alias("mean"), A.std(a).alias("std"), A.median(a).alias("median"), A.quantile(a, 0.3).alias("q"), A.mad(a).alias("mad"), A.diff(a).alias("diff"), A.moving_average(a).alias("ma"), A.remove_steps(a, 1.0).alias("steps"), A.remove_bursts(a, 1.0).alias("bursts")).orderBy("i").collect()
    for x, r in zip(data, rows):
        x = np.array(x)
        assert (r["mean"], r["std"], r["median"], r.q) == pytest.approx((x.mean(), x.std(), np.median(x), np.quantile(x, 0.3)))
        assert r.mad == pytest.approx(np.median(np.abs(x - np.median(x)))) and r["diff"] == pytest.approx(np.diff(x).tolist())
        assert r.ma == pytest.approx(np.convolve(np.pad(x, 1), np.ones(3) / 3, "valid").tolist())
        if len(x) > 2:
            assert r.steps == pytest.approx(K.without_steps(x[None], 1.0)[0].tolist())
            assert r.bursts == pytest.approx(K.without_bursts(x[None], 1.0)[0].tolist())


def test_extracted_frames(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(5e4, 4e3, (6, 300)).tolist(), rng.normal(0, 1, (2, 3000)).tolist() if i else None, None) for i in range(3)] + [(9, [[1.0] * 20] * 6, None, None), (10, None, None, None)]
    df = spark.createDataFrame(rows, "w int, ppg array<array<double>>, emg array<array<double>>, acc array<array<double>>")
    got = X.extracted(df, ["w"]).toPandas().set_index("w").sort_index()
    assert list(got.index) == [0, 1, 2] and got.shape[1] == 242 and isinstance(got, pd.DataFrame)
    assert got.loc[0, "EMG0_RMS"] == 0 and got.loc[1, "EMG0_RMS"] > 0
