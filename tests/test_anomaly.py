import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderlens.functions.numeric import signed_log
from tenderlens.operators import knn
from tenderlens.operators import lof as lof_module
from tenderlens.operators.knn import collapse_points, knn_self
from tenderlens.operators.lof import lof
from tenderlens.operators.peers import FEATURES, feature_matrix, peer_deviation
from tenderlens.operators.quantile import exact_quantiles
from tenderlens.operators.ranks import assign_folds, sample_exact, split_train_test
from tenderlens.plans import anomaly
from tenderlens.runtime import materialize


def contracts(n=100, seed=0):
    rng = np.random.default_rng(seed)
    normal = pd.DataFrame({"montant": np.maximum(rng.normal(100_000, 15_000, n), 1000),
                           "dureeMois": np.maximum(rng.normal(12, 3, n), 1)})
    odd = pd.DataFrame({"montant": [1e7] * 5, "dureeMois": [12.0] * 5})
    out = pd.concat([normal, odd], ignore_index=True)
    out["codeCPV"], out["ligne"] = "45000000", 0
    out["uid"] = [f"u{i:04d}" for i in range(len(out))]
    return out


@pytest.mark.parametrize("buffer_rows", [10**6, 0])
def test_quantiles_equal_numpy(spark, buffer_rows):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 60_000), "x": np.round(rng.lognormal(3, 2, 60_000), 2)})
    pdf.loc[pdf.g == 0, "x"] = np.where(rng.random((pdf.g == 0).sum()) < 0.4, 7.0, pdf.x[pdf.g == 0])
    pdf["y"] = -pdf.x
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(
        [(0, float("nan"), None), (9, None, 2.0)], "g long, x double, y double")).repartition(5)
    got = exact_quantiles(df, {"a": ("x", 0.5), "b": ("x", 0.05), "c": ("y", 0.9)}, ["g"], "n", buffer_rows)
    got = got.toPandas().set_index("g").sort_index()
    for name, (column, p) in {"a": ("x", 0.5), "b": ("x", 0.05), "c": ("y", 0.9)}.items():
        want = pdf.groupby("g")[column].quantile(p)
        assert np.allclose(got.loc[[0, 1, 2], name], want)
    assert got.loc[9, "a"] is None or np.isnan(got.loc[9, "a"])
    assert got.loc[9, "c"] == 2.0 and got.loc[9, "n"] == 1
    whole = exact_quantiles(df, {"a": ("x", 0.9)}, buffer_rows=buffer_rows).first()["a"]
    assert whole == pytest.approx(pdf.x.quantile(0.9))


def test_peer_groups(spark):
    df = spark.createDataFrame([("a", 100.0, 1.0, "45452100"), ("b", 200.0, 2.0, "45000000"),
                                ("c", 300.0, 3.0, "71200000"), ("d", 5.0, 1.0, None)],
                               "uid string, montant double, dureeMois double, codeCPV string")
    rows = {r["uid"]: r for r in peer_deviation(df).collect()}
    assert [rows[u]["cpv_groupe_taille"] for u in "abc"] == [2, 2, 1]
    assert not any(r["cpv_groupe_fiable"] for r in rows.values())
    assert rows["a"]["montant_ratio_mediane_cpv"] == pytest.approx(100 / 150)
    assert rows["d"]["cpv_division"] is None and rows["d"]["cpv_groupe_taille"] is None
    assert rows["d"]["montant_ratio_mediane_cpv"] is None


def test_feature_matrix_imputes_and_deduplicates(spark):
    df = spark.createDataFrame([("a", 100.0, None, "45", 0), ("a", 999.0, 9.0, "45", 1), ("b", None, 4.0, "45", 0),
                                ("c", 300.0, 8.0, "45", 0)],
                               "uid string, montant double, dureeMois double, codeCPV string, ligne int")
    rows = {r["uid"]: r for r in feature_matrix(df, ["ligne"]).collect()}
    assert len(rows) == 3 and rows["b"]["montant"] == 200.0 and rows["a"]["dureeMois"] == 6.0
    assert all(r[c] is not None for r in rows.values() for c in FEATURES)


def test_signed_log(spark):
    values = [-7e6, -1.0, 0.0, 1.0, 7e6]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(signed_log(F.col("x"))).collect()]
    assert np.allclose(got, np.sign(values) * np.log1p(np.abs(values)))


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dk = np.take_along_axis(d, near, 1)
    kd = dk[:, -1]
    lrd = 1 / (np.maximum(kd[near], dk).mean(1) + 1e-10)
    return -lrd[near].mean(1) / lrd


def test_lof_equals_brute_force_with_a_third_copies(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    x[:500] = x[0]
    x[-4:] *= 40
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(uid=np.arange(len(x))))
    got = lof(df, list("abc"), n_neighbors=20, cell_points=50).orderBy("uid").toPandas()
    want = brute_lof(x, 20)
    assert np.allclose(got["anomaly_score_lof"], want, rtol=1e-9)
    assert list(got["is_anomaly_lof"]) == list(want < np.quantile(want, 0.05))


def test_lof_with_equal_distances_and_an_unknown_id(spark):
    """On a grid the lowest id decides; a point without an id has no score and counts in no other's."""
    grid = np.array([(a, b) for a in range(24) for b in range(24)], dtype="float64")
    x = np.random.default_rng(4).permutation(grid)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("ab")).assign(uid=np.arange(len(x))))
    got = lof(df, list("ab"), n_neighbors=7, cell_points=40).orderBy("uid").toPandas()
    assert np.allclose(got["anomaly_score_lof"], brute_lof(x, 7), rtol=1e-9)
    some = lof(df.withColumn("uid", F.when(F.col("uid") != 100, F.col("uid"))), list("ab"), n_neighbors=7, cell_points=40)
    scores = {r["uid"]: r["anomaly_score_lof"] for r in some.collect()}
    assert scores.pop(None) is None and None not in scores.values()


def test_neighbours_stay_packed(spark, monkeypatch):
    """No stored step has a row per neighbour."""
    kept = {}

    def spy(df, label):
        kept[label] = materialize(df, label)
        return kept[label]

    monkeypatch.setattr(knn, "materialize", spy)
    monkeypatch.setattr(lof_module, "materialize", spy)
    x = np.random.default_rng(6).normal(size=(4000, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("ab")).assign(uid=np.arange(len(x))))
    assert lof(df, list("ab"), n_neighbors=20, cell_points=200).count() == 4000
    rows = {label: step.count() for label, step in kept.items()}
    assert max(rows.values()) <= 4000 and rows["neighbours"] <= 200


def test_neighbours_per_group_and_clamped_k(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 2)), 1)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(uid=np.arange(400), g=np.arange(400) % 2)
    pdf = pd.concat([pdf, pd.DataFrame({"a": [0.0, 1.0, 5.0], "b": [0.0] * 3, "uid": [900, 901, 902], "g": 2})])
    points = collapse_points(spark.createDataFrame(pdf), ["a", "b"], ["g"])
    got = knn_self(points, ["a", "b"], 7, ["g"], cell_points=16).toPandas()
    for g in (0, 1):
        part = pdf[pdf.g == g]
        xs = part[["a", "b"]].to_numpy()
        d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        kth = dict(zip(part.uid, np.sort(d, axis=1)[:, 6], strict=True))
        mine = got[got.g == g].groupby("pid").agg(d=("d", "max"), used=("used", "sum"))
        assert set(mine.used) == {7}
        assert all(mine.d[u] == pytest.approx(kth[u]) for u in mine.index)
    small = got[got.g == 2].groupby("pid")["used"].sum()
    assert set(small) == {2}


@pytest.mark.parametrize("regions", [1, 4])
def test_regions_are_split_until_cells_fit(spark, monkeypatch, regions):
    monkeypatch.setattr(knn, "FAN", 5)  # up to three levels below the regions
    monkeypatch.setattr(knn, "CELL_SAMPLE", 60)
    monkeypatch.setattr(knn, "REQUEST_ROWS", 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.normal(size=(450, 3)), 2), rng.normal(size=(150, 3)) * [1e-3, 30, 1]])
    x[:150] = x[0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(uid=np.arange(len(x))))
    points = collapse_points(df, list("abc")).cache()
    sizes = []
    refine = knn._refine
    monkeypatch.setattr(knn, "_refine", lambda *a: sizes.append(refine(*a)) or sizes[-1])
    got = knn_self(points, list("abc"), 6, cell_points=8, regions=regions).toPandas()
    cells = sizes[0].groupBy("region", "cell").count().toPandas()
    assert cells["count"].max() <= knn.OVERFULL * 8 and cells["count"].sum() == points.count()
    assert cells["region"].nunique() <= regions + 1
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, 5]
    mine = got.groupby("pid").agg(d=("d", "max"), used=("used", "sum"))
    assert len(mine) == points.count() and set(mine.used) == {6}
    assert np.allclose(mine.d, kth[mine.index])


def test_planted_outliers(spark):
    df = spark.createDataFrame(contracts())
    for flags, name in ((anomaly.detect_isolation_forest(df, ["ligne"]), "is_anomaly_iforest"),
                        (anomaly.detect_lof(df, ["ligne"]), "is_anomaly_lof")):
        pdf = flags.toPandas()
        assert pdf[pdf.montant == 1e7][name].sum() >= 4
        assert len(pdf) == 105


def test_forest_does_not_depend_on_partitioning(spark):
    pdf = contracts(400)
    scores = [anomaly.detect_isolation_forest(spark.createDataFrame(pdf).repartition(n), ["ligne"]).orderBy(
        "uid").toPandas()["anomaly_score_iforest"] for n in (1, 7)]
    assert np.array_equal(*scores)


def test_agreement_and_stability(spark):
    df = spark.createDataFrame(contracts(300))
    row = anomaly.compare_methods(df, ["ligne"]).first()
    assert row["n_total"] == row["n_contracts"] == 305
    assert 0 <= row["taux_accord"] <= 1 and row["n_accord"] <= row["n_anomalies_lof"]
    draws = anomaly.stability_draws(df, ["uid"], ["ligne"], sample_size=200, seeds=(0, 1, 2), n_trees=20)
    summary = anomaly.stability_summary(draws, 200).first()
    assert summary["n_repeats"] == 3 and {r["n_total"] for r in summary["detail_par_tirage"]} == {200}


def test_samples_folds_and_splits_ignore_partitioning(spark):
    base = spark.range(5000).withColumnRenamed("id", "uid")
    results = []
    for n in (1, 8):
        df = base.repartition(n)
        results.append((
            sorted(r[0] for r in sample_exact(df, 700, 1, ["uid"]).collect()),
            sorted(map(tuple, assign_folds(df, 5, 1, ["uid"]).select("uid", "fold").collect())),
            sorted(map(tuple, split_train_test(df, 1, ["uid"]).collect()))))
    assert results[0] == results[1]
    assert len(results[0][0]) == 700
    assert pd.Series([f for _, f in results[0][1]]).value_counts().tolist() == [1000] * 5
    assert sample_exact(base, 10_000, 1, ["uid"]).count() == 5000
