import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.functions.vector import dot
from tenderlens.operators import bm25
from tenderlens.operators.bm25 import bm25_rank
from tenderlens.operators.fusion import fuse_configs, reciprocal_rank_fusion
from tenderlens.operators.query_log import parse_queries
from tenderlens.operators.strict_filters import apply_strict_filters, with_filter_id
from tenderlens.operators.vectors import (append_cells, calibrate_probes, search_cells, store_cells, topk_overlap,
                                          vector_ann_topk, vector_topk)
from tenderlens.plans import evaluation as ev
from tenderlens.plans import search


def parsed_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, requete string")
    return [tuple(r)[2:] for r in parse_queries(df).orderBy("query_id").collect()]


def test_query_log(spark):
    got = parsed_of(spark, [
        "marchés en Bretagne pour travaux", "marchés supérieur à 100000 euros",
        "marchés de cybersécurité en Île-de-France de montant élevé", "voirie plus de 50 000,5€",
        "gros montants ÎLE-DE-FRANCE", "plus de 100.000 euros", "de du en", "travaux plus de   € montant élevé"])
    assert got[0] == ("Bretagne", None, False, "marchés en pour travaux")
    assert got[1] == (None, 100000.0, False, "marchés")
    assert got[2] == ("Île-de-France", None, True, "marchés de cybersécurité")
    assert got[3] == (None, 50000.5, False, "voirie")
    assert got[4] == ("Île-de-France", None, True, "")
    assert got[5] == (None, 100.0, False, "")
    assert got[6] == (None, None, False, "")
    assert got[7][1:3] == (None, True)


def bm25_reference(docs, query):
    """Okapi over token lists, straight from the formula."""
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
                for t in query) for d in docs]


def check_bm25(spark, docs, queries, k):
    corpus = spark.createDataFrame(
        [("f", i, " ".join(d) if d is not None else None) for i, d in enumerate(docs)],
        "filter_id string, uid long, objet string")
    asked = spark.createDataFrame([(i, "f", " ".join(q)) for i, q in enumerate(queries)],
                                  "query_id int, filter_id string, texte_libre string")
    got = bm25_rank(corpus, asked, k).toPandas()
    for i, q in enumerate(queries):
        scores = np.round(bm25_reference([d or [] for d in docs], q), 9)
        order = sorted(range(len(docs)), key=lambda u: (-scores[u], u))[:k]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine.uid) == order
        assert np.allclose(mine.bm25_score, scores[order])


def test_bm25_ranks_like_the_formula(spark):
    rng = np.random.default_rng(0)
    words = [f"mot{i:02d}" for i in range(40)]
    docs = [list(rng.choice(words, rng.integers(1, 12))) for _ in range(120)] + [None, None]
    check_bm25(spark, docs, [["mot01", "mot02", "mot01"], ["mot39"], ["absent"]], 30)
    check_bm25(spark, docs, [["mot01"]], 500)


def test_bm25_negative_scores_rank_below_zero_ones(spark):
    docs = [["aa", "bb", "cc"] for _ in range(9)] + [["dd"], ["dd", "aa"], ["zz"]]
    check_bm25(spark, docs, [["aa", "bb"], ["dd"], ["cc"]], 4)


def test_bm25_blank_query_and_no_zeros(spark):
    corpus = spark.createDataFrame([("f", 1, "voirie"), ("f", 2, "cantine"), ("f", 3, "parc")],
                                   "filter_id string, uid long, objet string")
    asked = spark.createDataFrame([(1, "f", "  "), (2, "f", "voirie")],
                                  "query_id int, filter_id string, texte_libre string")
    assert [(r["query_id"], r["uid"]) for r in bm25_rank(corpus, asked, 5, include_zero_scores=False).collect()] == [(2, 1)]
    assert bm25_rank(corpus, asked, 5).filter("query_id = 1").count() == 0


def test_strict_filters(spark):
    rows = [(f"u{i}", float(i), "Bretagne" if i < 10 else "Corse", i) for i in range(20)]
    rows.append(("u9", 9.0, "Bretagne", 99))
    corpus = spark.createDataFrame(rows, "uid string, montant double, acheteur_region_nom string, n int")
    parsed = with_filter_id(spark.createDataFrame(
        [(1, "Bretagne", None, True), (2, None, 15.0, True), (3, None, None, False), (4, "Mayotte", None, True)],
        "query_id int, region string, montant_min double, montant_eleve_qualitatif boolean"))
    kept = apply_strict_filters(corpus, parsed, ["n"]).join(parsed.select("query_id", "filter_id"), "filter_id")
    got = {k: sorted(v) for k, v in kept.toPandas().groupby("query_id")["uid"].apply(list).items()}
    assert got[1] == ["u9"]
    assert got[2] == ["u15", "u16", "u17", "u18", "u19"]
    assert len(got[3]) == 20 and 4 not in got


def brute_topk(vectors, queries, k):
    scores = np.round(queries @ vectors.T, 9)
    return [[int(u) for u in sorted(range(len(vectors)), key=lambda u: (-s[u], u))[:k]] for s in scores]


def unit_vectors(spark, n, d=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[: n // 3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "uid long, vec array<double>")
    return x, df


@pytest.mark.parametrize("max_inline", [4096, 3])
def test_vector_topk_equals_brute_force(spark, max_inline):
    x, df = unit_vectors(spark, 300)
    asked = df.filter("uid % 29 = 0").select(F.col("uid").alias("query_id"), F.col("vec").alias("qvec"))
    got = vector_topk(df.repartition(3), asked, 10, max_inline=max_inline).toPandas()
    wanted = brute_topk(x, x[::29], 10)
    for i, want in zip(range(0, 300, 29), wanted, strict=True):
        assert list(got[got.query_id == i].sort_values("rank").uid) == want
    one = df.filter("uid = 5").select("vec").first()[0]
    value = df.limit(1).select(dot(F.lit(one), F.lit(one))).first()[0]
    assert value == pytest.approx(1.0)


def test_vector_topk_respects_match_columns_and_string_ids(spark):
    df = spark.createDataFrame([("a", "m1", [1.0, 0.0]), ("b", "m1", [0.0, 1.0]), ("c", "m2", [1.0, 0.0, 0.0])],
                               "uid string, model string, vec array<float>")
    asked = spark.createDataFrame([("q1", "m1", [1.0, 0.0]), ("q2", "m2", [1.0, 0.0, 0.0])],
                                  "query_id string, model string, qvec array<float>")
    got = vector_topk(df, asked, 5, ["model"]).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["uid"]) for r in got] == [("q1", "a"), ("q1", "b"), ("q2", "c")]


def test_ann_falls_back_to_exact_and_recalls_well(spark):
    _, df = unit_vectors(spark, 600, d=4)
    asked = df.select(F.col("uid").alias("query_id"), F.col("vec").alias("qvec"))
    exact = vector_topk(df, asked, 5)
    assert vector_ann_topk(df, asked, 5, nlist=100).exceptAll(exact).isEmpty()
    near = vector_ann_topk(df, asked, 1, nlist=10)
    assert near.filter("rank = 1").count() == 600


def test_stored_cells_are_searched_by_folder(spark, tmp_path):
    x, df = unit_vectors(spark, 200, d=4)
    asked = df.filter("uid % 50 = 0").select(F.col("uid").alias("query_id"), F.col("vec").alias("qvec"))
    path = str(tmp_path / "index")
    store_cells(df, path, centres=df.filter("uid >= 195"))
    stored = spark.read.parquet(f"{path}/cells")
    near = ((x[:, None, :] - x[None, 195:, :]) ** 2).sum(2).argmin(1) + 195
    assert {r["uid"]: r["cell"] for r in stored.collect()} == dict(enumerate(near.tolist()))
    every = search_cells(spark, path, asked, 5, probes=5).select("query_id", "uid", "rank")
    assert every.exceptAll(vector_topk(df, asked, 5).select("query_id", "uid", "rank")).isEmpty()
    got = search_cells(spark, path, asked, 200, probes=2).toPandas()
    for i in range(0, 200, 50):
        probed = np.lexsort((np.arange(5), -np.round(x[195:] @ x[i], 9)))[:2] + 195
        assert set(got[got.query_id == i].uid) == set(np.flatnonzero(np.isin(near, probed)).tolist())


def test_an_index_is_appended_completed_and_calibrated(spark, tmp_path):
    x, df = unit_vectors(spark, 400, d=4)
    asked = df.filter("uid % 8 = 0").select(F.col("uid").alias("query_id"), F.col("vec").alias("qvec"))
    path = str(tmp_path / "index")
    store_cells(df.filter("uid < 150"), path, centres=df.filter("uid % 20 = 0"))
    for _ in range(2):  # the second time nothing is new
        append_cells(df, path)
    stored = spark.read.parquet(f"{path}/cells")
    near = ((x[:, None, :] - x[None, ::20, :]) ** 2).sum(2).argmin(1) * 20
    assert sorted((r["uid"], r["cell"]) for r in stored.collect()) == list(enumerate(near.tolist()))
    assert search_cells(spark, path, asked, 60, probes=1).count() < 50 * 60
    full = search_cells(spark, path, asked, 60, probes=1, complete=True)
    assert full.groupBy("query_id").count().filter("count = 60").count() == 50
    assert search_cells(spark, path, asked, 500, probes=1, complete=True).count() == 50 * 400  # all there are
    exact = vector_topk(df, asked, 10)

    def recall(probes):
        found = search_cells(spark, path, asked, 10, probes, complete=True)
        return topk_overlap(exact, found).agg(F.avg("overlap")).first()[0]

    probes = calibrate_probes(spark, path, asked, 10, goal=0.95)
    assert 1 < probes < 20 and recall(probes) >= 0.95
    assert calibrate_probes(spark, path, asked, 10, goal=1.0) >= probes
    assert calibrate_probes(spark, path, asked.limit(0), 10) == 1
    assert search_cells(spark, path, asked.limit(0), 10, 2, complete=True).count() == 0


def ranking(spark, uids):
    return spark.createDataFrame([(0, u, i) for i, u in enumerate(uids, 1)], "query_id int, uid string, rank int")


def test_fusion(spark):
    def fused(*lists, weights=None):
        out = reciprocal_rank_fusion([ranking(spark, u) for u in lists], weights=weights)
        return {r["uid"]: r["rrf_score"] for r in out.collect()}, [r["uid"] for r in out.orderBy("rank").collect()]

    assert fused("abc", "acb")[1][0] == "a"
    assert fused("ab", "bc")[1][0] == "b"
    scores, _ = fused("ab", "cd")
    assert scores["a"] == scores["c"] == pytest.approx(1 / 61, abs=1e-11)
    assert fused("ab", "ba", weights=[3.0, 1.0])[1][0] == "a"
    assert fused("", "")[1] == []
    with pytest.raises(ValueError):
        reciprocal_rank_fusion([ranking(spark, "a")], weights=[1.0, 2.0])
    many = fuse_configs({"x": ranking(spark, "ab"), "y": ranking(spark, "ba")},
                        {"one": {"x": 3.0}, "two": {"y": 3.0}}).filter("rank = 1").orderBy("configuration")
    assert [(r["configuration"], r["uid"]) for r in many.collect()] == [("one", "a"), ("two", "b")]


def test_hybrid_search_end_to_end(spark):
    corpus = spark.createDataFrame([
        ("a", "travaux de voirie", 10.0, "Bretagne", 1), ("a", "travaux de voirie", 10.0, "Bretagne", 2),
        ("b", "cantine scolaire", 20.0, "Bretagne", 1), ("c", "entretien voirie", 30.0, "Corse", 1)],
        "uid string, objet string, montant double, acheteur_region_nom string, n int")
    queries = spark.createDataFrame([(1, "voirie en Bretagne"), (2, "en Bretagne"), (3, "voirie en Mayotte")],
                                    "query_id int, requete string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])],
                                    "uid string, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id int, qvec array<double>")
    parts = search.search_parts(corpus, queries, vectors, asked, ["n"])
    got = search.hybrid_results(parts).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["uid"]) for r in got] == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert got[0]["rrf_score"] == pytest.approx(2 / 61) and got[2]["rrf_score"] is None
    notes = {r["query_id"]: r for r in search.explain_search(parts).collect()}
    assert notes[1]["n_marches_avant_filtre"] == 4 and notes[1]["n_marches_apres_filtre_strict"] == 2
    assert notes[1]["n_candidats_bm25"] == 2 and notes[2]["n_candidats_bm25"] is None
    assert notes[3]["n_marches_apres_filtre_strict"] == 0 and notes[3]["n_candidats_embeddings"] is None


def themes(spark):
    return ev.theme_queries(spark, {"q": "requête", "vide": "rien"}, {"q": ["voirie"], "vide": ["absent"]})


def metric_row(spark, texts, n_corpus, k_values=(3, 10)):
    results = spark.createDataFrame([("q", i, t) for i, t in enumerate(texts, 1)],
                                    "query_id string, rank int, objet string")
    relevant = spark.createDataFrame([("q", n_corpus), ("vide", 0)], "query_id string, n_pertinents_corpus long")
    return {r["nom"]: r for r in ev.evaluate(results, themes(spark), relevant, k_values).collect()}


def test_metrics(spark):
    rows = metric_row(spark, ["Voirie", "autre"], 2)
    assert rows["q"]["precision@10"] == 0.1 and rows["q"]["recall@10"] == 0.5
    assert rows["vide"]["ndcg@3"] == 0.0 and rows["vide"]["recall@3"] is None and rows["vide"]["n_resultats"] == 0
    assert metric_row(spark, ["voirie", "VOIRIE x", "z"], 2)["q"]["ndcg@3"] == 1.0
    assert metric_row(spark, ["voirie", "VOIRIE x", "z"], 10)["q"]["ndcg@3"] < 1.0
    assert metric_row(spark, ["voirie"], 3)["q"]["recall@3"] == 0.333
    bare = ev.evaluate(spark.createDataFrame([("q", 1, "voirie")], "query_id string, rank int, objet string"),
                       themes(spark), None, (5,))
    assert bare.filter("nom = 'q'").first()["ndcg@5"] is None and "recall@5" not in bare.columns


def test_hard_queries_share_no_keyword():
    def fold(text):
        import unicodedata
        plain = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
        return set(re.findall(r"\w+", plain))

    for name, query in ev.HARD_QUERIES.items():
        if name.startswith("cyber"):
            continue
        for keyword in ev.KEYWORDS[name.replace("_difficile", "")]:
            assert not set(keyword.split()) & fold(query)


def test_sample_sizes(spark):
    df = spark.createDataFrame([("cybersecurite_difficile",), ("espaces_verts",), ("autre",)], "n string")
    assert [r[0] for r in df.select(ev.sample_size_for(F.col("n"))).collect()] == [100_000, 15_000, 15_000]


def test_annotation_agreement(spark):
    annotated = spark.createDataFrame([("q", "voirie", 1), ("q", "voirie", 0), ("q", "autre", 1), ("q", "autre", 0),
                                       ("inconnu", "voirie", 1)], "requete string, objet string, pertinent int")
    rows = ev.annotation_agreement(annotated, themes(spark)).collect()
    assert [tuple(r) for r in rows] == [("q", 4, 0.5, 1, 1)]


def test_ragged_vectors_are_refused(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0]), ("c", [5.0, 1.0])], "uid string, vec array<double>")
    queries = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, qvec array<double>")
    with pytest.raises(Exception, match="has 1 components, the queries have 2"):
        vector_topk(vectors, queries, 2).collect()


def test_search_encodes_what_the_store_lacks(spark, tmp_path):
    corpus = spark.createDataFrame([
        ("a", "travaux de voirie", 10.0, "Bretagne", 1), ("b", "cantine scolaire", 20.0, "Bretagne", 1),
        ("c", "entretien voirie", 30.0, "Corse", 1), ("d", None, 30.0, "Bretagne", 1)],
        "uid string, objet string, montant double, acheteur_region_nom string, n int")
    queries = spark.createDataFrame([(1, "voirie en Bretagne"), (2, "en Bretagne")], "query_id int, requete string")
    path, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return [[float("voirie" in t), float("cantine" in t), 0.1] for t in texts]

    def run():
        return [(r["query_id"], r["uid"]) for r in search.hybrid_search(
            corpus, queries, None, None, ["n"], encoding=search.Encoding(encoder, path, "m")).orderBy("query_id", "rank").collect()]

    assert run() == [(1, "a"), (1, "b"), (1, "d"), (2, "a"), (2, "b"), (2, "d")]
    assert seen.value == 4  # three contracts of the region and one query with text
    assert run() == run() and seen.value == 6  # later on only the query
    parts = search.search_parts(corpus, queries, None, None, ["n"], encoding=search.Encoding(encoder, path, "m"))
    notes = {r["query_id"]: r for r in search.explain_search(parts).collect()}
    assert notes[1]["n_marches_sans_vecteur"] == 0 and notes[1]["requete_sans_vecteur"] is False
    few = spark.createDataFrame([("a", [1.0, 0.0])], "uid string, vec array<double>")
    none = spark.createDataFrame([], "query_id int, qvec array<double>")
    notes = {r["query_id"]: r for r in search.explain_search(
        search.search_parts(corpus, queries, few, none, ["n"])).collect()}
    assert notes[1]["n_marches_sans_vecteur"] == 2 and notes[1]["requete_sans_vecteur"] is True
    assert notes[2]["n_marches_sans_vecteur"] is None


def test_many_filters_share_one_copy_of_the_corpus(spark):
    rng = np.random.default_rng(9)
    rows = [(f"u{i % 90}", f"mot{i % 7} texte", float(rng.integers(0, 300)), rng.choice(["Bretagne", "Corse", None]), i)
            for i in range(400)]
    corpus = spark.createDataFrame(rows, "uid string, objet string, montant double, acheteur_region_nom string, n int")
    asked = [(i, f"mot{i % 7} " + ["", "en Bretagne ", "en Corse "][i % 3] + (f"plus de {i} euros" if i % 4 else ""))
             for i in range(150)]
    queries = spark.createDataFrame(asked, "query_id int, requete string")
    parts = search.search_parts(corpus, queries, spark.createDataFrame([("u1", [1.0])], "uid string, vec array<double>"),
                                spark.createDataFrame([(i, [1.0]) for i, _ in asked], "query_id int, qvec array<double>"), ["n"])
    assert parts.filtered.sets.select("filter_id").distinct().count() > 63  # more than one word of a bitmap
    assert parts.filtered.rows.count() == 400  # every corpus row once, whatever the number of filters
    kept = parts.filtered.kept
    assert kept.count() == kept.select("row_id").distinct().count() <= 400
    got = {(r["filter_id"], r["uid"], r["n"]) for r in parts.subset.collect()}
    want = set()
    for p in parts.parsed.collect():
        first = {}
        for uid, _, amount, region, n in rows:
            if (p.region is None or p.region == region) and (p.montant_min is None or amount >= p.montant_min):
                first.setdefault(uid, n)
        want |= {(p.filter_id, uid, n) for uid, n in first.items()}
    assert got == want
    near = {r["query_id"] for r in parts.vectors.collect()}
    members = {(f, u) for f, u, _ in want}
    assert near == {p.query_id for p in parts.parsed.collect() if (p.filter_id, "u1") in members}


def test_scores_of_a_block_are_bounded(monkeypatch):
    import pandas as pd

    from tenderlens.operators import vectors as module

    rng, held = np.random.default_rng(3), []
    x, asked = rng.normal(size=(400, 6)), rng.normal(size=(90, 6))
    queries = pd.DataFrame({"query_id": np.arange(90), "qvec": list(asked)})
    keep = module._TopK._keep

    def spied(self, rows, uids, scores):
        held.append(scores.size)
        keep(self, rows, uids, scores)

    monkeypatch.setattr(module._TopK, "_keep", spied)
    monkeypatch.setattr(module, "SCORE_CELLS", 4_000)
    top = module._TopK(queries, [], 7)
    for part in np.array_split(np.arange(400), 3):
        top.add((), part, x[part])
    got = top.rows().groupby("query_id")["uid"].apply(list)
    wanted = np.argsort(-np.round(asked @ x.T, module.SCORE_DIGITS), axis=1, kind="stable")[:, :7]
    assert max(held) <= 4_000 and [got[i] for i in range(90)] == wanted.tolist()


def test_strict_filters_make_the_corpus_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def amount(uid):
        made.add(1)
        return float(uid)

    corpus = spark.range(40).select(F.col("id").alias("uid"), F.lit("A").alias("acheteur_region_nom")).withColumn(
        "montant", amount("uid"))
    parsed = with_filter_id(spark.createDataFrame(
        [(0, "A", None, True)], "query_id long, region string, montant_min double, montant_eleve_qualitatif boolean"))
    assert {r.uid for r in apply_strict_filters(corpus, parsed, ["montant"]).collect()} == {36, 37, 38, 39}
    assert made.value == 40


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bm25_scores_stay_with_their_documents(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    words = [f"mot{i:02d}" for i in range(30)]
    uids = [*range(180), *range(15), None, None]  # some documents are in several rows
    rows = [(f"s{i % 3}" if i % 11 else None, u, " ".join(rng.choice(words, rng.integers(0, 14)))) for i, u in enumerate(uids)]
    corpus = spark.createDataFrame(rows, "set_id string, uid long, objet string").withColumn(
        "uid", F.col("uid").cast(kind)).repartition(3)
    sets = spark.createDataFrame([("s0", "f"), ("s1", "f"), ("s1", "g"), ("s2", "g"), ("s2", "h")], "set_id string, filter_id string")
    asked = spark.createDataFrame(
        [(i, "fgh"[i % 3], " ".join(rng.choice(words, 4))) for i in range(12)]
        + [(None, "g", "mot01 mot01"), (3, "g", "mot02"), (20, "f", "absent"), (21, "nulle part", "mot01")],
        "query_id int, filter_id string, texte_libre string")

    def ranked(zeros):
        got = bm25_rank(corpus, asked, 7, include_zero_scores=zeros, sets=sets)
        return sorted(map(repr, got.select("query_id", "uid", F.round("bm25_score", 6), "rank").collect()))

    monkeypatch.setattr(bm25, "MAX_INLINE_TERMS", 0)
    grouped = [ranked(True), ranked(False)]
    monkeypatch.undo()
    assert [ranked(True), ranked(False)] == grouped
    monkeypatch.setattr(bm25, "SCORE_CELLS", 16)
    assert [ranked(True), ranked(False)] == grouped

    # What leaves a task is bounded by the queries, not by the documents.
    plain = spark.range(4000, numPartitions=2).select(F.lit("s0").alias("set_id"), F.col("id").alias("uid"), F.lit("mot01 mot02").alias("objet"))
    docs = bm25.tokenised(plain)
    terms = spark.createDataFrame([(q, "f", "mot01", 1, 1.0, 2.0) for q in range(5)],
                                  "query_id int, filter_id string, token string, qtf long, idf double, avgdl double")
    best = bm25._best_scores(docs, sets, terms, 7)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
    assert best.count() == 7 * 5 * docs.rdd.getNumPartitions()


@pytest.mark.parametrize("match", [[], ["cell"]])
def test_many_queries_go_in_rounds_and_leave_no_copies(spark, monkeypatch, tmp_path, match):
    """every block of queries had a copy of all vectors."""
    import tenderlens.operators.vectors as module

    monkeypatch.setattr(module, "ROUND_BYTES", 7 * 8 * 4)  # seven queries a round
    monkeypatch.setattr(module, "shared_path", lambda _, label: str(tmp_path / label))
    monkeypatch.setattr(module, "materialize", lambda df, label: (
        df.write.parquet(str(tmp_path / label)), spark.read.schema(df.schema).parquet(str(tmp_path / label)))[1])
    rng = np.random.default_rng(6)
    vecs, asks = np.round(rng.normal(size=(90, 4)), 1), np.round(rng.normal(size=(40, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vecs)], "uid long, vec array<double>, cell int")
    asked = spark.createDataFrame([(i, v.tolist(), c) for i, v in enumerate(asks) for c in range(i % 2, 3)],
                                  "query_id long, qvec array<double>, cell int")
    got = module.vector_topk(df, asked if match else asked.dropDuplicates(["query_id"]), 5, match, max_inline=2)
    assert len([f for f in tmp_path.glob("nearest/*.parquet")]) > 3  # the rounds
    assert not list(tmp_path.glob("vectors/*")) and not list(tmp_path.glob("queries/*"))
    found = {(r.query_id, r["rank"]): (r.uid, r.score) for r in got.collect()}
    assert len(found) == 5 * 40
    for i, q in enumerate(asks):
        seen = [j for j in range(90) if not match or j % 3 >= i % 2]
        best = sorted(seen, key=lambda j: (-np.round(vecs[j] @ q, 9), j))[:5]
        assert [found[i, n + 1][0] for n in range(5)] == best
        assert [found[i, n + 1][1] for n in range(5)] == pytest.approx([vecs[j] @ q for j in best])
