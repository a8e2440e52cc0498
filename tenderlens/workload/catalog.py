"""Registered queries: name -> function of (spark, directory of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.functions.numeric import signed_log
from tenderlens.operators import bm25, cleaning, fusion, peers, quality, query_log, ranks, strict_filters
from tenderlens.operators import contracts as grain
from tenderlens.operators import vectors as vec
from tenderlens.operators.knn import collapse_points, knn_cells, knn_self
from tenderlens.operators.lof import lof_scores
from tenderlens.plans import anomaly, evaluation, prediction, search
from tenderlens.runtime import materialize, shared_path
from tenderlens.sources import contracts as scans
from tenderlens.sources import exports, vector_store
from tenderlens.workload import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RESULT_COLUMNS = ["query_id", "uid", "rank", "rrf_score", "montant", "acheteur_region_nom"]


def registered(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def as_text(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that result comparison does not depend on time types."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
                           for c, t in df.dtypes if t.startswith("timestamp")})


# Scans -----------------------------------------------------------------------

@registered
def scan_core(spark, sf):
    return as_text(scans.prune(b.contracts(spark, sf, full=True)))


@registered
def scan_coerce_dates(spark, sf):
    rows = b.contracts(spark, sf).withColumn("dateNotification", F.when(
        F.col("uid") % 10 == 3, F.concat(F.lit("illisible "), F.col("uid"))
    ).otherwise(F.date_format("dateNotification", "yyyy-MM-dd")))
    return as_text(scans.coerce_dates(rows, min_valid="1993-01-01").select(
        "uid", "l_linenumber", "l_partkey", "dateNotification", "datePublicationDonnees"))


@registered
def scan_current(spark, sf):
    return scans.current_only(b.contracts(spark, sf), ["uid", "montant", "dureeMois", "codeCPV"])


@registered
def sample_exact(spark, sf):
    return ranks.sample_exact(b.contracts(spark, sf), 5000, 42, b.ROW_KEYS).select(
        "uid", "l_linenumber", "l_partkey", "montant")


@registered
def drop_missing(spark, sf):
    return scans.drop_missing(b.contracts(spark, sf), ["montant", "codeCPV"]).select(
        "uid", "l_linenumber", "l_partkey", "montant", "codeCPV")


# Filters and flags -------------------------------------------------------------

def _one_filter(spark, sf, region=None, minimum=None, high=False, dedup=True):
    rows = b.contracts(spark, sf)
    parsed = rows.sparkSession.createDataFrame(
        [(0, region, minimum, high)],
        "query_id long, region string, montant_min double, montant_eleve_qualitatif boolean")
    kept = strict_filters.apply_strict_filters(
        rows, search.with_filter_id(parsed), b.TIE_BREAK if dedup else b.ROW_KEYS)
    return kept.select("uid", "l_linenumber", "l_partkey", "montant", "acheteur_region_nom")


@registered
def filter_region(spark, sf):
    return _one_filter(spark, sf, region="ASIA")


@registered
def filter_min_amount(spark, sf):
    return _one_filter(spark, sf, minimum=250_000.0)


@registered
def filter_high_amount(spark, sf):
    return _one_filter(spark, sf, high=True)


@registered
def strict_filters_many(spark, sf):
    parsed = materialize(search.with_filter_id(query_log.parse_queries(b.query_log(spark, sf))), "parsed")
    kept = strict_filters.apply_strict_filters(b.corpus(spark, sf), parsed, ["montant"])
    return kept.select("filter_id", "uid", "montant").join(
        parsed.select("query_id", "filter_id"), "filter_id").drop("filter_id")


@registered
def strict_filters_high_in_region(spark, sf):
    return _one_filter(spark, sf, region="EUROPE", high=True)


@registered
def valid_target(spark, sf):
    return prediction.valid_target(b.signed_contracts(spark, sf)).select(
        "uid", "l_linenumber", "l_partkey", "montant", "dureeMois", "offresRecues")


_FLAG_KEYS = ["uid", "l_linenumber", "l_partkey", "l_suppkey"]


@registered
def flag_amount(spark, sf):
    rows = b.signed_contracts(spark, sf).withColumn("montant", F.col("montant") * 200_000)
    return cleaning.flag_amounts(rows).select(*_FLAG_KEYS, "montant_negatif_ou_nul", "montant_extreme")


@registered
def flag_dates(spark, sf):
    rows = b.contracts(spark, sf).withColumn(
        "dateNotification", F.when(F.col("uid") % 11 != 0, F.col("dateNotification")))
    return cleaning.flag_dates(rows, b.DATE_LOW, b.DATE_HIGH).select(
        *_FLAG_KEYS, "dateNotification_hors_plage", "datePublicationDonnees_hors_plage")


@registered
def canonical_category(spark, sf):
    return cleaning.normalize_nature(b.contracts(spark, sf)).select(*_FLAG_KEYS, "nature", "nature_original")


@registered
def clean_pipeline(spark, sf):
    return cleaning.clean(b.signed_contracts(spark, sf), b.DATE_LOW, b.DATE_HIGH).select(
        *_FLAG_KEYS, "nature", "nature_original", "montant_negatif_ou_nul", "montant_extreme",
        "dateNotification_hors_plage", "datePublicationDonnees_hors_plage")


# Query log ---------------------------------------------------------------------

@registered
def query_region(spark, sf):
    return query_log.with_region(b.query_log(spark, sf)).select(
        "query_id", "region", F.col("_rest").alias("reste"))


@registered
def query_amount(spark, sf):
    return query_log.with_amount(b.query_log(spark, sf), "requete").select(
        "query_id", "montant_min", "montant_eleve_qualitatif", F.col("_rest").alias("reste"))


@registered
def parse_queries(spark, sf):
    return query_log.parse_queries(b.query_log(spark, sf)).drop("requete")


@registered
def parse_user_turns(spark, sf):
    return query_log.parse_queries(b.user_turns(spark, sf)).drop("requete")


# Quality -------------------------------------------------------------------------

def _audited(spark, sf):
    return scans.prune(b.signed_contracts(spark, sf))


@registered
def audit_missing(spark, sf):
    return rounded(quality.missing_profile(_audited(spark, sf)))


@registered
def audit_dates(spark, sf):
    return quality.date_issues(_audited(spark, sf), b.DATE_LOW, b.DATE_HIGH)


@registered
def audit_amount(spark, sf):
    return quality.amount_issues(_audited(spark, sf))


@registered
def audit_categories(spark, sf):
    return quality.category_variants(_audited(spark, sf))


@registered
def audit_versioning(spark, sf):
    return quality.version_issues(_audited(spark, sf))


@registered
def quality_report(spark, sf):
    return rounded(quality.quality_report(
        _audited(spark, sf), b.DATE_LOW, b.DATE_HIGH, display=False).drop("issues"))


@registered
def missing_by_group(spark, sf):
    return rounded(quality.missing_by_group(
        b.contracts(spark, sf), tx.category_key(F.col("procedure"))))


# Contract grain and peers ---------------------------------------------------------

@registered
def group_by_contract(spark, sf):
    return grain.group_by_contract(b.contracts(spark, sf), b.TIE_BREAK).select(
        "uid", "titulaire_id", "montant", "dureeMois", "nb_titulaires")


@registered
def dedup_contract(spark, sf):
    return grain.dedup_contracts(b.contracts(spark, sf), b.TIE_BREAK).select(
        "uid", "titulaire_id", "montant", "dureeMois", "l_linenumber", "l_partkey")


@registered
def peer_deviation(spark, sf):
    first = materialize(grain.dedup_contracts(b.contracts(spark, sf), b.TIE_BREAK).select(
        "uid", "montant", "dureeMois", "codeCPV"), "first")
    return rounded(peers.peer_deviation(first).drop("codeCPV"))


@registered
def anomaly_features(spark, sf):
    return rounded(peers.feature_matrix(b.signed_contracts(spark, sf), b.TIE_BREAK).select(
        "uid", *peers.FEATURES))


@registered
def anomaly_features_log(spark, sf):
    return rounded(peers.feature_matrix(b.signed_contracts(spark, sf), b.TIE_BREAK, log_scale=True).select(
        "uid", *peers.FEATURES))


@registered
def scale_features(spark, sf):
    rows = b.contracts(spark, sf).na.drop(subset=["montant"])
    return rounded(peers.scale_features(rows, ["montant", "dureeMois"]).select(
        *_FLAG_KEYS, "montant_z", "dureeMois_z"))


# Text -------------------------------------------------------------------------------

@registered
def accent_fold(spark, sf):
    return b.corpus(spark, sf).select("uid", tx.accent_fold(F.col("objet")).alias("plie"))


@registered
def category_key(spark, sf):
    return b.contracts(spark, sf).select(
        *_FLAG_KEYS, tx.category_key(F.concat_ws(" d ", "nature", "procedure")).alias("cle"))


@registered
def tokenize(spark, sf):
    return b.corpus(spark, sf).select("uid", F.array_join(tx.tokens(F.col("objet")), " ").alias("mots"))


@registered
def signed_log_amount(spark, sf):
    return rounded(b.signed_contracts(spark, sf).select(
        *_FLAG_KEYS, signed_log(F.col("montant")).alias("montant_log")))


@registered
def theme_sample_size(spark, sf):
    names = F.concat(F.element_at(F.array(*[F.lit(n) for n in evaluation.SAMPLE_SIZES], F.lit("autre")),
                                  (F.col("doc_id") % 5).cast("int") + 1),
                     F.when(F.col("doc_id") % 2 == 0, "_difficile").otherwise(""))
    return b.table(spark, sf, "documents").select(
        "doc_id", evaluation.sample_size_for(names).alias("taille"))


# Search -------------------------------------------------------------------------------

def _themes(spark):
    return evaluation.theme_queries(
        spark, {n: q for n, (q, _, _) in b.THEMES.items()},
        {n.replace("_difficile", ""): k for n, (_, k, _) in b.THEMES.items()})


def _whole(spark, sf):
    return b.corpus(spark, sf).withColumn("filter_id", F.lit("all"))


@registered
def bm25_stats(spark, sf):
    return rounded(bm25.bm25_statistics(b.corpus(spark, sf)))


@registered
def bm25_search(spark, sf):
    queries = b.query_log(spark, sf).select(
        "query_id", F.lit("all").alias("filter_id"), F.col("requete").alias("texte_libre"))
    return rounded(bm25.bm25_rank(_whole(spark, sf), queries, 50))


@registered
def vector_topk(spark, sf):
    return rounded(vec.vector_topk(b.vectors(spark, sf), b.query_vectors(spark, sf), 20))


@registered
def vector_ann_topk(spark, sf):
    return vec.vector_ann_topk(b.vectors(spark, sf), b.query_vectors(spark, sf), 20, nlist=10)


@registered
def vector_cells_topk(spark, sf):
    """Search of a stored index whose centres are ten given vectors, two cells per query."""
    held, path = b.vectors(spark, sf), shared_path(spark, "cells")
    vec.store_cells(held, path, centres=held.filter("uid < 10"))
    return rounded(vec.search_cells(spark, path, b.query_vectors(spark, sf), 20, probes=2))


@registered
def vector_index_complete(spark, sf):
    """An index built on the even vectors, the odd ones appended twice; queries go on to further cells until these hold 50."""
    held, path = b.vectors(spark, sf), shared_path(spark, "cells")
    vec.store_cells(held.filter("uid % 2 = 0"), path, centres=held.filter("uid < 10"))
    for _ in range(2):
        vec.append_cells(held, path)
    return rounded(vec.search_cells(spark, path, b.query_vectors(spark, sf), 50, probes=1, complete=True))


@registered
def vector_index_recall(spark, sf):
    """Overlap with the exact top-20 of an index that is trained, then probed as often as a sample asks for."""
    held, asked, path = b.vectors(spark, sf), b.query_vectors(spark, sf), shared_path(spark, "cells")
    vec.store_cells(held, path, nlist=10)
    probes = vec.calibrate_probes(spark, path, asked, 20)
    return vec.topk_overlap(vec.vector_topk(held, asked, 20), vec.search_cells(spark, path, asked, 20, probes, complete=True))


@registered
def topk_overlap(spark, sf):
    """Exact top-20 of the whole vectors against the top-20 of their first half."""
    half = b.vectors(spark, sf).withColumn("vec", F.slice("vec", 1, 32))
    asked = b.query_vectors(spark, sf)
    return rounded(vec.topk_overlap(
        vec.vector_topk(b.vectors(spark, sf), asked, 20),
        vec.vector_topk(half, asked.withColumn("qvec", F.slice("qvec", 1, 32)), 20)))


@registered
def ann_overlap(spark, sf):
    held, asked = b.vectors(spark, sf), b.query_vectors(spark, sf)
    return vec.topk_overlap(vec.vector_topk(held, asked, 20), vec.vector_ann_topk(held, asked, 20, nlist=10))


@registered
def missing_vectors(spark, sf):
    stored = b.vectors(spark, sf).withColumn("model", F.lit("entier"))
    return vector_store.missing_uids(b.corpus(spark, sf).select("uid"), stored, "entier")


def letter_shares(texts: list[str]) -> list[list[float]]:
    """A stand-in batch encoder: how often each letter occurs."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


@registered
def vector_upsert(spark, sf):
    path = shared_path(spark, "store")
    docs = b.corpus(spark, sf)
    english = docs.filter(F.col("acheteur_region_nom") == "Île-de-France")
    vector_store.upsert_vectors(english, path, "lettres", letter_shares)
    stored = vector_store.upsert_vectors(docs, path, "lettres", letter_shares)
    weighted = F.transform("vec", lambda x, i: x.cast("double") * (i + 1))
    return stored.select(F.col("uid").cast("long").alias("uid"), "model", F.size("vec").alias("dim"),
                         F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 3).alias("lettres"))


def _rankings(spark, sf):
    """Two rankings of documents per language: by length, and by hash."""
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.col("lang").alias("query_id"), "n_chars")
    by_length = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "uid")
    by_hash = Window.partitionBy("query_id").orderBy(F.md5(F.col("uid").cast("string")), "uid")
    return [docs.select("query_id", "uid", F.row_number().over(w).alias("rank"))
            for w in (by_length, by_hash)]


@registered
def rrf_fusion(spark, sf):
    return rounded(fusion.reciprocal_rank_fusion(_rankings(spark, sf)), 9)


@registered
def rrf_weighted(spark, sf):
    return rounded(fusion.reciprocal_rank_fusion(_rankings(spark, sf), weights=[3.0, 1.0]), 9)


def _parts(spark, sf, **options):
    return search.search_parts(b.corpus(spark, sf), b.query_log(spark, sf), b.vectors(spark, sf),
                               b.query_vectors(spark, sf), ["montant"], **options)


@registered
def hybrid_search(spark, sf):
    return rounded(search.hybrid_results(_parts(spark, sf)).select(*RESULT_COLUMNS), 9)


@registered
def hybrid_search_matches_only(spark, sf):
    parts = _parts(spark, sf, include_zero_scores=False)
    return rounded(search.hybrid_results(parts, weights=[1.0, 3.0]).select(*RESULT_COLUMNS), 9)


@registered
def hybrid_search_encoded(spark, sf):
    """Over all documents: the store is empty at first and knows French texts before the search."""
    path, docs = shared_path(spark, "store"), b.corpus(spark, sf)
    vector_store.upsert_vectors(docs.filter(F.col("acheteur_region_nom") == "Bretagne"), path, "lettres", letter_shares)
    results = search.hybrid_search(docs, b.query_log(spark, sf), None, None, ["montant"],
                                   encoding=search.Encoding(letter_shares, path, "lettres"))
    return rounded(results.select(*RESULT_COLUMNS), 9)


@registered
def search_explain(spark, sf):
    return search.explain_search(_parts(spark, sf))


@registered
def filter_only_search(spark, sf):
    return search.filter_only_search(b.corpus(spark, sf), b.query_log(spark, sf), ["montant"]).select(
        "query_id", "uid", "rank", "montant")


@registered
def annotation_sheet(spark, sf):
    results = search.hybrid_results(_parts(spark, sf)).withColumn("requete", F.col("query_id").cast("string"))
    return exports.annotation_sheet(results, 8)


# Evaluation -----------------------------------------------------------------------------

@registered
def keyword_relevance(spark, sf):
    """Every document judged for every theme."""
    themes = _themes(spark)
    docs = b.corpus(spark, sf).withColumn("query_id", F.explode(F.array(*[F.lit(n) for n in b.THEMES])))
    return evaluation.judged(docs, themes).select("query_id", "uid", F.col("rel").alias("pertinent"))


@registered
def relevant_in_corpus(spark, sf):
    return evaluation.relevant_in_corpus(b.corpus(spark, sf), _themes(spark))


def _theme_ranking(spark, sf):
    """BM25 ranking of the themes over the whole corpus, with texts."""
    themes = _themes(spark)
    asked = themes.select("query_id", F.lit("all").alias("filter_id"), F.col("requete").alias("texte_libre"))
    ranked = materialize(bm25.bm25_rank(_whole(spark, sf), asked, 20), "ranked")
    return b.corpus(spark, sf).join(ranked, "uid"), themes


def _metric(spark, sf, name):
    results, themes = _theme_ranking(spark, sf)
    relevant = evaluation.relevant_in_corpus(b.corpus(spark, sf), themes)
    table = evaluation.evaluate(results, themes, relevant, digits=None)
    return rounded(table.select("nom", *[c for c in table.columns if c.startswith(name)]))


@registered
def precision_at_k(spark, sf):
    return _metric(spark, sf, "precision@")


@registered
def recall_at_k(spark, sf):
    return _metric(spark, sf, "recall@")


@registered
def ndcg_at_k(spark, sf):
    return _metric(spark, sf, "ndcg@")


@registered
def evaluate_queries(spark, sf):
    results, themes = _theme_ranking(spark, sf)
    return rounded(evaluation.evaluate(
        results, themes, evaluation.relevant_in_corpus(b.corpus(spark, sf), themes), digits=None))


@registered
def eval_bm25(spark, sf):
    return rounded(evaluation.evaluate_bm25(
        b.corpus(spark, sf), _themes(spark), b.CORPUS_KEYS, digits=None))


def _eval_inputs(spark, sf):
    return (b.corpus(spark, sf), _themes(spark), b.vectors(spark, sf), b.theme_vectors(spark, sf),
            b.CORPUS_KEYS, ["montant"])


@registered
def eval_hybrid(spark, sf):
    return rounded(evaluation.evaluate_hybrid(*_eval_inputs(spark, sf), digits=None))


@registered
def sweep_rrf_weights(spark, sf):
    return rounded(evaluation.sweep_weights(*_eval_inputs(spark, sf), digits=None))


@registered
def compare_vector_sets(spark, sf):
    corpus, themes, held, asked, keys, tie = _eval_inputs(spark, sf)
    return rounded(evaluation.compare_vector_sets(
        corpus, themes, b.two_models(held, "vec"), b.two_models(asked, "qvec"), keys, tie,
        digits=None))


@registered
def annotation_agreement(spark, sf):
    return rounded(evaluation.annotation_agreement(b.annotated(spark, sf), _themes(spark)))


# Anomalies --------------------------------------------------------------------------------

def _detection_input(spark, sf):
    return b.signed_contracts(spark, sf).select(
        "uid", "montant", "dureeMois", "codeCPV", *b.TIE_BREAK)


_SHOWN = ["uid", *peers.FEATURES]


@registered
def isolation_forest(spark, sf):
    return anomaly.detect_isolation_forest(_detection_input(spark, sf), b.TIE_BREAK).select(
        *_SHOWN, "anomaly_score_iforest", "is_anomaly_iforest")


@registered
def lof(spark, sf):
    return anomaly.detect_lof(_detection_input(spark, sf), b.TIE_BREAK).select(
        *_SHOWN, "anomaly_score_lof", "is_anomaly_lof")


@registered
def knn_neighbours(spark, sf):
    """Nearest contracts of every contract by amount and duration."""
    first = grain.dedup_contracts(_detection_input(spark, sf), b.TIE_BREAK)
    points = materialize(collapse_points(first, ["montant", "dureeMois"]), "points")
    return rounded(knn_self(points, ["montant", "dureeMois"], 5))


@registered
def lof_score(spark, sf):
    """Outlier factor of every distinct (amount, duration), as they are."""
    columns = ["montant", "dureeMois"]
    first = grain.dedup_contracts(_detection_input(spark, sf), b.TIE_BREAK)
    points = materialize(collapse_points(first, columns), "points")
    return rounded(lof_scores(points, knn_cells(points, columns, 5), columns))


@registered
def method_agreement(spark, sf):
    return anomaly.compare_methods(_detection_input(spark, sf), b.TIE_BREAK)


@registered
def agreement_stability(spark, sf):
    draws = anomaly.stability_draws(_detection_input(spark, sf), b.ROW_KEYS, b.TIE_BREAK,
                                    log_scale=True)
    return anomaly.stability_summary(draws).drop("detail_par_tirage")


@registered
def top_anomalies(spark, sf):
    return anomaly.top_anomalies(anomaly.detect_isolation_forest(_detection_input(spark, sf), b.TIE_BREAK))


# Prediction ---------------------------------------------------------------------------------

@registered
def prepare_training(spark, sf):
    return prediction.prepare_training(b.contracts(spark, sf), b.TIE_BREAK).select(
        "uid", "montant", "dureeMois", "offresRecues", "procedure_normalisee", "nature_normalisee", "cpv_division")


@registered
def training_features(spark, sf):
    return rounded(prediction.training_columns(b.contracts(spark, sf), b.TIE_BREAK))


@registered
def train_test_split(spark, sf):
    return ranks.split_train_test(
        grain.dedup_contracts(b.contracts(spark, sf), b.TIE_BREAK).select("uid"), 42, ["uid"])


@registered
def kfold_assign(spark, sf):
    first = materialize(grain.dedup_contracts(b.contracts(spark, sf), b.TIE_BREAK).select("uid"), "first")
    return ranks.assign_folds(first, 5, 42, ["uid"])


@registered
def regression_metrics(spark, sf):
    """Metrics of a plain guess (a tenth of the duration) per procedure."""
    rows = prediction.valid_target(b.contracts(spark, sf)).select(
        tx.category_key(F.col("procedure")).alias("procedure"),
        F.log1p("offresRecues").alias(prediction.LABEL), (F.col("dureeMois") / 25 - 0.1).alias("prediction"))
    return rounded(prediction.metrics(rows, ["procedure"]))


def _training(spark, sf):
    return prediction.training_set(b.contracts(spark, sf), b.TIE_BREAK)


@registered
def baseline_median(spark, sf):
    columns = materialize(prediction.training_columns(b.contracts(spark, sf), b.TIE_BREAK), "training")
    data = ranks.split_train_test(columns, 42, ["uid"])
    return rounded(prediction.baseline_predictions(data).select("uid", prediction.LABEL, "prediction"))


@registered
def ridge(spark, sf):
    data, _ = _training(spark, sf)
    train = data.filter(~F.col("is_test"))
    return prediction.ridge(train).fit(train).transform(data.filter("is_test")).select(
        "uid", prediction.LABEL, "prediction")


@registered
def random_forest(spark, sf):
    data, _ = _training(spark, sf)
    fitted = prediction.forest().fit(data.filter(~F.col("is_test")))
    return fitted.transform(data.filter("is_test")).select("uid", prediction.LABEL, "prediction")


@registered
def compare_models(spark, sf):
    data, _ = _training(spark, sf)
    return prediction.compare_models(data)


@registered
def feature_importance(spark, sf):
    data, names = _training(spark, sf)
    return prediction.feature_importance(data, names)


@registered
def cross_validate(spark, sf):
    data, _ = _training(spark, sf)
    return prediction.summarise_folds(prediction.cross_validate(data, prediction.ridge))


@registered
def random_search(spark, sf):
    data, _ = _training(spark, sf)
    table, _ = prediction.random_search(data.drop("is_test"))
    return table


@registered
def tuned_vs_default(spark, sf):
    data, _ = _training(spark, sf)
    return prediction.tuned_vs_default(data)


# Flagship ------------------------------------------------------------------------------------

@registered
def most_above_peers(spark, sf):
    """Contracts whose amount is most above the median of their peer group."""
    return rounded(peers.feature_matrix(b.contracts(spark, sf), b.TIE_BREAK).filter(
        "cpv_groupe_fiable").orderBy(F.desc("montant_ratio_mediane_cpv"), "uid").limit(50).select(
        "uid", "montant", "cpv_division", "cpv_groupe_taille", "montant_ratio_mediane_cpv"))
