"""Retrieval metrics, evaluation tables and configuration sweeps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions.text import is_relevant, keyword_keys, text_key
from tenderlens.operators.bm25 import bm25_rank
from tenderlens.operators.contracts import dedup_contracts
from tenderlens.operators.ranks import sample_exact
from tenderlens.plans.search import hybrid_configs, hybrid_results, search_parts
from tenderlens.runtime import materialize

# Test themes with the keywords that make a text relevant.
KEYWORDS = {
    "cybersecurite": ["securite des systemes d information", "cybersecurite", "cyber securite",
                      "securite du si", "securite informatique"],
    "travaux_voirie": ["voirie", "chaussee", "trottoir", "revetement"],
    "restauration_scolaire": ["restauration scolaire", "cantine", "repas"],
    "espaces_verts": ["espaces verts", "tonte", "elagage", "espaces naturels"],
}

# Test queries; the hard ones share no keyword with their theme.
EASY_QUERIES = {
    "cybersecurite": "marchés de cybersécurité en Île-de-France de montant élevé",
    "travaux_voirie": "travaux de voirie et de chaussée",
    "restauration_scolaire": "marchés de restauration scolaire et cantine",
    "espaces_verts": "entretien des espaces verts et tonte",
}
HARD_QUERIES = {
    "cybersecurite_difficile": "protection des systèmes informatiques en Île-de-France de montant élevé",
    "travaux_voirie_difficile": "entretien des routes communales",
    "restauration_scolaire_difficile": "nourriture destinée aux enfants dans les établissements primaires",
    "espaces_verts_difficile": "maintenance des parcs municipaux",
}

# Corpus sample size per theme, and for any other theme.
SAMPLE_SIZES = {"cybersecurite": 100_000, "travaux_voirie": 15_000,
                "restauration_scolaire": 15_000, "espaces_verts": 15_000}
DEFAULT_SAMPLE_SIZE = 15_000

# Fusion weightings compared by the sweep, (BM25, vectors).
RRF_CONFIGS = {"egal": (1.0, 1.0), "bm25_x3": (3.0, 1.0), "embeddings_x3": (1.0, 3.0)}

_HARD_SUFFIX = "_difficile"


def sample_size_for(name: Column, sizes: Mapping[str, int] | None = None,
                    default: int = DEFAULT_SAMPLE_SIZE) -> Column:
    """Sample size of a query's theme, easy or hard."""
    sizes = SAMPLE_SIZES if sizes is None else sizes
    table = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.replace(name, F.lit(_HARD_SUFFIX), F.lit(""))),
                      F.lit(default))


def theme_queries(spark: SparkSession, queries: Mapping[str, str],
                  keywords: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Test queries as a table: query_id (name), requete, mots_cles (normalised)."""
    keywords = KEYWORDS if keywords is None else keywords
    rows = [(n, q, list(keywords[n.replace(_HARD_SUFFIX, "")])) for n, q in queries.items()]
    frame = spark.createDataFrame(rows, "query_id string, requete string, mots_cles array<string>")
    return frame.withColumn("mots_cles", keyword_keys(F.col("mots_cles")))


def relevant_in_corpus(corpus: DataFrame, queries: DataFrame, text: str = "objet",
                       on: str | None = None) -> DataFrame:
    """(query_id, n_pertinents_corpus): relevant texts per query.

    ``on`` restricts a query to corpus rows of its own population or filter.  The
    text key is computed once per row, and only matching query ids are emitted.
    """
    keyed = corpus.select(*([on] if on else []), text_key(F.col(text)).alias("_key"))
    asked = queries.groupBy(*([on] if on else [])).agg(
        F.collect_list(F.struct("query_id", "mots_cles")).alias("_queries"))
    asked = materialize(asked, "asked")
    pairs = keyed.join(asked, on) if on else keyed.withColumn(
        "_queries", asked.select("_queries").scalar())
    hits = pairs.select(F.explode(F.transform(
        F.filter("_queries", lambda q: F.exists(q["mots_cles"], lambda k: F.contains(F.col("_key"), k))),
        lambda q: q["query_id"])).alias("query_id"))
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("_n", F.lit(0)).alias("n_pertinents_corpus"))


def judged(results: DataFrame, queries: DataFrame, text: str = "objet") -> DataFrame:
    """Results with ``rel``: does the text contain a keyword of its query."""
    return results.join(queries.select("query_id", "mots_cles"), "query_id").withColumn(
        "rel", is_relevant(text_key(F.col(text)), F.col("mots_cles")))


def precision_at(k: int) -> Column:
    """Relevant among the first k, always over k; k = 0 gives 0."""
    return F.count_if(F.col("rel") & (F.col("rank") <= k)) / F.lit(k) if k else F.lit(0.0)


def dcg_at(k: int) -> Column:
    gain = F.when(F.col("rel") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0))
    return F.coalesce(F.sum(gain), F.lit(0.0))


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """Gain of the best possible ranking: min(n_relevant, k) hits in front."""
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1.0 / math.log2(i + 1))
    return F.element_at(F.array(*[F.lit(x) for x in sums]), F.least(n_relevant, F.lit(k)).cast("int") + 1)


def evaluate(results: DataFrame, queries: DataFrame, relevant: DataFrame | None = None,
             k_values: Sequence[int] = (5, 10, 20), by: Sequence[str] = (), text: str = "objet",
             digits: int | None = 3) -> DataFrame:
    """One row per query (and ``by`` key) with precision@k, and with ``relevant``
    (query_id, n_pertinents_corpus) also recall@k and ndcg@k; without it ndcg is null.
    ``digits=None`` keeps the metrics unrounded.
    """
    by = list(by)
    sums = judged(results, queries, text).groupBy("query_id", *by).agg(
        F.count(F.lit(1)).alias("n_resultats"),
        *[c for k in k_values for c in (
            precision_at(k).alias(f"_p{k}"), dcg_at(k).alias(f"_d{k}"),
            F.count_if(F.col("rel") & (F.col("rank") <= k)).alias(f"_h{k}"))])
    asked = queries.select("query_id")
    if by:
        # Every query gets a row for every compared setting, also without results.
        settings = results.agg(F.collect_set(F.struct(*by)).alias("_s")).scalar()
        asked = asked.select("query_id", F.inline(settings))
    out = asked.join(sums, ["query_id", *by], "left")
    if relevant is not None:
        out = out.join(relevant, "query_id", "left")
    n = F.col("n_pertinents_corpus")

    def shown(value: Column) -> Column:
        return F.bround(value, digits) if digits is not None else value

    columns = []
    for k in k_values:
        columns.append(shown(F.coalesce(F.col(f"_p{k}"), F.lit(0.0))).alias(f"precision@{k}"))
        if relevant is None:
            columns.append(F.lit(None).cast("double").alias(f"ndcg@{k}"))
            continue
        ideal = ideal_dcg(n, k)
        columns.append(shown(F.when(ideal > 0, F.coalesce(F.col(f"_d{k}"), F.lit(0.0)) / ideal)
                             .otherwise(F.lit(0.0))).alias(f"ndcg@{k}"))
        columns.append(shown(F.when(n > 0, F.coalesce(F.col(f"_h{k}"), F.lit(0)) / n)).alias(f"recall@{k}"))
    return out.select(
        F.col("query_id").alias("nom"), *by, F.coalesce("n_resultats", F.lit(0)).alias("n_resultats"),
        *(["n_pertinents_corpus"] if relevant is not None else []), *columns)


def themed_samples(corpus: DataFrame, row_keys: Sequence[str],
                   sizes: Sequence[int], seed: int = 42) -> DataFrame:
    """One seeded sample per distinct size, told apart by ``pop`` (the size)."""
    parts = [sample_exact(corpus, size, seed, row_keys).withColumn("pop", F.lit(str(size)))
             for size in sorted(set(sizes))]
    return materialize(reduce(DataFrame.unionByName, parts), "samples")


def _populations(corpus: DataFrame, queries: DataFrame, row_keys: Sequence[str],
                 sizes: Mapping[str, int] | None, default: int | None) -> tuple[DataFrame, DataFrame]:
    """The corpus by population and every query's population: one, the whole corpus,
    unless the caller gives sample sizes."""
    if sizes is None and default is None:
        return corpus.withColumn("pop", F.lit("all")), queries.withColumn("pop", F.lit("all"))
    default = DEFAULT_SAMPLE_SIZE if default is None else default
    sized = queries.withColumn(
        "pop", sample_size_for(F.col("query_id"), sizes, default).cast("string"))
    chosen = {default, *(SAMPLE_SIZES if sizes is None else sizes).values()}
    return themed_samples(corpus, row_keys, sorted(chosen)), sized


def evaluate_bm25(corpus: DataFrame, queries: DataFrame, row_keys: Sequence[str],
                  sizes: Mapping[str, int] | None = None, default: int | None = None,
                  k_values: Sequence[int] = (5, 10), digits: int | None = 3,
                  dedup_by: Sequence[str] | None = None) -> DataFrame:
    """BM25 alone on the raw query text; contracts are not deduplicated unless
    ``dedup_by`` gives the order of a contract's rows."""
    sample, sized = _populations(corpus, queries, row_keys, sizes, default)
    if dedup_by:
        sample = dedup_contracts(sample, dedup_by, ["pop"])
    docs = sample.withColumn("filter_id", F.col("pop"))
    asked = sized.select("query_id", F.col("pop").alias("filter_id"), F.col("requete").alias("texte_libre"))
    ranked = bm25_rank(docs, asked, 20)
    results = ranked.join(asked.select("query_id", "filter_id"), "query_id").join(
        docs.select("filter_id", "uid", "objet"), ["filter_id", "uid"])
    relevant = relevant_in_corpus(docs, sized.withColumn("filter_id", F.col("pop")), on="filter_id")
    table = evaluate(results, queries, relevant, k_values, digits=digits)
    return _with_sample_size(table, sample, sized)


def _with_sample_size(table: DataFrame, sample: DataFrame, sized: DataFrame) -> DataFrame:
    counts = sample.groupBy("pop").agg(F.count(F.lit(1)).alias("n_echantillon"))
    sizes = sized.select(F.col("query_id").alias("nom"), "pop").join(counts, "pop", "left").drop("pop")
    return table.join(sizes, "nom", "left")


def evaluate_hybrid(corpus: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
                    row_keys: Sequence[str], tie_break: Sequence[str],
                    sizes: Mapping[str, int] | None = None, default: int | None = None,
                    k_values: Sequence[int] = (5, 10), digits: int | None = 3) -> DataFrame:
    """Full pipeline; recall and NDCG against the strictly filtered rows."""
    sample, sized = _populations(corpus, queries, row_keys, sizes, default)
    parts = search_parts(sample, sized, vectors, query_vectors, tie_break)
    results = materialize(hybrid_results(parts), "results")
    filtered = sized.join(parts.parsed.select("query_id", "filter_id"), "query_id")
    relevant = relevant_in_corpus(parts.subset, filtered, on="filter_id")
    table = evaluate(results, queries, relevant, k_values, digits=digits)
    return _with_sample_size(table, sample, sized)


def sweep_weights(corpus: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
                  row_keys: Sequence[str], tie_break: Sequence[str],
                  configs: Mapping[str, Sequence[float]] | None = None,
                  sizes: Mapping[str, int] | None = None, default: int | None = None,
                  k_values: Sequence[int] = (5, 10), digits: int | None = 3) -> DataFrame:
    """Fusion weightings side by side; rankings are computed once.  The reference
    set of relevant texts is the whole sample here, before filters."""
    sample, sized = _populations(corpus, queries, row_keys, sizes, default)
    parts = search_parts(sample, sized, vectors, query_vectors, tie_break)
    results = materialize(hybrid_configs(parts, configs or RRF_CONFIGS), "results")
    relevant = relevant_in_corpus(sample, sized, on="pop")
    return evaluate(results, queries, relevant, k_values, ["configuration"], digits=digits)


def compare_vector_sets(corpus: DataFrame, queries: DataFrame, vectors: DataFrame,
                        query_vectors: DataFrame, row_keys: Sequence[str], tie_break: Sequence[str],
                        sizes: Mapping[str, int] | None = None, default: int | None = None,
                        k_values: Sequence[int] = (5, 10), digits: int | None = 3) -> DataFrame:
    """Same queries under several embedding models, told apart by ``model``."""
    sample, sized = _populations(corpus, queries, row_keys, sizes, default)
    parts = search_parts(sample, sized, vectors, query_vectors, tie_break, by=["model"])
    results = materialize(hybrid_results(parts, by=["model"]), "results")
    relevant = relevant_in_corpus(sample, sized, on="pop")
    return evaluate(results, queries, relevant, k_values, ["model"], digits=digits)


def annotation_agreement(annotated: DataFrame, queries: DataFrame) -> DataFrame:
    """Human judgement against the keyword rule, per query; unknown queries are skipped."""
    known = queries.select(F.col("query_id").alias("requete"), "mots_cles")
    both = annotated.join(known, "requete").withColumn(
        "rule", is_relevant(text_key(F.col("objet")), F.col("mots_cles")).cast("int"))
    return both.groupBy("requete").agg(
        F.count(F.lit(1)).alias("n_lignes"),
        F.avg((F.col("rule") == F.col("pertinent")).cast("double")).alias("taux_accord"),
        F.count_if((F.col("rule") == 1) & (F.col("pertinent") == 0)).alias("faux_positifs_motscles"),
        F.count_if((F.col("rule") == 0) & (F.col("pertinent") == 1)).alias("faux_negatifs_motscles"))
