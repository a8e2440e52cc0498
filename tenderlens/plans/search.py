"""Hybrid search: strict filters, BM25 and vectors, fused, for a table of queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.operators.bm25 import bm25_rank
from tenderlens.operators.fusion import fuse_configs, reciprocal_rank_fusion
from tenderlens.operators.query_log import parse_queries
from tenderlens.operators.strict_filters import Filtered, filter_members, with_filter_id
from tenderlens.operators.vectors import vector_topk
from tenderlens.runtime import materialize
from tenderlens.sources.vector_store import Encoder, encode, upsert_vectors

BM25_WEIGHT, VECTOR_WEIGHT = "bm25", "embeddings"


@dataclass
class SearchParts:
    """Intermediate tables of one search over many queries; the costly ones are stored."""

    parsed: DataFrame      # query_id, filter_id, parsed columns
    filtered: Filtered     # which filters keep which rows of the corpus, stored once
    bm25: DataFrame        # query_id, by columns, uid, rank
    vectors: DataFrame     # query_id, by columns, uid, rank
    n_corpus: DataFrame    # pop, n
    held: DataFrame        # uid, set_id: kept contracts that have a vector
    asked: DataFrame       # query_id: queries that have one

    @property
    def subset(self) -> DataFrame:
        """filter_id, uid and corpus columns, one row per filter and contract; not stored."""
        return self.filtered.subset()


def search_parts(corpus: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
                 tie_break: Sequence[str], bm25_candidates: int = 200,
                 embedding_candidates: int = 200, include_zero_scores: bool = True,
                 by: Sequence[str] = (), encoding: Encoding | None = None) -> SearchParts:
    """Everything up to the two candidate rankings.

    ``queries``: query_id, requete and optionally pop.  ``vectors``: uid, vec;
    ``query_vectors``: query_id, qvec.  ``by`` names extra columns (such as model)
    that vectors and query vectors share; both rankings then carry them.  With ``encoding``
    they are not given: contracts that pass some filter and have no stored vector are encoded
    and stored first, and the queries' free texts are encoded too.
    """
    parsed = materialize(with_filter_id(parse_queries(queries)), "parsed")
    if "pop" not in corpus.columns:
        corpus = corpus.withColumn("pop", F.lit("all"))
    filtered = filter_members(corpus, parsed, tie_break)
    texted = parsed.filter(F.trim("texte_libre") != "")
    bm25 = bm25_rank(filtered.documents(), texted, bm25_candidates, include_zero_scores=include_zero_scores,
                     sets=filtered.sets)
    if encoding is not None:
        vectors, query_vectors = _encoded(filtered, texted, encoding)
    by = list(by)
    held = filtered.kept.select("set_id", "uid").join(vectors.select("uid", *by, "vec"), "uid")
    asked = texted.select("query_id", "filter_id").join(
        query_vectors.select("query_id", *by, "qvec"), "query_id")
    if by:  # one ranking per (query, by): the pair is the query seen by the search
        asked = asked.withColumn("_q", F.col("query_id")).withColumn(
            "query_id", F.concat_ws("\x1f", F.col("_q").cast("string"), *by))
        pairs = materialize(asked.select(F.col("query_id").alias("_pair"), F.col("_q").alias("query_id"), *by), "pairs")
    answered = asked.select(F.col("_q" if by else "query_id").alias("query_id")).distinct()
    near = vector_topk(held, asked.select("query_id", "filter_id", *by, "qvec"), embedding_candidates, by,
                       sets=filtered.sets)
    if by:
        near = near.withColumnRenamed("query_id", "_pair").join(pairs, "_pair").drop("_pair")
        bm25 = bm25.join(pairs.drop("_pair"), "query_id")
    near = near.select("query_id", *by, "uid", "score", "rank")
    return SearchParts(parsed, filtered, bm25, near, corpus.groupBy("pop").agg(F.count(F.lit(1)).alias("n")),
                       held.select("set_id", "uid").distinct(), answered)


@dataclass
class Encoding:
    """An encoder, and the store that keeps what it has encoded under its model's name."""

    encoder: Encoder
    store: str
    model: str


def _encoded(filtered: Filtered, texted: DataFrame, encoding: Encoding) -> tuple[DataFrame, DataFrame]:
    """Vectors of all kept contracts, from the store where it has them, and of the queries."""
    texts = filtered.documents().select("uid", "objet")
    kind, asked_kind = dict(texts.dtypes)["uid"], dict(texted.dtypes)["query_id"]
    stored = upsert_vectors(texts, encoding.store, encoding.model, encoding.encoder)
    vectors = stored.filter(F.col("model") == encoding.model).select(F.col("uid").cast(kind).alias("uid"), "vec")
    asked = encode(texted.select(F.col("query_id").alias("uid"), F.col("texte_libre").alias("objet")),
                   encoding.model, encoding.encoder)
    return vectors, materialize(asked.select(F.col("uid").cast(asked_kind).alias("query_id"), F.col("vec").alias("qvec")),
                                "query-vectors")


def _unranked(parsed: DataFrame, filtered: Filtered, top_k: int) -> DataFrame:
    """Queries without free text list their filtered contracts in uid order."""
    blank = parsed.filter(F.trim("texte_libre") == "").select("query_id", "filter_id")
    firsts = Window.partitionBy("filter_id").orderBy("uid")
    heads = filtered.members().select("filter_id", "uid").withColumn(
        "rank", F.row_number().over(firsts)).filter(F.col("rank") <= top_k)
    return blank.join(heads, "filter_id").select(
        "query_id", "uid", F.lit(None).cast("double").alias("rrf_score"), "rank")


def filter_only_search(corpus: DataFrame, queries: DataFrame, tie_break: Sequence[str],
                       top_k: int = 20) -> DataFrame:
    """Strict filters alone: the first contracts of every query's subset."""
    parsed = materialize(with_filter_id(parse_queries(queries)), "parsed")
    filtered = filter_members(corpus, parsed, tie_break)
    blank = parsed.withColumn("texte_libre", F.lit(""))
    return _with_columns(parsed, filtered, _unranked(blank, filtered, top_k)).drop("rrf_score")


def _with_columns(parsed: DataFrame, filtered: Filtered, ranked: DataFrame) -> DataFrame:
    """Corpus columns for the few ranked rows."""
    keyed = ranked.join(parsed.select("query_id", "filter_id"), "query_id")
    placed = materialize(keyed.join(filtered.members(), ["filter_id", "uid"]).drop("filter_id", "uid"), "ranked-rows")
    return filtered.rows.drop("pop").join(placed, "row_id").drop("row_id")


def hybrid_results(parts: SearchParts, top_k: int = 20, weights: Sequence[float] | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """Fused top-k with corpus columns, rrf_score and rank."""
    by = list(by)
    fused = reciprocal_rank_fusion([parts.bm25, parts.vectors], weights=weights,
                                   by=["query_id", *by], top_k=top_k)
    if not by:
        fused = fused.unionByName(_unranked(parts.parsed, parts.filtered, top_k))
    return _with_columns(parts.parsed, parts.filtered, fused)


def hybrid_configs(parts: SearchParts, configs: Mapping[str, Sequence[float]],
                   top_k: int = 20) -> DataFrame:
    """Same rankings fused under several (bm25, vector) weightings."""
    fused = fuse_configs({BM25_WEIGHT: parts.bm25, VECTOR_WEIGHT: parts.vectors},
                         {c: {BM25_WEIGHT: w[0], VECTOR_WEIGHT: w[1]} for c, w in configs.items()},
                         top_k=top_k)
    return _with_columns(parts.parsed, parts.filtered, fused)


def hybrid_search(corpus: DataFrame, queries: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None,
                  tie_break: Sequence[str], top_k: int = 20, bm25_candidates: int = 200,
                  embedding_candidates: int = 200, weights: Sequence[float] | None = None,
                  include_zero_scores: bool = True, encoding: Encoding | None = None) -> DataFrame:
    """Fused top-k of every query.  Vectors are given, or made and stored with ``encoding``."""
    parts = search_parts(corpus, queries, vectors, query_vectors, tie_break, bm25_candidates,
                         embedding_candidates, include_zero_scores, encoding=encoding)
    return hybrid_results(parts, top_k, weights)


def explain_search(parts: SearchParts) -> DataFrame:
    """One row per query: filters applied, sizes before and after, candidate counts.

    Candidate counts are null where the search stopped after the filters; so are the number
    of contracts that the vector ranking does not know, and whether it knows the query.
    """
    sets = parts.filtered.sets

    def per_filter(rows: DataFrame, name: str) -> DataFrame:
        counted = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n"))
        return counted.join(sets, "set_id").groupBy("filter_id").agg(F.sum("_n").alias(name))

    def count_of(ranking: DataFrame, name: str) -> DataFrame:
        return ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))

    out = parts.parsed.join(parts.n_corpus, "pop", "left").join(
        per_filter(parts.filtered.kept, "_after"), "filter_id", "left").join(
        per_filter(parts.held, "_held"), "filter_id", "left").join(
        count_of(parts.bm25, "_b"), "query_id", "left").join(
        count_of(parts.vectors, "_v"), "query_id", "left").join(
        parts.asked.withColumn("_asked", F.lit(True)), "query_id", "left")
    after = F.coalesce("_after", F.lit(0))
    full = (after > 0) & (F.trim("texte_libre") != "")
    return out.select(
        "query_id", F.col("region").alias("region_filtree"),
        F.col("montant_min").alias("montant_min_applique"), "montant_eleve_qualitatif",
        F.col("texte_libre").alias("texte_recherche"),
        F.coalesce("n", F.lit(0)).alias("n_marches_avant_filtre"),
        after.alias("n_marches_apres_filtre_strict"),
        F.when(full, F.coalesce("_b", F.lit(0))).alias("n_candidats_bm25"),
        F.when(full, F.coalesce("_v", F.lit(0))).alias("n_candidats_embeddings"),
        F.when(full, after - F.coalesce("_held", F.lit(0))).alias("n_marches_sans_vecteur"),
        F.when(full, F.col("_asked").isNull()).alias("requete_sans_vecteur"))
