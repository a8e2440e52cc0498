"""BM25 (Okapi) for many queries, each over its own filtered corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions.text import tokens
from tenderlens.runtime import materialize

# Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 9  # rounding before ranking, so that summation order cannot break ties
MAX_INLINE_TERMS = 1_000_000  # words of queries sent to every task at most
SCORE_CELLS = 1 << 20         # (document, query) scores, or words they add up, that a task holds at once


def tokenised(corpus: DataFrame, text: str = "objet") -> DataFrame:
    """(set_id, uid, words, dl): every row cut into words once, whatever the number of filters."""
    return materialize(
        corpus.select("set_id", "uid", tokens(F.col(text)).alias("words")).withColumn(
            "dl", F.size("words").cast("long")), "words")


def corpus_stats(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Documents and mean length per filter, summed over the sets it occurs in; empty texts count."""
    sums = docs.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length"))
    return sums.join(sets, "set_id").groupBy("filter_id").agg(
        F.sum("n").alias("n_docs"), (F.sum("length") / F.sum("n")).alias("avgdl"))


def term_stats(docs: DataFrame, sets: DataFrame, corpora: DataFrame) -> DataFrame:
    """Document frequency and floored idf of every word of every filter's corpus."""
    counted = docs.select("set_id", F.explode(F.array_distinct("words")).alias("token")).groupBy(
        "set_id", "token").agg(F.count(F.lit(1)).alias("df"))
    frequency = counted.join(sets, "set_id").groupBy("filter_id", "token").agg(F.sum("df").alias("df"))
    raw = frequency.join(corpora, "filter_id").withColumn(
        "raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = materialize(raw, "terms")
    floor = raw.groupBy("filter_id").agg((F.avg("raw_idf") * EPSILON).alias("floor_idf"))
    return raw.join(materialize(floor, "idf_floor"), "filter_id").withColumn(
        "idf", F.when(F.col("raw_idf") < 0, F.col("floor_idf")).otherwise(F.col("raw_idf"))).drop(
        "raw_idf", "floor_idf")


def _single(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A corpus that has ``filter_id`` itself: every filter is a set of its own."""
    docs = corpus.withColumnRenamed("filter_id", "set_id")
    return docs, materialize(docs.select("set_id", F.col("set_id").alias("filter_id")).distinct(), "filter-sets")


def bm25_statistics(corpus: DataFrame, text: str = "objet") -> DataFrame:
    """Index statistics of one corpus: per word df, idf, total count; N and mean length."""
    rows, sets = _single(corpus.withColumn("filter_id", F.lit("all")))
    docs = tokenised(rows, text)
    terms = term_stats(docs, sets, materialize(corpus_stats(docs, sets), "corpora"))
    counts = docs.select(F.explode("words").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("cf"))
    return terms.join(counts, "token").select("token", "df", "cf", "idf", "n_docs", "avgdl")


def _scores(docs: DataFrame, sets: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Non-zero scores; only words some query asks for are counted and shuffled."""
    query_terms = query_terms.join(sets, "filter_id").drop("filter_id")
    wanted = query_terms.select("set_id", "token").distinct()
    postings = docs.select("set_id", "uid", "dl", F.explode("words").alias("token")).join(
        wanted, ["set_id", "token"], "left_semi").groupBy(
        "set_id", "uid", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return postings.join(query_terms, ["set_id", "token"]).groupBy("query_id", "uid").agg(
        F.round(F.sum(F.col("qtf") * F.col("idf") * weight), SCORE_DIGITS).alias("bm25_score")
    ).filter(F.col("bm25_score") != 0)


class _Matches:
    """Which words of which queries a row of a set meets, by the word's number in the vocabulary."""

    def __init__(self, terms: pa.Table, sets: list[dict], held: int = 4 * MAX_INLINE_TERMS):
        self.vocabulary = pc.unique(terms["token"].combine_chunks())
        queries = terms["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids, self.query = queries.dictionary, queries.indices.to_numpy()
        self.code = pc.index_in(terms["token"].combine_chunks(), value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        self.weight = terms["qtf"].to_numpy() * terms["idf"].to_numpy()
        self.avgdl = terms["avgdl"].to_numpy()
        asked: dict = {}
        for i, f in enumerate(terms["filter_id"].to_pylist()):
            asked.setdefault(f, []).append(i)
        self.rows_of: dict = {}
        for pair in sets:
            self.rows_of.setdefault(pair["set_id"], []).extend(asked.get(pair["filter_id"], ()))
        self.held, self.cache = held, {}

    def of(self, set_id) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the set's queries by word, where each word's start, their queries, and these by number."""
        if set_id not in self.cache:
            rows = np.array(self.rows_of.get(set_id, ()), dtype="int64")
            if sum(len(r) for r, *_ in self.cache.values()) + len(rows) > self.held:
                self.cache.clear()
            rows = rows[np.argsort(self.code[rows], kind="stable")]
            starts = np.searchsorted(self.code[rows], np.arange(len(self.vocabulary) + 1))
            queries, place = np.unique(self.query[rows], return_inverse=True)
            self.cache[set_id] = rows, starts, place, queries
        return self.cache[set_id]


class _Best:
    """Running best k documents of every query over what a task has seen; ties go to the smaller uid."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.kept: pa.Table | None = None
        self.new: list[pa.Table] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, queries: np.ndarray, uids: pa.Array) -> None:
        """``scores`` of documents (rows) and queries (columns); 0 is no match."""
        if len(scores) > self.k:
            matched = np.where(scores != 0, scores, -np.inf)
            last = np.partition(matched, len(scores) - self.k, axis=0)[len(scores) - self.k]
            self.floor[queries] = np.maximum(self.floor[queries], last)
        row, place = np.nonzero((scores != 0) & (scores >= self.floor[queries]))
        if not len(row):
            return
        self.new.append(pa.table({"q": queries[place], "score": scores[row, place], "uid": uids.take(pa.array(row))}))
        self.waiting += len(row)
        if self.waiting > max(self.k * len(self.floor), SCORE_CELLS // 8):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        rows = pa.concat_tables([*([] if self.kept is None else [self.kept]), *self.new])
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("uid", "ascending")]))
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], rows["score"].to_numpy()[last])
        self.kept, self.new, self.waiting = rows.filter(pa.array(rank < self.k)).combine_chunks(), [], 0


def _score_batch(batch: pa.RecordBatch, matches: _Matches, best: _Best) -> None:
    """Every document's words are looked up once; scores are summed for a bounded run of documents at a time."""
    words, dl = batch.column("words"), batch.column("dl").to_numpy()
    code = pc.index_in(words.flatten(), value_set=matches.vocabulary)
    found = pc.is_valid(code).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))[found]
    size = max(len(matches.vocabulary), 1)
    pair, tf = np.unique(doc * size + code.drop_null().to_numpy(), return_counts=True)
    doc, code = pair // size, pair % size
    held = batch.column("set_id").dictionary_encode()
    set_of = held.indices.fill_null(-1).to_numpy()
    for number, set_id in enumerate(held.dictionary.to_pylist()):
        rows, starts, place, queries = matches.of(set_id)
        if not len(rows):
            continue
        mine = set_of[doc] == number
        d, c, n = doc[mine], code[mine], tf[mine]
        low, count = starts[c], starts[c + 1] - starts[c]
        docs, first = np.unique(d, return_index=True)
        ends = np.append(np.cumsum(count), 0)[np.append(first[1:], len(d)) - 1]  # words added up, to each document's end
        most, at = max(1, SCORE_CELLS // len(queries)), 0
        while at < len(docs):
            done = ends[at - 1] if at else 0
            to = min(at + most, max(at + 1, int(np.searchsorted(ends, done + SCORE_CELLS, side="right"))))
            some = slice(first[at], first[to] if to < len(docs) else len(d))
            times = count[some]
            before = np.cumsum(times) - times
            at_row = np.arange(times.sum()) + np.repeat(low[some] - before, times)
            term = rows[at_row]
            many = np.repeat(n[some], times)
            length = np.repeat(dl[d[some]], times)
            value = matches.weight[term] * (many * (K1 + 1) / (
                many + K1 * (1 - B + B * length / matches.avgdl[term])))
            cell = np.repeat(np.searchsorted(docs[at:to], d[some]), times) * len(queries) + place[at_row]
            scores = np.bincount(cell, value, (to - at) * len(queries)).reshape(to - at, len(queries))
            best.add(np.round(scores, SCORE_DIGITS), queries, batch.column("uid").take(pa.array(docs[at:to])))
            at = to


def _best_in_place(docs: DataFrame, sets: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """The best ``k`` non-zero scores of every query in every task: documents stay where they are.

    Each row of ``docs`` is a document of its own here; queries of up to MAX_INLINE_TERMS words travel.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (query_terms.toArrow(), [r.asDict() for r in sets.select("set_id", "filter_id").collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(*shared.value)
        best = _Best(len(matches.ids), k)
        for batch in batches:
            _score_batch(batch, matches, best)
        best.merge()
        if best.kept is not None:
            out = pa.table({"query_id": matches.ids.take(best.kept["q"].combine_chunks()),
                            "uid": best.kept["uid"], "bm25_score": best.kept["score"]})
            yield from out.to_batches(max_chunksize=10_000)

    types = dict(query_terms.dtypes) | {"uid": dict(docs.dtypes)["uid"]}
    return docs.select("set_id", "uid", "words", "dl").mapInArrow(
        scan, f"query_id {types['query_id']}, uid {types['uid']}, bm25_score double")


def _best_scores(docs: DataFrame, sets: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """Non-zero scores, at least the best ``k`` of every query.

    Rows that share a uid, or have none, add up to one document wherever they are, so these
    are grouped by Spark; so is everything when the queries have too many words to travel.
    """
    if query_terms.count() > MAX_INLINE_TERMS:
        return _scores(docs, sets, query_terms)
    shared = materialize(docs.groupBy("uid").agg(F.count(F.lit(1)).alias("_n")).filter(
        (F.col("_n") > 1) | F.col("uid").isNull()).select("uid"), "shared-uids")
    if shared.isEmpty():
        return _best_in_place(docs, sets, query_terms, k)
    alone = docs.filter(F.col("uid").isNotNull()).join(shared, "uid", "left_anti")
    together = docs.join(shared.withColumnRenamed("uid", "_uid"), F.col("uid").eqNullSafe(F.col("_uid")), "left_semi")
    return _best_in_place(alone, sets, query_terms, k).unionByName(_scores(together, sets, query_terms))


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "uid")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_rank(corpus: DataFrame, queries: DataFrame, k: int = 50, text: str = "objet",
              include_zero_scores: bool = True, sets: DataFrame | None = None) -> DataFrame:
    """(query_id, uid, bm25_score, rank) with rank <= k per query.

    ``corpus`` has filter_id, uid and the text, or set_id in place of filter_id when ``sets``
    says which filters (set_id, filter_id) a row belongs to; ``queries`` has query_id, filter_id
    and texte_libre.  Blank queries return nothing.  With ``include_zero_scores`` a
    query that matches fewer than k documents is filled up with documents of score
    zero in uid order, without scoring every (query, document) pair.
    """
    asked = queries.filter(F.trim("texte_libre") != "").select(
        "query_id", "filter_id", tokens(F.col("texte_libre")).alias("words"))
    if sets is None:
        corpus, sets = _single(corpus)
    docs = tokenised(corpus, text)
    corpora = materialize(corpus_stats(docs, sets), "corpora")
    terms = term_stats(docs, sets, corpora)
    members = docs.select("set_id", "uid").join(sets, "set_id").select("filter_id", "uid")
    query_terms = asked.select("query_id", "filter_id", F.explode("words").alias("token")).groupBy(
        "query_id", "filter_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    query_terms = materialize(
        terms.join(query_terms, ["filter_id", "token"]).select(
            "query_id", "filter_id", "token", "qtf", "idf", "avgdl"), "query_terms")
    scored = _best_scores(docs, sets, query_terms, k)
    if not include_zero_scores:
        return _top(scored, k)
    best = materialize(_top(scored, k), "bm25_top")

    # Zero-score documents.  A query with fewer than k non-zero documents has all of
    # them in ``best``, so among the first 2k documents of its corpus at least k are
    # zero (or the corpus is smaller).
    firsts = Window.partitionBy("filter_id").orderBy("uid")
    pool = materialize(members.withColumn(
        "_rn", F.row_number().over(firsts)).filter(F.col("_rn") <= 2 * k), "pool")
    found = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("bm25_score").alias("_min"))
    open_queries = asked.select("query_id", "filter_id").join(found, "query_id", "left").filter(
        F.coalesce(F.col("_n"), F.lit(0)) < k)
    parts = [best.drop("rank"),
             open_queries.select("query_id", "filter_id").join(pool, "filter_id").join(
                 best, ["query_id", "uid"], "left_anti").select("query_id", "uid", F.lit(0.0).alias("bm25_score"))]
    # Negative scores (possible when most words are in most documents) rank below
    # zero; a query full of them needs its complete match list to know its zeros.
    hard = asked.join(found.filter((F.col("_n") >= k) & (F.col("_min") < 0)), "query_id").select(
        "query_id", "filter_id")
    if not hard.isEmpty():
        matched = _scores(docs, sets, query_terms.join(hard, ["query_id", "filter_id"], "left_semi"))
        zeros = hard.join(members, "filter_id").join(
            matched, ["query_id", "uid"], "left_anti").withColumn("bm25_score", F.lit(0.0))
        parts.append(_top(zeros.select("query_id", "uid", "bm25_score"), k).drop("rank"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return _top(merged, k)
