"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

Two texts of Jaccard similarity t or more share a token within the first
n - ceil(t*n) + 1 tokens of any common token order, and at least ``l`` tokens when both
prefixes are ``l`` - 1 longer.  Every document picks its own ``l`` by estimated cost: a longer
prefix reads more postings but sends fewer candidates to verification.  A pair must share
min(l) tokens within the shorter of the two extensions; no ``l`` exceeds ceil(t*n), the least
overlap that a link of its set can have.

The order is rare first.  Tokens are hashes, cut to 48 bits where they are counted and matched, which
can only add candidates (links are compared on whole hashes); document frequencies are counted over the tokens
whose hash lies below a fixed part of the hash space (the pool, a little wider than a prefix),
which are the only ones a prefix can need, so most of the shingles are never shuffled.  A pool
token that occurs once in the corpus cannot match and is dropped after counting.

Candidates are gathered into clusters before anything large moves: pairs from short posting
lists that share enough tokens, and stars over the long lists, where listing all pairs would
be quadratic.  Then each candidate text travels to its cluster once, pairs that share enough
prefix tokens are compared in full, and a spanning forest of the links is returned; the
connected components are exact.

Clusters too large to compare in one group are narrowed first.  Their documents get a new order,
over all of their tokens instead of the pool, so that a passage many of them hold no longer
reaches their prefixes.  In what is still large, every member meets a few pivots, the members
with the largest share of tokens that others have too.  Jaccard distance obeys the triangle
inequality: a member whose pivot is, by distance, out of reach of all that the pivot's links
do not join goes, and so do the pivots.  Rounds end when they no longer help; what is left is compared block by
block, where copies of a text grow with the size of that rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.llm.common import LOWER, SPACE, SpanHash, chunks, lists, mix, split_runs, utf8
from tenderlens.llm.components import connected_components
from tenderlens.runtime import materialize

CUT = np.uint64(16)  # low bits of a hash that do not travel
POOL = 1.5  # width of the counted part of the hash space, in prefixes
MOST_MATCHES = 8  # longest extension
VERIFY_COST = 8.0  # cost of one verification against one posting read
SHORT_LIST = 24  # postings up to which all pairs of a list are listed
SMALL_IDS = 1_000_000  # candidate ids (8 MB) that may be broadcast to the texts; beyond, the texts are shuffled
BLOCK = 384  # documents of a cluster that are compared in one group with another block
PIVOTS = 8  # documents of a large cluster that all its members are compared with in a round
WORTH = 0.25  # share of the members that a round must settle for another one to follow


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of every text.

    Letters A-Z are lowered; words are ``[^\\x20\\x09-\\x0D]+``.  A text with fewer words is one
    shingle, one without words has none.
    """
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, text_of = split_runs(~SPACE[data], offsets)
    h = SpanHash(data).of(starts, ends)
    n = np.bincount(text_of, minlength=len(offsets) - 1)
    stop = np.cumsum(n)
    step = np.uint64(0x9E3779B97F4A7C15)
    joined = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for j in range(words):
        joined = mix(joined * step + h[j:j + len(joined)])
    sets = []
    for m, end in zip(n.tolist(), stop.tolist(), strict=True):
        if m >= words:
            sets.append(np.unique(joined[end - m:end - words + 1]))
        elif m:
            one = np.uint64(m)
            for x in h[end - m:end]:
                one = mix(np.array([one], np.uint64) * step + x)[0]
            sets.append(np.array([one], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _base_prefix(n, similar: int):
    """n - ceil(similar/100 * n) + 1."""
    return n - (similar * n + 99) // 100 + 1


def most_matches(n: int, similar: int) -> int:
    """The longest extension of a set of n: no link may have to share more than ceil(similar/100 * n) tokens."""
    return max(1, min(MOST_MATCHES, (similar * n + 99) // 100))


def _sketch(docs: DataFrame, words: int, similar: int, pool: float = POOL) -> DataFrame:
    """doc_id, n, signature of the whole set, pool tokens in hash order, how many of them are counted.

    The pool is ``pool`` times as wide as a prefix, and all tokens at most.  Two shingles of a set
    that share their token count once; prefixes go by n, so that makes them longer, never too short.
    """
    edge = np.uint64(int(min(pool * (100 - similar) / 100, 1.0) * (1 << 64)) - 1) >> CUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n, sign, pools, counted = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                tokens = np.unique(s >> CUT)
                inside = int(np.searchsorted(tokens, edge, "right"))
                longest = _base_prefix(len(s), similar) + MOST_MATCHES - 1
                n.append(len(s))
                counted.append(inside)
                pools.append(tokens[:max(inside, longest)])
                sign.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            flat = np.concatenate(pools).view(np.int64) if pools else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(sign, pa.binary()),
                lists(flat, np.array([len(p) for p in pools]), pa.int64()), pa.array(counted, pa.int64())],
                ["doc_id", "n", "sign", "pool", "counted"])

    return docs.mapInArrow(run, "doc_id long, n long, sign binary, pool array<long>, counted long")


def choose_matches(frequency: np.ndarray, level: np.ndarray, most: int = MOST_MATCHES) -> int:
    """The extension up to ``most`` with the least estimated cost: postings read plus candidates verified."""
    costs = []
    for matches in range(1, most + 1):
        read = float(frequency[level <= matches].sum())
        costs.append(read + VERIFY_COST * read / matches)
    return int(np.argmin(costs)) + 1


def _prefixes(shared: DataFrame, similar: int) -> DataFrame:
    """doc_id, n, matches, the (token, level) of its adaptive prefix, and how much it has in common.

    ``shared`` has doc_id, n, counted and the tokens that other documents emitted too, as
    (frequency above 32 bits for the place in hash order behind the counted ones, 0 for these; token).  ``level`` is the least extension that holds a token.
    ``central`` is the share of the counted tokens that others have too, ``often`` their mean frequency.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, n, counted, tokens in zip(frame["doc_id"], frame["n"], frame["counted"], frame["tokens"], strict=True):
                often, place = np.divmod(np.array([t["df_pos"] for t in tokens], np.int64), 1 << 32)
                token = np.array([t["token"] for t in tokens], np.int64)
                first = place == 0
                # Counted tokens: singles first, then by frequency; the others follow in hash order.
                order = np.lexsort((token.view(np.uint64), np.where(first, often, 0), ~first))
                place, often, token, first = place[order], often[order], token[order], first[order]
                k = int(first.sum())
                central, mean = (k / counted, float(often[:k].mean())) if k else (0.0, 0.0)
                place = np.where(first, counted - k + np.arange(len(place)), counted - 1 + place)
                level = np.maximum(place - _base_prefix(n, similar) + 2, 1)
                matches = choose_matches(often, level, most_matches(n, similar))
                keep = level <= matches
                if keep.any():
                    out.append((doc_id, n, matches, token[keep], level[keep].astype(np.int32), often[keep], central, mean))
            yield pd.DataFrame(out, columns=["doc_id", "n", "matches", "tokens", "levels", "dfs", "central", "often"])

    return shared.mapInPandas(run, "doc_id long, n long, matches int, tokens array<long>, levels array<int>, dfs array<long>, "
                                   "central double, often double")


def _ordered(base: DataFrame, similar: int, without: DataFrame | None = None) -> DataFrame:
    """The prefixes of sketched documents but those of ``without`` (doc_id, sign), whose tokens still count."""
    frequent = base.select(F.explode("pool").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = base if without is None else base.join(without, ["doc_id", "sign"], "left_anti")
    # Every token crosses the network with its document's id and its place behind the counted ones, nearly always 0.
    own = own.filter("doc_id is not null")
    emitted = own.select("doc_id", "counted", F.posexplode("pool").alias("pos", "token")).select(
        "doc_id", "token", F.greatest(F.col("pos") + 1 - F.col("counted"), F.lit(0)).cast("int").alias("pos"))
    shared = emitted.join(frequent, "token").groupBy("doc_id").agg(F.collect_set(F.struct(
        (F.shiftleft(F.least("df", F.lit((1 << 31) - 1)), 32) + F.col("pos")).alias("df_pos"), "token")).alias("tokens"))
    # Texts that share an id: the smaller numbers only make its prefix longer.
    sizes = own.groupBy("doc_id").agg(F.min("n").alias("n"), F.min("counted").alias("counted"))
    shared = shared.join(sizes, "doc_id")
    return materialize(_prefixes(shared, similar), "near-prefixes")


def _candidates(prefixes: DataFrame, similar: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares enough prefix tokens."""
    postings = prefixes.select("doc_id", "n", "matches", F.explode(F.arrays_zip("tokens", "levels", "dfs")).alias("_t")).select(
        F.col("_t.tokens").alias("token"), "doc_id", "n", "matches", F.col("_t.levels").alias("level"), F.col("_t.dfs").alias("df"))
    postings = materialize(postings, "near-postings")
    # A list is never longer than its token's frequency, so only lists of frequent tokens are counted.
    often = postings.filter(F.col("df") > SHORT_LIST)
    sizes = materialize(often.groupBy("token").agg(
        F.count(F.lit(1)).alias("_m"), F.min("doc_id").alias("_hub")).filter("_m > 1"), "near-lists")
    short = postings.filter(F.col("df") <= SHORT_LIST).unionByName(
        often.join(sizes.filter(F.col("_m") <= SHORT_LIST).select("token"), "token", "left_semi"))
    # At most SHORT_LIST entries each, by ascending id.
    lists_ = short.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n", "matches", "level"))).alias("_list"))
    both = F.flatten(F.transform("_list", lambda x, i: F.transform(
        F.slice("_list", i + 2, F.size("_list")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists_.filter(F.size("_list") > 1).select(F.explode(both).alias("_p")).select(
        F.col("_p.x.doc_id").alias("a"), F.col("_p.y.doc_id").alias("b"), F.col("_p.x.n").alias("_n"), F.col("_p.y.n").alias("_n_b"),
        F.greatest("_p.x.level", "_p.y.level").alias("_level"), F.least("_p.x.matches", "_p.y.matches").alias("_need"))
    pairs = pairs.filter((F.col("_n") * 100 >= F.col("_n_b") * similar) & (F.col("_n_b") * 100 >= F.col("_n") * similar)
                         & (F.col("_level") <= F.col("_need")))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_common"), F.first("_need").alias("_need"))
    pairs = pairs.filter("_common >= _need").select("a", "b")
    stars = often.join(sizes.filter(F.col("_m") > SHORT_LIST).select("token", "_hub"), "token").filter(
        "doc_id <> _hub").select(F.col("_hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    return materialize(pairs.unionByName(stars), "near-candidates")


class _Forest:
    """Union-find inside one group; keeps the links that joined two parts."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(overlap: int, n: int, m: int, similar: int) -> bool:
    return 100 * overlap >= similar * (n + m - overlap)


def verify_group(ids, sets, matches, tokens, levels, second, similar: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one group of documents.

    ``second`` marks the documents of the second block; None compares all with all.
    """
    g = len(ids)
    n = np.array([len(s) for s in sets])
    matches = np.asarray(matches)
    known, column = np.unique(np.concatenate(tokens), return_inverse=True)
    level = np.zeros((g, len(known)), np.uint8)
    level[np.repeat(np.arange(g), [len(t) for t in tokens]), column] = np.concatenate(levels)
    forest, found = _Forest(g), []
    for x in range(g):
        mine = np.flatnonzero(level[x])
        rest = slice(x + 1, g)
        need = np.minimum(matches[rest], matches[x])
        both = np.maximum(level[rest][:, mine], level[x, mine])
        common = ((level[rest][:, mine] > 0) & (both <= need[:, None])).sum(1)
        fits = (common >= need) & (100 * n[rest] >= similar * n[x]) & (100 * n[x] >= similar * n[rest])
        if second is not None:
            fits &= second[rest] != second[x]
        for y in (np.flatnonzero(fits) + x + 1).tolist():
            if forest.find(x) != forest.find(y):
                overlap = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if linked(overlap, n[x], n[y], similar) and forest.join(x, y):
                    found.append((ids[x], ids[y]))
    return found


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes``; from here on only candidates move."""
    wanted = nodes.select("node")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL_IDS else wanted
    return docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi")


def _distances(pivots: list[np.ndarray], s: np.ndarray) -> np.ndarray:
    """Jaccard distances of a sorted set to the pivots' sorted sets."""
    overlap = np.array([len(np.intersect1d(p, s, assume_unique=True)) for p in pivots])
    return 1 - overlap / np.maximum(np.array([len(p) for p in pivots]) + len(s) - overlap, 1)


def meet_pivots(pivots: list[np.ndarray], similar: int) -> list[int]:
    """The hue of each pivot: the first pivot that it is linked with, in steps."""
    forest = _Forest(len(pivots))
    for i, s in enumerate(pivots):
        for j in range(i):
            overlap = len(np.intersect1d(pivots[j], s, assume_unique=True))
            if linked(overlap, len(pivots[j]), len(s), similar):
                forest.join(i, j)
    return [forest.find(i) for i in range(len(pivots))]


def _pivot_round(docs: DataFrame, prefixes: DataFrame, large: DataFrame, words: int,
                 similar: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with the pivots of large clusters, and the members (node, component) not settled by them.

    A member is dealt by its cluster and a salt, the pivots go to every salt, so no task gets a
    whole cluster.  Distances are to pivots only.  Let far be a member's distance to a pivot of
    its own hue, and near the least distance to it of all members of other hues or none: when
    near - far is beyond the distance of a link, the member has no link but within its hue.
    """
    count = large.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_salts"))
    placed = materialize(large.join(count, "component").join(prefixes.select(
        F.col("doc_id").alias("node"), "central", "often"), "node"), "near-large")
    best = Window.partitionBy("component").orderBy(F.desc("central"), F.desc("often"), "node")
    pivots = placed.withColumn("pivot", F.row_number().over(best)).filter(F.col("pivot") <= PIVOTS)
    spread = placed.select("node", "component", F.lit(0).alias("pivot"), F.pmod(
        F.xxhash64("node"), F.col("_salts")).cast("int").alias("salt")).unionByName(pivots.select(
            "node", "component", "pivot", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt")))
    keys = ["component", "salt"]
    rows = _texts(docs, placed).join(spread, F.col("doc_id") == F.col("node")).select(
        *keys, F.expr("pivot = 0").alias("member"), "pivot", "doc_id", "text")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "member", "pivot", "doc_id", "text")
    reach = (100 - similar) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, hues, last = None, [], [], None, None
        for batch in chunks(batches, "text"):
            frame = batch.drop_columns(["text"]).to_pydict()
            out = []
            for i, s in enumerate(shingle_sets(batch.column(5), words)):
                key, node = (frame["component"][i], frame["salt"][i]), frame["doc_id"][i]
                if key != group:
                    group, ids, sets, hues, last = key, [], [], None, None
                if not frame["member"][i]:
                    if not ids or ids[-1] != node:
                        ids.append(node)
                        sets.append(s)
                    continue
                if node == last:
                    continue  # rows that share an id are one document
                last = node
                hues = meet_pivots(sets, similar) if hues is None else hues
                far = _distances(sets, s)
                n = len(s)
                links = [j for j, d in enumerate(far) if d <= reach and ids[j] != node and linked(
                    len(np.intersect1d(sets[j], s, assume_unique=True)), len(sets[j]), n, similar)]
                place = ids.index(node) if node in ids else None
                hue = hues[place] if place is not None else hues[links[0]] if links else None
                out.append((node, key[0], place is not None, hue, [ids[j] for j in links], hues, far.tolist()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()),
             pa.list_(pa.float64())]
    names = ["node", "component", "chosen", "hue", "links", "hues", "far"]
    met = materialize(rows.mapInArrow(run, "node long, component long, chosen boolean, hue int, links array<long>, "
                                           "hues array<int>, far array<double>"), "near-pivots")
    near = met.groupBy("component").agg(*[
        F.min(F.when(~F.col("hue").eqNullSafe(F.get("hues", F.lit(j))), F.get("far", F.lit(j)))).alias(f"_near{j}")
        for j in range(PIVOTS)])
    apart = F.lit(False)
    for j in range(PIVOTS):
        alone = F.col(f"_near{j}").isNull() | (F.col(f"_near{j}") - F.get("far", F.lit(j)) > reach)
        apart = apart | F.coalesce((F.get("hues", F.lit(j)) == F.col("hue")) & alone, F.lit(False))
    left = met.join(near, "component").filter(~F.col("chosen") & ~apart).select("node", "component")
    links = met.select(F.explode("links").alias("a"), F.col("node").alias("b"))
    return links, materialize(left, "near-left")


def _split(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters that fit one block, and larger ones."""
    sizes = clusters.groupBy("component").agg((F.count(F.lit(1)) > BLOCK).alias("_large"))
    marked = materialize(clusters.join(sizes, "component"), "near-clusters")
    return marked.filter("not _large").drop("_large"), marked.filter("_large").drop("_large")


def _narrowed(docs: DataFrame, large: DataFrame, words: int, similar: int) -> list[DataFrame]:
    """Links of large clusters: by a new order over all their tokens, by pivots, and by blocks what is left."""
    base = materialize(_sketch(_texts(docs, large), words, similar, pool=100 / max(100 - similar, 1)), "near-sketch")
    prefixes = _ordered(base, similar)
    small, large = _split(connected_components(_candidates(prefixes, similar)))
    found, before = [], large.count()
    while before:
        links, left = _pivot_round(docs, prefixes, large, words, similar)
        found.append(links)
        fits, large = _split(left)
        small, after = small.unionByName(fits), large.count()
        if after > (1 - WORTH) * before:
            small = small.unionByName(large)
            break
        before = after
    return [*found, _verify(docs, prefixes, small, words, similar)]


def _verify(docs: DataFrame, prefixes: DataFrame, clusters: DataFrame, words: int, similar: int) -> DataFrame:
    """Links (a, b): per cluster, or per pair of blocks of a large cluster, a spanning forest."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    placed = materialize(clusters.join(sizes, "component").join(
        prefixes.select(F.col("doc_id").alias("node"), "matches", "tokens", "levels"), "node"), "near-placed")
    texts = _texts(docs, placed)
    placed = placed.withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with")).select(
        "node", "component", "matches", "tokens", "levels", "_mine",
        F.least("_mine", "_with").alias("_low"), F.greatest("_mine", "_with").alias("_high"))
    rows = texts.join(spread, F.col("doc_id") == F.col("node")).select(
        "component", "_low", "_high", "_mine", "doc_id", "text", "matches", "tokens", "levels")
    keys = ["component", "_low", "_high"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def links():
            if len(held) < 2:
                return []
            ids, sets, matches, tokens, levels, mine = zip(*held, strict=True)
            second = None if group[1] == group[2] else np.array(mine) == group[2]
            return verify_group(ids, sets, matches, tokens, levels, second, similar)

        found = []
        for batch in chunks(batches, "text"):
            frame = batch.to_pydict()
            sets = shingle_sets(batch.column(5), words)
            for i, s in enumerate(sets):
                key = tuple(frame[k][i] for k in keys)
                if key != group:
                    found += links()
                    group, held = key, []
                if held and held[-1][0] == frame["doc_id"][i]:
                    continue  # rows that share an id are one document
                held.append((frame["doc_id"][i], s, frame["matches"][i], np.array(frame["tokens"][i], np.int64),
                             np.array(frame["levels"][i], np.uint8), frame["_mine"][i]))
        found += links()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                          pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similar: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= ``similar`` * |A or B| over their sets of
    distinct ``words``-word shingles; component_id is the smallest id reachable by links.
    Null and empty texts have no shingles and no links.  Rows that share an id count as one
    document; a null id links with nothing and has a null component.  Empty table: empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = materialize(_sketch(docs, words, similar), "near-sketch")
    # Equal sets are one class, represented by its smallest id.
    classes = base.filter("n > 0").groupBy("sign").agg(F.min("doc_id").alias("rep"))
    members = materialize(base.select("doc_id", "n", "sign").join(classes, "sign", "left"), "near-members")
    copies = members.filter("n > 0 and not doc_id <=> rep").select("doc_id", "sign").distinct()
    prefixes = _ordered(base, similar, materialize(copies, "near-copies"))
    small, large = _split(connected_components(_candidates(prefixes, similar)))
    links = _verify(docs, prefixes, small, words, similar)
    if not large.isEmpty():
        for more in _narrowed(docs, large, words, similar):
            links = links.unionByName(more)
    links = materialize(links, "near-links")
    parts = connected_components(links).withColumnRenamed("node", "rep")
    return members.join(parts, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similar: int = 80) -> DataFrame:
    """The row with the smallest doc_id of every component, with the input's columns.

    Documents without shingles all stay, and so do rows with a null id.
    """
    groups = near_duplicates(docs, words, similar)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "near-gone"), "doc_id", "left_anti").select(*docs.columns)
