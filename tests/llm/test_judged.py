"""Rule forest, importance resampling and Merkle manifest: brute force and edge cases on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderlens.llm import importance, merkle, rule_forest
from tenderlens.llm.common import fold_of
from tenderlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, "a"), (2, "", "a"), (3, "x", None), (3, "x", None), (None, "x", "b"), (4, "é" * 50_000, "b"),
        (5, "one two three", "b"), (6, "one two three", "a"), (7, " \n\t ", "a"), (8, "w " * 30_000, "b")]
CLASHING = ("rank", "score", "node", "steps", "leaf", "pos", "tree", "buckets", "n_words", "kept", "limit", "_at", "n")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE).withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# Rule statistics and isolation forest


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated))


def rules_of(texts):
    found = rule_forest.rule_counts(pa.array(texts, pa.string()))
    return [tuple(int(found[c][i]) for c in rule_forest.COUNTS[:5]) for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\té#\r|", max_size=40)), min_size=1, max_size=6))
def test_rule_counts_match_plain_loops(texts):
    assert rules_of(texts) == [brute_rules(t) for t in texts]


def test_rule_counts_on_given_texts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rules_of(texts) == [brute_rules(t) for t in texts]


def brute_path(points, feature, cut, path, row):
    node = 0
    while feature[node] >= 0:
        node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
    return path[node]


def test_forest_scores_match_a_walk_row_by_row():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 3))
    points[:4] += 9
    forest = rule_forest.grow(points, trees=20, sample=64)
    got = forest.score(points)
    for i in range(0, 400, 7):
        paths = [brute_path(points, *t, points[i]) for t in zip(forest.feature, forest.cut, forest.path, strict=True)]
        assert got[i] == pytest.approx(2 ** (-np.mean(paths) / forest.norm))
    assert got[:4].min() > np.quantile(got[4:], 0.99)  # outliers need few splits


def test_forest_on_degenerate_tables():
    assert rule_forest.grow(np.zeros((0, 2))).score(np.zeros((3, 2))).tolist() == [1.0] * 3
    same = rule_forest.grow(np.ones((50, 2)), trees=5)
    assert len(set(same.score(np.array([[1.0, 1.0], [5.0, 5.0]])).tolist())) == 1  # nothing to split on


def test_limit_spares_the_good():
    bins = [(300, 900, 0), (400, 95, 1), (600, 5, 50), (700, 0, 49)]
    assert rule_forest.limit_of(bins, keep_good=0.99) == pytest.approx(0.5005)
    assert rule_forest.limit_of(bins, keep_good=1.0) == pytest.approx(0.6505)
    assert rule_forest.limit_of([(500, 10, 0)]) == 1.0 and rule_forest.limit_of([]) == 1.0


def test_rules_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = rule_forest.judge(edge, labels).collect()
    assert sorted(tuple(r[c] for c in rule_forest.COUNTS[:5]) for r in rows) == sorted(brute_rules(t) for _, t, _ in EDGE)
    assert all(r.base_failed and not r.kept for r in rows)  # too short, or all repeated
    assert rule_forest.judge(none, labels).count() == 0
    plain = docs_of(spark, [(i, " ".join(f"w{i}x{j}" for j in range(60)), "a") for i in range(30)])
    assert all(r.kept for r in rule_forest.judge(plain, labels).collect())  # no labels: only the fixed rules


def test_forest_finds_held_out_junk(spark):
    rows = QUERIES["op11_rule_forest"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if fold_of(r.doc_id, 3) == 1 and not r.base_failed]
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2


# Importance resampling


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9 _é\n日", max_size=30), st.text("a", min_size=60, max_size=140)),
                min_size=1, max_size=6))
def test_buckets_match_zlib(texts):
    words, flat = importance.feature_buckets(pa.array(texts, pa.string()))
    at = 0
    for i, text in enumerate(texts):
        own, grams = brute_features(text)
        assert words[i] == len(own)
        assert flat[at:at + len(grams)].tolist() == [zlib.crc32(g.encode()) % 10_000 for g in grams]
        at += len(grams)
    assert at == len(flat)


def brute_resample(docs, target, percent=25, least=20):
    features = [brute_features(t) for _, t in docs]
    count = lambda all_: collections.Counter(zlib.crc32(g.encode()) % 10_000 for f in all_ for g in f)
    s, t = count(f for _, f in features), count(brute_features(x)[1] for x in target)
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    rows = []
    for (doc_id, _), (words, grams) in zip(docs, features, strict=True):
        weight = sum(gain(zlib.crc32(g.encode()) % 10_000) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(grams), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], (1 << 63) - 1 if r[0] is None else r[0]))
    for place, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_matches_brute_force(spark, edge, none):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), "a")
            for i in range(300)] + [(i, t, s) for i, t, s in EDGE if i != 3]
    target = ["a b c", "aa bb", None, "j " * 40]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs_of(spark, rows).repartition(7).withColumns({c: F.lit(1) for c in CLASHING}), wanted)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample([(i, t) for i, t, _ in rows], target)
    assert importance.resample(edge, wanted, least_words=1, percent=100).filter("rank is null").count() == 3
    assert importance.resample(none, wanted).count() == 0
    assert importance.resample(edge, wanted.limit(0)).count() == len(EDGE)


def test_radix_sort_places_every_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 7, -(1 << 63), (1 << 63) - 1, rng.randrange(-(1 << 40), 1 << 40)]), rng.randrange(9), i)
            for i in range(3000)]
    rows += [(7, 7, i) for i in range(3000, 4500)]  # a third of all rows share both keys
    table = spark.createDataFrame(rows, "a long, b long, c long").repartition(13)
    got = importance.radix_sorted(table, ["a", "b"], block=64).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 4501))
    assert [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _ in rows)
    assert sorted(r.c for r in got) == list(range(4500))
    same = importance.radix_sorted(spark.createDataFrame([(1,)] * 5, "a long"), ["a"]).collect()
    assert sorted(r["rank"] for r in same) == [1, 2, 3, 4, 5]


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def climb(nodes):
        """The top, and per node its (before, after) steps."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, a in enumerate(at):
                run = level[a // 16 * 16:a // 16 * 16 + 16]
                steps[i].append(("".join(run[:a % 16]), "".join(run[a % 16 + 1:])))
            level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
            at = [a // 16 for a in at]
        return level[0], steps

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[s] = climb([leaf(r) for r in groups[s]])
    root, upper = climb([tops[s][0] for s in order])
    out = []
    for s, more in zip(order, upper, strict=True):
        for row, steps in zip(groups[s], tops[s][1], strict=True):
            steps = steps + more
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = (*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4]))
            node = leaf(now)
            for before, after in steps:
                node = h(before, node, after)
            out.append((row[0], leaf(row), tops[s][0], root, h(*[b + a for b, a in steps]), node, node == root))
    return sorted(out, key=str)


def marks():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.mark.parametrize("shape", ["one", "lone groups", "runs", "deep", "edge"])
def test_manifest_matches_brute_force(spark, edge, shape):
    sizes = {"one": [1], "lone groups": [1] * 20, "runs": [15, 16, 17, 33, 1], "deep": [300, 17, 1], "edge": []}[shape]
    rows = [(100 * g + i if g else -i, f"Text {i} É", f"s{g}" if g != 2 else None) for g, n in enumerate(sizes) for i in range(n)]
    docs = docs_of(spark, rows).repartition(5) if rows else edge
    plain = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted(map(tuple, merkle.verify(docs, marks()).collect()), key=str) == brute_manifest(plain)


def test_manifest_of_nothing(none):
    assert merkle.verify(none, marks()).count() == 0


def test_lag_and_lead_stop_at_the_run(spark):
    nodes = spark.createDataFrame([(0, i, 20, f"<{i}>") for i in range(20)], "tree long, pos long, n long, node string")
    parents = {r.pos: r.node for r in merkle.parents(nodes).collect()}
    assert parents == {0: h(*[f"<{i}>" for i in range(16)]), 1: h(*[f"<{i}>" for i in range(16, 20)])}


# Workers that cannot import the package


def test_models_reach_workers_without_the_package(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from tenderlens.llm import bpe, kmeans_tree, rule_forest
from tenderlens.llm.queries import vocabulary
from tenderlens.session import local_session
spark = local_session("away", 2)
def importable(_):
    try:
        import tenderlens
        yield 1
    except ImportError:
        yield 0
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).first() == 0
rows = spark.createDataFrame([(i, [float(i % 7), float(i + 1)]) for i in range(60)], "vec_id long, v array<double>")
assert kmeans_tree.search(rows, rows.limit(3), k=2, vec="v").count() == 6
docs = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
assert bytes(bpe.round_trip(docs, vocabulary(spark)).filter("doc_id = 1").first().decoded) == b"hello there"
labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
assert rule_forest.judge(docs, labels).count() == 2
print("all there")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all there" in done.stdout, done.stderr[-2000:]


# Labelled samples


def test_one_huge_text_does_not_end_the_labelled_sample(spark):
    from tenderlens.llm.training import labelled_sample

    docs = docs_of(spark, [(i, "x" * (5000 if i % 10 == 0 else 50), "a") for i in range(100)] + [(7, "a", "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    taken = labelled_sample(docs, labels, "quality", 3, 1, max_bytes=16_000).to_pylist()
    want = {i for i in range(100) if i % 10 and fold_of(i, 3) != 1}
    assert {r["doc_id"] for r in taken} == want and {r["label"] for r in taken} == {0, 1}
    assert all(r["text"] == "a" for r in taken if r["doc_id"] == 7)  # of repeated ids the smallest text
    odd = labels.withColumn("quality", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1))
    with pytest.raises(ValueError, match="labelled"):
        labelled_sample(docs, odd, "quality", 3, 1, max_bytes=16_000)
    assert labelled_sample(docs, labels.limit(0), "quality", 3, 1).num_rows == 0


def test_toxicity_is_trained_on_every_labelled_row(spark, monkeypatch):
    from tenderlens.llm import toxicity
    from tenderlens.llm.common import fold_of

    whole, seen = toxicity.fit_shards, []

    def watched(shards, n_shards):
        seen.append((n_shards, {r.doc_id for r in shards.select("doc_id").collect()}))
        return whole(shards, n_shards, 4)

    monkeypatch.setattr(toxicity, "fit_shards", watched)
    docs = spark.createDataFrame([(i, f"word{i % 7} " + ("vilain " if i % 3 == 0 else "gentil ") * 2, "fr") for i in range(200)],
                                 "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, shard_docs=60)
    n_shards, ids = seen[-1]
    assert n_shards > 1 and ids == {i for i in range(200) if fold_of(i, 4) != 2}
    rows = toxicity.score(docs, model, out="s").collect()
    assert min(r.s for r in rows if r.doc_id % 3 == 0) > max(r.s for r in rows if r.doc_id % 3)
    assert len(model.thresholds) >= 1 and None in model.thresholds


def test_words_are_packed_without_loss():
    from tenderlens.llm import toxicity

    column = pa.array(["one two one", "", None, "élan ! x", "?!"], pa.string())
    rows, first, end = toxicity.word_rows(column)
    stop = np.append(first[1:], len(rows))
    for words, a, b, z in zip(toxicity.packed_words(rows, first, end), first, stop, end, strict=True):
        back, length = toxicity.unpacked_words(words)
        assert back.dtype == rows.dtype and (back == rows[a:b]).all() and length == z - a
        assert len(words) in (0, 6 * (z - a))


def test_epochs_leave_no_shuffle_files(spark):
    from tenderlens.llm import toxicity

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    rows = [(i % 2, i, ("vilain " if i % 3 == 0 else "gentil ") * 3, int(i % 3 == 0)) for i in range(60)]
    shards = spark.createDataFrame(rows, "shard int, doc_id long, text string, label int")
    words = {r.doc_id: toxicity.packed_words(*toxicity.word_rows(pa.array([r.text])))[0] for r in shards.collect()}
    shards = spark.createDataFrame([(s, i, bytearray(words[i]), y) for s, i, _, y in rows],
                                   "shard int, doc_id long, words binary, label int")
    before = held()
    toxicity.fit_shards(shards, 2, 3)
    assert not held() - before
