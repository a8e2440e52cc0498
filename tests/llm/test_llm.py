"""The training-data operators on small tables: brute force, round trips, edge cases, held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlens.llm import (bpe, chat_trees, components, crf_quality, exact_dedup, kmeans_tree, line_blocks, mixing,
                            prefix_join, secrets, toxicity)
from tenderlens.llm.common import fold, fold_of
from tenderlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, "x", None), (3, "x", None), (None, "x", "b"), (4, "é" * 50_000, "b"),
        (5, "one two three", "b"), (6, "one two three", "a"), (7, " \n\t ", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    return docs_of(spark, EDGE).withColumns({c: F.lit(1) for c in ("size", "digest", "_row", "_gone", "n", "ids", "key", "score")})


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# Exact deduplication


def test_duplicate_groups_edge_cases(edge, none):
    rows = exact_dedup.duplicate_groups(edge).collect()
    assert len(rows) == len(EDGE)
    by = {(r.doc_id, r.keep_id, r.group_size) for r in rows}
    assert by == {(1, 2, 2), (2, 2, 2), (3, 3, 3), (None, 3, 3), (4, 4, 1), (5, 6, 2), (6, 6, 2), (7, 7, 1)}
    assert sum(r.kept for r in rows) == 5
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.survivors(none).count() == 0


def test_survivors_keep_whole_rows(edge):
    kept = exact_dedup.survivors(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept.collect()) == [
        (2, ""), (3, "x"), (4, "ééé"), (6, "one"), (7, " \n\t")]


def test_colliding_digests_are_told_apart(spark):
    rows = [(i, f"text {i % 40}", "a") for i in range(400)]
    weak = lambda text: F.unhex(F.lpad(F.hex(F.crc32(text.cast("binary")) % 7), 2, "0"))
    found = exact_dedup.duplicate_groups(docs_of(spark, rows), digest=weak, salts=3).collect()
    assert len(found) == 400 and all(r.keep_id == 360 + r.doc_id % 40 and r.group_size == 10 for r in found)
    assert sum(r.kept for r in found) == 40


# Chat formatting


NODES = "tree long, node long, parent long, role string, text string, score double"


def test_best_branch_of_a_reply_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0),
            (1, 4, 3, "user", "more", 4.0), (1, 5, 4, "assistant", "</s>\\<s>", 4.0), (1, 6, 77, "user", "lost", -9.0),
            (None, 1, None, None, None, None), (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0)]
    out = chat_trees.format_trees(spark.createDataFrame(rows, NODES), top=2).select(
        "tree", "branch", "leaf", "n_turns", chat_trees.read_turns(F.col("formatted")).alias("turns"),
        chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).orderBy("tree", "branch").collect()
    assert [(r.tree, r.branch, r.leaf, r.n_turns, r.loss) for r in out] == [
        (None, 1, 1, 1, ""), (1, 1, 5, 4, "good</s>\\<s>"), (1, 2, 2, 2, "bad")]
    assert [(t.role, t.text) for t in out[1].turns] == [
        ("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "</s>\\<s>")]


def test_long_thread_and_no_rows(spark):
    rows = [(9, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(70)]
    frame = spark.createDataFrame(rows, NODES)
    one = chat_trees.format_trees(frame).select(chat_trees.read_turns(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in one] == [f"t{i}" for i in range(70)]
    assert chat_trees.format_trees(frame.limit(0)).count() == 0


def test_escape_round_trip(spark):
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "s>", "\n", "é", "𝒳", "/", "INST]"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_trees.escape(F.col("t")))
    for r in frame.withColumn("b", chat_trees.unescape(F.col("e"))).collect():
        assert r.b == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["big"] * 30 + ["mid"] * 4 + ["tiny", None, "ä"]))
            for i in range(4000)]
    frame = docs_of(spark, rows)
    out = mixing.allocate(frame).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert sorted(out) == sorted(mixing.allocate(frame.repartition(7)).collect())
    again = collections.Counter(r.doc_id for r in mixing.mix(frame).collect())
    assert again == collections.Counter({r.doc_id: r.copies for r in out if r.copies})


def test_odds_change_who_is_taken(spark):
    rows = [(i, "w " * 10, "a" if i % 10 else "b") for i in range(3000)]
    frame = docs_of(spark, rows)
    out = mixing.allocate(frame, odds=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).collect()
    share = [np.mean([r.copies for r in out if r.source == "a" and r.doc_id % 2 == k]) for k in (0, 1)]
    assert share[0] > share[1] + 0.1


def test_mixing_edge_cases(edge, none):
    out = mixing.allocate(edge).collect()
    assert len(out) == len(EDGE) and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(edge).columns == edge.columns
    assert mixing.allocate(none).count() == 0 and mixing.mix(none).count() == 0


# HTML extraction


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><header><p>Site</p></header><script>var t="</p>";</script>
<article><h1>Caf&eacute; &amp; more</h1><p>%s</p><p>Short.</p><aside>Aside text</aside><p>a<b>b</b>c<br>d&nbsp; e</p>
<form><p>Mail</p></form></article><div id="comments"><p>%s</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    long = "word " * 60
    assert line_blocks.main_text(PAGE % (long, long)) == "Café & more " + long.strip() + " Short. abc d e"


def test_plain_markup_and_unclosed_elements():
    long = "word " * 60
    page = f"<div><a href=x>menu one</a></div><div><a>menu</a></div><div><a>x</a></div><div><a>y</a></div><div>{long}</div><div>end</div>"
    assert line_blocks.main_text(page) == long.strip() + " end"
    assert line_blocks.main_text("<nav>menu<article><p>Body &am") == "Body &am"
    assert line_blocks.main_text("just text") == "just text"
    assert line_blocks.main_text("<article><h1>A</h1><p>B<br></article><footer>f") == "A B"


def test_articles_only_add_weight():
    story, teaser = "word " * 60, "<article><h3>Teaser</h3><p>Short.</p></article>"
    page = f"<body><div><p>{story}</p><p>End.</p></div>{teaser}{teaser}</body>"
    assert line_blocks.main_text(page) == story.strip() + " End."
    for unreal in ("<!-- <main> -->", "<script>var a='<article>'</script>"):
        assert line_blocks.main_text(f"<body>{unreal}<div><p>{story}</p></div></body>") == story.strip()
    assert line_blocks.main_text("<div>A note of a few words.</div><article><p>A story, not long.</p></article>") == "A story, not long."


def test_adverts_and_open_tags_drop_nothing_else():
    long = "word " * 60
    advert, want = '<div class="ad">Buy</div>', long.strip()
    assert line_blocks.main_text(f"<div><p>{long}</p>{advert}<p>Short close.</p></div>") == want + " Short close."
    page = f"<div><p>{long}</p>{advert}<div><p>Mid.</p></div>{advert}<p>{long}</p></div>{advert}<div><p>Other.</p></div>"
    assert line_blocks.main_text(page) == f"{want} Mid. {want}"
    assert line_blocks.main_text(f"<div><h1><a href=x>Title</a></h1><p>{long}</p></div>") == "Title " + want
    assert line_blocks.main_text(f"<article><p>{long}</p></article><article><p>Two.</p></article>") == want + " Two."
    assert line_blocks.main_text(f"<article><p>{long}<p class=ad>Buy<p>End.</article>") == want + " End."
    assert line_blocks.main_text(f"<article><div><p class=ad>Buy</div><p>{long}</article>") == want
    heads = "<h2><a href=x>Head</a></h2>" * 4
    assert line_blocks.main_text(f"<div><p>{long}</p>{heads}<p>{long}</p></div>") == f"{want} Head Head Head Head {want}"
    items = f"<ul><li>{long}<li class=share>Share<ul><li>x</li></ul>it<li>Last.</ul><p>End."
    assert line_blocks.main_text(f"<article>{items}</article>") == want + " Last. End."
    assert line_blocks.main_text(f"<article><ul><li>{long}<li class=share>Share</ul><p>End.</article>") == want + " End."


def test_extract_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>" + "long text " * 30_000), (4, "u", "<<<>>>&#xZZ;"), (4, "u", "<!-- open")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = line_blocks.extract(frame).collect()
    assert [(r.page_id, len(r.text)) for r in out][:3] == [(1, 0), (2, 0), (3, 299_999)] and len(out) == 5
    assert line_blocks.extract(frame.limit(0)).count() == 0


# N-gram Jaccard join


def brute_components(rows, words, similar):
    sets = {}
    for i, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows(n, seed):
    """Base texts with copies that differ in a few words, a shared passage, and one large group."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, rows, base = [word() for _ in range(40)], [], None
    for i in range(n):
        kind = rng.random()
        if base is None or kind < 0.35:
            base = [word() for _ in range(rng.randint(1, 120))] + (passage if rng.random() < 0.5 else [])
            text = base
        else:
            text = list(base if kind < 0.6 else passage * 2)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text), "a"))
    return rows


@pytest.mark.parametrize(("words", "similar"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, words, similar):
    rows = near_rows(260, words)
    want = brute_components(rows, words, similar)
    out = prefix_join.near_duplicates(docs_of(spark, rows), words, similar).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_short_texts_with_one_word_appended(spark):
    rng, rows = random.Random(7), []
    for i in range(0, 180, 2):
        text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(5 + i // 2 % 9))
        rows += [(i, text, "a"), (i + 1, text + " added", "a")]
    want = brute_components(rows, 5, 80)
    assert sum(c != i for i, (_, c) in want.items()) == 60  # from 8 words on, the copy is a link
    out = prefix_join.near_duplicates(docs_of(spark, rows), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert [prefix_join.most_matches(n, 80) for n in (1, 4, 7, 9, 50)] == [1, 4, 6, 8, 8]


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "BLOCK", 20)
    monkeypatch.setattr(prefix_join, "SHORT_LIST", 4)
    monkeypatch.setattr(prefix_join, "SMALL_IDS", 0)
    rows = near_rows(200, 9)
    out = prefix_join.near_duplicates(docs_of(spark, rows), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 3, 80)


def group_of_copies(n, seed):
    """A text, many copies of it with one or two words changed, texts that share a passage, and small groups."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, passage, rows = [word() for _ in range(70)], [word() for _ in range(30)], []
    for i in range(n):
        kind = rng.random()
        text = list(base) if kind < 0.6 else passage + [word() for _ in range(rng.randint(3, 30))]
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 5)) if kind < 0.6 else 0):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text), "a"))
        if kind > 0.9:
            rows.append((n + i, " ".join(text) + " end", "b"))
    return rows


@pytest.mark.parametrize(("words", "similar", "worth"), [(3, 90, 0.25), (5, 80, 0.25), (3, 90, 0.0), (5, 80, 1.1)])
def test_pivots_lose_no_link(spark, monkeypatch, words, similar, worth):
    monkeypatch.setattr(prefix_join, "BLOCK", 12)
    monkeypatch.setattr(prefix_join, "SHORT_LIST", 3)
    monkeypatch.setattr(prefix_join, "PIVOTS", 3)
    monkeypatch.setattr(prefix_join, "WORTH", worth)
    rows = group_of_copies(220, words)
    out = prefix_join.near_duplicates(docs_of(spark, rows), words, similar).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, words, similar)


def test_pivots_that_link_share_a_hue():
    at = [np.arange(0, 100, dtype=np.uint64), np.arange(300, 400, dtype=np.uint64),
          np.arange(5, 105, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)]
    assert prefix_join.meet_pivots(at, 90) == [0, 1, 0, 0]  # the last by way of the third


def test_join_edge_cases(edge, none):
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(edge, 3, 90).collect()}
    assert out == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 1, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7)}
    assert prefix_join.keep_one(edge).columns == edge.columns
    assert sorted(str(r.doc_id) for r in prefix_join.keep_one(edge).collect()) == ["1", "2", "3", "3", "4", "5", "7", "None"]
    assert prefix_join.near_duplicates(none).count() == 0 and prefix_join.keep_one(none).count() == 0


def test_hot_documents_ask_for_more_matches():
    level = np.maximum(np.arange(20) - 10, 1)
    assert prefix_join.choose_matches(np.full(20, 1000), level) > 1
    assert prefix_join.choose_matches(np.where(level < 2, 2, 5000), level) == 1


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [
        (200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert all(r.component == find(r.node) for r in found)
    assert {r.node for r in found} == {x for a, b in edges if a != b for x in (a, b)}


# Byte-level BPE


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.Vocabulary.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [b"key%d" % i for i in range(5000)]
    table = bpe.PerfectHash(keys, list(range(5000)))
    assert [table.get(k) for k in keys] == list(range(5000)) and len(table.keys) == 5000
    assert table.get(b"other") == -1 and bpe.PerfectHash([], []).get(b"x") == -1


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t 　'sdrtl1.,!éß漢字𝒳abc"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoding_equals_the_public_library(vocabulary, known, text):
    ids = bpe.Encoder(vocabulary).encode(text)
    assert ids == known.encode_ordinary(text)
    data, _ = vocabulary.decode(np.array(ids, np.int64), np.array([len(ids)]))
    assert data.tobytes().decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\ta.1"), max_size=12))
def test_entries_of_several_spaces(text):
    lines = [(bytes([b]), b) for b in range(256)] + [
        (w, 256 + i) for i, w in enumerate([b"  ", b" \n", b"\n ", b"    ", b"\t ", b" a", b"  \n"])]
    own = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(lines), special_tokens={})
    assert bpe.Encoder(bpe.Vocabulary(lines, public_tokenizers.PATTERN)).encode(text) == own.encode_ordinary(text)


def test_round_trip_edge_cases(edge, none, vocabulary, known):
    out = bpe.round_trip(edge, vocabulary).collect()
    assert len(out) == len(EDGE)
    for r in out:
        assert r.ids == known.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.round_trip(none, vocabulary).count() == 0
    assert bpe.decode(bpe.encode(edge, vocabulary), vocabulary).count() == len(EDGE)


# Classifiers


def held_out(spark, frame, label, parts, out_fold, predicted):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = frame.join(labels, "doc_id").filter(fold("doc_id", parts) == out_fold).select(predicted.alias("p"), label).collect()
    return np.mean([int(r.p) == r[label] for r in rows])


def test_folds(spark):
    rows = spark.range(50).withColumn("f", fold("id", 3)).collect()
    assert all(r.f == fold_of(r.id, 3) for r in rows)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = crf_quality.train(docs, labels)
    scored = crf_quality.score(docs, model, out="q")
    assert held_out(spark, scored, "quality", 3, 1, F.col("q") >= 0.5) > 0.95


def test_filter_responses_take_less_time_than_plain_ones():
    """The same floats as one product after the other, in less CPU time."""
    rng, model = np.random.default_rng(5), toxicity.TextCnn()
    for bias in model.bias:
        bias += rng.normal(0, 0.1, bias.shape).astype(np.float32)
    rows = (rng.integers(0, toxicity.ROWS, (12_000, 3)) + np.arange(3) * toxicity.ROWS).astype(np.int32)

    def plain():
        x, n = model.table[rows].reshape(len(rows), -1), len(rows)
        for f, b in zip(model.filters, model.bias, strict=True):
            y = np.tile(b, (n, 1))
            for j in range(len(f)):
                y[:n - j] += x[j:] @ f[j]
            yield y

    for got, want in zip(model._maps(rows), plain(), strict=True):
        assert np.allclose(got, want, rtol=1e-5, atol=1e-6)

    def best(run):
        spent = []
        for _ in range(15):
            start = time.process_time()
            list(run())
            spent.append(time.process_time() - start)
        return min(spent)

    assert best(lambda: model._maps(rows)) < 0.85 * best(plain)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert held_out(spark, toxicity.score(docs, model, out="s"), "toxic", 4, 2, F.col("s") >= 0.3) > 0.9
    assert set(toxicity.clean(docs, model).columns) == set(docs.columns)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    evidence, move, text_of = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    good, pairs, z = crf_quality.marginals(evidence, move, text_of)
    want, want_pairs, want_z = np.zeros(9), np.zeros((2, 2)), 0.0
    for text in range(3):
        at = np.flatnonzero(text_of == text)
        weights = []
        for code in range(2 ** len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            s = sum(evidence[i] * v for i, v in zip(at, y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
            weights.append((math.exp(s), y))
        total = sum(w for w, _ in weights)
        want_z += math.log(total)
        for w, y in weights:
            want[at] += np.array(y) * w / total
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and math.isclose(z, want_z)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["a b\nC!! d\n", "", "x\n\nyy yy", "é"]
    x, size, text_of = crf_quality.line_features(pa.array(texts))
    assert text_of.tolist() == [0, 0, 0, 1, 2, 2, 2, 3] and size.tolist() == [3, 5, 0, 0, 1, 0, 5, 2]
    alone = np.concatenate([crf_quality.line_features(pa.array([t]))[0] for t in texts])
    assert np.allclose(x, alone)


def test_scores_do_not_depend_on_the_batch():
    texts = ["you fool", "", None, "fine words here", "fool"]
    model = toxicity.TextCnn().fit(["you fool", "fine words", "fool me", "good words"] * 5, np.array([1, 0, 1, 0] * 5, np.float32))
    together = model.scores(*toxicity.word_rows(pa.array(texts)))
    alone = np.concatenate([model.scores(*toxicity.word_rows(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and together[0] > 0.5 > together[3]


def test_classifier_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    crf, cnn = crf_quality.train(edge, labels), toxicity.train(edge, labels)
    assert {r.q for r in crf_quality.score(edge, crf, out="q").collect()} == {0.5}
    assert toxicity.clean(edge, cnn).count() == len(EDGE)
    assert toxicity.clean(none, cnn).count() == 0 and crf_quality.score(none, crf).count() == 0
    lines = crf_quality.line_labels(edge, crf).collect()
    assert len(lines) == len(EDGE) + 1


# Neighbours


def brute_nearest(rows, query, k):
    found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, dict(rows)[query]))), i) for i, v in rows if i != query)
    return [i for _, i in found[:k]]


def test_neighbours_edge_cases(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [inf, 1.0]),
            (6, [0.0, 1.0]), (7, [1.0, 0.1]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    out = kmeans_tree.search(frame, frame.filter("vec_id in (0, 2, 3, 8)"), k=10, vec="v").orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 1), (0, 7), (0, 6)]
    assert math.isclose(out[2].score, math.sqrt(2))
    assert kmeans_tree.search(frame.limit(0), frame.limit(0), vec="v").count() == 0


def test_recall_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    x[500:1500] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = frame.filter("vec_id % 100 = 0")
    out = kmeans_tree.search(frame, queries, k=10, vec="v").collect()
    found = collections.defaultdict(set)
    for r in out:
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & set(brute_nearest(rows, q, 10))) / 10 for q in range(0, 3000, 100)]
    assert np.mean(hits) >= 0.9 and len(out) == 300
    assert found[700] == set(range(500, 510)) and found[500] == set(range(501, 511))


def test_outliers_beside_groups_of_copies_find_k(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 8)), 100, axis=0)
    far = np.repeat(rng.normal(size=(2, 8)) * 100, 3, axis=0) + rng.normal(size=(6, 8))
    x = np.concatenate([x, far])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    queries = frame.filter("vec_id % 5 = 0 or vec_id >= 2000")
    out = kmeans_tree.search(frame, queries, k=10, vec="v", visits=1).collect()  # as a calibration may find
    counts = collections.Counter(r.query_id for r in out)
    assert [counts[q] for q in range(2000, 2006)] == [10] * 6
    assert len(counts) == 406 and set(counts.values()) == {10}


# Secrets


def brute_base(text):
    spans = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for m in assign.finditer(text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, m.end(), "hex"))
    return [(s, e, k) for s, _, e, k in sorted(spans)]


def test_base_spans_equal_brute_force():
    rng = random.Random(4)
    parts = ["password", "API_key", "apikey", "Token", "=", ":", " ", '"', "abcdef", "x", "é", "𝒳", "AKIA", "ABCDEFGHIJKLMNOP", "Z",
             "0123456789abcdef01234567", "deadbeef", "\n", "secretsecret"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(600)] + ["", None]
    allowed = re.compile("(?!)")
    for text, found in zip(texts, secrets.scan_texts(pa.array(texts), allowed), strict=True):
        assert [s for s in found if s[2] != "entropy"] == brute_base(text or "")


def test_window_entropies_equal_direct_counts():
    rng = random.Random(6)
    run = "".join(rng.choices("abcdef0123", k=80))
    for i, e in enumerate(secrets.window_entropies(run)):
        counts = collections.Counter(run[i:i + 20]).values()
        assert math.isclose(e, -sum(c / 20 * math.log2(c / 20) for c in counts), abs_tol=1e-9)


def test_entropy_spans_and_allow_list(spark):
    rows = [(1, "é key Zq8vK2mX9pL4wR7tB3nY6cHs end", "a"), (2, "123e4567-e89b-12d3-a456-426614174000", "a"),
            (3, "internationalization_of_everything", "a"), (4, None, "a"), (5, "Zq8vK2mX9pL4wR7tB3nY6cHs", "a")]
    frame = docs_of(spark, rows)
    out = {r.doc_id: [tuple(s) for s in r.secrets] for r in secrets.scan(frame).collect()}
    assert out == {1: [(6, 30, "entropy")], 2: [], 3: [], 4: [], 5: [(0, 24, "entropy")]}
    assert not any(r.secrets for r in secrets.scan(frame, allow=("Zq8.*",)).collect())
    assert secrets.scan(frame.limit(0)).count() == 0


# Queries and pipeline


def test_query_columns(spark):
    want = {"op2_quality": {"doc_id", "held_out", "score", "predicted"}, "op4_mixing": {"doc_id", "size", "source_size", "target", "taken"},
            "op5_main_text": {"page_id", "url", "text", "n_chars"}, "op10_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}}
    for name, columns in want.items():
        out = QUERIES[name](spark, SF)
        assert columns <= set(out.columns)
    r = QUERIES["op10_secrets"](spark, "/root/testdata/sf0.01").filter("spans <> ''").first()
    base = [s for s in r.spans.split(",") if not s.startswith("entropy")]
    assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    texts = collections.Counter(r.doc_id for r in kept.collect())
    out = corpus_pipeline.run(spark, SF)
    assert collections.Counter(r.doc_id for r in out.collect()) == texts
    assert out.filter("not decodes").count() == 0 and max(texts.values()) <= 3
