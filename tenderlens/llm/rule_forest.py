"""Quality rules judged by an isolation forest over their statistics.

Every text gives a row of rule statistics: words, symbols, repeated lines and words, capitals
and punctuation.  The forest grows on bounded samples of these rows by
random splits; a row that few splits set apart from the others has short paths and a high
anomaly score.  Where the score begins to mean a bad document is read off labelled rows: the
scores of all of them are counted in bins by label, and the limit is the best one that leaves
nearly all good rows alone.  Two fixed rules reject whatever the forest says.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.llm.common import SPACE, SpanHash, byte_class, chunks, fold, mix, split_runs, utf8
from tenderlens.runtime import materialize

TREES, SAMPLE = 100, 256  # trees, and rows that one of them grows on
BINS = 1000  # bins of the score in which labelled rows are counted
KEEP_GOOD = 0.99  # share of the labelled good rows that the limit leaves alone, at least
LEAST_WORDS, MOST_REPEATED = 50, 50  # fixed rules: words, per cent of repeated words
_SYMBOL = byte_class(*b"#*$%&|<>")
_UPPER = byte_class((0x41, 0x5A))
_PUNCTUATION = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punctuation")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is one of several equal keys, is not the first of them)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    several[order[1:]] = same
    several[order[:-1]] |= same
    return several, later


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text; words are ``[^\\x20\\x09-\\x0D]+``, lines end at ``\\n``."""
    data, offsets = utf8(column)
    n_texts = len(offsets) - 1
    word = ~SPACE[data]
    starts, ends, text_of = split_runs(word, offsets)

    def per_text(member: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(member, dtype=np.int64)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    hashed = SpanHash(data)
    own = mix(np.arange(n_texts, dtype=np.uint64) + _STEP)  # equal words of two texts are no repeat
    h = hashed.of(starts, ends)
    windows = np.flatnonzero(text_of[2:] == text_of[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    key = own[text_of[windows]]
    for j in range(3):
        key = mix(key * _STEP + h[windows + j])
    repeated = np.zeros(len(h), bool)
    several = windows[_copies(key)[0]]
    for j in range(3):
        repeated[several + j] = True

    breaks = np.flatnonzero(data == 0x0A)
    first = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_text = np.searchsorted(offsets, first, "right") - 1
    inside = (line_text < n_texts) & (first < len(data))
    first, line_text = first[inside], line_text[inside]
    # A line ends before its break, or where its text ends.
    last = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, first, "left")], offsets[line_text + 1])
    upto = np.concatenate([[0], np.cumsum(word, dtype=np.int64)])
    held = upto[last] > upto[first]
    first, last, line_text = first[held], last[held], line_text[held]
    line_key = mix(own[line_text] * _STEP + hashed.of(first, last) + (last - first).astype(np.uint64))
    again = _copies(line_key)[1]

    def count(of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights, minlength=n_texts).astype(np.int64)

    return {
        "n_words": count(text_of), "word_chars": per_text(word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]), "n_dup_lines": count(line_text[again]),
        "n_repeat_words": count(text_of[repeated]), "n_upper": per_text(_UPPER[data]),
        "n_punctuation": per_text(_PUNCTUATION[data])}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the long columns ``COUNTS``, in place of earlier ones; a null text has no words.

    ``n_dup_lines`` counts the lines with a word that equal an earlier line of their text.  ``n_repeat_words`` counts the words inside 3-word windows that
    the text holds twice or more.  Rows and other columns stay.
    """
    docs = docs.drop(*COUNTS)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = rule_counts(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[c], pa.int64()) for c in COUNTS]],
                                             [*batch.schema.names, *COUNTS])

    return docs.mapInArrow(run, schema)


def features() -> list[Column]:
    """What the forest sees: rates that do not depend on a text's length.

    Repeats are left to the fixed rule: one licence block that a short text holds twice is an outlier, but not bad.
    """
    words, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    return [F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_upper") / chars,
            F.col("n_punctuation") / chars]


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them repeated."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def average_path(n):
    """Mean path length in a random search tree over n points."""
    n = np.asarray(n, np.float64)
    deep = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, deep))


class Forest(NamedTuple):
    """Plain arrays, one row per tree; node i splits to 2i + 1 and 2i + 2."""
    feature: np.ndarray  # -1: leaf
    cut: np.ndarray
    path: np.ndarray  # expected path length of a leaf
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return forest_score(tuple(self), x)


def forest_score(forest: tuple, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / expected path): 0.5 for the usual row, towards 1 for one set apart early."""
    feature, cut, path, norm = forest
    total = np.zeros(len(x))
    if not len(x):
        return total
    rows = np.arange(len(x))
    for f, c, p in zip(feature, cut, path, strict=True):
        at = np.zeros(len(x), np.int64)
        live = rows
        while len(live):
            split = f[at[live]]
            live = live[split >= 0]
            split = f[at[live]]
            at[live] = 2 * at[live] + 1 + (x[live, split] > c[at[live]])
        total += p[at]
    return np.exp2(-total / len(feature) / norm)


def grow(points: np.ndarray, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest over a bounded table of points; each tree takes ``sample`` of them without replacement."""
    sample = min(sample, len(points))
    depth = max(int(np.ceil(np.log2(max(sample, 2)))), 1)
    width = 2 ** (depth + 1) - 1
    feature = np.full((trees, width), -1, np.int64)
    cut, path = np.zeros((trees, width)), np.zeros((trees, width))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        rows = rng.permutation(len(points))[:sample]
        stack = [(0, 0, rows)]
        while stack:
            node, level, held = stack.pop()
            part = points[held]
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
            usable = np.flatnonzero(high > low)
            if level >= depth or len(held) < 2 or not len(usable):
                path[t, node] = level + float(average_path(len(held)))
                continue
            f = int(rng.choice(usable))
            value = float(rng.uniform(low[f], high[f]))
            feature[t, node], cut[t, node] = f, value
            right = part[:, f] > value
            stack += [(2 * node + 1, level + 1, held[~right]), (2 * node + 2, level + 1, held[right])]
    return Forest(feature, cut, path, max(float(average_path(sample)), 1.0))


def fit(stats: DataFrame, doc_id: str = "doc_id", seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest on at most ``trees`` x ``sample`` rows with words, drawn by a hash of id and statistics."""
    rows, need = stats.filter("n_words > 0"), trees * sample
    # About twice the rows needed pass the draw, however many tasks there are.
    share = min(1.0, 2.0 * need / max(rows.count(), 1))
    drawn = rows.select(F.xxhash64(F.lit(seed), F.col(doc_id), *COUNTS).alias("_draw"),
                        *[f.alias(f"_f{i}") for i, f in enumerate(features())])
    drawn = drawn.filter(F.pmod("_draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    order = ["_draw", *[f"_f{i}" for i in range(len(features()))]]
    points = drawn.orderBy(*order).limit(need).drop("_draw").toPandas().to_numpy(np.float64)
    return grow(points, seed, trees, sample)


def anomaly(stats: DataFrame, forest: Forest, out: str = "anomaly") -> DataFrame:
    """Adds the anomaly score of every row, in place of an earlier column of that name."""
    shared = stats.sparkSession.sparkContext.broadcast(tuple(forest))  # of fixed size
    stats = stats.drop(out)
    schema = T.StructType([*stats.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(batch.num_columns - 1)
            x = points.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forest_score(shared.value, x))], schema.names)

    return stats.withColumn(out, F.array(*features())).mapInArrow(run, schema)


def limit_of(bins: list[tuple[int, int, int]], keep_good: float = KEEP_GOOD) -> float:
    """The score from which a row is bad, from (bin, good rows, bad rows).

    Among the limits that leave at least ``keep_good`` of the good rows below them, the one
    that separates both labels best, and of equal ones the middle of the lowest empty stretch;
    without rows of both labels nothing is bad.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, g, b in bins:
        good[at] += g
        bad[at] += b
    if not good.sum() or not bad.sum():
        return 1.0
    spared = np.concatenate([[0.0], np.cumsum(good)]) / good.sum()  # good rows below bin i
    caught = 1.0 - np.concatenate([[0.0], np.cumsum(bad)]) / bad.sum()
    merit = np.where(spared >= keep_good, spared + caught, -1.0)
    best = np.flatnonzero(merit >= merit.max() - 1e-12)
    stretch = best[:int(np.argmax(np.append(np.diff(best) != 1, True))) + 1]
    return float(stretch[0] + stretch[-1]) / 2 / BINS


def calibrate(scored: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", parts: int = 3,
              held_out: int = 1, keep_good: float = KEEP_GOOD) -> float:
    """The limit read off all labelled rows that pass the fixed rules, without those of fold ``held_out``."""
    known = labels.filter(F.col(label).isNotNull() & (fold(doc_id, parts) != held_out)).groupBy(
        F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    rows = scored.filter(~base_failed()).join(known, F.col(doc_id) == F.col("_id"))
    counted = rows.groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).agg(
        F.count_if(F.col("_label") == 1).alias("good"), F.count_if(F.col("_label") == 0).alias("bad"))
    return limit_of([(r["bin"], r["good"], r["bad"]) for r in counted.collect()], keep_good)  # BINS + 1 rows at most


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          seed: int = 42, keep_good: float = KEEP_GOOD) -> DataFrame:
    """doc_id, ``COUNTS``, anomaly, limit, base_failed, kept: one row per input row.

    ``kept`` is false where a fixed rule fails, else whether the anomaly score stays below the
    limit.  Null and empty texts have no words and fail.  Rows that share an id are judged each
    by its own text.  Without labels of both kinds only the fixed rules reject.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = materialize(statistics(base).drop("text"), "rule-statistics")
    scored = anomaly(stats, fit(stats, seed=seed))
    limit = calibrate(scored, labels.withColumnRenamed(doc_id, "doc_id"), label, keep_good=keep_good)
    return scored.withColumns({"limit": F.lit(limit), "base_failed": base_failed()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < F.col("limit")))
