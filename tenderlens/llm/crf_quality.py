"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its evidence is made of its own features and those of the lines
before and after it; neighbouring labels depend on each other.  Forward-backward gives every
line's marginal probability of being good, and the document's quality is their mean, weighted
by line length.  Training lines take the label of their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenderlens.llm.common import Shared, SPACE, SpanHash, byte_class, chunks, mix, split_runs, utf8
from tenderlens.llm.training import labelled_sample

_CLASSES = [
    byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A)), byte_class((0x30, 0x39)), SPACE, byte_class(*b".,;:'\"-"),
    byte_class(*b"!?"), byte_class(*b"|/\\"), byte_class(*b"#$%&*+<=>@^_`~"), byte_class(*b"()[]{}"),
    byte_class((0x80, 0xFF)),
]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _member in enumerate(_CLASSES):
    _CLASS_OF[_member] = _i
N_CLASSES = len(_CLASSES) + 1
N_LINE = N_CLASSES + 5  # features of one line
STEPS = 150
RIDGE = 1e-3


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, byte lengths, text number) per line; every text has at least one line."""
    data, offsets = utf8(column)
    n_texts = len(offsets) - 1
    newline = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, newline, "right") - 1
    starts = np.concatenate([offsets[:-1], newline + 1])
    ends = np.concatenate([newline, offsets[1:]])
    text_of = np.concatenate([np.arange(n_texts), owner])
    order = np.lexsort((starts, text_of))
    starts, text_of = starts[order], text_of[order]
    ends = ends[np.lexsort((ends, np.concatenate([owner, np.arange(n_texts)])))]
    size = np.maximum(ends - starts, 0)
    n = len(starts)
    line_of = np.searchsorted(starts, np.arange(len(data)), "right") - 1 if len(data) < 1 else np.repeat(
        np.arange(n), np.diff(np.concatenate([starts, [len(data)]])))
    counts = np.bincount(line_of * N_CLASSES + _CLASS_OF[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    counts[:, 3] = np.maximum(counts[:, 3] - 1, 0)  # the line break itself
    word_start, word_end, _ = split_runs(~SPACE[data], offsets)
    words = SpanHash(data).of(word_start, word_end)
    of_line = line_of[word_start] if len(word_start) else np.zeros(0, np.int64)
    n_words = np.bincount(of_line, minlength=n)
    again = np.zeros(n)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (of_line[1:] == of_line[:-1])
        again = np.bincount(of_line[1:][same], minlength=n)
    keyed = np.unique(mix(words + of_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(of_line[keyed], minlength=n)
    per_word = np.maximum(n_words, 1)
    share = counts / np.maximum(size, 1)[:, None]
    extra = np.stack([np.log1p(size) / 5, np.log1p(n_words) / 5, again / per_word, 1 - distinct / per_word,
                      (size / per_word) / 10], 1)
    return np.concatenate([np.sqrt(share), extra], 1), size, text_of


def with_neighbours(x: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """A line's own features, its neighbours' inside the text (zero at the ends), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    inner = text_of[1:] == text_of[:-1]
    before[1:][inner] = x[:-1][inner]
    after[:-1][inner] = x[1:][inner]
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


def marginals(evidence: np.ndarray, move: np.ndarray, text_of: np.ndarray):
    """Forward-backward in all texts at once.

    ``evidence`` is the log odds of good per line, ``move[a, b]`` the score of label b after a.
    Returns P(good) per line, P(a, b) summed over all neighbouring pairs, and log Z in total.
    """
    n = len(evidence)
    length = np.bincount(text_of)
    length = length[length > 0]
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    length = length[order]
    longest = int(length[0]) if n else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")  # texts with a line t
    score = np.stack([np.zeros(n), evidence], 1)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    for t, m in enumerate(alive):
        at = first[:m] + t
        if t == 0:
            forward[at] = score[at]
        else:
            before = forward[at - 1]
            forward[at] = score[at] + np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
    for t in range(len(alive) - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        after = score[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
    both = forward + backward
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    pair = np.flatnonzero(text_of[1:] == text_of[:-1])
    joint = forward[pair][:, :, None] + move + (score[pair + 1] + backward[pair + 1])[:, None, :] - z[pair][:, None, None]
    last = np.flatnonzero(np.append(text_of[1:] != text_of[:-1], True)) if n else np.zeros(0, int)
    return good, np.exp(joint).sum(0), float(z[last].sum())


class LineCrf:
    """Weights of the field: one per feature and one per pair of neighbouring labels."""

    def __init__(self):
        self.mean, self.scale = np.zeros(N_LINE), np.ones(N_LINE)
        self.weights, self.move = np.zeros(3 * N_LINE + 1), np.zeros((2, 2))

    def _design(self, x: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, text_of)

    def fit(self, texts: list[str], labels: np.ndarray) -> LineCrf:
        """Maximum likelihood with a ridge, by Adam over the whole sample."""
        parts = [line_features(pa.array(texts[i:i + 256])) for i in range(0, len(texts), 256)]
        x = np.concatenate([p[0] for p in parts])
        text_of = np.concatenate([p[2] + 256 * i for i, p in enumerate(parts)])
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        design, y = self._design(x, text_of), labels[text_of].astype(np.float64)
        same = text_of[1:] == text_of[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
        theta = np.zeros(design.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            weights, move = theta[:-4], theta[-4:].reshape(2, 2)
            good, pairs, _ = marginals(design @ weights, move, text_of)
            grad = np.concatenate([design.T @ (good - y), (pairs - seen).ravel()]) / len(texts) + RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            theta = theta - 0.08 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.weights, self.move = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def label_lines(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good), byte length, text number) per line."""
        x, size, text_of = line_features(column)
        good, _, _ = marginals(self._design(x, text_of) @ self.weights, self.move, text_of)
        return good, size, text_of

    def scores(self, column: pa.Array) -> np.ndarray:
        """Length-weighted mean of the marginals; a text without characters is one empty line."""
        if not len(column):
            return np.zeros(0)
        good, size, text_of = self.label_lines(column)
        total = np.bincount(text_of, size, len(column))
        weight = np.where(total[text_of] > 0, size, 1.0)
        return np.bincount(text_of, good * weight, len(column)) / np.bincount(text_of, weight, len(column))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held_out: int = 1) -> LineCrf:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Without labelled rows of both kinds all weights are 0 and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, label, parts, held_out)
    y = np.array(sample["label"].to_pylist(), np.float64)
    return LineCrf().fit(sample["text"].to_pylist(), y) if len(set(y.tolist())) > 1 else LineCrf()


def score(docs: DataFrame, model: LineCrf, text: str = "text", out: str = "quality") -> DataFrame:
    """Adds the quality (0 to 1) of every whole text; null counts as empty.

    Rows and other columns stay; an earlier column of that name is replaced.
    """
    shared = Shared(docs.sparkSession, model)
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = shared.value.scores(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def line_labels(docs: DataFrame, model: LineCrf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line number (from 0), n_bytes and P(good) of every line."""
    shared = Shared(docs.sparkSession, model)
    rows = docs.select(doc_id, text)
    schema = T.StructType([rows.schema[doc_id], T.StructField("line", T.IntegerType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("good", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            good, size, text_of = shared.value.label_lines(batch.column(1))
            first = np.searchsorted(text_of, text_of, "left")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text_of)), pa.array((np.arange(len(good)) - first).astype(np.int32)),
                 pa.array(size.astype(np.int64)), pa.array(good)], schema.names)

    return rows.mapInArrow(run, schema)
