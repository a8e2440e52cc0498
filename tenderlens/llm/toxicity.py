"""Toxicity by a small convolutional network over hashed word embeddings.

A word is three embedding rows side by side: two independent hashes of the word, so that two
words rarely share both, and a hash of its first bytes, so that forms of a stem share one.
Filters one, two and three words wide run over the whole text; each keeps its maximum, and a
logistic layer with weights of at least 0 turns the maxima into a score: a text can only become
more toxic by what it holds, so no clean passage hides an insult.  Every labelled row outside the
held-out fold is trained on: tasks each run an epoch over a shard of them from common weights, which are
then averaged, row by row of the table over the shards that moved it.  Decisions use thresholds calibrated by language on documents kept out of the fit;
the score itself sees nothing but the text.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.llm.common import Shared, LETTER, LOWER, SpanHash, chunks, split_runs, utf8
from tenderlens.llm.training import SAMPLE_BYTES, SAMPLE_DOCS, labelled_rows
from tenderlens.runtime import materialize, released

ROWS = 1 << 16  # embedding rows per hash
DIM = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
STEM = 6  # bytes
EPOCHS = 12
BATCH = 32
RATE = 0.1
PART = 1 << 12  # embedding rows that are averaged together
SCORE_BINS = 1 << 16  # scores told apart when thresholds are read off many shards
LEAST_POSITIVE = 20  # positive examples a language needs for a threshold of its own


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embedding rows of all words, first word, end) per text.

    Texts are padded by two zero words (row 3*ROWS) so that no filter reads into the next.
    """
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, text_of = split_runs(LETTER[data], offsets)
    spans = SpanHash(data)
    whole, stem = spans.of(starts, ends), spans.of(starts, np.minimum(ends, starts + STEM))
    mask = np.uint64(ROWS - 1)
    n_words = np.bincount(text_of, minlength=len(offsets) - 1)
    held = np.maximum(n_words, 1) + max(WIDTHS) - 1
    first = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int64)
    rows = np.full((int(held.sum()), 3), 3 * ROWS, np.int32)
    place = np.arange(len(starts)) + np.repeat(first - (np.cumsum(n_words) - n_words), n_words)
    rows[place, 0] = (whole & mask).astype(np.int64)
    rows[place, 1] = ((whole >> np.uint64(32)) & mask).astype(np.int64) + ROWS
    rows[place, 2] = (stem & mask).astype(np.int64) + 2 * ROWS
    return rows, first, first + np.maximum(n_words, 1)


_FIRST = np.arange(3, dtype=np.int32) * ROWS  # first embedding row of each hash


def packed_words(rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words of every text without padding, 16 bits a hash."""
    found = []
    for a, b in zip(first, end, strict=True):
        words = rows[a:b]
        found.append(b"" if words[0, 0] == 3 * ROWS else (words - _FIRST).astype("<u2").tobytes())
    return found


def unpacked_words(words: bytes) -> tuple[np.ndarray, int]:
    """(embedding rows, end) of one text, as ``word_rows`` gives them."""
    known = np.frombuffer(words, "<u2").reshape(-1, 3) + _FIRST
    end = max(len(known), 1)
    rows = np.full((end + max(WIDTHS) - 1, 3), 3 * ROWS, np.int32)
    rows[:len(known)] = known
    return rows, end


class TextCnn:
    """Weights of the network; picklable, of fixed size (about 6 MB)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (3 * ROWS + 1, DIM)).astype(np.float32)
        self.table[-1] = 0
        wide = 3 * DIM
        self.filters = [rng.normal(0, (w * wide) ** -0.5, (w, wide, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.uniform(0.2, 0.8, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(-2.0)
        self.thresholds: dict[str | None, float] = {}

    def _maps(self, rows: np.ndarray):
        """Filter responses at every position, each filter's side by side in memory."""
        n = len(rows)
        x = self.table.take(rows.ravel(), axis=0).reshape(n, 3 * DIM).T
        for f, b in zip(self.filters, self.bias, strict=True):
            parts = (f.transpose(0, 2, 1).reshape(-1, 3 * DIM) @ x).reshape(len(f), FILTERS, n)
            y = parts[0]
            y += b[:, None]
            for j in range(1, len(f)):
                y[:, :n - j] += parts[j][:, j:]
            yield y.T

    def scores(self, rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        cuts = np.stack([first, end], 1).ravel()[:-1]
        pooled = [np.maximum.reduceat(y[:end[-1]], cuts, axis=0)[::2] for y in self._maps(rows)]
        z = np.concatenate(pooled, 1).astype(np.float64) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> TextCnn:
        """Adagrad on the logistic loss; the order of documents is fixed by the seed."""
        docs = []
        for text in texts:
            rows, _, end = word_rows(pa.array([text]))
            docs.append((rows, int(end[0])))
        self.run_epochs(docs, labels, self.squares(), range(epochs), seed)
        return self

    def squares(self) -> dict:
        """Adagrad's sums before the first step."""
        return {"table": np.full(len(self.table), 1e-4, np.float32), "out": np.full_like(self.out, 1e-4),
                "shift": 1e-4, "filters": [np.full_like(f, 1e-4) for f in self.filters],
                "bias": [np.full_like(b, 1e-4) for b in self.bias]}

    def run_epochs(self, docs: list[tuple[np.ndarray, int]], labels: np.ndarray, square: dict, epochs: range,
                   seed: int = 7) -> None:
        """The epochs of these numbers over (embedding rows, end) of the documents; ``square`` goes on."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs.start):
            rng.permutation(len(docs))
        for _ in epochs:
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                picked = order[at:at + BATCH]
                rows = np.concatenate([docs[i][0] for i in picked])
                first = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in picked])[:-1]])
                best, values = [], []
                for y in self._maps(rows):
                    where = np.stack([f + y[f:f + docs[i][1]].argmax(0) for f, i in zip(first, picked, strict=True)])
                    best.append(where)
                    values.append(np.take_along_axis(y, where, 0))
                pooled = np.concatenate(values, 1)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))
                error = ((p - labels[picked]) / len(picked)).astype(np.float32)
                back = error[:, None] * self.out
                grad = pooled.T @ error
                square["out"] += grad ** 2
                self.out = np.maximum(self.out - RATE * grad / np.sqrt(square["out"]), 0)
                square["shift"] += float(error.sum()) ** 2
                self.shift -= np.float32(RATE * error.sum() / np.sqrt(square["shift"]))
                touched, pushed = [], []
                for k, width in enumerate(WIDTHS):
                    g = back[:, k * FILTERS:(k + 1) * FILTERS]
                    total = np.empty_like(self.filters[k])
                    for j in range(width):
                        used = rows[best[k] + j]  # documents, filters, 3
                        x = self.table[used].reshape(*g.shape, 3 * DIM)
                        total[j] = np.einsum("bf,bfd->df", g, x)
                        touched.append(used.ravel())
                        pushed.append((g[:, :, None] * self.filters[k][j].T).reshape(-1, DIM))
                    square["filters"][k] += total ** 2
                    self.filters[k] -= RATE * total / np.sqrt(square["filters"][k])
                    square["bias"][k] += g.sum(0) ** 2
                    self.bias[k] -= RATE * g.sum(0) / np.sqrt(square["bias"][k])
                ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                moved = np.zeros((len(ids), DIM), np.float32)
                np.add.at(moved.reshape(-1), (inverse[:, None] * DIM + np.arange(DIM)).ravel(), np.concatenate(pushed).ravel())
                moved[ids == len(self.table) - 1] = 0
                square["table"][ids] += (moved ** 2).mean(1)
                self.table[ids] -= RATE * moved / np.sqrt(square["table"][ids])[:, None]


_MOVED = "part int, ids binary, weights binary, squares binary"
_DENSE = -1  # part of all that is not the table


def _dense(model: TextCnn, square: dict) -> np.ndarray:
    held = [model.out, [model.shift], *model.filters, *model.bias,
            square["out"], [square["shift"]], *square["filters"], *square["bias"]]
    return np.concatenate([np.ravel(x) for x in held]).astype(np.float64)


def _set_dense(model: TextCnn, square: dict, flat: np.ndarray) -> None:
    at = 0
    for of, take in ((model.__dict__, np.float32), (square, float)):
        n = len(of["out"])
        of["out"], of["shift"] = flat[at:at + n].astype(np.float32), take(flat[at + n])
        at += n + 1
        for name in ("filters", "bias"):
            for k, x in enumerate(of[name]):
                of[name][k] = flat[at:at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size


def _moved_parts(model: TextCnn, square: dict, squares_before: np.ndarray) -> pd.DataFrame:
    """What a shard changed: table rows as they are now with their new squares, by part, and everything else."""
    ids = np.flatnonzero(square["table"] != squares_before)
    cuts = np.searchsorted(ids, np.arange(0, len(model.table) + PART, PART))
    found = [(_DENSE, b"", _dense(model, square).tobytes(), b"")]
    for part, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if high > low:
            some = ids[low:high]
            found.append((part, some.astype(np.int64).tobytes(), model.table[some].tobytes(),
                          square["table"][some].tobytes()))
    return pd.DataFrame(found, columns=["part", "ids", "weights", "squares"])


def _mean_part(frame: pd.DataFrame) -> pd.DataFrame:
    """Mean over the shards; a table row's over those that moved it."""
    part = int(frame["part"].iloc[0])
    if part == _DENSE:
        mean = sum(np.frombuffer(x) for x in frame["weights"]) / len(frame)
        return pd.DataFrame([(part, b"", mean.tobytes(), b"")], columns=frame.columns)
    n, weights, squares = np.zeros(PART), np.zeros((PART, DIM)), np.zeros(PART)
    for ids, moved, square in zip(frame["ids"], frame["weights"], frame["squares"], strict=True):
        at = np.frombuffer(ids, np.int64) - part * PART
        n[at] += 1
        weights[at] += np.frombuffer(moved, np.float32).reshape(-1, DIM)
        squares[at] += np.frombuffer(square, np.float32)
    at = np.flatnonzero(n)
    return pd.DataFrame([(part, (at + part * PART).tobytes(), (weights[at] / n[at, None]).astype(np.float32).tobytes(),
                          (squares[at] / n[at]).astype(np.float32).tobytes())], columns=frame.columns)


def _shard_epochs(sent: Shared, epochs: range, seed: int):
    """A function from a shard's rows to what these epochs over it change."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        model, square = copy.deepcopy(sent.value)
        squares_before = square["table"].copy()
        docs = [unpacked_words(w) for w in frame["words"]]
        model.run_epochs(docs, frame["label"].to_numpy(np.float32), square, epochs, seed)
        return _moved_parts(model, square, squares_before)

    return run


def fit_shards(shards: DataFrame, n_shards: int, epochs: int = EPOCHS, seed: int = 7) -> TextCnn:
    """Fit on (shard, doc_id, words, label): an epoch over every shard, then the mean of what they changed.

    One shard runs all epochs in one task.  The driver holds the weights alone; an epoch leaves
    nothing on disk.
    """
    spark = shards.sparkSession
    model = TextCnn()
    square = model.squares()
    for number in ([range(epochs)] if n_shards == 1 else [range(i, i + 1) for i in range(epochs)]):
        sent = Shared(spark, (model, square))
        moved = shards.select("shard", "doc_id", "words", "label").groupBy("shard").applyInPandas(
            _shard_epochs(sent, number, seed), _MOVED)
        with released(spark):
            mean = moved.groupBy("part").applyInPandas(_mean_part, _MOVED).collect()  # one model, about 8 MB
        sent.destroy()
        for row in mean:
            if row["part"] == _DENSE:
                _set_dense(model, square, np.frombuffer(row["weights"]))
            else:
                ids = np.frombuffer(row["ids"], np.int64)
                model.table[ids] = np.frombuffer(row["weights"], np.float32).reshape(-1, DIM)
                square["table"][ids] = np.frombuffer(row["squares"], np.float32)
    return model


def _best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The cut with the best F1, in the middle between the scores around it.

    With ``counts`` an entry stands for that many rows, ``labels`` of them positive.
    """
    counts = np.ones(len(scores)) if counts is None else counts
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(counts[order]) + labels.sum())
    at = int(np.argmax(f1))
    low = scores[order[at + 1]] if at + 1 < len(order) else 0.0
    return float(np.clip((scores[order[at]] + low) / 2, 0.05, 0.95))


def _shards(rows: DataFrame, n_shards: int) -> DataFrame:
    """Stored (shard, doc_id, language, label, apart, words) of every labelled row."""
    schema = "shard int, doc_id long, language string, label int, apart boolean, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = packed_words(*word_rows(batch.column(batch.schema.get_field_index("text"))))
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(words, pa.binary())], [*kept.schema.names, "words"])

    dealt = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")) - 1
    apart = materialize(dealt.select("shard", "doc_id").withColumn("apart", place % 5 == 0), "apart")
    placed = dealt.join(apart, ["shard", "doc_id"])
    return materialize(placed.select("shard", "doc_id", "language", "label", "apart", "text").mapInArrow(run, schema), "shards")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", language: str = "lang",
          parts: int = 4, held_out: int = 2, shard_docs: int = SAMPLE_DOCS, shard_bytes: int = SAMPLE_BYTES) -> TextCnn:
    """Fit on all labelled rows outside the held-out fold, calibrate thresholds by language.

    The rows are dealt by their id into as many shards as ``shard_docs`` and ``shard_bytes`` ask for.
    A fifth of them calibrates: a language with enough positive examples gets its own
    threshold, the others share one.  The final network is fitted on all.
    Without labelled rows of both kinds every score is 0 and nothing is rejected.
    """
    rows = materialize(labelled_rows(docs, labels, label, parts, held_out, (language,)).withColumnRenamed(
        language, "language"), "labelled")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"),
                    F.min("label").alias("low"), F.max("label").alias("high")).first()
    if not seen["n"] or seen["low"] == seen["high"]:
        model = TextCnn()
        model.out[:] = 0
        model.shift = np.float32(-30)
        return model
    n_shards = max(-(-seen["n"] // shard_docs), -(-seen["bytes"] // shard_bytes), 1)
    shards = _shards(rows, n_shards)
    kinds = {(r["apart"], r["label"]) for r in shards.select("apart", "label").distinct().collect()}
    thresholds = {None: 0.5}
    if {(False, 0), (False, 1), (True, 1)} <= kinds:
        trial = fit_shards(shards.filter(~F.col("apart")), n_shards)
        scored = _score_words(shards.filter("apart"), trial)
        if n_shards > 1:
            scored = scored.withColumn("score", (F.floor(F.col("score") * SCORE_BINS) + 0.5) / SCORE_BINS)
            scored = scored.groupBy("language", "score").agg(F.sum("label").alias("label"), F.count(F.lit(1)).alias("n"))
        else:
            scored = scored.withColumn("n", F.lit(1)).orderBy("doc_id")
        held = scored.select("language", "score", "label", "n").toPandas()  # a shard's fifth, or counts by bin
        score, y, n = held["score"].to_numpy(), held["label"].to_numpy(np.float64), held["n"].to_numpy(np.float64)
        same = pd.DataFrame({"score": score, "y": y, "n": n})
        if n_shards > 1:
            same = same.groupby("score", as_index=False).sum()
        thresholds = {None: _best_threshold(*same.to_numpy().T)}
        spoken = held["language"].fillna("").to_numpy(object)
        for name in sorted(set(spoken)):
            mine = spoken == name
            if name and y[mine].sum() >= LEAST_POSITIVE:
                thresholds[name] = _best_threshold(score[mine], y[mine], n[mine])
    model = fit_shards(shards, n_shards)
    model.thresholds = thresholds
    return model


def _score_words(shards: DataFrame, model: TextCnn) -> DataFrame:
    """(doc_id, language, label, score) of stored words."""
    shared = Shared(shards.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words in batch.column(3):
                rows, end = unpacked_words(words.as_py())
                found.append(shared.value.scores(rows, np.array([0]), np.array([end]))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["doc_id", "language", "label", "score"])

    return shards.select("doc_id", "language", "label", "words").mapInArrow(
        run, "doc_id long, language string, label int, score double")


def score(docs: DataFrame, model: TextCnn, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the score (0 to 1) of every whole text; null and empty texts are scored like no words.

    Rows and other columns stay; an earlier column of that name is replaced.
    """
    shared = Shared(docs.sparkSession, model)
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = shared.value.scores(*word_rows(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def rejected(model: TextCnn, score: Column, language: Column) -> Column:
    """True where the score reaches the threshold of the document's language."""
    limit = F.lit(model.thresholds.get(None, 2.0))
    for name, value in model.thresholds.items():
        if name is not None:
            limit = F.when(language.eqNullSafe(F.lit(name)), F.lit(value)).otherwise(limit)
    return score >= limit


def clean(docs: DataFrame, model: TextCnn, language: str = "lang") -> DataFrame:
    """The rows that are not rejected, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"),
                        F.col(language).alias("_language"))
    scored = score(whole, model, "_text", "_toxicity")
    return scored.filter(~rejected(model, F.col("_toxicity"), F.col("_language"))).select("_row.*")
