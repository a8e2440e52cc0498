"""Secret scan: fixed key formats plus windows of high entropy.

Besides the three fixed kinds, every run of 20 or more key characters is a candidate.  A
window of 20 characters slides over it; the counts of the characters in the window, and with
them the sum of c*log2(c), change by one step per character, so the Shannon entropy of all
windows costs one pass.  A run is reported from its first to its last window above the limit
of its character class, unless the allow-list knows it or a fixed kind covers it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenderlens.llm.common import byte_class, chunks, split_runs, utf8

WINDOW = 20
# Entropy in bits from which a window of 20 characters counts, by the class of its run.
LIMITS = {"digits": 9.9, "hex": 3.0, "alnum": 3.7, "base64": 3.9}
# Runs that look random but are no secrets: plain words, paths and names, UUIDs, dates, placeholders.
ALLOWED = [
    r"[A-Za-z_=-]+", r"[0-9_=+/-]+", r"(?i:.*(?:example|sample|placeholder|changeme|xxxx).*)",
    r"(?:[A-Za-z]*/)+[A-Za-z0-9_-]{0,16}", r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"[a-z]+(?:[-_][a-z0-9]{1,12})+", r"(?P<same>.)(?P=same)+",
]
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = byte_class((0x30, 0x39), (0x61, 0x66))
_RUN = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *b"+/_=-")
_STEP = [0.0, 0.0] + [c * math.log2(c) for c in range(2, WINDOW + 1)]  # c*log2(c)


def window_entropies(run: str, window: int = WINDOW) -> list[float]:
    """Shannon entropy of every window of a run, by incremental counts."""
    step = _STEP if window == WINDOW else [0.0, 0.0] + [c * math.log2(c) for c in range(2, window + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        total += step[c + 1] - step[c]
        counts[char] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += step[c - 1] - step[c]
            counts[old] = c - 1
        if i >= window - 1:
            found.append(math.log2(window) - total / window)
        # A window of n characters has entropy log2(n) - sum(c log2 c)/n.
    return found


def run_class(run: str) -> str:
    if run.isdigit():
        return "digits"
    if all(c in "0123456789abcdefABCDEF" for c in run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def random_part(run: str, allowed: re.Pattern) -> tuple[int, int] | None:
    """Start and end of the part of a run whose windows are random enough."""
    if allowed.fullmatch(run):
        return None
    limit = LIMITS[run_class(run)]
    high = [i for i, e in enumerate(window_entropies(run)) if e >= limit]
    return (high[0], high[-1] + WINDOW) if high else None


def _within(starts: np.ndarray, ends: np.ndarray, least: int, text_of: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    keep = np.flatnonzero(ends - starts >= least)
    found: dict[int, list[tuple[int, int]]] = {}
    for k in keep:
        found.setdefault(int(text_of[k]), []).append((int(starts[k]), int(ends[k])))
    return found


def scan_texts(column: pa.Array, allowed: re.Pattern) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) in code points for every text."""
    data, offsets = utf8(column)
    hexes = _within(*_at(_HEX[data], offsets, 24))
    candidates = _within(*_at(_RUN[data], offsets, WINDOW))
    out = []
    for i, text in enumerate(column.to_pylist()):
        text = text or ""
        spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if i in hexes or i in candidates:
            first, last = offsets[i], offsets[i + 1]
            raw = data[first:last]
            point = None if len(raw) == len(text) else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])

            def place(at: int, point=point, first=first) -> int:
                return int(at - first) if point is None else int(point[at - first])

            spans += [(place(a), place(b), "hex") for a, b in hexes.get(i, ())]
            base = sorted(spans)
            for a, b in candidates.get(i, ()):
                run = raw[a - first:b - first].tobytes().decode("ascii")
                part = random_part(run, allowed)
                if part:
                    start, end = place(a) + part[0], place(a) + part[1]
                    if not any(s < end and start < e for s, e, _ in base):
                        spans.append((start, end, "entropy"))
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
    return out


def _at(member: np.ndarray, offsets: np.ndarray, least: int):
    starts, ends, text_of = split_runs(member, offsets)
    return starts, ends, least, text_of


def scan(docs: DataFrame, text: str = "text", spans: str = "secrets", allow: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``secrets``: array of (start, end, kind), code points, end exclusive, by start then kind.

    A null or empty text has none.  ``allow`` adds regular expressions that suppress whole
    entropy candidates; fixed kinds are never suppressed.  Rows and other columns stay.
    """
    allowed = re.compile("|".join(f"(?:{a})" for a in [*ALLOWED, *allow]))
    docs = docs.drop(spans)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                     T.StructField("kind", T.StringType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, kind)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = scan_texts(batch.column(batch.schema.get_field_index(text)), allowed)
            column = pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in row] for row in found], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, spans])

    return docs.mapInArrow(run, schema)
