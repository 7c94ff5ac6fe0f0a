"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters, digits or other signs.  N-grams are taken twice: over the words, and
over their forms (case and kind of word, the sign itself, or "as before" for a repeated word), so
that words never seen in training still tell how a text is written.  A score is the sigmoid of a
sparse dot product.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, held_out, numbered, uniform
from folioseek.llm.shingles import mixed
from folioseek.session import staged

BITS = 18
ROWS_LEARNED = 4_096
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_PIECE = 1 << 20
_CACHE = 200_000


def _form(word: str) -> str:
    if word[0].isalpha():
        kind = "A" if word.isupper() else "a" if word.islower() else "Aa" if word.istitle() else "mixed"
        return kind if len(word) > 1 else kind + "1"
    return "9" if word[0].isdigit() else word[:3]


class WordFeatures:
    """Sparse features of a text: sorted indices and values of length 1 (a constant comes on top)."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = (xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest("form " + _form(w)))
        return np.array([known[w] for w in words], np.uint64).reshape(-1, 2)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        index, count = np.empty(0, np.int64), np.empty(0)
        before = np.empty((0, 2), np.uint64)
        at = 0
        while at < len(text):
            end = at + _PIECE
            blank = re.compile(r"\s").search(text, end) if end < len(text) else None
            end = blank.start() if blank and blank.start() < end + _PIECE else end
            pairs = self._hashes(_WORD.findall(text[at:end]))
            at = end
            if not len(pairs):
                continue
            line = np.concatenate([before, pairs])
            again = np.flatnonzero(line[1:, 0] == line[:-1, 0]) + 1
            forms = line[:, 1].copy()
            forms[again] = np.uint64(1)
            found = []
            for column, orders in ((line[:, 0], (1, 2)), (forms, (1, 2, 3))):
                for order in orders:
                    part = column[max(0, len(before) - order + 1) :]
                    if len(part) < order:
                        continue
                    h = np.full(len(part) - order + 1, order, np.uint64)
                    for i in range(order):
                        h = mixed(h * np.uint64(0xC4CEB9FE1A85EC53) + part[i : len(part) - order + 1 + i])
                    found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            before = np.stack([line[-2:, 0], forms[-2:]], axis=1)
            new, times = np.unique(np.concatenate(found), return_counts=True)
            if len(index):
                new, back = np.unique(np.concatenate([index, new]), return_inverse=True)
                times = np.bincount(back, np.concatenate([count, times]))
            index, count = new, times.astype(float)
        value = np.sqrt(count)
        return index, value / max(1e-9, float(np.sqrt((value * value).sum())))


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 2
) -> np.ndarray:
    """Weights learned row by row with per-coordinate FTRL-proximal steps; the last is the constant's."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    rows = [(np.append(i, 1 << BITS), np.append(x, 1.0), y) for i, x, y in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    return weights(np.arange(len(z))).astype(np.float32)


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, rows_learned: int = ROWS_LEARNED, seed: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> np.ndarray:
    """Learn from about ``rows_learned`` labelled rows that are not held out, drawn by hash over all of them.

    A document marked both good and bad counts as bad; null marks and null ids do not count.  The
    sample meets in one task, whose size that bound fixes; the driver receives the weights.
    """
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark")).filter("mark IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min((F.col("mark") == 1).cast("int")).alias("mark"))
    known = staged(rows.filter(~held_out("doc_id")).select(FILE, ROW, "doc_id").join(staged(marks, "marks"), "doc_id").drop("doc_id"), "labelled")
    share = rows_learned / max(1, known.count())
    chosen = known.filter(uniform(ROW, FILE, seed=seed) < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = WordFeatures()
        for batch in batches:
            index, value = [], []
            for t in batch.column(2).to_pylist():
                i, x = make.of((t or b"").decode("utf-8", "replace"))
                index.append(i.astype(np.int32).tobytes())
                value.append(x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                names=[FILE, ROW, "mark", "i", "x"],
            )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([FILE, ROW])
        data = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y) for i, x, y in zip(pdf["i"], pdf["x"], pdf["mark"])]
        out = io.BytesIO()
        np.save(out, ftrl(data))
        return pd.DataFrame({"w": [out.getvalue()]})

    # at most about rows_learned keys
    sample = rows.join(F.broadcast(chosen), [FILE, ROW]).select(FILE, ROW, F.col("text").cast("binary").alias("text"), "mark")
    learned = sample.mapInArrow(features, f"{FILE} long, {ROW} long, mark int, i binary, x binary").groupBy().applyInPandas(fit, "w binary").first()
    return np.zeros((1 << BITS) + 1, np.float32) if learned is None else np.load(io.BytesIO(bytes(learned.w)))


def score_quality(docs: DataFrame, w: np.ndarray, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: file and row key, doc_id, held_out, score, predicted.

    A null text counts as empty; an empty text scores by the constant alone.  Without labelled
    rows every score is 0.5.  Repeated rows score alike; an empty table gives none.
    """
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col)).select(
        FILE, ROW, "doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(w)  # 2^18 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, weights = WordFeatures(), shared.value
        for batch in batches:
            scores = []
            for t in batch.column(4).to_pylist():
                i, x = make.of((t or b"").decode("utf-8", "replace"))
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[i] @ x + weights[-1], -35, 35)))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(4)), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[FILE, ROW, "doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"{FILE} long, {ROW} long, doc_id {kind}, held_out boolean, score double, predicted int")
