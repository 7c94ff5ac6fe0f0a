"""Personal data in whole texts: exact base formats, widened by boosted trees over candidate spans.

Generators propose overlapping spans for anything with the outline of an address or a number.
Trees judge format and context.  They learn from the corpus itself: base matches are positive,
candidates that fail the base's rules negative, and base matches rewritten in other usual ways
(and in look-alikes that are no personal data) teach what lies beyond the base formats.  A kind's
threshold is the lowest that keeps the wanted precision on rows not learned from.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, numbered, uniform
from folioseek.llm.pii_spans import KINDS, SpanModel, base_spans, training_rows

SAMPLE_ROWS, PER_ROW, PRECISION = 20_000, 32, 0.98
#: Without one of these no base match and no candidate exists.
_HINT = r"[0-9@]|(?i:[\[({]at[\])}]| at )"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col))
    hinted: Column = F.when(F.col("text").rlike(_HINT), F.col("text").cast("binary"))
    return rows.select(FILE, ROW, "doc_id", hinted.alias("text"))


def fit_spans(
    docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, per_row: int = PER_ROW, precision: float = PRECISION, seed: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> SpanModel | None:
    """Trees learned from about ``sample_rows`` rows drawn by hash, at most ``per_row`` spans of a kind of example each.

    The examples' features meet in one task, whose size those two numbers bound.  None if there
    are too few examples to learn from; then only base matches count.
    """
    rows = _texts(docs, id_col, text_col)
    total = rows.count()
    chosen = rows.filter(uniform(ROW, "doc_id", seed=seed) < sample_rows / max(1, total)).filter("text IS NOT NULL")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, key = [], [], []
            for t in batch.column(3).to_pylist():
                a, b = training_rows(t.decode("utf-8", "replace"), per_row, xxhash.xxh32_intdigest(t, seed))
                x += [np.array(r, np.float32).tobytes() for r in a]
                y += b
                key += [xxhash.xxh3_64_intdigest(t) >> 1] * len(b)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.int32())], names=["key", "x", "y"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "x", "y"])
        y = pdf["y"].to_numpy(float)
        if len(y) < 40 or not 0 < y.sum() < len(y):
            return pd.DataFrame({"model": [b""]})
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(y), -1).astype(float)
        model, out = SpanModel(x, y, pdf["key"].to_numpy(), precision, seed), io.BytesIO()
        pickle.dump((model.trees.edges, model.trees.start, model.trees.split, model.trees.leaf, model.threshold), out)
        return pd.DataFrame({"model": [out.getvalue()]})

    learned = chosen.mapInArrow(examples, "key long, x binary, y int").groupBy().applyInPandas(fit, "model binary").first()
    if learned is None or not learned.model:
        return None
    return SpanModel.restored(*pickle.loads(bytes(learned.model)))


def find_personal_data(docs: DataFrame, model: SpanModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of base matches; ``spans`` also lists what the model adds, each as
    kind:start:end in code points, by kind, then start.  Added spans overlap no other span.  A null or
    empty text has no spans (digest of the empty string).  Repeated rows give equal rows; an
    empty table gives none.  Work on a text grows with its length times the logarithm of its spans.
    """
    rows = _texts(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def listed(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_text, all_text, added = [], [], []
            for t in batch.column(3).to_pylist():
                base, more = [], []
                if t is not None:
                    text = t.decode("utf-8", "replace")
                    base = base_spans(text)
                    more = model.extra(text, base) if model else []
                for k in range(4):
                    counts[k].append(sum(b[0] == k for b in base))
                base_text.append(listed(base))
                all_text.append(listed(base + more) if more else base_text[-1])
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text), pa.array(all_text), pa.array(added, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"],
            )

    found = rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")
