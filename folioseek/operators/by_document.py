"""Top-k of should queries that share their words: a document's postings meet all queries at once.

Joined with the queries, a posting becomes one row for each query that asks for its token; hundreds of queries with common words
make more such rows than can be grouped.  Here the asked postings are brought together by document, once.  A task holds the
queries as a matrix of weights, adds up a document's shares for all of them in one pass, and keeps the best of each.

The first k rows are those of scoring in rows, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import DIGITS, term_score

# Numbers in one piece of the matrix, and in one step of adding up.
_WEIGHTS = 4 << 20
_STEP = 1 << 20
# Candidates kept before they are cut to the best.
_PENDING = 20_000
# Sums in another order differ in the last bits; scores are rounded after this much is left over.
_SLACK = 1e-7


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of ``(docid, tid, share)`` in the order of ``docid``, cut to whole documents: ids, where each starts, tokens, shares."""
    last, tids, shares = None, np.zeros(0, np.int32), np.zeros(0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0)
        changes = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(changes) + 1)
        names = ids.take(pa.array(starts)).to_pylist()
        if last is not None:
            starts = starts + len(tids)
            if names[0] == last:
                starts[0] = 0
            else:
                names, starts = [last, *names], np.append(0, starts)
        tids = np.concatenate((tids, batch.column(1).to_numpy()))
        shares = np.concatenate((shares, batch.column(2).to_numpy()))
        cut = starts[-1]
        if cut:
            yield names[:-1], starts[:-1], tids[:cut], shares[:cut]
        last, tids, shares = names[-1], tids[cut:], shares[cut:]
    if last is not None:
        yield [last], np.zeros(1, np.int64), tids, shares


class _Best:
    """The ``k`` best of each of ``n`` queries, by score and then id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.kept: list[list[tuple[float, str]]] = [[] for _ in range(n)]
        self.pending: list[tuple[int, float, str]] = []

    def add(self, scores: np.ndarray, names: list[str]) -> None:
        """``scores`` by document and query, not rounded; nothing was added up where they are 0."""
        least = self.least - _SLACK
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[-self.k] - _SLACK)
        doc, query = np.nonzero((scores >= least) & (scores > 0))
        rounded = np.round(scores[doc, query], DIGITS)
        self.pending += zip(query.tolist(), (-rounded).tolist(), (names[i] for i in doc.tolist()))
        if len(self.pending) > _PENDING:
            self.settle()

    def settle(self) -> None:
        for query, score, name in self.pending:
            self.kept[query].append((score, name))
        for query in {p[0] for p in self.pending}:
            self.kept[query] = sorted(self.kept[query])[: self.k]
            if len(self.kept[query]) == self.k:
                self.least[query] = -self.kept[query][-1][0]
        self.pending = []


def top_by_document(tokens: pa.Table, qid: T.StructField, posted: DataFrame, avg_dl: Column, k: int) -> DataFrame:
    """``(qid, docid, score)`` with the first ``k`` rows of every query and some more.

    ``tokens`` is ``(qid, scope, token, weight)`` of queries with should tokens alone; the matrix is sent to the tasks, so they
    have to be few enough for that.  ``posted`` are postings ``(scope, token, docid, tf, dl)``.
    """
    spark = posted.sparkSession
    asked = tokens.group_by(["scope", "token"]).aggregate([])
    asked = asked.append_column("tid", pa.array(np.arange(asked.num_rows, dtype=np.int32)))
    at = {(s, t): i for s, t, i in zip(*(asked.column(c).to_pylist() for c in ("scope", "token", "tid")))}
    tid = np.array([at[pair] for pair in zip(tokens.column("scope").to_pylist(), tokens.column("token").to_pylist())], np.int32)
    asking = tokens.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
    query, weight = asking.indices.to_numpy(), tokens.column("weight").to_numpy()
    qids, n_tokens = asking.dictionary, asked.num_rows
    width = max(1, _WEIGHTS // max(1, n_tokens))

    def matrices() -> list[np.ndarray]:
        out = []
        for first in range(0, len(qids), width):
            here = (query >= first) & (query < first + width)
            m = np.zeros((n_tokens, min(width, len(qids) - first)))
            np.add.at(m, (tid[here], query[here] - first), weight[here])
            out.append(m)
        return out

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(m, _Best(m.shape[1], k)) for m in matrices()]
        step = max(1, _STEP // max((m.shape[1] for m, _ in parts), default=1))
        for names, starts, tids, shares in documents(batches):
            # Steps of whole documents with about so many postings.
            edges = np.flatnonzero(np.diff(starts // step)) + 1
            for a, z in zip([0, *edges], [*edges, len(starts)]):
                low, high = starts[a], starts[z] if z < len(starts) else len(tids)
                for m, found in parts:
                    found.add(np.add.reduceat(m[tids[low:high]] * shares[low:high, None], starts[a:z] - low, axis=0), names[a:z])
        first = 0
        for m, found in parts:
            found.settle()
            rows = [(first + q, name, -score) for q, kept in enumerate(found.kept) for score, name in kept]
            first += m.shape[1]
            if rows:
                places, names, scores = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(places)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["qid", "docid", "score"]
                )

    share = term_score(F.lit(1.0), F.col("tf"), F.col("dl"), avg_dl).alias("share")
    hits = posted.join(F.broadcast(spark.createDataFrame(asked)), ["scope", "token"]).select("docid", "tid", share)
    schema = T.StructType([T.StructField("qid", qid.dataType), T.StructField("docid", T.StringType()), T.StructField("score", T.DoubleType())])
    return hits.repartition("docid").sortWithinPartitions("docid", "tid").mapInArrow(best, schema)
