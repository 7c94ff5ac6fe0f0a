"""Exact top-k inner products through an impact-ordered index, score at a time.

Vectors are dealt to groups and indexed in blocks.  A component is a posting; its impact is
quantised to the bit length of its size, and a block's postings lie in segments of equal impact.
A search takes the segments in descending impact.  After each it knows, for every query and vector,
the score so far and a bound on the rest (length of the query times length of what is left of the
vector, by Cauchy and Schwarz).  It stops when this proves which vectors can still reach the top k,
if those are few; these possible members, ties included, are rescored exactly from the whole vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, numbered
from folioseek.session import staged

GROUP, BLOCK, QUERIES = 8_192, 2_048, 1_024
_INDEX = "cg int, block int, level int, dims binary, at binary, value binary, rest binary"
#: Share of pairs up to which exact rescoring is cheaper than another segment.
_FEW = 0.05


def segments(ids: np.ndarray, x: np.ndarray) -> list[tuple]:
    """Rows (level, dims, at, value, rest) of one block: the whole vectors (level -1), then postings by impact."""
    level = np.frexp(np.abs(x).astype(float))[1]
    rows = [(-1, b"", ids.tobytes(), x.tobytes(), b"")]
    for impact in sorted(set(np.unique(level)) - {0}, reverse=True):
        at, dims = np.nonzero(level == impact)
        left = np.where(level < impact, x, 0).astype(float)
        rest = np.sqrt((left * left).sum(axis=1))
        rows.append((int(impact), dims.astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), x[at, dims].tobytes(), rest.tobytes()))
    return rows


def _exact_type(q: np.ndarray, x: np.ndarray):
    """The fastest number type in which no sum of products is rounded."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class TopK:
    """The best k so far of each query: score descending, then id ascending."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.q = np.empty(0, np.int64)
        self.score, self.id = self.q.copy(), self.q.copy()
        self.least = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(p) for p in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        start = np.searchsorted(q, np.arange(self.queries))
        keep = np.arange(len(q)) - start[q] < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        full = np.bincount(self.q, minlength=self.queries) >= self.k
        last = np.searchsorted(self.q, np.arange(self.queries), side="right") - 1
        self.least = np.where(full, self.score[last] if len(self.q) else 0, -np.inf)


def search_block(q: np.ndarray, q_ids: np.ndarray, rows: list[tuple], best: TopK) -> int:
    """Search one block's segments for all queries; returns how many segments were processed."""
    ids = np.frombuffer(rows[0][2], np.int64)
    x = np.frombuffer(rows[0][3], np.int64).reshape(len(ids), -1)
    kind = _exact_type(q, x)
    weights, length = q.astype(kind), np.sqrt((q.astype(float) ** 2).sum(axis=1))
    own = q_ids[:, None] == ids[None, :]
    sums = np.zeros((len(q), len(ids)), kind)
    done, rest = 0, np.sqrt((x.astype(float) ** 2).sum(axis=1))
    possible = ~own
    for done, (_, dims, at, value, left) in enumerate(rows[1:], 1):
        segment = np.zeros((q.shape[1], len(ids)), kind)
        segment[np.frombuffer(dims, np.int32), np.frombuffer(at, np.int32)] = np.frombuffer(value, np.int64)
        sums += weights @ segment
        rest = np.frombuffer(left, float)
        if done < len(rows) - 1 and np.isfinite(best.least).all():
            slack = length[:, None] * rest[None, :] * (1 + 1e-6) + 1e-3
            possible = (sums + slack >= best.least[:, None]) & ~own
            if np.count_nonzero(possible) <= _FEW * possible.size:
                break
    else:
        least = best.least[:, None]
        if len(ids) > best.k:
            bar = np.partition(np.where(own, -np.inf, sums.astype(float)), len(ids) - best.k, axis=1)[:, len(ids) - best.k]
            least = np.maximum(least, bar[:, None])
        possible = (sums >= least) & ~own
    for at in range(0, len(q), 64):
        i, j = np.nonzero(possible[at : at + 64])
        i += at
        best.add(i, np.einsum("ij,ij->i", q[i], x[j]), ids[j])
    return done


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, group: int = GROUP, block: int = BLOCK, query_block: int = QUERIES
) -> DataFrame:
    """The k largest inner products of each query with all vectors: query_id, rank, vec_id, score.

    Both frames have ``id`` and ``v`` (array of long).  Vectors with the query's own id are no
    candidates; ties go to the smaller id.  Null ids, null vectors and vectors with a null component take no
    part.  Vectors of other lengths count as padded with zeros, so an empty vector scores 0.
    Repeated vectors are candidates each, repeated queries are answered each.  Fewer candidates
    than k give fewer rows, an empty side none.  Scores must fit in 64 bits.

    Index groups meet query blocks pairwise, in tasks of bounded size; only k rows per query and
    group leave a task.
    """
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())
    vectors, queries = (
        staged(numbered(df, id=F.col("id").cast("long"), v=F.col("v")).filter(usable), label) for df, label in ((vectors, "vectors"), (queries, "queries"))
    )
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    groups, packs = -(-sizes.n // group), -(-asked.n // query_block)
    width = max(sizes.d or 0, asked.d or 0, 1)

    def matrix(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), width), np.int64)
        for line, v in zip(out, column):
            line[: len(v)] = v
        return out

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([FILE, ROW])
        ids, x, out = pdf["id"].to_numpy(np.int64), matrix(pdf["v"]), []
        for b, at in enumerate(range(0, len(ids), block)):
            out += [(pdf["cg"].iat[0], b, *r) for r in segments(ids[at : at + block], x[at : at + block])]
        return pd.DataFrame(out, columns=["cg", "block", "level", "dims", "at", "value", "rest"])

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([FILE, ROW])
        keys = pdf[["id", FILE, ROW]].to_numpy(np.int64)
        return pd.DataFrame({"qb": [pdf["qb"].iat[0]], "keys": [keys.tobytes()], "q": [matrix(pdf["v"]).tobytes()]})

    def search(key, asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(index):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "qf", "qr", "vec_id", "score")})
        keys = np.frombuffer(asked["keys"].iat[0], np.int64).reshape(-1, 3)
        q = np.frombuffer(asked["q"].iat[0], np.int64).reshape(len(keys), width)
        best = TopK(len(q), k)
        for _, rows in index.groupby("block", sort=True):
            rows = rows.sort_values("level", ascending=False)[["level", "dims", "at", "value", "rest"]]
            rows = list(rows.itertuples(index=False, name=None))
            search_block(q, keys[:, 0], rows[-1:] + rows[:-1], best)
        out = keys[best.q]
        return pd.DataFrame({"query_id": out[:, 0], "qf": out[:, 1], "qr": out[:, 2], "vec_id": best.id, "score": best.score})

    dealt = F.xxhash64(F.lit(4), FILE, ROW)
    index = vectors.withColumn("cg", F.pmod(dealt, F.lit(max(1, groups))).cast("int")).groupBy("cg").applyInPandas(build, _INDEX)
    packs_of = queries.withColumn("qb", F.pmod(dealt, F.lit(max(1, packs))).cast("int")).groupBy("qb").applyInPandas(packed, "qb int, keys binary, q binary")
    index, packs_of = staged(index, "impact-index"), staged(packs_of, "query-packs")
    tasks = max(1, groups * packs)
    left = packs_of.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1))))).repartition(tasks, "qb", "cg")
    right = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(0, packs - 1))))).repartition(tasks, "qb", "cg")
    found = left.groupBy("qb", "cg").cogroup(right.groupBy("qb", "cg")).applyInPandas(search, "query_id long, qf long, qr long, vec_id long, score long")
    order = Window.partitionBy("query_id", "qf", "qr").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embedding, scale: int = 64):
    """floor(scale * x) of each component as long; null where a component is null or not finite."""
    ends = [F.lit(float(x)) for x in ("nan", "inf", "-inf")]
    bad = F.exists(embedding, lambda x: x.isNull() | x.cast("double").isin(*ends))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))
