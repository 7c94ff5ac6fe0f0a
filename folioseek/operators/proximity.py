"""Proximity cut: drop documents in which a clause's tokens stand too far apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the largest proximity that is kept.
MAX_PROXIMITY = 2


def _below(places: Column, at: Column) -> Column:
    """How many of the ascending ``places`` lie below ``at``, by halving steps."""
    top = F.floor(F.log2(F.size(places))).cast("int")

    def step(found: Column, k: Column) -> Column:
        further = found + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.get(places, further - 1)["at"] < at, further).otherwise(found)

    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), step)


def _least_spread(chain: Column) -> Column:
    """min over one position per list of sum |p[i+1] - p[i] - 1|, carried from list to list.

    What a place of one list costs differs from the cost of another of that list by no more than they lie apart: it is
    true of the first list, where all cost 0, and each further list inherits it.  So the best way to
    a place comes from the nearest place before it or the nearest one not before it, and a
    list of n places takes n look-ups in the sorted list before it, not all pairs.
    """

    def reached(so_far: Column, at: Column, n: Column) -> Column:
        left, right = F.get(so_far, n - 1), F.get(so_far, n)
        return F.least(left["cost"] + at - 1 - left["at"], right["cost"] + right["at"] - at + 1)

    def places(positions: Column, cost) -> Column:
        return F.transform(positions, lambda p: F.struct(p["at"].alias("at"), cost(p).cast("bigint").alias("cost")))

    def sited(positions: Column, n) -> Column:
        return F.transform(F.sort_array(positions), lambda p: F.struct(p.cast("bigint").alias("at"), n(p).alias("n")))

    return F.aggregate(
        F.slice(chain, 2, F.size(chain)),
        places(sited(chain[0], lambda p: F.lit(0)), lambda p: F.lit(0)),
        lambda so_far, positions: places(
            sited(positions, lambda p: _below(so_far, p)), lambda p: reached(so_far, p["at"], p["n"])
        ),
        lambda last: F.array_min(last["cost"]),
    )


def proximity(ordered: DataFrame, posted: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``(qid, docid, cno, proximity)`` for clauses all of whose tokens a document holds.

    ``ordered`` is (qid, cno, tno, scope, token) in clause order.  A clause of one token
    has proximity 0 and is left out.  With ``found`` (qid, docid) only these pairs are measured; pairs
    of query and document also keep the postings of a frequent token from meeting in one task.
    """
    sized = ordered.join(
        ordered.groupBy("qid", "cno").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), ["qid", "cno"]
    )
    posted = posted.select("scope", "token", "docid", "positions")
    if found is None:
        met = sized.join(posted, ["scope", "token"])
    else:
        met = sized.join(found.select("qid", "docid"), "qid").join(posted, ["scope", "token", "docid"])
    chains = (
        met.groupBy("qid", "cno", "docid")
        .agg(
            F.max("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("tno", "positions")))["positions"].alias("chain"),
        )
        .filter(F.size("chain") == F.col("n"))
    )
    return chains.select("qid", "docid", "cno", _least_spread(F.col("chain")).alias("proximity"))


def too_far(measured: DataFrame, limit: int = MAX_PROXIMITY) -> DataFrame:
    return measured.filter(F.col("proximity") > limit).select("qid", "docid").distinct()
