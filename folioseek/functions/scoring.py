"""BM25 with the non-negative idf (Robertson & Zaragoza, 2009)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual BM25 parameters.
K1 = 1.2
B = 0.75
# Scores are kept to this many digits: sums of doubles depend on their order in the last
# bits, which would shuffle equal documents from run to run.
DIGITS = 9


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, dl: Column, avg_dl: Column) -> Column:
    """Share of one term; ``weight`` is its idf, ``dl`` the document's token count."""
    return weight * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avg_dl))
