"""Pages and pagination figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default and largest page size.
DEFAULT_SIZE = 20
MAX_SIZE = 100

# Up to this rank Spark cuts each group before the shuffle (window group limit).
_EARLY_CUT = 1000


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = DEFAULT_SIZE

    @classmethod
    def of(cls, number: Any = None, size: Any = None) -> Page:
        """Sizes run to 100; junk or a size below 1 means 20, a junk page means 1."""
        n, s = _whole(number), _whole(size)
        return cls(n if n and n > 0 else 1, min(s, MAX_SIZE) if s and s > 0 else DEFAULT_SIZE)

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size

    @property
    def end(self) -> int:
        return self.offset + self.size


def _whole(value: Any) -> int | None:
    try:
        return int(str(value))
    except ValueError:
        return None


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``, groups of any size.

    For usual ``k`` each map task keeps at most ``k`` rows of a group before the shuffle.
    Beyond the limit of that cut, a group is first dealt over many parts and cut there,
    so that the last step sees at most ``parts * k`` rows of it.
    """
    if k > _EARLY_CUT:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn("_part", F.pmod(F.xxhash64("docid"), F.lit(parts)))
        local = Window.partitionBy(*group, "_part").orderBy(*order)
        df = dealt.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k).drop("_r", "_part")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    # The type changes after the filter: the early cut looks for the bare rank.
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def window(df: DataFrame, order: Sequence[Column], page: Page) -> DataFrame:
    """One result list: sorted, cut to the page."""
    return df.orderBy(*order).offset(page.offset).limit(page.size)


def figures(total: Column, page: Page) -> list[Column]:
    return [
        total.cast("bigint").alias("total"),
        F.ceil(total / page.size).cast("bigint").alias("pages"),
        F.lit(page.size).cast("bigint").alias("page_size"),
        F.lit(page.number).cast("bigint").alias("curr_page"),
        F.least(F.greatest(total - page.offset, F.lit(0)), F.lit(page.size)).cast("bigint").alias("page_count"),
    ]
