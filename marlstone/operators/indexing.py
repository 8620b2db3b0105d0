"""What an index of a column would hold: keys with their numbers of rows, duplicates, uniqueness, pages.

Tables are stored sorted by their first key, so that row-group statistics do the work of an index; these operators
report on keys and never gather rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=None)
def page_counts(n: int, page_size: int) -> tuple[int, int, int]:
    """(leaf pages, inner nodes, leaves as nodes) of a balanced tree of n keys.

    Up to page_size keys are a leaf; of more, the middle key is an inner node and both sides are trees. The number of
    different sizes that occur is logarithmic, so that the recursion is short.
    """
    if n <= 0:
        return 0, 0, 0
    if n <= page_size:
        return 1, 0, 1
    left, right = page_counts(n // 2, page_size), page_counts(n - n // 2 - 1, page_size)
    return left[0] + right[0], left[1] + right[1] + 1, left[2] + right[2]


def index_groups(df: DataFrame, column: str) -> DataFrame:
    """(key, rows): every value that is not null, with its number of rows."""
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("key")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """(key, rows) of the values with more than one row."""
    return index_groups(df, column).where("rows > 1")


def is_unique(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct, unique (no value has two rows)."""
    groups = index_groups(df, column)
    return groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.max("rows") <= 1, F.lit(True)).alias("unique"))


def index_report(df: DataFrame, column: str, page_size: int) -> DataFrame:
    """One row: distinct, leaf_pages, inner_nodes, leaf_nodes, pages of the index that the column would have."""
    n = is_unique(df, column).first()["distinct"]
    leaves, inner, nodes = page_counts(n, page_size)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("distinct", "leaf_pages", "inner_nodes", "leaf_nodes", "pages")])
    return df.sparkSession.createDataFrame([(n, leaves, inner, nodes, leaves + inner + nodes)], schema)
