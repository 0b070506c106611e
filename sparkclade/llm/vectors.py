"""What the two vector searches share: taking vectors in, and dealing rows out in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every hundredth id is a query.
QUERY_STEP = 100


def usable(table: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part: no null or non-finite component, one length.

    The length is that of most rows, the least on a tie; rows of other lengths, without an id or (unless
    ``allow_zero``) of zeros alone take no part.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite)
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (most[0].d if most else 0))


def distinct_queries(rows: DataFrame, step: int) -> DataFrame:
    """(query, vec_id, v): each different row whose id is divisible by ``step`` once, with a number of its own."""
    some = rows.where(F.pmod("vec_id", F.lit(step)) == 0).dropDuplicates(["vec_id", "v"])
    return some.select(F.xxhash64("vec_id", "v").alias("query"), "vec_id", "v")


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.array(column.tolist(), dtype) if len(column) else np.zeros((0, 0), dtype)
