"""Exact top-k inner products over vectors sorted by length.

Vectors are rotated by the singular vectors of all vectors, so that their first columns carry most of their length, and
processed by descending length.  A partial product over those columns, plus the product of the lengths of what remains
(Cauchy-Schwarz), bounds a candidate's score; only candidates whose bound reaches the query's tenth best are computed,
in integers.  A block whose longest vector cannot reach it is skipped whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import QUERY_STEP, distinct_queries, matrix, usable

#: The longest vectors, from which every query gets its first limit; rows in a block; queries in a block; bands of length.
HEAD_ROWS, ROWS_A_BLOCK, QUERIES_A_BLOCK, MOST_BANDS = 2_000, 8_000, 2_000, 64
#: Rows scanned between two updates of the limits.
STEP = 1_000
SCALE = 1024


def moments(rows: DataFrame) -> np.ndarray:
    """Sum of the outer products of all vectors, from one small triangle a task."""

    def run(frames):
        total = None
        for f in frames:
            x = matrix(f["v"])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "m": total[i, j]})

    found = rows.select("v").mapInPandas(run, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).toPandas()
    d = int(found["i"].max()) + 1
    out = np.zeros((d, d))
    out[found["i"], found["j"]] = out[found["j"], found["i"]] = found["m"]
    return out


def scan(q_id: np.ndarray, q: np.ndarray, r_id: np.ndarray, r: np.ndarray, limit: np.ndarray, turn: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's ``k`` best of the rows, and any others that reach its limit at first: (query, its place in ``q``; query_id, vec_id, score)."""
    order = np.lexsort((r_id, -(r.astype(np.float64) ** 2).sum(1)))
    r_id, r = r_id[order], r[order]
    head = max(1, r.shape[1] // 4)
    rq, rr = q @ turn, r @ turn
    q_len, q_rest = np.sqrt((rq**2).sum(1)), np.sqrt((rq[:, head:] ** 2).sum(1))
    r_len, r_rest = np.sqrt((rr**2).sum(1)), np.sqrt((rr[:, head:] ** 2).sum(1))
    rq, rr, limit = np.ascontiguousarray(rq[:, :head]), np.ascontiguousarray(rr[:, :head]), limit.astype(np.float64)
    held = pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    for at in range(0, len(r), STEP):
        # Rounding is far below the slack; products themselves are integers.
        alive = np.flatnonzero(q_len * r_len[at] * (1 + 1e-9) + 1 >= limit)
        if not len(alive):
            break
        upto = slice(at, at + STEP)
        bound = rq[alive] @ rr[upto].T + q_rest[alive, None] * r_rest[None, upto] + 1e-9 * q_len[alive, None] * r_len[None, upto] + 1
        i, j = np.nonzero(bound >= limit[alive, None])
        i, j = alive[i], j + at
        other = q_id[i] != r_id[j]
        i, j = i[other], j[other]
        score = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], r[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        held = pd.concat([held, pd.DataFrame({"query": i, "vec_id": r_id[j], "score": score})])
        held = held.sort_values(["query", "score", "vec_id"], ascending=[True, False, True])
        held = held[held.groupby("query").cumcount() < k]
        full = held.groupby("query")["score"].agg(["min", "size"])
        full = full[full["size"] == k]
        limit[full.index] = np.maximum(limit[full.index], full["min"])
    return pd.DataFrame({"query": held["query"].to_numpy(np.int64), "query_id": q_id[held["query"].to_numpy(np.int64)], "vec_id": held["vec_id"].to_numpy(), "score": held["score"].to_numpy()})


def top_inner_products(table: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, exactly.

    A component x counts as floor(1024 * x).  Queries are the rows whose id is divisible by ``query_step``, their
    candidates all rows of another id; ties go to the smaller id.  Vectors that are null, of an odd length or hold null
    or non-finite components take no part.  Products are exact as long as they fit a long.  Repeated rows are candidates
    each, and one query; vectors that differ under one id are a query each.  Extra columns are ignored; an empty table
    gives an empty table.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col, allow_zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    head = rows.withColumn("length", length).orderBy(F.desc("length"), "vec_id").limit(HEAD_ROWS).toPandas()
    turn = np.linalg.eigh(moments(rows))[1][:, ::-1].copy()
    shared = spark.sparkContext.broadcast((head["vec_id"].to_numpy(), matrix(head["v"], np.int64), turn))

    # Rows of like length share a band, so that bands of short rows are skipped whole; a band is dealt out in blocks.
    bands = min(MOST_BANDS, max(1, n // ROWS_A_BLOCK))
    edges = sorted(set(rows.select(length.alias("length")).approxQuantile("length", [i / bands for i in range(1, bands)], 0.005))) if bands > 1 else []
    band = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e > F.col("length"))) if edges else F.lit(0)
    dealt = stored(rows.withColumn("length", length).withColumn("band", band), "bands")
    cut = dealt.groupBy("band").agg(F.max("length").alias("longest"), F.ceil(F.count("*") / ROWS_A_BLOCK).cast("int").alias("row_blocks"))

    def first_limits(frames):
        ids, head, _ = shared.value
        for f in frames:
            q, q_id = matrix(f["v"], np.int64), f["vec_id"].to_numpy()
            least = []
            for at in range(0, len(q), 256):
                s = (q[at : at + 256].astype(np.float64) @ head.T.astype(np.float64)).round()
                s[q_id[at : at + 256, None] == ids[None, :]] = -np.inf
                own = np.partition(s, -k, 1)[:, -k] if len(ids) > k else np.full(len(s), -np.inf)
                least += [float(x) * (1 - 1e-9 * np.sign(x)) - 1 for x in own]
            yield f.assign(limit=np.maximum(np.array(least), -9e18).astype(np.float64))

    limits = distinct_queries(rows, query_step).mapInPandas(first_limits, "query long, vec_id long, v array<long>, limit double").withColumn("length", length)
    # A query goes to those bands alone whose longest row can reach its limit; bands are few and their table is small.
    asking = stored(limits.join(F.broadcast(cut), F.sqrt(limits.length * F.col("longest")) * (1 + 1e-9) + 1 >= F.col("limit")).drop("length", "longest"), "asking")
    cut = asking.groupBy("band").agg(F.ceil(F.count("*") / QUERIES_A_BLOCK).cast("int").alias("query_blocks"), F.first("row_blocks").alias("row_blocks"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    keys = ["band", "row_block", "query_block"]
    left = dealt.join(F.broadcast(cut), "band").withColumn("row_block", mine("row_blocks")).withColumn("query_block", each("query_blocks")).select(*keys, "vec_id", "v")
    right = asking.drop("row_blocks").join(F.broadcast(cut), "band").withColumn("query_block", mine("query_blocks")).withColumn("row_block", each("row_blocks")).select(*keys, "query", "vec_id", "v", "limit")

    def search(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        found = scan(asking["vec_id"].to_numpy(), matrix(asking["v"], np.int64), rows["vec_id"].to_numpy(), matrix(rows["v"], np.int64), asking["limit"].to_numpy(), shared.value[2], k)
        return found.assign(query=asking["query"].to_numpy()[found["query"]])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
