"""Exact top-k inner product by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import table
from pagemill.session import settled

K = 5
#: Vectors of a document-range block, the unit that bounds skip.
BLOCK = 128
#: Vectors and queries that a task holds at once.
SHARD_ROWS = 8_192
QUERY_ROWS = 4_096


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null, NaN or infinity."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, whole)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def block_at_a_time(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int) -> list:
    """For each query the ids and scores of its ``k`` best vectors but its own, ties to smaller ids.

    Vectors are laid out by the signs of their strongest dimensions, then cut into blocks. A
    dimension is a term: a block's bound is the sum over terms of the query's weight times the
    block's maximum (minimum where the weight is negative). Each query takes its blocks from the
    highest bound down, scores them whole through the block's rows (its forward index), and stops
    when the next bound is below its k-th score; an equal bound may still hold a smaller id.
    """
    strong = np.argsort(-vectors.astype(float).var(axis=0), kind="stable")[:16]
    order = np.lexsort([ids, *(vectors[:, d] > 0 for d in strong[::-1])])
    vectors, ids = vectors[order], ids[order]
    # Sums of integer products are exact in doubles under 2^53, in 64-bit integers under 2^63.
    largest = max((abs(int(x)) for x in (vectors.max(initial=0), vectors.min(initial=0)))) * max((abs(int(x)) for x in (queries.max(initial=0), queries.min(initial=0))))
    largest *= max(1, vectors.shape[1])
    kind, none = (np.float64, -np.inf) if largest < 2**53 else (np.int64, -(2**63)) if largest < 2**63 else (object, -(2**200))
    starts = np.arange(0, len(ids), block)
    q, v = queries.astype(kind), vectors.astype(kind)
    top, low = np.maximum.reduceat(v, starts), np.minimum.reduceat(v, starts)
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    best_score = np.full((len(q), k), none, kind)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    active = np.arange(len(q))
    for step in range(len(starts)):
        active = active[bounds[active, turn[active, step]] >= best_score[active, -1]]
        if not len(active):
            break
        at = turn[active, step]
        by_block = np.argsort(at, kind="stable")
        for group in np.split(active[by_block], np.flatnonzero(np.diff(at[by_block])) + 1):
            b = turn[group[0], step]
            own = slice(starts[b], starts[b] + block)
            score = q[group] @ v[own].T
            score[query_ids[group][:, None] == ids[own][None, :]] = none
            score = np.concatenate([best_score[group], score], axis=1)
            number = np.concatenate([best_id[group], np.broadcast_to(ids[own], (len(group), len(ids[own])))], axis=1)
            for i, row in enumerate(group):
                near = np.flatnonzero(score[i] >= np.partition(score[i], -k)[-k]) if score.shape[1] > k else np.arange(score.shape[1])
                # Ties go to the smaller id; ids first, then the scores by a stable sort, whatever their kind.
                near = near[np.argsort(number[i][near], kind="stable")]
                pick = near[np.argsort(~score[i][near] if kind is np.int64 else -score[i][near], kind="stable")][:k]
                best_score[row], best_id[row] = score[i][pick], number[i][pick]
    found = best_score > none
    return [(int(query_ids[i]), int(best_id[i, j]), int(best_score[i, j])) for i, j in zip(*np.nonzero(found), strict=True)]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products, ties to smaller ids.

    ``queries`` and ``candidates`` have ``vec_id`` and ``vector array<bigint>``; null vectors and null
    ids take no part, and a query meets candidates of its own number of dimensions only. Fewer
    candidates give fewer rows; equal vectors are ranked one by one. A ``vec_id`` on several rows is
    several candidates, none of which meets the query of that id; a repeated query is asked once.

    Candidates are dealt into shards of a bounded size by id, queries into groups of a bounded size,
    and each task takes one shard and one group; it keeps ``k`` rows of each query.
    """
    given = lambda rows: rows.where("vec_id is not null and vector is not null and size(vector) > 0").select("vec_id", "vector")
    asked = given(queries).dropDuplicates(["vec_id"])
    held = given(candidates)
    n_queries, n_rows = asked.count(), held.count()
    shards, groups = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", dealt(["vec_id"], groups).alias("g"), every(shards).alias("s"), F.size("vector").alias("d"))
    # The row's place, not its id alone: one id or vector may hold many rows.
    right = held.select("*", dealt(["vec_id", F.monotonically_increasing_id()], shards).alias("s"), every(groups).alias("g"), F.size("vector").alias("d"))

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            found = block_at_a_time(_matrix(asked["vector"]), asked["vec_id"].to_numpy(), _matrix(rows["vector"]), rows["vec_id"].to_numpy(), k, block)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["s", "g", "d"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    rows = settled(rows.where("vector is not null"))
    return top_k(rows.where("vec_id % 50 = 0"), rows)


QUERIES = {"op9_block_topk": op9_block_topk}
SQL = {
    "op9_block_topk": f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
}
