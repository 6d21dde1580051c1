"""Similarity of fragment vectors: pooling, exact pairs, greedy de-duplication.

Vectors arrive as ``page_id, vec_id, score, embedding``. Exact copies are collapsed before
anything is compared, and groups above one block are compared block by block, so neither a
hot page nor a hot vector ends up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir, settled, shuffled

BLOCK = 512
HEADS, OTHERS = 1_024, 4_096  # vectors of a page that one task walks, and that meet the kept ones in one task
PRODUCTS = 1 << 20  # numbers of a matrix product that are held at once
PAIR_SCHEMA = "better bigint, worse bigint, cosine double, better_copies bigint, worse_copies bigint"


def mean_pool(tokens: DataFrame, group: str) -> DataFrame:
    """Masked mean of token vectors (``group, embedding, mask``) as ``group, dim, value`` rows.

    Whole vectors are combined in each partition before the shuffle; only results are taken apart. A group without
    a masked-in vector has zeros. Vectors of one group have one length; null ones take no part.
    """
    given = tokens.where(F.col("embedding").isNotNull() & F.col("mask").isNotNull()).select(group, "embedding", F.col("mask").cast("double").alias("m"))
    weighed = array_to_vector(F.transform("embedding", lambda x: x.cast("double") * F.col("m")))
    found = given.groupBy(group).agg(Summarizer.sum(weighed).alias("total"), F.greatest(F.sum("m"), F.lit(1e-9)).alias("n"))
    return found.select(group, F.posexplode(F.transform(vector_to_array("total"), lambda x: x / F.col("n"))).alias("dim", "value"))


def collapse_copies(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector of a page: its best-ranked member and the number of copies."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("vec_id").alias("id")))
    return (
        vectors.groupBy("page_id", "embedding")
        .agg(best.alias("best"), F.count("*").alias("copies"))
        .select("page_id", F.col("best.id").alias("vec_id"), (-F.col("best.neg")).alias("score"), "copies", "embedding")
    )


def _block_pairs(keys: list[str], threshold: float):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["embedding"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        ids, copies = group["vec_id"].to_numpy(), group["copies"].to_numpy()
        score = group["score"].to_numpy(dtype=np.float64)
        blocks = group["block"].to_numpy()
        low, high = (np.flatnonzero(blocks == group[end].to_numpy()) for end in ("low", "high"))
        cosine = unit[low] @ unit[high].T
        i, j = np.nonzero(cosine > threshold)
        a, b, c = low[i], high[j], cosine[i, j]
        # Inside one block every pair shows up twice, across blocks once and in either order.
        ahead = (score[a] > score[b]) | ((score[a] == score[b]) & (ids[a] < ids[b]))
        if len(low) and np.array_equal(low, high):
            a, b, c = a[ahead], b[ahead], c[ahead]
        else:
            a, b = np.where(ahead, a, b), np.where(ahead, b, a)
        out = pd.DataFrame(
            {"better": ids[a], "worse": ids[b], "cosine": c, "better_copies": copies[a], "worse_copies": copies[b]}
        )
        for k in keys:
            out[k] = group[k].iloc[0]
        return out

    return match


def similar_pairs(distinct: DataFrame, threshold: float, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs of a group whose cosine exceeds the (non-negative) threshold; zero vectors have none.

    Each pair names its better-ranked member first (higher score, then lower id). A group of n
    vectors is cut into ceil(n / block) hash blocks and each pair of blocks is one task-sized
    matrix product; only matches are emitted.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    keys = keys or ["page_id"]
    rows = distinct.select(*keys, "vec_id", "score", "copies", "embedding")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = counts.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("n_blocks"))
    placed = rows.join(sizes, keys).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int")
    )
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        *keys, "vec_id", "score", "copies", "embedding", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    types = dict(distinct.dtypes)
    schema = PAIR_SCHEMA + "".join(f", {k} {types[k]}" for k in keys)
    return paired.groupBy(*keys, "low", "high").applyInPandas(_block_pairs(keys, threshold), schema)


def cosine_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs of distinct vectors of a page in id order, with the copies each side stands for."""
    in_order = F.col("better") < F.col("worse")
    side = lambda ok, no: F.when(in_order, F.col(ok)).otherwise(F.col(no))
    return similar_pairs(collapse_copies(vectors), threshold).select(
        "page_id",
        side("better", "worse").alias("left_id"),
        side("worse", "better").alias("right_id"),
        "cosine",
        side("better_copies", "worse_copies").alias("left_copies"),
        side("worse_copies", "better_copies").alias("right_copies"),
    )


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _walk(threshold: float):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        """Of the best vectors of a page, in rank order: those not too similar to one kept before."""
        group = group.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable")
        unit = _unit(group["embedding"])
        open_ = np.ones(len(group), bool)
        for i in range(len(group)):
            if open_[i]:
                open_[i + 1 :] &= unit[i + 1 :] @ unit[i] <= threshold
        return group[open_]

    return walk


def _unlike(threshold: float):
    def unlike(rest: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        """Vectors of a block that resemble none of the kept ones of their page."""
        if len(rest) and len(kept):
            rest = rest[(_unit(rest["embedding"]) @ _unit(kept["embedding"]).T <= threshold).all(axis=1)]
        return rest.drop(columns="block")

    return unlike


def semantic_dedup(vectors: DataFrame, threshold: float, block: int = HEADS) -> DataFrame:
    """Keep vectors in rank order (score, then id), discarding those too similar to a kept one of their page.

    Each round walks the best ``block`` vectors of every page in one task per page, and takes away from
    the rest, in blocks of bounded size, what resembles one that was kept. No pairs are stored. Pages
    of up to ``block`` distinct vectors take one round; a larger page takes one per ``block`` vectors
    that are neither copies nor discarded, each linear in what is left. From a threshold of 1 on,
    nothing is too similar and all vectors are returned as they are.
    """
    columns = ["page_id", "vec_id", "score", "embedding"]
    if threshold >= 1:
        return vectors.select(*columns)
    zero = F.forall("embedding", lambda x: x == 0)
    # Zero vectors resemble nothing, not even their copies.
    alone = vectors.where(zero | F.col("embedding").isNull()).select(*columns)
    rest = settled(collapse_copies(vectors.where(~zero)).select(*columns))
    schema = ", ".join(f"{n} {t}" for n, t in rest.dtypes)
    kept = alone
    while not rest.isEmpty():
        w = Window.partitionBy("page_id").orderBy(F.desc("score"), "vec_id")
        heads = rest.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= block).drop("turn")
        chosen = settled(heads.groupBy("page_id").applyInPandas(_walk(threshold), schema))
        kept = kept.unionByName(chosen)
        later = rest.join(shuffled(heads.select("page_id", "vec_id")), ["page_id", "vec_id"], "left_anti")
        counts = later.groupBy("page_id").agg(F.ceil(F.count("*") / OTHERS).cast("int").alias("n"))
        # One count per page with vectors left: no more rows than large pages.
        placed = later.join(shuffled(counts), "page_id").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")).drop("n")
        beside = chosen.join(shuffled(counts), "page_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        keys = ["page_id", "block"]
        rest = settled(placed.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInPandas(_unlike(threshold), schema))
    return kept


def first_wins(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy choice in rank order: keep a node unless a kept better one is paired with it.

    Each round keeps every node no undecided better node is paired with and drops its
    partners; rounds end when no pair is left. Rounds are written to the checkpoint folder.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    edges = pairs.select("page_id", "better", "worse").checkpoint()
    dropped = edges.select("page_id", F.col("worse").alias("vec_id")).limit(0)
    while not edges.isEmpty():
        worse = edges.select("page_id", F.col("worse").alias("better")).distinct()
        heads = edges.join(worse, ["page_id", "better"], "left_anti")
        now = heads.select("page_id", F.col("worse").alias("vec_id")).distinct().checkpoint()
        gone = now.withColumnRenamed("vec_id", "better")
        edges = (
            edges.join(gone, ["page_id", "better"], "left_anti")
            .join(now.withColumnRenamed("vec_id", "worse"), ["page_id", "worse"], "left_anti")
            .checkpoint()
        )
        dropped = dropped.unionByName(now)
    return nodes.join(dropped, ["page_id", "vec_id"], "left_anti")


def _planes(size: int, bands: int, bits: int, seed: int = 42) -> np.ndarray:
    """Random hyperplanes for vectors of a size: ``bits`` for each band."""
    return np.random.default_rng(seed).standard_normal((size, bands * bits))


def _buckets(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each vector in each band; a few vectors at a time, for there may be thousands of planes."""
    step = max(1, PRODUCTS // planes.shape[1])
    parts = [(x[at : at + step] @ planes > 0).reshape(-1, planes.shape[1] // bits, bits) @ (1 << np.arange(bits)) for at in range(0, len(x), step)]
    return np.concatenate(parts)


def band_keys(vectors: DataFrame, bands: int, bits: int, seed: int = 42) -> DataFrame:
    """Repeat each vector once per band of random-hyperplane sign bits (``band, bucket``)."""
    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes) + ", band int, bucket bigint"
    columns = vectors.columns

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["embedding"].tolist(), dtype=np.float64)
            if planes is None:
                planes = _planes(x.shape[1], bands, bits, seed)
            buckets = _buckets(x, planes, bits)
            for band in range(bands):
                yield batch[columns].assign(band=band, bucket=buckets[:, band])

    return vectors.mapInPandas(project, schema)


def _walk_banded(threshold: float, bands: int, bits: int):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        """Of the best vectors, in rank order: those not too similar to one kept before that shares a bucket with them."""
        group = group.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable")
        x, unit = np.array(group["embedding"].tolist(), dtype=np.float64), _unit(group["embedding"])
        buckets = _buckets(x, _planes(x.shape[1], bands, bits), bits)
        open_ = np.ones(len(group), bool)
        for i in range(len(group)):
            if open_[i]:
                alike = i + 1 + np.flatnonzero(open_[i + 1 :] & (unit[i + 1 :] @ unit[i] > threshold))
                open_[alike] = (buckets[alike] != buckets[i]).all(axis=1)
        return group[open_].drop(columns="block")

    return walk


def _unlike_banded(threshold: float, bands: int, bits: int):
    def unlike(rest: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        """Vectors of a block without a kept one that resembles them and shares a bucket with them."""
        alike = np.zeros(len(rest), bool)
        if len(rest) and len(kept):
            x, y = (np.array(rows["embedding"].tolist(), dtype=np.float64) for rows in (rest, kept))
            planes = _planes(x.shape[1], bands, bits)
            unit, others, theirs = _unit(rest["embedding"]), _unit(kept["embedding"]), _buckets(y, planes, bits)
            for at in range(0, len(x), BLOCK):
                i, j = np.nonzero(unit[at : at + BLOCK] @ others.T > threshold)
                own, step = _buckets(x[at : at + BLOCK], planes, bits), max(1, PRODUCTS // bands)
                for k in range(0, len(i), step):
                    a, b = i[k : k + step], j[k : k + step]
                    alike[at + a[(own[a] == theirs[b]).any(axis=1)]] = True
        return rest[~alike].drop(columns="block")

    return unlike


def plan_bands(n: int, threshold: float, bucket: int = 256, missed: float = 0.01) -> tuple[int, int]:
    """``bands, bits`` for ``n`` vectors: buckets of about ``bucket`` unrelated vectors, and a share of
    at most ``missed`` of the pairs at the threshold that no band brings together."""
    bits = max(6, math.ceil(math.log2(max(1, n / bucket))))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return math.ceil(math.log(missed) / math.log(1 - min(agree, 0.99))), bits


def semantic_dedup_lsh(
    vectors: DataFrame, threshold: float, bands: int | None = None, bits: int | None = None, block: int = HEADS
) -> DataFrame:
    """Corpus-wide form: keep vectors in rank order, discarding those too similar to a kept one in a common band bucket.

    Similarity is verified exactly, so nothing dissimilar is dropped; a similar vector that shares no
    bucket with the kept one may stay (see :func:`plan_bands`, which chooses both numbers from the corpus unless
    they are given).

    Each round walks the best ``block`` vectors in one task and takes away from the rest, in blocks of bounded size,
    what meets one that was kept. Buckets are computed where they are compared: no pairs are stored and no vector
    is repeated by band. Where few vectors are alike, rounds would be many: once one has taken away less than half
    and there are fewer bands than rounds to come, the rest is repeated by band instead and its pairs are stored.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    columns = ["vec_id", "score", "copies", "embedding"]
    whole = vectors.withColumn("page_id", F.lit(0).cast("bigint"))
    distinct = settled(collapse_copies(whole).select(*columns))
    if bands is None or bits is None:
        planned = plan_bands(distinct.count(), threshold)
        bands, bits = bands or planned[0], bits or planned[1]
    schema = ", ".join(f"{n} {t}" for n, t in distinct.dtypes)
    kept, rest = distinct.where("embedding is null"), distinct.where("embedding is not null")
    left = rest.count()
    while left:
        heads = settled(rest.orderBy(F.desc("score"), "vec_id").limit(block))
        chosen = settled(heads.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_walk_banded(threshold, bands, bits), schema))
        kept = kept.unionByName(chosen)
        before = left - min(left, block)
        if not before:
            break
        # Distinct vectors: each is a key. The heads are no more than a block.
        later = rest.join(F.broadcast(heads.select("embedding")), "embedding", "left_anti").select(*columns)
        n = math.ceil(before / OTHERS)
        placed = later.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        beside = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rest = settled(placed.groupBy("block").cogroup(beside.groupBy("block")).applyInPandas(_unlike_banded(threshold, bands, bits), schema))
        left = rest.count()
        if 2 * left > before and bands < left / block:
            keyed = band_keys(rest, bands, bits)
            pairs = similar_pairs(keyed, threshold, ["band", "bucket"]).select("better", "worse").distinct()
            page = F.lit(0).cast("bigint")
            kept = kept.unionByName(first_wins(rest.withColumn("page_id", page), pairs.withColumn("page_id", page)).select(*columns))
            break
    return kept
