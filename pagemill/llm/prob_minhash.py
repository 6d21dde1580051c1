"""Near-duplicate classes by ProbMinHash, banding and exact verification."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, scramble, shingle_hashes, table, word_hashes
from pagemill.session import scratch_dir, settled

WORDS = 5
SIMILARITY = 0.8
#: Registers of a signature, and of a band. Texts of similarity 0.8 share one of 16 bands of 4 with
#: probability 0.9998.
REGISTERS, BAND = 64, 4
#: Pairs whose signatures agree in a smaller share are not verified: four standard deviations below 0.8.
LEAST_ESTIMATE = 0.6
#: Buckets of up to so many rows give pairs; in larger ones, so many outsiders and others meet in one task.
SMALL, OUTSIDERS, OTHERS = 24, 512, 2_048
#: Candidates whose ids are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_NODES = 500_000


def counted_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of five words, as sorted hashes, and how often each occurs.

    Words are lower-cased and split at ASCII white space; a shorter text is one run.
    """
    return np.unique(shingle_hashes(word_hashes(text.lower().encode().split()), WORDS), return_counts=True)


def shingles(text: str) -> np.ndarray:
    return counted_shingles(text)[0]


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (``docs x registers`` of 32 bits) of weighted sets.

    Each element of a set arrives at exponential times, at a rate of its weight; each arrival goes to
    a random register, which keeps its earliest element. Both come from the element's hash alone.
    Two registers then agree with a probability of the sets' probability Jaccard similarity. An
    element is done when its next arrival is later than all of the set's registers hold.
    """
    time = np.full(docs * registers, np.inf)
    held = np.zeros(docs * registers, np.uint32)
    at = np.zeros(len(element))
    latest = np.full(docs, np.inf)
    arrival = np.uint64(0)
    while len(element):
        arrival += np.uint64(1)
        with np.errstate(over="ignore"):
            h = scramble(element + arrival * np.uint64(0x9E3779B97F4A7C15))
        at = at - np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53) / weight
        place = doc * registers + (scramble(h) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(at < time[place])
        better = better[np.argsort(-at[better], kind="stable")]  # of several writes to a register the last one stays
        time[place[better]] = at[better]
        held[place[better]] = (element[better] >> np.uint64(32)).astype(np.uint32)
        latest = time.reshape(docs, registers).max(axis=1)
        going = at < latest[doc]
        doc, element, weight, at = doc[going], element[going], weight[going], at[going]
    return held.reshape(docs, registers)


def _sketch(batch: pa.RecordBatch) -> dict:
    texts = [t.encode() for t in batch.column(1).to_pylist()]
    digests = [hashlib.md5(t).digest() for t in texts]
    distinct = {d: t.decode() for d, t in zip(digests, texts, strict=True)}
    found: dict[bytes, bytes | None] = {}
    keys = list(distinct)
    for start in range(0, len(keys), 200):
        part = keys[start : start + 200]
        sets = [counted_shingles(distinct[d]) for d in part]
        plain, weighted = _signed([(x, np.ones(len(x))) for x, _ in sets]), {}
        # Where no shingle repeats, both signatures are the same.
        repeating = [i for i, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
        for i, row in zip(repeating, _signed([(sets[i][0], 1 + np.log(sets[i][1])) for i in repeating]), strict=True):
            weighted[i] = row
        for i, (d, row) in enumerate(zip(part, plain, strict=True)):
            found[d] = np.concatenate([row, weighted.get(i, row)]).astype("<u4").tobytes() if len(sets[i][0]) else None
    return {"doc_id": batch.column(0), "digest": digests, "sig": [found[d] for d in digests]}


def _signed(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The signature of each set of elements with weights."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint32)
    sizes = [len(x) for x, _ in sets]
    return prob_minhash(np.repeat(np.arange(len(sets)), sizes), np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets]), len(sets))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The larger of the shares in which plain and weighted signatures agree, row by row."""
    same = (x == y).reshape(-1, 2, REGISTERS)
    return same.mean(axis=2).max(axis=1)


def connected(links: DataFrame) -> DataFrame:
    """``node, comp`` for each end of the links ``a, b``: the smallest node that it is connected with.

    Labels go along links and jump to their label's label, so rounds grow with the logarithm of a
    chain's length; each round is a written table.
    """
    both = settled(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("c"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "c").alias("next"))
        stepped = settled(stepped)
        far = stepped.select(F.col("node").alias("p"), F.col("next").alias("jump"))
        moved = settled(stepped.join(far, stepped["next"] == far["p"]).select("node", "comp", F.least("next", "jump").alias("next")))
        done = moved.where("next <> comp").isEmpty()
        labels = moved.select("node", F.col("next").alias("comp"))
        if done:
            return labels


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingle hashes (sorted, little-endian) of each node's text: ``node, shingles``. ``nodes`` has ``node, first, digest``."""
    wanted = nodes.select("node", "first", F.col("digest").alias("d"))
    if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    given = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    held = given.join(wanted, given["doc_id"] == wanted["first"]).where(F.unhex(F.md5("text")) == F.col("d")).select("node", "text")
    hashed = map_batches(
        held,
        lambda batch: {"node": batch.column(0), "shingles": [shingles(t).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]},
        "node bigint, shingles binary",
    )
    return settled(hashed.dropDuplicates(["node"]))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have a Jaccard similarity of ``least`` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def verify(batch: pa.RecordBatch) -> dict:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= least * (len(x) + len(y) - both))
        return {"a": batch.column(0), "b": batch.column(1), "ok": ok}

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), verify, "a bigint, b bigint, ok boolean").where("ok").drop("ok")


def _signatures(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1)


def _met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows of a bucket whose signature comes near one of another component."""
    if not len(left) or not len(right):
        return pd.DataFrame(columns=["key", "node"]).astype("int64")
    a, b, comp = _signatures(left["sig"]), _signatures(right["sig"]), right["comp"].to_numpy()
    hit, mine = np.zeros(len(b), bool), np.zeros(len(a), bool)
    for i, own in enumerate(left["comp"].to_numpy()):
        near = (agreement(b, a[i]) >= LEAST_ESTIMATE) & (comp != own)
        hit |= near
        mine[i] = near.any()
    nodes = np.unique(np.concatenate([left["node"].to_numpy()[mine], right["node"].to_numpy()[hit]]))
    return pd.DataFrame({"key": np.full(len(nodes), left["key"].iloc[0], np.int64), "node": nodes})


def _linked(least: float):
    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Exact links across components, one at most for each left row and other component."""
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            b, comp, nodes = _signatures(right["sig"]), right["comp"].to_numpy(), right["node"].to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in right["shingles"]]
            size = np.array([len(s) for s in sets])
            for sig, own, node, mine in zip(_signatures(left["sig"]), left["comp"], left["node"], left["shingles"], strict=True):
                x = np.frombuffer(mine, "<u8")
                fits = (np.minimum(size, len(x)) >= least * np.maximum(size, len(x))) & (comp != own)
                agree = np.where(fits, agreement(b, sig), 0)
                near = np.flatnonzero(agree >= LEAST_ESTIMATE)
                seen = set()
                for j in near[np.argsort(-agree[near], kind="stable")]:
                    if comp[j] not in seen:
                        both = len(np.intersect1d(x, sets[j], assume_unique=True))
                        if both >= least * (len(x) + size[j] - both):
                            seen.add(comp[j])
                            out.append((int(node), int(nodes[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return link


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (``key, node, comp``) of buckets with several components, with ``all``: the bucket's rows, ``main``: the
    component that has most of them, and ``inside``: how many."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    stats = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most")).where("all > most.n")
    stats = stats.select(F.col("key").alias("k"), "all", F.col("most.comp").alias("main"), F.col("most.n").alias("inside"))
    return settled(rows.join(stats, rows["key"] == stats["k"]).select("key", "node", "comp", "all", "main", "inside"))


def _pairs(mixed: DataFrame) -> DataFrame:
    """Every two nodes ``a, b`` of different components that share a bucket of a bounded size."""
    held = mixed.groupBy("key").agg(F.collect_set(F.struct("node", "comp")).alias("s"))
    others = lambda x: F.transform(F.filter("s", lambda y: (y["node"] > x["node"]) & (y["comp"] != x["comp"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))
    return held.select(F.explode(F.flatten(F.transform("s", others))).alias("p")).select("p.*").distinct()


def _blocks(mixed: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bucket rows as (outsiders, all), both with ``key, i, j``: blocks of a bounded size that meet once.

    Outsiders are the rows outside the component that has most rows of the bucket; any pair of two
    components has one at least.
    """
    path = scratch_dir(mixed.sparkSession, "buckets")
    parts = lambda rows, size: F.ceil(rows / size).cast("int")
    mixed.withColumns({"ni": parts(F.col("all") - F.col("inside"), OUTSIDERS), "nj": parts(F.col("all"), OTHERS)}).write.parquet(path)
    # Read twice: two sides of one group must not share their columns' identities.
    held, other = (mixed.sparkSession.read.parquet(path) for _ in range(2))
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "node", "comp", *keep]
    outside = held.where("comp <> main").select(*columns, spread("ni").alias("i"), every("nj").alias("j"))
    return outside, other.select(*columns, spread("nj").alias("j"), every("ni").alias("i"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` of every row: the smallest ``doc_id`` it is connected with by links.

    Texts link if they are equal, or if the Jaccard similarity of their five-word shingles is
    ``least`` or more. Candidates share a band of one of their two ProbMinHash signatures: in the first each distinct
    shingle has the weight 1, so that candidates and links are cut by the same similarity; in the second the
    weight 1 + ln(occurrences), so that it estimates the probability Jaccard of the weighted shingles.

    1. Signatures of each row, where it is read; equal texts become one node.
    2. Each bucket's nodes are checked against its smallest node, exactly, if the signatures come
       near. Copies of one text become a star, not pairs.
    3. What is left are buckets of several components. Small ones give the pairs between components, of which those
       with near signatures are verified. In larger ones the outsiders are compared with all rows of
       the bucket, in blocks of a bounded size, and only exact links between components come out.
    4. Connected components of all links.

    Null texts and null ids are classes of their own (a null id has a null class); texts without
    words link to equal ones only. A ``doc_id`` on several texts is several documents, each in the class of its text.
    Repeated rows share a class and are returned as often as they are
    there. Other columns are ignored.
    """
    return text_classes(docs, least).select("doc_id", "class_id")


def text_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``near_duplicates`` with the MD5 ``digest`` of each row's text and its class's number ``comp``; null where there
    is no text or id."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = settled(map_batches(given.where("doc_id is not null and text is not null"), _sketch, "doc_id bigint, digest binary, sig binary"))
    # A node is a text, numbered as it is written.
    nodes = sketch.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig"))
    nodes = settled(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "sig"))
    signed = nodes.where("sig is not null")
    place = lambda half, k: half * (4 * REGISTERS) + k * (4 * BAND) + 1
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.array(*(F.xxhash64(k, F.substring(F.col("sig"), place(h, k), F.lit(4 * BAND))) for h in (0, 1))))
    rows = signed.select(F.explode(F.array_distinct(F.flatten(keys))).alias("key"), "node")
    shared = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select(F.col("key").alias("k"), "hub")
    buckets = settled(rows.join(shared, rows["key"] == shared["k"]).select("key", "node", "hub"))
    sig = lambda name, out: signed.select(F.col("node").alias(name), F.col("sig").alias(out))

    def close(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 3))
        return {"a": batch.column(0), "b": batch.column(1), "near": agreement(x, y) >= LEAST_ESTIMATE}

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sig("a", "x"), "a").join(sig("b", "y"), "b").select("a", "b", "x", "y")
        return settled(map_batches(both, close, "a bigint, b bigint, near boolean").where("near").select("a", "b"))

    ends = lambda links: links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    sets_of = lambda wanted: _texts(given, settled(wanted.distinct().join(nodes.select("node", "first", "digest"), "node")))
    stars = near(buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    links = [_similar(stars, sets_of(ends(stars)), least)]

    comps = connected(links[0])
    label = lambda rows: rows.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = _mixed(label(buckets))
    large = mixed.where(F.col("all") > SMALL)
    between = near(_pairs(mixed.where(F.col("all") <= SMALL)))
    if large.isEmpty():
        links.append(_similar(between, sets_of(ends(between)), least))
    else:
        meeting = ["key", "i", "j"]
        outside, every = _blocks(large.join(sig("node", "sig"), "node"), ["sig"])
        met = settled(outside.groupBy(*meeting).cogroup(every.groupBy(*meeting)).applyInPandas(_met, "key bigint, node bigint").distinct())
        sets = sets_of(ends(between).union(met.select("node")))
        links.append(_similar(between, sets, least))
        again = _mixed(label(met))
        outside, every = _blocks(again.join(sig("node", "sig"), "node").join(sets, "node"), ["sig", "shingles"])
        links.append(outside.groupBy(*meeting).cogroup(every.groupBy(*meeting)).applyInPandas(_linked(least), "a bigint, b bigint"))

    final = connected(reduce(DataFrame.union, links[1:], links[0]))
    of_text = settled(nodes.select("digest", "node", "first").join(final, "node", "left").select("digest", "first", F.coalesce("comp", "node").alias("comp")))
    # The smallest doc_id of each class. One of a single text is that text's own.
    least_of = of_text.groupBy("comp").agg(F.min("first").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    if least_of.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        least_of = F.broadcast(least_of)
    classes = of_text.join(least_of, "comp", "left").select("digest", F.coalesce("class_id", "first").alias("class_id"), "comp")
    alone = given.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("comp"))
    return sketch.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id", "digest", "comp").union(alone)


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_prob_minhash": op4_prob_minhash}
SQL: dict[str, str] = {}
