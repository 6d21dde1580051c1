"""Ranked lexical search, reversed: items are indexed, documents stream through the index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappush, heapreplace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, table
from pagemill.session import settled

K = 10
#: Postings (term, item) of an index that is broadcast; more items go in groups of about so many.
POSTINGS = 200_000
#: Scores (document, item) that a task holds at once.
CELLS = 1 << 20
#: Heaps of one item that are merged in one task, before those results are merged.
MERGED = 64

#: Bytes that belong to terms (digits, letters, all of beyond ASCII), with A-Z lower-cased; others are spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A document without an id comes after all others.
_NO_ID = 2**63


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return (text or b"").translate(_TERM_BYTES).split()


class ItemIndex:
    """Inverted index over a group of items: term to number, and the items of each term."""

    def __init__(self, items: list[list[bytes]]):
        found = sorted({t for terms in items for t in terms})
        self.n_items = len(items)
        self.number = {t: i for i, t in enumerate(found)}
        term = np.array([self.number[t] for terms in items for t in terms], np.int64)
        item = np.repeat(np.arange(len(items)), [len(terms) for terms in items])
        self.posting = item[np.argsort(term, kind="stable")]
        self.size = np.bincount(term, minlength=len(found))
        self.start = np.cumsum(self.size) - self.size

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text with repeats; then text, term number and occurrences of those that items hold."""
        split = [terms_of(t) for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        numbers = np.fromiter(map(self.number.get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
        held = numbers >= 0
        width = max(1, len(self.number))
        key, tf = np.unique(np.repeat(np.arange(len(texts)), n)[held] * width + numbers[held], return_counts=True)
        return n, key // width, key % width, tf

    def scores(self, doc: np.ndarray, gain: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """``docs x items``: the gains of each document's terms, summed over the items that hold them."""
        size = self.size[term]
        ends = np.cumsum(size)
        place = np.repeat(self.start[term] - (ends - size), size) + np.arange(int(size.sum()))
        out = np.zeros(docs * self.n_items, np.int64)
        np.add.at(out, np.repeat(doc * self.n_items, size) + self.posting[place], np.repeat(gain, size))
        return out.reshape(docs, self.n_items)


def _matched(docs: DataFrame, index) -> DataFrame:
    """``doc_id, n, term, tf`` of each document with a term: its length, and the item terms that it holds."""

    def run(batch: pa.RecordBatch) -> dict:
        n, doc, term, tf = index.value.counts(batch.column(1).to_pylist())
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
        return {"doc_id": batch.column(0), "n": n, "term": lists(term), "tf": lists(tf)}

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return settled(map_batches(texts, run, "doc_id bigint, n bigint, term array<int>, tf array<int>").where("n > 0"))


def _heaps(matched: DataFrame, index, weights: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the best ``k`` documents that each task saw for each item."""
    sent = matched.sparkSession.sparkContext.broadcast(np.array([weights.get(t, 0) for t in range(len(index.value.number))], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = index.value, sent.value
        heaps: list[list] = [[] for _ in range(own.n_items)]
        least = np.ones(own.n_items, np.int64)  # a score must be above 0
        step = max(1, CELLS // max(1, own.n_items))
        for batch in batches:
            ids = [_NO_ID if d is None else d for d in batch.column(0).to_pylist()]
            lists = batch.column(2)
            count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            m = 10 + 90 * batch.column(1).to_numpy() * n_docs // n_terms
            doc = np.repeat(np.arange(len(ids)), count)
            gain = weight[term] * (1_000_000_000 * tf // (1_000 * tf + 8 * m[doc]))
            for at in range(0, len(ids), step):
                docs = min(step, len(ids) - at)
                part = slice(*np.searchsorted(doc, [at, at + docs]))
                score = own.scores(doc[part] - at, gain[part], term[part], docs)
                enough = np.partition(score, -k, axis=0)[-k] if docs > k else 0
                for d, i in zip(*(x.tolist() for x in np.nonzero(score >= np.maximum(least, enough))), strict=True):
                    entry = (int(score[d, i]), -ids[at + d])
                    if len(heaps[i]) < k:
                        heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapreplace(heaps[i], entry)
                least = np.array([h[0][0] if len(h) == k else 1 for h in heaps], np.int64)
        rows = [(i, None if d == -_NO_ID else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return matched.mapInArrow(run, "item int, doc_id bigint, score bigint")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = K, postings: int = POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs`` for each row of ``items``.

    Both have a ``text``. Terms are runs of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased.
    Weights and lengths are whole numbers, so that scores are the same everywhere: see ``_heaps`` for
    a document's and the module's SQL for the whole formula. Only scores above 0 are ranked; equal ones by
    ascending ``doc_id``, null last.

    The index is over the items' terms, not over the corpus. It is broadcast; each document's term counts
    are looked up in it where the document is read, which gives the corpus counts in a first pass, and are
    then run through it against heaps of ``k`` places for each item. A task ends with its heaps, so what
    is shuffled is ``k`` rows for each item and task. The index holds about ``postings`` entries; more
    items go in groups, one after the other.

    Null texts have no terms; items without a known term have no rows. Equal rows of ``items`` are one
    item, others of one ``item_id`` are ranked apart. Repeated documents are ranked one by one. Empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary").alias("text")).distinct()
    split = lambda b: {"item_id": b.column(0), "terms": [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]}
    prepared = settled(map_batches(asked, split, "item_id bigint, terms array<binary>").where("size(terms) > 0"))
    total = prepared.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = -(-total // postings)
    found = None
    for g in range(groups):
        held = sorted(prepared.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(groups)) == g).collect(), key=lambda r: (r.item_id is None, r.item_id, r.terms))
        index = spark.sparkContext.broadcast(ItemIndex([[bytes(t) for t in r.terms] for r in held]))
        matched = _matched(docs, index)
        n_docs, n_terms = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row for each term of the index.
        df = matched.select(F.explode("term").alias("t")).groupBy("t").count().collect()
        weights = {r.t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1))) for r in df}
        own = _heaps(matched, index, weights, n_docs, max(1, n_terms), k)
        best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        own = own.withColumn("part", F.spark_partition_id() % MERGED).withColumn("rank", best("item", "part")).where(F.col("rank") <= k)
        own = own.withColumn("rank", best("item")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(held)], "item int, item_id bigint")
        own = own.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op13_reversed_search": op13_reversed_search}
SQL = {
    "op13_reversed_search": f"""
WITH items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(terms) AS terms
  FROM (SELECT item_id, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n
  FROM (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL) WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs
), asked AS (
  SELECT i, item_id, unnest(terms) AS term FROM items
), held AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
), weights AS (
  SELECT h.term, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held h, corpus GROUP BY h.term, big_n
), scored AS (
  SELECT a.i, a.item_id, h.r, d.doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weights USING (term) JOIN docs d USING (r), corpus
  GROUP BY a.i, a.item_id, h.r, d.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
}
