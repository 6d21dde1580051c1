"""Spelling variants by pivotal grams: words one edit apart, and the form that each is a variant of."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, table
from pagemill.session import settled, shuffled

#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_N = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: A run whose hash this number divides loses a code point.
SLIPS = 199
#: Words that a task counts before it passes them on.
COUNTED = 200_000
#: Two words one edit apart share a pivot of one and a prefix gram of the other, if words have so many letters.
SHORTEST = 4

#: Latin-1 bytes that belong to words, with A-Z lower-cased; others are spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def words_of(doc_id, text: str | None, least: int = LEAST_LENGTH) -> Counter:
    """The words of a text of ``least`` code points or more, as Latin-1, with their occurrences.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. A run whose crc32 with the document's id is
    divisible by ``SLIPS`` loses one code point, so shorter runs needn't be looked at. Without an id
    no run does.
    """
    runs = Counter([w for w in (text or "").encode("latin-1", "replace").translate(_WORD_BYTES).split() if len(w) >= least])
    if doc_id is None:
        return runs
    start, slips = zlib.crc32(f"{doc_id}:".encode()), []
    for w in runs:
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % SLIPS == 0:
            slips.append((w, h % len(w)))
    moved = [(w[:k] + w[k + 1 :], runs.pop(w)) for w, k in slips]
    for w, n in moved:
        if len(w) >= least:
            runs[w] += n
    return runs


def count_words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n`` of all ``docs``: counted in each task before the shuffle, in a table of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.update(words_of(doc_id, text.as_py(), least))
                if len(total) > COUNTED:
                    yield counted()
        yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def grams_of(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix_and_pivots(word: str, count: dict[str, int], pivots: int = 2) -> tuple[list[int], list[int]]:
    """The places of a word's prefix grams, and those of its pivots among them.

    Grams are ordered by rarity. The prefix holds the first ``2 * pivots - 1`` grams, and all that equal the
    last of them. Pivots are disjoint grams of the prefix whose counts have the least sum, found by
    dynamic programming over places: the best choice of j pivots among the first i.
    """
    grams = grams_of(word)
    key = [(count[g], g) for g in grams]
    last = sorted(key)[min(2 * pivots - 1, len(key)) - 1]
    prefix = [i for i, k in enumerate(key) if k <= last]
    best: list = [(0, ())] * (len(prefix) + 1)
    for _ in range(pivots):
        taken: list = [None]
        for i, at in enumerate(prefix):
            before = best[bisect_left(prefix, at - 1)]  # places of grams that end before this one begins
            with_it = before and (before[0] + count[grams[at]], (*before[1], at))
            taken.append(min(filter(None, (taken[i], with_it)), default=None))
        best = taken
    return prefix, list(best[-1][1])


def _gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each gram occurs in words. There are 90 letters, so at most 8,100 grams."""

    def count(batch: pa.RecordBatch) -> dict:
        own = Counter(g for w in batch.column(0).to_pylist() for g in grams_of(w))
        return {"gram": list(own), "n": list(own.values())}

    rows = map_batches(words.select("word"), count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: r.n for r in rows}


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each two different words that are one edit apart, once, with ``a < b``.

    ``words`` has distinct ``word`` of four letters or more, with ``n``. One edit changes two grams at most, which
    overlap. So of the word whose last prefix gram comes first in order, one of the two disjoint pivots is
    left in the other word, and among that one's prefix grams. It lies where the difference in length says:
    as far from the start, or from the end. Pivots are joined with prefix grams on gram, place and
    length, by a shuffle: a word has some fifteen of these; each candidate is then verified by its edit distance.
    """
    count = _gram_counts(words)

    def sides(want_pivots: bool) -> Callable[[pa.RecordBatch], dict]:
        def rows(batch: pa.RecordBatch) -> dict:
            out: list[tuple] = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix, pivots = prefix_and_pivots(w, count)
                long = len(w)
                if want_pivots:
                    out += [(w, n, w[i : i + 2], i, long) for i in pivots]
                else:
                    for i in prefix:
                        out += [(w, n, w[i : i + 2], at, size) for at, size in ((i, long), (i, long + 1), (i + 1, long + 1), (i, long - 1), (i - 1, long - 1))]
            return dict(zip(("word", "n", "gram", "place", "size"), map(list, zip(*out, strict=True)), strict=True))

        return rows

    schema = "{0} string, {0}_n bigint, gram string, place int, size int"
    named = lambda name, fn: map_batches(words.select("word", "n"), lambda b: dict(zip((name, f"{name}_n", "gram", "place", "size"), fn(b).values(), strict=True)), schema.format(name))
    met = named("p", sides(True)).join(shuffled(named("q", sides(False))), ["gram", "place", "size"]).where((F.col("p") != F.col("q")) & (F.levenshtein("p", "q", 1) == 1))
    ordered = lambda x, y: F.when(F.col("p") < F.col("q"), F.col(x)).otherwise(F.col(y))
    return met.select(ordered("p", "q").alias("a"), ordered("p_n", "q_n").alias("a_n"), ordered("q", "p").alias("b"), ordered("q_n", "p_n").alias("b_n")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: where each word's forms lead. Each round doubles the steps taken; a form has several
    times its variant's count, so a chain is as long as the logarithm of the largest count at most."""
    at = settled(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("of"), F.col("root").alias("next"))
        at = settled(at.join(shuffled(further), at["root"] == further["of"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (distinct ``word``, ``n``).

    A word's form is its near word (one edit apart) of the largest ``n``, ties to the smallest in code-point
    order, if that is ``times`` its own ``n`` at least; else null. ``root`` is where forms lead, the word itself
    if it has none. ``n_near`` counts near words. An empty table gives no rows.
    """
    near = near_words(words)
    both = near.select(F.col("a").alias("w"), "a_n", F.col("b").alias("o"), F.col("b_n").alias("o_n")).union(near.select("b", "b_n", "a", "a_n"))
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.max("a_n").alias("own"), F.min(F.struct((-F.col("o_n")).alias("less"), "o")).alias("top"))
    fits = lambda c: F.when(-F.col("top.less") >= times * F.col("own"), c)
    best = settled(best.select("w", "n_near", fits(F.col("top.o")).alias("form"), fits(-F.col("top.less")).alias("form_n")))
    roots = _roots(best.where("form is not null").select(F.col("w").alias("word"), "form"))
    found = best.join(shuffled(roots.withColumnRenamed("word", "w")), "w", "left")
    known: Column = F.coalesce("n_near", F.lit(0))
    return words.select("word", "n").join(shuffled(found), F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", known.alias("n_near"), "form_n")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """The spelling variants among the words of ``docs`` (see ``words_of`` and ``variants``).

    Only words of ``least_length`` code points (four or more) and ``least_n`` occurrences take part. Null texts
    have no words; repeated rows count as often as they are there; other columns are ignored.
    """
    if least_length < SHORTEST:
        raise ValueError(f"words of under {SHORTEST} letters have too few grams")
    return variants(settled(count_words(docs, least_length).where(F.col("n") >= least_n)), times)


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_pivotal_grams": op11_pivotal_grams}
#: The SQL finds near words by what is left of them without one code point.
SQL = {
    "op11_pivotal_grams": f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS n, length(run) AS size
  FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
  )
  WHERE length(run) >= {LEAST_LENGTH}
  GROUP BY doc_id, run
), bytes AS (
  SELECT run, n, size, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b
  FROM runs
), hashed AS (
  SELECT run, n, size,
    xor(list_reduce(list_concat([4294967295], list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) AS h
  FROM bytes, crc_table
), slipped AS (
  SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, CAST(h % size AS BIGINT)) || substr(run, CAST(h % size AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_N}
), cut AS (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS o, b.n AS o_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, max(o_n) AS top_n FROM near GROUP BY word, n
), formed AS (
  SELECT b.word, b.n_near, CASE WHEN b.top_n >= {TIMES} * b.n THEN b.top_n END AS form_n,
         CASE WHEN b.top_n >= {TIMES} * b.n THEN (SELECT min(o) FROM near x WHERE x.word = b.word AND x.o_n = b.top_n) END AS form
  FROM best b
), chain AS (
  WITH RECURSIVE walk(word, reached, step) AS (
    SELECT word, form, 1 FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT w.word, f.form, w.step + 1 FROM walk w JOIN formed f ON w.reached = f.word WHERE f.form IS NOT NULL
  )
  SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word
)
SELECT w.word, f.form, coalesce(c.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN formed f ON w.word = f.word LEFT JOIN chain c ON w.word = c.word
"""
}
