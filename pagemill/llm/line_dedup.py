"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.staged import computed
from pagemill.llm.common import table
from pagemill.session import settled

#: A line is boilerplate of a host if more than this share of the host's pages contain it ...
RATIO = 0.05
#: ... and at least so many of its pages do: on a host of few pages a share says nothing.
MIN_PAGES = 5
#: The boilerplate table is broadcast up to so many lines (16-byte digests); beyond it, it is joined
#: by a shuffle on the host.
BROADCAST_LINES = 200_000


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_texts: bool = False
) -> DataFrame:
    """The lines that more than ``ratio`` of a host's pages contain: ``host, line`` (an MD5 digest).

    A page counts once for a line, however often it repeats it; lines are compared without the
    spaces around them, and empty ones don't count. Counts are summed before the shuffle, so a
    host or line that most rows share sends one row per task.

    With ``distinct_texts`` the pages of a host are its distinct texts (no text is one of them): copies
    of a page count once. They become one by the digest of the whole text, in each task before the
    shuffle; what is shuffled then are the line digests of each text.
    """
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    kept = F.filter(lines, lambda x: x != "")
    counted = docs.select(F.col(host).alias("host"))
    held = docs.select(F.col(host).alias("host"), F.explode(kept).alias("line")).select("host", _digest(F.col("line")).alias("line"))
    if distinct_texts:
        text = docs.select(F.col(host).alias("host"), _digest(F.col("text")).alias("of"), F.transform(kept, _digest).alias("lines"))
        counted = text.select("host", "of").distinct()
        held = text.groupBy("host", "of").agg(F.first("lines").alias("lines")).select("host", F.explode("lines").alias("line"))
    pages = counted.groupBy("host").agg(F.count("*").alias("pages"))
    containing = (
        held.groupBy("host", "line")
        .agg(F.count("*").alias("with_line"))
        .where(F.col("with_line") >= min_pages)
    )
    return (
        containing.join(pages, containing["host"].eqNullSafe(pages["host"]))
        .where(F.col("with_line") > F.col("pages") * ratio)
        .select(containing["host"], "line")
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_texts: bool = False
) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of ``text``, and ``n_lines, n_dropped``.

    Rows and other columns stay as they are. A null text stays null, with 0 lines; a null host is a
    host of its own; a text that is boilerplate throughout becomes empty. Lines that stay keep
    their order and white space. Every page of a host counts, also those without text; repeated
    rows count as often as they are there. So a text whose copies are more than ``ratio`` of a host's
    rows becomes empty in all of them; with ``distinct_texts`` copies count once (see
    ``boilerplate_lines``), and a text goes only if other texts share its lines.

    A host has at most (mean lines per page / ``ratio``) boilerplate lines: they are small enough to
    go to its pages as one array.
    """
    found = settled(boilerplate_lines(docs, host, ratio, min_pages, distinct_texts))
    by_host = found.groupBy("host").agg(F.collect_list(F.hex("line")).alias("__pm_lines")).withColumnRenamed("host", "__pm_host")
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    split = docs.withColumn("__pm_all", F.split("text", "\n")).withColumn("__pm_of", F.col(host))
    known = lambda x: F.array_contains(F.col("__pm_lines"), F.upper(F.md5(F.trim(x))))
    kept = F.when(
        F.col("__pm_lines").isNotNull(), F.filter("__pm_all", lambda x: ~known(x) | (F.trim(x) == ""))
    ).otherwise(F.col("__pm_all"))
    cut = computed(split.join(by_host, F.col("__pm_of").eqNullSafe(F.col("__pm_host")), "left"), __pm_kept=kept)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    out = {
        "text": F.array_join("__pm_kept", "\n"),
        "n_lines": size("__pm_all"),
        "n_dropped": size("__pm_all") - size("__pm_kept"),
    }
    return cut.select(*(c for c in docs.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL = {
    "op3_line_dedup": f"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, source, text, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM pieces
), pages AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), common AS (
  SELECT l.source, trim(l.line, ' ') AS line
  FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE trim(l.line, ' ') <> ''
  GROUP BY l.source, trim(l.line, ' '), p.pages
  HAVING count(DISTINCT l.r) >= {MIN_PAGES} AND count(DISTINCT l.r) > p.pages * CAST({RATIO} AS DOUBLE)
), marked AS (
  SELECT l.r, l.line, l.place, c.line IS NOT NULL AS cut
  FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND trim(l.line, ' ') = c.line
), kept AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT cut), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_dropped
  FROM marked GROUP BY r
)
SELECT p.doc_id, p.source, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM pieces p LEFT JOIN kept k ON p.r = k.r
"""
}
