"""URL filters: allow and block rules, and gradient-boosted trees on lexical features where none fits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.staged import computed, let
from pagemill.llm.common import table
from pagemill.session import ensure_checkpoint_dir, settled

#: Bound of the labelled sample that the trees are fitted on.
TRAIN_ROWS = 8_000
TREES, DEPTH = 12, 3
#: Suffix counts are broadcast up to so many suffixes; more are joined by a shuffle.
BROADCAST_SUFFIXES = 200_000
#: A suffix's block rate counts as if so many URLs of the overall rate had been seen with it.
PRIOR = 8

#: The rules of the query, (rule, verdict): a host and the start of its paths.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
FEATURES = ["f_length", "f_host", "f_labels", "f_depth", "f_digits", "f_hyphens", "f_entropy", "f_params", "f_tld_rate", "f_suffix_rate", "f_suffix_seen"]
SUFFIXES = {"tld": 1, "suffix": 2}  # labels at the end of the host


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before_query = lambda x: F.substring_index(F.substring_index(x, "?", 1), "#", 1)
    host = F.substring_index(before_query(rest), "/", 1)
    path = F.substring(before_query(rest), F.length(host) + 1, F.length(rest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``rule, verdict``; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of equal
    length, which then differ in their hosts, that with the longer host wins.
    """
    split = [(rule, *rule.partition("/")[::2], verdict) for rule, verdict in rules]
    tests = []
    for rule, own, start, verdict in sorted(split, key=lambda x: (-len(x[0]), -len(x[1]), x[3])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        tests.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    count = lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", let(count(c) / n, lambda p: -p * F.log2(p))).otherwise(0.0))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Add the features that a URL has by itself, and its host's suffixes; needs ``url, host, path``."""
    url = F.coalesce("url", F.lit(""))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    number = lambda c: c.cast("double")
    count = lambda text, what: number(F.length(text) - F.length(F.replace(text, F.lit(what), F.lit(""))))
    digits = number(F.length(url) - F.length(F.translate(url, "0123456789", "")))
    return computed(
        urls,
        f_length=number(F.length(url)),
        f_host=number(F.length("host")),
        f_labels=count(F.col("host"), "."),
        f_depth=number(F.size(F.filter(F.split("path", "/"), lambda x: x != ""))),
        f_digits=digits / F.greatest(F.length(url), F.lit(1)),
        f_hyphens=count(url, "-"),
        f_entropy=_entropy(url),
        f_params=F.when(query != "", count(query, "&") + 1).otherwise(0.0),
        **{k: F.substring_index("host", ".", -n) for k, n in SUFFIXES.items()},
    )


def labelled_urls(urls: DataFrame) -> DataFrame:
    """The distinct labelled URLs, with a 0/1 ``label``."""
    return urls.where("verdict in ('allow', 'block') and url is not null").groupBy("url", "host", "path").agg(
        F.max((F.col("verdict") == "block").cast("double")).alias("label")
    )


def _with_rates(rows: DataFrame, stats: dict[str, DataFrame], overall: float, own: Column | None = None) -> DataFrame:
    """Add each suffix's smoothed block rate, and how often it was seen. ``own``: the row's label, left out of its rate."""
    for k, table_ in stats.items():
        rows = rows.join(table_, k, "left")
        seen = F.coalesce(f"{k}_n", F.lit(0.0)) - (0 if own is None else 1)
        hits = F.coalesce(f"{k}_block", F.lit(0.0)) - (0 if own is None else own)
        rows = rows.withColumn(f"f_{k}_rate", (hits + PRIOR * overall) / (seen + PRIOR)).withColumn(f"f_{k}_seen", F.log1p(seen))
    return rows


def suffix_counts(known: DataFrame) -> dict[str, DataFrame]:
    """How many of the distinct labelled URLs have each suffix, and how many of those are blocked."""
    out = {}
    for k, n in SUFFIXES.items():
        suffix = F.substring_index("host", ".", -n).alias(k)
        counted = settled(known.groupBy(suffix).agg(F.count("*").cast("double").alias(f"{k}_n"), F.sum("label").alias(f"{k}_block")))
        out[k] = F.broadcast(counted) if counted.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES else counted
    return out


def train(urls: DataFrame, rows: int = TRAIN_ROWS) -> tuple[PipelineModel, dict[str, DataFrame], float] | float:
    """Trees, suffix statistics and the overall block rate, from labelled ``url, host, path, verdict``.

    The rates and counts are of all distinct labelled URLs; the trees are fitted on at most ``rows`` of
    them, those of the smallest hashes. Only the rate, if the labels are all alike (0.0 without any).
    """
    ensure_checkpoint_dir(urls.sparkSession)  # the trees' own checkpoints go to the shared folder
    known = settled(labelled_urls(urls))
    overall = known.agg(F.avg("label").alias("rate")).first().rate or 0.0
    if overall in (0.0, 1.0):
        return overall
    stats = suffix_counts(known)
    sample = settled(lexical_features(known.orderBy(F.xxhash64("url"), "url").limit(rows)))
    ready = settled(_with_rates(sample, stats, overall, F.col("label")).select("label", *FEATURES))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="__pm_features")
    trees = GBTClassifier(featuresCol="__pm_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxMemoryInMB=64)
    return PipelineModel([assemble, trees.fit(assemble.transform(ready))]), stats, overall


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], rows: int = TRAIN_ROWS) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict, block_probability``; needs ``url``.

    The longest rule that fits decides. The URLs it decides are the labelled ones; trees on length,
    depth, digit ratio, entropy, parameter counts and suffix statistics (counted on all labelled URLs),
    fitted on at most ``rows`` of them, decide the others: ``block`` from a probability of one half on. If the labels are all
    alike, so are the trees' verdicts; without any label all are allowed. Null URLs and those without
    ``://`` have an empty host and path and are judged by the trees as an empty text or as they are.

    Everything is a DataFrame function; URLs are scored where they are read, without a
    shuffle unless there are more than BROADCAST_SUFFIXES suffixes.
    Repeated rows are judged alike. Columns of ``urls`` of these names are replaced; others stay.
    """
    out = ["host", "path", "rule", "verdict", "block_probability"]
    mine = {*out, *FEATURES, *SUFFIXES, *(f"{k}_{x}" for k in SUFFIXES for x in ("n", "block")), "f_tld_seen"}
    others = [c for c in urls.columns if c != "url" and c not in out]
    # Other columns go along in a struct, so that their names can't clash with the features'.
    given = urls.select("url", F.struct(*(F.col(f"`{c}`") for c in others)).alias("__pm_given") if others else F.lit(0).alias("__pm_given"))
    host, path = parts(F.col("url"))
    split = computed(given, host=host, path=path)
    ruled = computed(split, __pm_rule=fitting_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("*", F.col("__pm_rule.rule").alias("rule"), F.col("__pm_rule.verdict").alias("verdict")).drop("__pm_rule")
    model = train(ruled.select("url", "host", "path", "verdict"), rows)
    if isinstance(model, float):
        scored = ruled.withColumn("block_probability", F.lit(model))
    else:
        fitted, stats, overall = model
        scored = fitted.transform(_with_rates(lexical_features(ruled), stats, overall))
        scored = scored.withColumn("block_probability", vector_to_array("probability")[1])
    method = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    kept = scored.withColumn("verdict", F.coalesce("verdict", method)).drop(*(mine - set(out)))
    return kept.select(*(F.col("__pm_given").getField(c).alias(c) for c in others), "url", *out)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


QUERIES = {"op5_url_filter": op5_url_filter}
SQL: dict[str, str] = {}
