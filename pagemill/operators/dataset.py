"""URL pool, labelled samples and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions.text import strip_ws
from pagemill.functions.urls import sample_domain
from pagemill.operators.cleaning import truncate


def named_links(links: DataFrame, domains: DataFrame) -> DataFrame:
    return links.join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain")), "domain_id")


def url_pool(links: DataFrame, domains: DataFrame, domain: str | None = None, limit: int | None = None) -> DataFrame:
    """Pool URLs by id, of one domain if given; no limit when it is 0 or None."""
    pool = named_links(links, domains)
    if domain:
        pool = pool.where(F.col("domain") == domain)
    pool = pool.select("id", "url", "domain")
    return pool.orderBy("id").limit(limit) if limit else pool


def domain_stats(links: DataFrame, domains: DataFrame) -> DataFrame:
    """URL count per domain; counted per id before the names are joined."""
    counts = links.groupBy("domain_id").agg(F.count("*").alias("n_urls"))
    return named_links(counts, domains).select("domain", "n_urls")


def pool_summary(links: DataFrame, domains: DataFrame) -> DataFrame:
    """Totals and the per-domain counts, largest first; ``domain`` is NULL on the totals row."""
    stats = domain_stats(links, domains)
    totals = stats.agg(F.coalesce(F.sum("n_urls"), F.lit(0)).alias("n_urls"), F.count("*").alias("n_domains"))
    rows = stats.select("domain", "n_urls", F.lit(1).cast("bigint").alias("n_domains"))
    return totals.select(F.lit(None).cast("string").alias("domain"), "n_urls", "n_domains").unionByName(rows).orderBy(
        F.desc("n_urls"), F.asc_nulls_first("domain")
    )


def unlabeled(urls: DataFrame, samples: DataFrame) -> DataFrame:
    return urls.join(samples.select("url"), "url", "left_anti")


def continue_counts(urls: DataFrame, samples: DataFrame) -> DataFrame:
    """How many URLs are removed as labelled and how many remain."""
    labelled = samples.select("url").distinct().withColumn("labelled", F.lit(True))
    marked = urls.join(labelled, "url", "left")
    return marked.agg(
        F.count_if("labelled").alias("removed"), F.count_if(F.col("labelled").isNull()).alias("remaining")
    )


def balanced_sample(links: DataFrame, domains: DataFrame, total: int) -> DataFrame:
    """``max(1, total // number of domains)`` URLs per domain by id, cut at ``total``; no refill.

    The first rows are found within 64 salts of each domain, then among those: a hot domain is never
    sorted by one task, whatever the quota is.
    """
    n_domains = links.select("domain_id").distinct().count()
    if not n_domains or total <= 0:
        return named_links(links, domains).select("domain", "id", "url").limit(0)
    quota = max(1, total // n_domains)
    parts = links.select("domain_id", "id", "url", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_salt"))
    ranked = lambda rows, *keys: rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("turn") <= quota)
    taken = ranked(ranked(parts, "domain_id", "_salt").drop("turn"), "domain_id")
    return named_links(taken, domains).select("domain", "id", "url").orderBy("domain", "id").limit(total)


def by_priority(*sources: DataFrame) -> DataFrame:
    """Rows (``url``) of the first source that has any."""
    tagged = [s.select("url").withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    best = union.agg(F.min("priority").alias("priority"))
    return union.join(F.broadcast(best), "priority").select("url", "priority")  # one row


def content_groups(rows: DataFrame, content: str = "text") -> DataFrame:
    return rows.groupBy(F.md5(content).alias("content_hash")).agg(F.count("*").alias("n_rows"))


def samples_per_domain(pages: DataFrame) -> DataFrame:
    return pages.groupBy(sample_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n_samples"))


def _hashed(batch: DataFrame) -> DataFrame:
    return batch.withColumns(
        {"content_hash": F.md5("html_content"), "domain": sample_domain(F.col("url"))}
    )


def save_samples(stored_hashes: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Accepted samples and their contents, one per content hash not stored yet.

    The first row of each hash is found from hashes and ids alone; the wide content is only
    joined back for the winners.
    """
    hashed = _hashed(batch)
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    fresh = first.join(stored_hashes.select("content_hash"), "content_hash", "left_anti").select(order)
    accepted = hashed.join(fresh, order, "left_semi")
    samples = accepted.select(order, "url", "is_plp", "ts", "domain", "content_hash")
    contents = accepted.select(
        "content_hash", F.inline(F.array(
            F.struct(F.lit("raw").alias("variant"), F.col("html_content").alias("html")),
            F.struct(F.lit("cleaned").alias("variant"), F.col("cleaned_html").alias("html")),
        )),
    ).where("html is not null and (variant = 'raw' or html <> '')")
    return samples, contents


def duplicate_samples(batch: DataFrame, order: str) -> DataFrame:
    """Rejected samples with the first sample of the content they repeat."""
    hashed = _hashed(batch).select(order, "url", "content_hash")
    groups = hashed.groupBy("content_hash").agg(
        F.min(F.struct(F.col(order).alias("first_id"), F.col("url").alias("first_url"))).alias("f"), F.count("*").alias("_n")
    )
    repeated = groups.where("_n > 1")
    firsts = repeated.select("content_hash", "f.first_id", "f.first_url")
    return hashed.join(firsts, "content_hash").where(F.col(order) != F.col("first_id"))


def content_lookup(hashes: DataFrame, contents: DataFrame) -> DataFrame:
    """Cleaned html of each hash, else raw, else empty."""
    best = contents.groupBy("content_hash").agg(
        F.coalesce(
            F.max(F.when(F.col("variant") == "cleaned", F.col("html"))),
            F.max(F.when(F.col("variant") == "raw", F.col("html"))),
        ).alias("html")
    )
    return hashes.join(best, "content_hash", "left").withColumn("html", F.coalesce("html", F.lit("")))


def dataset_stats(samples: DataFrame) -> DataFrame:
    positives = F.count_if(F.col("is_plp") == 1)
    return samples.agg(
        F.count("*").alias("total_samples"),
        positives.alias("plp_samples"),
        F.count_if(F.col("is_plp") == 0).alias("non_plp_samples"),
        (positives / F.greatest(F.count("*"), F.lit(1))).alias("balance_ratio"),
    )


def dataset_domain_stats(samples: DataFrame) -> DataFrame:
    """Samples per domain and label, with subtotals and the grand total."""
    rolled = samples.rollup("domain", "is_plp").agg(F.count("*").alias("n_samples"))
    return rolled.orderBy(F.desc("n_samples"), "domain", "is_plp")


def dataset_frame(samples: DataFrame) -> DataFrame:
    return samples.select(
        "url", F.col("is_plp").alias("label"), "domain", F.col("ts").alias("timestamp"),
        F.length(F.coalesce("cleaned_html", "html_content", F.lit(""))).alias("html_length"),
    )


def training_records(samples: DataFrame) -> DataFrame:
    html = F.coalesce("cleaned_html", "html_content", F.lit(""))
    return samples.select("url", html.alias("html_content"), F.col("is_plp").alias("label"), "domain", F.col("ts").alias("timestamp"))


def plp_prompt(html: Column, question: str = P.LISTING_QUESTION, limit: int | None = P.MODEL_MAX_CHARS) -> Column:
    """The question and the first ``limit`` characters of the page (None: all of it)."""
    return F.concat(F.lit(question), truncate(html, limit), F.lit("\n"))


def plp_verdict(response: Column, error: Column) -> Column:
    """True when the answer says so; an error or no answer is False."""
    says = F.contains(F.lower(strip_ws(response)), F.lit("true"))
    return F.when(error.isNotNull(), False).otherwise(F.coalesce(says, F.lit(False)))


def model_page_grid(pages: DataFrame, models: list[str]) -> DataFrame:
    """Every model with every page, as narrow rows; the model list is a literal."""
    names = F.array(*[F.lit(m) for m in models])
    return pages.select("page_id", "url", F.explode(names).alias("model"))


def verdicts_by_model(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("model").agg(F.count("*").alias("n_pages"), F.count_if("is_plp").alias("n_positive"))


def filter_accuracy(samples: DataFrame, fragment_counts: DataFrame, key: str) -> DataFrame:
    """Confusion counts and accuracy of 'has any fragment' as a prediction of the label."""
    found = fragment_counts.where("n_fragments > 0").select(key).distinct().withColumn("predicted", F.lit(1))
    scored = samples.join(found, key, "left").select("is_plp", F.coalesce("predicted", F.lit(0)).alias("predicted"))
    hit = lambda p, a: F.count_if((F.col("predicted") == p) & (F.col("is_plp") == a))
    return scored.agg(
        F.count("*").alias("total"),
        hit(1, 1).alias("true_positive"),
        hit(1, 0).alias("false_positive"),
        hit(0, 1).alias("false_negative"),
        hit(0, 0).alias("true_negative"),
        F.avg(F.when(F.col("predicted") == F.col("is_plp"), 1.0).otherwise(0.0)).alias("accuracy"),
    )


def fragment_counts(fragments: DataFrame, show: int = 3) -> DataFrame:
    """Per page: number of fragments, their total length, and the first few (``rank`` orders them)."""
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= show, F.struct("rank", "fragment"))))
    return fragments.groupBy("page_id").agg(
        F.count("*").alias("n_fragments"),
        F.sum(F.length("fragment")).alias("total_chars"),
        F.transform(first, lambda r: r["fragment"]).alias("first_fragments"),
    )


def visited_union(new: DataFrame, cached: DataFrame) -> DataFrame:
    return new.select("url").union(cached.select("url")).distinct()


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    return links.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def append_products(*runs: DataFrame) -> DataFrame:
    """Bag union of extraction results; a column one run lacks is NULL there."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
