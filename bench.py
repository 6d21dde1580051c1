"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pagemill.plans import registry
from pagemill.session import build_session

HEADLINE = [
    "link_prune",
    "category_link_output",
    "page_text",
    "strip_attributes",
    "strip_elements",
    "element_prefilter",
    "text_density",
    "element_score",
    "ecommerce_score",
    "remove_nested",
    "schema_extract",
    "sample_save",
    "whitespace_token_count",
    "chunk_for_model",
    "content_hash",
    "cosine_pairs",
    "product_insert",
    "next_k_to_crawl",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "pagemill-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # Class loading and the first code generation are not what is measured.
    queries["link_prune"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["text_density"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    rates = {f"{q}_pages_per_sec": round(n_pages / seconds[q], 1) for q in ("link_prune", "page_text", "text_density")}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
