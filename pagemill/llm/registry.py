"""The queries of the training-data operators and, where one exists, their plain-SQL counterpart."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "fit_packing",
    "line_dedup",
    "token_matrix",
    "cross_parsing",
    "quality",
    "block_topk",
    "warc",
    "url_filter",
    "merge_dropout",
    "prob_minhash",
    "pivotal_grams",
    "disclosure",
    "reversed_search",
]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in import_module(f"pagemill.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"pagemill.llm.{m}").SQL.items()}
