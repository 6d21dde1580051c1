"""Pages as element tables.

An element is an interval of token positions inside its page, so nesting questions become
comparisons of intervals. A page is taken apart where it is read, once: no page text is shuffled,
and depth, sizes, flags, text and markup of its elements come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.functions.page import Page
from pagemill.session import shuffled

BIN = 64  # token positions per bin of the interval join
ROWS = 2_000  # element rows per Arrow batch
CHARS = 4 << 20  # characters of text and markup per Arrow batch, and those of one row
_FIELDS = {
    "node_id": "int", "tag": "string", "src": "string", "start_pos": "int", "end_pos": "int", "parent_pos": "int", "closed": "boolean",
    "depth": "int", "off": "bigint", "outer_len": "bigint", "inner_bytes": "bigint", "start_line": "bigint",
    "line_count": "bigint", "text_len": "bigint", "n_words": "bigint", "n_images": "bigint", "n_actions": "bigint",
    "text": "string", "fragment": "string",
}


def each_row(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The values of each row of a batch, made when it's their turn."""
    return (tuple(v.as_py() for v in row) for row in zip(*batch.columns, strict=True))


def elements(pages: DataFrame, text: bool | tuple[int, int] = False, fragment: bool = False) -> DataFrame:
    """One row per element of ``pages`` (``page_id, html``), with its interval and sizes.

    ``parent_pos`` is the ``start_pos`` of the innermost element around it, ``depth`` how many there are.
    ``off``/``outer_len`` locate the element in the page. ``text`` and ``fragment`` add its text and
    its markup; with bounds (``low, high``) as ``text``, only elements of a ``text_len`` between them have theirs, others null.
    Closing rules: see :meth:`pagemill.functions.page.Page.spans`. A page without a body
    tag gets an element ``body`` around all of it, with ``node_id`` -1. Null and empty pages have no
    elements.

    Rows leave in batches of a bounded size, and text is cut when its row is made. So a task holds a page and a
    batch, however deep elements are nested; still, text or markup of *all* nested elements is much to
    write. Choose elements first and cut theirs by :func:`with_markup` where that does.
    """
    names = [n for n in _FIELDS if n not in ("text", "fragment") or (text if n == "text" else fragment)]
    key = pages.schema["page_id"].dataType.simpleString()
    schema = ", ".join([f"page_id {key}", *(f"{n} {_FIELDS[n]}" for n in names)])
    keep = [list(_FIELDS).index(n) for n in names]
    order = [to_arrow_schema(pages.select("page_id").schema).field(0).type, *(_ARROW[_FIELDS[n]] for n in names)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        picked = [columns[0], *(columns[1 + k] for k in keep)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(picked, order, strict=True)], ["page_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for page_id, html in each_row(batch):
                for row in Page(html).rows(text, fragment):
                    rows.append((page_id, *row))
                    chars += len(row[-1] or "") + len(row[-2] or "")
                    if len(rows) >= ROWS or chars >= CHARS:
                        yield batch_of(rows)
                        rows, chars = [], 0
            if rows:
                yield batch_of(rows)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little

    return pages.select("page_id", "html").mapInArrow(run, schema)


def with_markup(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """``chosen`` elements (``page_id, off, outer_len`` and others) with their markup as ``fragment``.

    The chosen ones of a page meet one copy of it (``page_id, html``) and are cut out of it there; pages are shuffled,
    never broadcast.
    """
    kept = [c for c in chosen.columns if c not in ("page_id", "fragment")]
    grouped = chosen.groupBy("page_id").agg(F.collect_list(F.struct(*kept)).alias("chosen"))
    fields = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"page_id {chosen.schema['page_id'].dataType.simpleString()}, {fields}, fragment string"
    kinds = to_arrow_schema(chosen.select("page_id", *kept).schema).append(pa.field("fragment", pa.string()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for page_id, html, own in each_row(batch):
                for e in own:
                    rows.append((page_id, *(e[c] for c in kept), html[e["off"] : e["off"] + e["outer_len"]]))
                    chars += e["outer_len"]
                    if len(rows) >= ROWS or chars >= CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        pa.default_memory_pool().release_unused()

    return pages.select("page_id", "html").join(shuffled(grouped), "page_id").select("page_id", "html", "chosen").mapInArrow(cut, schema)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def rewritten(pages: DataFrame, fn: Callable[[Page], str]) -> DataFrame:
    """``page_id, html`` with each page's html put through ``fn``; null counts as empty.

    New pages leave as soon as they are ``CHARS`` characters together: a task holds these and its batch.
    """
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, chars, first = [], 0, 0
            for i, (_, html) in enumerate(each_row(batch), 1):
                new.append(fn(Page(html)))
                chars += len(new[-1])
                if chars >= CHARS or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(new)), pa.array(new, pa.string())], ["page_id", "html"])
                    new, chars, first = [], 0, i
        pa.default_memory_pool().release_unused()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {key}, html string")


def containing(inner: DataFrame, outer: DataFrame, strict: bool = True, bin_size: int = BIN) -> DataFrame:
    """Each inner interval with every outer interval of its page that contains it.

    Both sides need ``page_id, start_pos, end_pos``; other columns must not clash. The outer
    intervals are repeated once per bin of token positions they cross and the inner ones are
    placed by their start, so only neighbours in a page are compared.
    """
    o = outer.withColumnsRenamed({"page_id": "o_page", "start_pos": "o_start", "end_pos": "o_end"}).withColumn(
        "o_bin",
        F.explode(
            F.sequence(F.floor(F.col("o_start") / bin_size), F.floor(F.col("o_end") / bin_size))
        ),
    )
    i = inner.withColumn("i_bin", F.floor(F.col("start_pos") / bin_size))
    inside = (F.col("o_start") <= F.col("start_pos")) & (F.col("end_pos") <= F.col("o_end"))
    if strict:
        inside = inside & (F.col("o_start") < F.col("start_pos"))
    return i.join(shuffled(o), (F.col("page_id") == F.col("o_page")) & (F.col("i_bin") == F.col("o_bin")) & inside).drop(
        "o_page", "o_bin", "i_bin"
    )
