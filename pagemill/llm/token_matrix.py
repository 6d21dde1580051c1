"""Token-id output: documents packed into id matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.llm.common import table
from pagemill.llm.vocab import ChunkEncoder

LENGTH = 2048
#: Remainders that a task packs together. Each holds under LENGTH ids, so a group stays under 64 MB.
GROUP = 8_192
SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, "
    "doc_ids array<bigint>, starts array<bigint>"
)


class CapacityTree:
    """A segment tree over room left, 0 to ``capacity``: how many bins have how much."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a bin of the smallest room that is at least ``least``; None if there is none."""
        at = self.size + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until there is something to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:  # down, to its leftmost leaf
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Indexes of ``lengths`` (1 to ``capacity`` each) by bin: longest first, into the tightest bin."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room, b = tree.take(lengths[i]) or (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        tree.add(room - lengths[i], b)
    return bins


def _row(parts: list[tuple[int, int, np.ndarray]], number: int, length: int, pad: int, kind: str) -> tuple:
    ids = np.full(length, pad, kind)
    places = np.zeros(length, kind)
    ends = np.cumsum([len(own) for _, _, own in parts])
    for end, (_, _, own) in zip(ends, parts, strict=True):
        ids[end - len(own) : end] = own
        places[end - len(own) : end] = np.arange(len(own))
    return number, int(ends[-1]), ids.tobytes(), places.tobytes(), [0, *ends.tolist()], [p[0] for p in parts], [p[1] for p in parts]


def packed_matrices(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, end_id: int = 50256, pad: int = 50256
) -> DataFrame:
    """Every document's token ids, packed into rows of ``length`` ids.

    A text becomes its ids and ``end_id``; null counts as empty. Longer ones are cut every ``length``
    ids, so the pieces of a document, in order of ``starts``, give its ids back. Full pieces are rows
    at once; remainders are packed within the task that made them, ``group`` at a time, longest
    first, each into the bin with the least room that takes it (a segment tree over room left).
    Nothing is shuffled, and each group leaves less than one row open.

    ``ids`` and ``position_ids`` are little-endian unsigned integers (16 bits if every id fits, else
    32), ``length`` of each: the rows' bytes in order are the id matrix. Positions start at 0 again
    with every segment; ``cu_seqlens`` holds 0 and the segments' ends. The rest is padding with
    ``pad`` and position 0. Repeated rows are packed once each; an empty table gives no rows; other
    columns are ignored. A null ``doc_id`` stays null in ``doc_ids``.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = ChunkEncoder.at(path)
        wide = "<u4" if max(encoder.tokenizer.get_vocab_size(), end_id + 1, pad + 1) > 1 << 16 else "<u2"
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []
        open_parts: list[tuple[int, int, np.ndarray]] = []

        def emit(parts):
            nonlocal number
            rows.append(_row(parts, number, length, pad, wide))
            number += 1

        def flush():
            for held in best_fit_decreasing([len(p[2]) for p in open_parts], length):
                emit([open_parts[i] for i in held])
            open_parts.clear()

        def made(least=1):
            while len(rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[:500], strict=True), kind, strict=True)], schema=kind)
                del rows[:500]

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                for doc_id, raw in zip(doc_ids[at : at + 200], encoder.encode([t or "" for t in texts[at : at + 200]]), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u4"), end_id).astype(wide)
                    whole = len(ids) - len(ids) % length
                    for start in range(0, whole, length):
                        emit([(doc_id, start, ids[start : start + length])])
                    if whole < len(ids):
                        open_parts.append((doc_id, whole, ids[whole:]))
                        if len(open_parts) == group:
                            flush()
                yield from made(500)
        flush()
        yield from made()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op10_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_matrix": op10_token_matrix}
SQL: dict[str, str] = {}
