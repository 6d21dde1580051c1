"""Best-fit packing with a swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, spread, table
from pagemill.llm.vocab import ChunkEncoder
from pagemill.session import settled

LIMIT = 2048
#: Pieces that one task packs together, about: with so many, what the last bin of a shard leaves
#: open is a few hundredths of a percent.
SHARD = 16_384


class _Bins:
    """Bins under a capacity. Underfull ones are indexed by gap and by the lengths they hold."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity, self.lengths = capacity, lengths
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.with_gap: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.gaps = 0  # bit g is set if a bin has gap g
        #: gap -> length -> bins of that gap that hold a document of that length
        self.holding: dict[int, dict[int, set[int]]] = defaultdict(dict)
        self.sorted_lengths: dict[int, list[int]] = defaultdict(list)

    def _gap_in(self, b: int, gap: int) -> None:
        self.with_gap[gap].add(b)
        self.gaps |= 1 << gap

    def _gap_out(self, b: int, gap: int) -> None:
        self.with_gap[gap].discard(b)
        if not self.with_gap[gap]:
            self.gaps &= ~(1 << gap)

    def smallest_gap(self, least: int) -> int | None:
        fits = self.gaps >> least
        return least + (fits & -fits).bit_length() - 1 if fits else None

    def put(self, i: int, b: int | None) -> None:
        if b is None:
            b = len(self.items)
            self.items.append([])
            self.fill.append(0)
        else:
            self._gap_out(b, self.capacity - self.fill[b])
        self.items[b].append(i)
        self.fill[b] += int(self.lengths[i])
        self._gap_in(b, self.capacity - self.fill[b])

    def best_fit_decreasing(self) -> None:
        for i in np.argsort(-self.lengths, kind="stable"):
            gap = self.smallest_gap(int(self.lengths[i]))
            self.put(int(i), None if gap is None else next(iter(self.with_gap[gap])))

    def index(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        for n in {int(self.lengths[i]) for i in self.items[b]} if gap else ():
            if n not in self.holding[gap]:
                self.holding[gap][n] = set()
                insort(self.sorted_lengths[gap], n)
            self.holding[gap][n].add(b)

    def unindex(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        for n in {int(self.lengths[i]) for i in self.items[b]} if gap else ():
            self.holding[gap][n].discard(b)
            if not self.holding[gap][n]:
                del self.holding[gap][n]
                del self.sorted_lengths[gap][bisect_left(self.sorted_lengths[gap], n)]

    def partner(self, total: int, most: int) -> tuple[int, int] | None:
        """A bin with a gap of at most ``most`` and the length of a document in it, which gains most by
        taking ``total`` for it."""
        best = None
        for gap, held in self.sorted_lengths.items():
            k = bisect_left(held, total - gap) if gap <= most else len(held)
            if k < len(held) and held[k] < total and (best is None or total - held[k] > best[0]):
                best = total - held[k], min(self.holding[gap][held[k]]), held[k]
        return best and best[1:]

    def shift(self, source: int, docs: list[int], target: int, back: int | None) -> None:
        """Move ``docs`` from source to target, and a document of length ``back`` the other way."""
        for b in (source, target):
            self.unindex(b)
            self._gap_out(b, self.capacity - self.fill[b])
        returned = [] if back is None else [next(i for i in self.items[target] if self.lengths[i] == back)]
        for i, a, b in [*((i, source, target) for i in docs), *((i, target, source) for i in returned)]:
            self.items[a].remove(i)
            self.items[b].append(i)
            self.fill[a] -= int(self.lengths[i])
            self.fill[b] += int(self.lengths[i])
        for b in (source, target):
            if self.items[b]:
                self._gap_in(b, self.capacity - self.fill[b])
                self.index(b)

    def offers(self, b: int) -> list[tuple[int, list[int]]]:
        """One or two documents of a bin, one choice for each total, largest total first."""
        one: dict[int, list[int]] = {}
        for i in self.items[b]:
            one.setdefault(int(self.lengths[i]), []).append(i)
        found = {n: [held[0]] for n, held in one.items()}
        for n, held in one.items():
            for m, others in one.items():
                if m < n or m == n and len(held) > 1:
                    found.setdefault(n + m, [held[0], others[-1]])
        return sorted(found.items(), reverse=True)

    def local_search(self) -> None:
        """Shift documents out of the emptiest bins until no exchange raises the squared fill.

        The source is never fuller than the target, so each shift that fills the target further
        raises the sum of squared fills; the search ends as that sum is bounded. It stops early at
        the least number of bins the total allows. What no bin took from an emptier source isn't tried
        again until something moved.
        """
        least = -(-int(self.lengths.sum()) // self.capacity)
        alive = sum(map(bool, self.items))
        for b in range(len(self.items)):
            self.index(b)
        moved = True
        while moved and alive > least:
            moved, failed, level = False, set(), (0, set())
            for source in sorted((b for b in range(len(self.items)) if self.items[b]), key=lambda b: (self.fill[b], b)):
                if alive <= least:
                    break
                if self.fill[source] != level[0]:
                    failed |= level[1]
                    level = self.fill[source], set()
                while self.items[source]:
                    room = self.capacity - self.fill[source]
                    self.unindex(source)
                    self._gap_out(source, room)
                    found = None
                    for total, docs in self.offers(source) if room else ():
                        if total < self.capacity and total not in failed:
                            gap = self.smallest_gap(total)
                            found = (min(self.with_gap[gap]), None) if gap is not None and gap <= room else self.partner(total, room)
                            if found:
                                break
                            level[1].add(total)
                    self._gap_in(source, room)
                    self.index(source)
                    if not found:
                        break
                    self.shift(source, docs, *found)
                    moved = True
                    failed.clear()
                    level[1].clear()
                alive -= not self.items[source]


def pack_lengths(lengths: np.ndarray, capacity: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A bin number and an offset for each length; bins hold at most ``capacity``."""
    bins = _Bins(np.asarray(lengths, np.int64), capacity)
    bins.best_fit_decreasing()
    bins.local_search()
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, held in enumerate(x for x in bins.items if x):
        number[held] = b
        offset[held] = np.cumsum([0, *bins.lengths[held][:-1]])
    return number, offset


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """One row per piece of each row's text: ``doc_id, piece, start, length, ids_crc32``.

    A text becomes its token ids and then ``end_id``; null counts as empty. Only texts of more than
    ``limit`` ids are cut, each ``limit`` ids. Reads ``doc_id`` and ``text`` alone.
    """

    end = np.array([end_id], "<u4").tobytes()

    def cut(batch):
        encoded = ChunkEncoder.at(tokenizer).encode([t or "" for t in batch.column(1).to_pylist()])
        data = memoryview(end.join([*encoded, b""]))
        n = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        ends = np.cumsum(n + 1)
        pieces = -(-(n + 1) // limit)
        of = np.repeat(np.arange(len(n)), pieces)
        piece = spread(np.zeros(len(n), np.int64), pieces)
        start = piece * limit
        length = np.minimum(limit, n[of] + 1 - start)
        first = (ends - n - 1)[of] + start
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        return {"doc_id": batch.column(0).take(pa.array(of)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(pieces: DataFrame, about: int, capacity: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id, offset`` to rows with a ``length`` of 1 to ``capacity``.

    Rows are dealt evenly over shards of about ``shard`` rows (``about``: the rows expected), which
    are packed apart: only lengths and ids travel, and no shard depends on a key. Within a shard,
    best fit, longest first; then documents are moved, exchanged one for one or two for one
    between underfull bins while that raises the squared fill, so that the emptiest bins run out.
    """
    shards = max(1, round(about / shard))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        number, offset = pack_lengths(group["length"].to_numpy(), capacity)
        group["sequence_id"], group["offset"] = number * shards + group["_shard"], offset
        return group.drop(columns="_shard")

    schema = ", ".join(f"`{k}` {v}" for k, v in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInPandas(fit, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pack whole documents into sequences of at most ``limit`` ids, as few as it can.

    Null and empty texts are pieces of one id; repeated rows are packed once each; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = settled(token_pieces(docs, tokenizer, limit))
    # A full piece is a sequence where it is; only others are packed.
    full = pieces.where(F.col("length") == limit).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    open_ = pieces.where(F.col("length") < limit)
    return pack(open_, open_.count(), limit).union(full)


def op1_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fit_packing": op1_fit_packing}
SQL: dict[str, str] = {}
