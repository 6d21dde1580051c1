"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import chain, compress, repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import Ragged, held, map_batches, scramble, spread, table

#: Share of candidate merges that are skipped.
DROPOUT = 0.1
#: Words a worker remembers (about 450 bytes each); beyond it, it keeps up to half
#: as many, those that came again (only speed changes).
REMEMBERED = 150_000
#: Words of more characters go through the agenda one by one and aren't remembered, others many at a time.
TOGETHER = 48
#: Occurrences get their draws at a time as long as they have this many places together.
DRAWN = 600_000
#: Equal words of up to this many places whose draws skip the same ones are taken apart once.
ALIKE = 40
#: New words that are taken apart at a time.
TAKEN_APART = 10_000

_SPACE = "▁"
_UNITS = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")


class Pieces:
    """A BPE model's pieces: which two make a third, and how good that one is."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        plain = [i for i in range(size) if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        number = {names[i]: i for i in plain}
        if any(re.search(f"[^{_SPACE}]{_SPACE}|.\n|\n.", p) for p in number):
            raise ValueError("a piece goes on over a space or a line end: words can't be taken apart there")
        self.score = np.array([model.get_score(i) for i in range(size)])
        self.of_byte = {int(names[i][3:5], 16): i for i in range(size) if byte[i]}
        if len(self.of_byte) < 256:
            raise ValueError("the model lacks byte pieces: not every text could be encoded")
        #: What each id stands for.
        self.text = [bytes([int(names[i][3:5], 16)]) if byte[i] else b"" for i in range(size)]
        for p, i in number.items():
            self.text[i] = p.replace(_SPACE, " ").encode()
        self.leads = np.zeros(size, bool)
        self.leads[[i for p, i in number.items() if p[0] == _SPACE]] = True
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = {
            number[p[:k]] << 32 | number[p[k:]]: i
            for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        }
        self.pairs = pairs
        #: The pieces that merges can make, by length, and how long the left part is in each way to make them.
        splits = {i: [] for i in sorted(plain, key=lambda i: len(names[i]))}
        for i, ways in splits.items():
            p = names[i]
            for k in range(1, len(p)):
                parts = number.get(p[:k]), number.get(p[k:])
                if all(x is not None and (len(names[x]) == 1 or splits[x]) for x in parts):
                    ways.append(k)
        self.splits = Ragged([len(splits.get(i, ())) for i in range(size)], left=np.array([k for i in range(size) for k in splits.get(i, ())], np.uint8))
        self.length = np.array([len(names[i]) for i in range(size)], np.uint8)
        #: Their characters as a tree: a single character's node is its id, ``ends`` tells the piece that ends at a node.
        edges, ends = {}, {}
        for i in (i for i, ways in splits.items() if ways):
            chars = [number[c] for c in names[i]]
            node = chars[0]
            for c in chars[1:]:
                node = edges.setdefault(node << 32 | c, size + len(edges))
            ends[node] = i
        self.ends = np.full(size + len(edges), -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        #: The edges by the slot of their hash, how many one slot has at most, and where a slot's begin. Most slots are
        #: empty (-1).
        edge = np.array(list(edges), np.int64)
        slot = self._slot(edge)
        order = np.argsort(slot, kind="stable")
        self.edge, self.node = edge[order], np.array(list(edges.values()), np.int32)[order]
        used, begin, count = np.unique(slot[order], return_index=True, return_counts=True)
        self.beside = int(count.max(initial=1))
        self.slots = np.full(1 << 21, -1, np.int32)
        self.slots[used] = begin
        #: A piece's rank by score (equal scores have one rank).
        self.rank = np.unique(-self.score, return_inverse=True)[1]
        self.forget()

    def forget(self) -> None:
        #: Remembered words by number. Of each: its characters' ids, undropped ids, and all places where two of its
        #: pieces make a third, in the agenda's order.
        self.known: dict[str, int] = {"\0" + _SPACE: 0}
        #: In how many calls of ``encode_texts`` a word came.
        self.came = np.zeros(1, np.int32)
        none = lambda kind: np.zeros(0, kind)
        self.chars = Ragged([0], id=none(np.int32))
        space = self.bytes_of(_SPACE)
        self.forms = Ragged([len(space)], id=np.array(space, np.uint16))
        #: ``where`` are the three borders of a merge, a byte each.
        self.places = Ragged([0], where=none(np.uint32), made=none(np.uint16))
        #: The places whose merges are made without dropout. An occurrence that skips none of them is undropped: of what
        #: is left on the agenda, the same one is best at every step. ``key`` is what a place adds to an occurrence's hash.
        self.way = Ragged([0], key=none(np.uint64))

    def forget_rare(self) -> None:
        """Keep the words that came again, ``REMEMBERED // 2`` at most; the most frequent ones, if they are more."""
        again = 1 + np.flatnonzero(self.came[1:] > 1)
        again = np.sort(again[np.argsort(-self.came[again], kind="stable")][: REMEMBERED // 2])
        which = np.concatenate([[0], again])
        words = list(self.known)  # in order of their numbers
        self.known = {words[i]: k for k, i in enumerate(which.tolist())}
        self.came = self.came[which] // 2
        self.chars, self.forms, self.places, self.way = (x.taken(which) for x in (self.chars, self.forms, self.places, self.way))

    @classmethod
    def at(cls, path: str) -> Pieces:
        """The one that a worker process holds."""
        return held(("pieces", path), lambda: cls(path))

    @staticmethod
    def _slot(edge: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (edge.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, or -1."""
        key = node.astype(np.int64) << 32 | char
        out = np.full(len(key), -1, np.int32)
        at = self.slots[self._slot(key)]
        which = np.flatnonzero(at >= 0)
        at = at[which]
        for _ in range(self.beside):
            same = self.edge[at] == key[which]
            out[which[same]] = self.node[at[same]]
            which, at = which[~same], np.minimum(at[~same] + 1, len(self.edge) - 1)
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.of_byte[b] for b in char.encode()]


def _keys(words: list[str], seed: int) -> np.ndarray:
    """The hash of each word under a seed."""
    plain = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return scramble(plain + np.uint64(seed & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xD1B54A32D192ED03))


def _place(start, middle, end) -> np.ndarray:
    """The merge of start..middle with middle..end, as a number."""
    return np.asarray(start, np.uint64) + (np.asarray(middle, np.uint64) << np.uint64(20)) + (np.asarray(end, np.uint64) << np.uint64(40))


def _borders(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return where & np.uint32(255), where >> np.uint32(8) & np.uint32(255), where >> np.uint32(16)


def _key(place: np.ndarray) -> np.ndarray:
    """What a place adds to an occurrence's hash."""
    with np.errstate(over="ignore"):
        return place * np.uint64(0x9E3779B97F4A7C15)


def _skipped(base, key, dropout: float) -> np.ndarray:
    """Whether the keyed hash skips the merge at the place of this key."""
    with np.errstate(over="ignore"):
        h = scramble(np.asarray(base, np.uint64) + key)
    return (h >> np.uint64(11)) < np.uint64(ceil(dropout * 2.0**53))


def agenda(pieces: Pieces, word: str, base: int, dropout: float) -> list[int]:
    """The ids of a word: candidate merges leave a heap, best score first, leftmost among equals.

    One that the keyed hash of its place skips is dropped for good. Characters that are no piece
    stay apart and become their bytes.
    """
    n = len(word)
    ids = pieces.of_char[[ord(c) for c in word]].tolist()
    end, previous, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
    alive = [True] * n

    def candidate(a: int) -> tuple | None:
        b = end[a]
        if b < n and ids[a] >= 0 and ids[b] >= 0:
            made = pieces.pairs.get(ids[a] << 32 | ids[b])
            if made is not None and not _skipped(base, _key(_place(a, b, end[b])), dropout):
                return -pieces.score[made], a, b, end[b], made
        return None

    heap = [c for c in map(candidate, range(n)) if c]
    heapify(heap)
    while heap:
        _, a, b, stop, made = heappop(heap)
        if not (alive[a] and b < n and alive[b] and end[a] == b and end[b] == stop):
            continue
        ids[a], end[a], alive[b] = made, stop, False
        if stop < n:
            previous[stop] = a
        for c in (candidate(a), candidate(previous[a]) if previous[a] >= 0 else None):
            if c:
                heappush(heap, c)
    out, at = [], 0
    while at < n:
        out += [ids[at]] if ids[at] >= 0 else pieces.bytes_of(word[at])
        at = end[at]
    return out


def _all_places(pieces: Pieces, ids: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word, start, middle, end, made`` of all places where two pieces make a third, in the agenda's order.

    ``ids`` are words' characters with a -1 after each word, ``word`` and ``first`` tell where a character
    belongs. The pieces that begin at a character are found by following the tree, for all words at once.
    """
    at = np.flatnonzero(ids >= 0)
    node, size, found = ids[at], 1, []
    while len(at):
        found.append((at, pieces.ends[node]))
        node = pieces.step(node, ids[at + size])
        on = np.flatnonzero(node >= 0)
        at, node, size = at[on], node[on], size + 1
    if not found:
        return (np.zeros(0, np.int64),) * 5
    at, made = (np.concatenate(x) for x in zip(*found, strict=True))
    ends = np.flatnonzero(made >= 0)
    at, made = at[ends], made[ends]
    ways = pieces.splits.sizes[made]
    left = pieces.splits["left"][spread(pieces.splits.starts[made], ways)]
    at, made = np.repeat(at, ways), np.repeat(made, ways)
    own, start, size = word[at], at - first[at], pieces.length[made]
    # Words are of fewer than 64 characters, ranks below 2**16.
    order = np.argsort(own << 34 | pieces.rank[made] << 18 | start << 12 | size.astype(np.int64) << 6 | left)
    own, start, left, size, made = (x[order] for x in (own, start, left, size, made))
    return own, start, start + left, start + size, made


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ONE_OF = 2.0 ** np.arange(ALIKE + 1)


def _remember(pieces: Pieces, words: list[str]) -> None:
    """Remember new words of up to ``TOGETHER`` characters: their places, and their ids without dropout."""
    if not words:
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    ids = pieces.of_char[codes]
    ids = np.where(ids < 0, -2 - codes, ids).astype(np.int32)  # an unknown character stands for itself, below 0
    ends, found = np.concatenate([[0], np.cumsum(sizes)]), []
    for at in range(0, len(words), TAKEN_APART):
        part = sizes[at : at + TAKEN_APART]
        begin = np.cumsum(part + 1) - part - 1
        spaced = np.full(int(part.sum()) + len(part), -1, np.int32)
        spaced[spread(begin, part)] = np.maximum(ids[ends[at] : ends[at + len(part)]], -1)
        word, *rest = _all_places(pieces, spaced, np.repeat(np.arange(len(part)), part + 1), np.repeat(begin, part + 1))
        found.append((np.bincount(word, minlength=len(part)), *rest))
    counts, start, middle, end, made = (np.concatenate(x) for x in zip(*found, strict=True))
    number = len(pieces.known) + np.arange(len(words))
    pieces.known.update(zip(words, number.tolist(), strict=True))
    pieces.came = np.concatenate([pieces.came, np.zeros(len(words), np.int32)])
    pieces.chars.extend(sizes, id=ids)
    where = (start | middle << 8 | end << 16).astype(np.uint32)
    pieces.places.extend(counts, where=where, made=made)
    begin, way = pieces.places.starts[number[0]], np.zeros(len(where), bool)
    flat, n = _segmented(pieces, number, None, lambda place: way.__setitem__(place - begin, True))
    pieces.forms.extend(n, id=flat)
    pieces.way.extend(np.bincount(np.repeat(number - number[0], counts)[way], minlength=len(number)), key=_key(_place(*_borders(where[way]))))


def _segmented(pieces: Pieces, number: np.ndarray, skipped: np.ndarray | None, tell=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers, of occurrences of remembered words. ``skipped`` tells for each place of each of them, one
    after another, whether the merge there is skipped; ``tell`` is called with the places whose merges are made."""
    sizes = pieces.places.sizes[number]
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    ordered, n, found, at = sizes[order], np.zeros(len(number), np.int64), [], 0
    while at < len(order):
        limit = max(4, -(-int(ordered[at]) // 4) * 4)  # words of about as many places at a time
        stop = min(at + 4_000, int(np.searchsorted(ordered, limit, "right")))
        which = order[at:stop]
        ids, n[which] = _rounds(pieces, number[which], sizes[which], skipped, first[which], tell)
        found.append(ids)
        at = stop
    if not found:
        return np.zeros(0, np.uint16), n
    starts = np.zeros(len(number), np.int64)
    starts[order] = np.cumsum(n[order]) - n[order]
    return np.concatenate(found)[spread(starts, n)], n


def _rounds(pieces: Pieces, number: np.ndarray, sizes: np.ndarray, skipped: np.ndarray | None, first: np.ndarray, tell) -> tuple[np.ndarray, np.ndarray]:
    """The agenda for many occurrences at once.

    What is left of a word's borders between characters is a bit set: a merge is possible while its three
    borders are there and none between them, and takes the middle one away. Each round, every
    occurrence makes its first possible merge in the agenda's order.
    """
    lengths, most = pieces.chars.sizes[number], int(sizes.max())
    column = np.arange(int(lengths.max()))
    inside = column < lengths[:, None]
    ids = np.zeros(inside.shape, np.int32)
    ids[inside] = pieces.chars["id"][spread(pieces.chars.starts[number], lengths)]
    kind = np.uint32 if len(column) < 32 else np.uint64
    state = (_BIT[lengths] - np.uint64(1) | _BIT[lengths]).astype(kind)
    if most:
        slot, base = np.arange(most), pieces.places.starts[number]
        held = slot < sizes[:, None]
        at = np.where(held, base[:, None] + slot, 0)
        if skipped is not None:
            held &= ~skipped[np.where(held, first[:, None] + slot, 0)]
        # The three borders of each merge as bits, and all bits from the first to the last of them.
        bit = _BIT.astype(kind)
        low, middle, high = (bit[x] for x in _borders(pieces.places["where"][at]))
        need, reach = low | middle | high, high - low | high
        reach[~held], need[~held] = 0, 1  # never equal
        row, now, k = np.arange(len(number)), state, np.arange(len(number))
        while True:
            free = (now[:, None] & reach) == need
            pick = free.argmax(axis=1)
            going = np.flatnonzero(free[k, pick])
            if not len(going):
                break
            place = (base + pick)[going]
            if tell:
                tell(place)
            start, middle, _ = _borders(pieces.places["where"][place])
            now[going] ^= bit[middle]
            ids[row[going], start] = pieces.places["made"][place]
            if len(going) < 0.7 * len(row):
                state[row] = now
                row, now, base, need, reach = row[going], now[going], base[going], need[going], reach[going]
                k = k[: len(row)]
        state[row] = now
    left = inside & (state[:, None] >> column.astype(kind) & kind(1)).astype(bool)
    flat, n = ids[left], left.sum(axis=1)
    if (flat < 0).any():
        # Unknown characters become their bytes.
        unknown, back = np.unique(flat, return_inverse=True)
        known = [[x] if x >= 0 else pieces.bytes_of(chr(-2 - x)) for x in unknown.tolist()]
        every, each = np.array([i for x in known for i in x]), np.array([len(x) for x in known])
        flat = every[spread((np.cumsum(each) - each)[back], each[back])]
        n = np.bincount(np.repeat(np.arange(len(n)), n), each[back], len(n)).astype(np.int64)
    return flat.astype(np.uint16), n


def _draws(pieces: Pieces, number: np.ndarray, bases: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the draws of each occurrence skip each place of its word, one occurrence after another."""
    sizes = pieces.places.sizes[number]
    where = pieces.places["where"][spread(pieces.places.starts[number], sizes)]
    return _skipped(np.repeat(bases, sizes), _key(_place(*_borders(where))), dropout)


def _alike(pieces: Pieces, number: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each word and skipped places, and which of those every occurrence is like."""
    sizes = pieces.places.sizes[number]
    first = np.cumsum(sizes) - sizes
    code = -1 - np.arange(len(number))  # like no other
    few = np.flatnonzero((sizes <= ALIKE) & (number < 1 << 63 - ALIKE))
    hit = np.flatnonzero(skipped)
    own = np.searchsorted(first, hit, "right") - 1
    bits = np.bincount(own, _ONE_OF[np.minimum(hit - first[own], ALIKE)], len(number))  # below 2**53: exact
    code[few] = number[few] << ALIKE | bits[few].astype(np.int64)
    like = np.unique(code, return_inverse=True)[1]
    one = np.zeros(like.max(initial=-1) + 1, np.int64)
    one[like] = np.arange(len(like))
    return one, like


def together(pieces: Pieces, words: list[str], bases: np.ndarray, dropout: float) -> list[bytes]:
    """``agenda`` for many words of up to ``TOGETHER`` characters, as bytes of ids."""
    _remember(pieces, sorted(set(words).difference(pieces.known)))
    number = np.array([pieces.known[w] for w in words], np.int64)
    flat, sizes = _segmented(pieces, number, _draws(pieces, number, bases, dropout))
    ends = np.cumsum(sizes).tolist()
    return [flat[a:b].tobytes() for a, b in zip([0, *ends], ends)]


def units_of(text: str) -> list[str]:
    """The parts of a text that no piece crosses. A "▁" of the text itself is a part of its own, marked by a leading NUL."""
    if not text:
        return []
    out: list[str] = []
    for k, part in enumerate(text.split(_SPACE)):
        if k:
            out.append("\0" + _SPACE)
        out += _UNITS.findall((_SPACE if not k else "") + part.replace(" ", _SPACE))
    return out


def encode_texts(pieces: Pieces, keys: list, texts: list[str | None], seed: int, dropout: float) -> list[bytes]:
    """Ids (unsigned 16 bit) of each text; ``keys`` tell texts apart, so that each occurrence has draws of its own."""
    if len(pieces.known) > REMEMBERED:
        pieces.forget_rare()
    split = [units_of(t or "") for t in texts]
    sizes = np.array([len(u) for u in split], np.int64)
    units = list(chain.from_iterable(split))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        places = np.repeat(_keys([str(k) for k in keys], seed), sizes) + (np.arange(len(units)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bases = scramble(places)
    number = np.fromiter(map(pieces.known.get, units, repeat(-1)), np.int64, len(units))
    new = np.flatnonzero(number < 0)
    unknown = list(compress(units, number < 0))
    _remember(pieces, [w for w in set(unknown) if len(w) <= TOGETHER])
    number[new] = np.fromiter(map(pieces.known.get, unknown, repeat(-1)), np.int64, len(unknown))
    pieces.came += np.bincount(number + 1, minlength=len(pieces.came) + 1)[1:] > 0
    starts, n = np.where(number >= 0, pieces.forms.starts[number], 0), np.where(number >= 0, pieces.forms.sizes[number], 0)
    pool, used = [pieces.forms["id"]], len(pieces.forms["id"])

    def put(which: np.ndarray, flat: np.ndarray, own: np.ndarray, like: np.ndarray) -> None:
        nonlocal used
        starts[which], n[which] = (used + np.cumsum(own) - own)[like], own[like]
        pool.append(flat)
        used += len(flat)

    drawn = np.flatnonzero(number >= 0) if dropout > 0 else np.zeros(0, np.int64)
    drawn = drawn[pieces.way.sizes[number[drawn]] > 0]
    part = np.cumsum(pieces.places.sizes[number[drawn]]) // DRAWN
    for held in np.split(drawn, np.flatnonzero(np.diff(part)) + 1):
        if len(held):
            own = pieces.way.sizes[number[held]]
            skipped = _skipped(np.repeat(bases[held], own), pieces.way["key"][spread(pieces.way.starts[number[held]], own)], dropout)
            held = held[np.logical_or.reduceat(skipped, np.cumsum(own) - own)]
            skipped = _draws(pieces, number[held], bases[held], dropout)
            one, like = _alike(pieces, number[held], skipped)
            own = pieces.places.sizes[number[held]]
            put(held, *_segmented(pieces, number[held[one]], skipped[spread((np.cumsum(own) - own)[one], own[one])]), like)
    for i in np.flatnonzero(number < 0).tolist():
        ids = np.array(agenda(pieces, units[i], int(bases[i]), dropout), np.uint16)
        put(np.array([i]), ids, np.array([len(ids)]), np.zeros(1, np.int64))
    flat = np.concatenate(pool)[spread(starts, n)]
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids; what isn't UTF-8 becomes U+FFFD. The space in front of the first piece is not text."""
    data = b"".join(map(pieces.text.__getitem__, ids.tolist()))
    if len(ids) and pieces.leads[ids[0]]:
        data = data[1:]
    return data.decode(errors="replace")


def _model(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def _kept(docs: DataFrame, names: tuple) -> tuple[list[str], str]:
    kept = [c for c in docs.columns if c not in names]
    return kept, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)


def encode(docs: DataFrame, seed: int = 1, dropout: float = DROPOUT, model: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>``: the pieces of ``text`` under merge-dropout.

    Each word's merges leave an agenda by score; a candidate is skipped if the hash of seed,
    ``doc_id``, the word's place in the text and the candidate's place in the word falls into the share
    ``dropout``. So each occurrence of a word has its own draws, other seeds give other segmentations,
    and the same seed the same ones on any machine. An occurrence takes its word's remembered
    undropped form only if no merge on the way there is skipped. With dropout 0
    the ids are the model's own. Characters without a piece become bytes, and so does a literal
    "▁", so that every text decodes to itself.

    Null texts have null ids, empty ones none; a null ``doc_id`` is a key like others; repeated rows
    get equal ids. A column ``ids`` is replaced; others stay.
    """
    path = _model(model)
    kept, schema = _kept(docs, ("ids",))

    def run(batch: pa.RecordBatch) -> dict:
        texts, keys = (batch.column(kept.index(c)).to_pylist() for c in ("text", "doc_id"))
        found = []
        for at in range(0, len(texts), 500):
            found += encode_texts(Pieces.at(path), keys[at : at + 500], texts[at : at + 500], seed, dropout)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 2 for x in found])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(found), "<u2").astype(np.int32))
        absent = pa.array([t is None for t in texts])
        ids = pa.ListArray.from_arrays(pa.array(offsets), values, mask=absent)
        return {c: batch.column(i) for i, c in enumerate(kept)} | {"ids": ids}

    return map_batches(docs.select(*kept), run, f"{schema}, ids array<int>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` with ``decoded string`` from ``ids``; null for null."""
    path = _model(model)
    kept, schema = _kept(rows, ("decoded",))
    place = kept.index("ids")

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(place)
        out = [None if x is None else decode_ids(Pieces.at(path), x.values.to_numpy(zero_copy_only=False)) for x in (s if s.is_valid else None for s in ids)]
        return {c: batch.column(i) for i, c in enumerate(kept)} | {"decoded": out}

    return map_batches(rows.select(*kept), run, f"{schema}, decoded string")


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs)).selectExpr("doc_id", "ids", "cast(size(ids) as bigint) as n_ids", "decoded <=> text as lossless")


QUERIES = {"op2_merge_dropout": op2_merge_dropout}
SQL: dict[str, str] = {}
