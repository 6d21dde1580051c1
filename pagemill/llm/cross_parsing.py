"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import held, map_batches, table

#: Bounds of the labelled sample: so many texts of each language, and so many characters of each and of all languages.
TRAIN_ROWS = 64
TRAIN_CHARS, TRAIN_CHARS_IN_ALL = 40_000, 2_000_000
#: A text is parsed in blocks of so many symbols; a phrase ends with its block.
BLOCK = 1_024
#: Letters of a language that have a column of the automaton's table; its rarer ones are searched for.
DENSE = 62
#: Rejected as no language if phrases are shorter than this share of what the language's own text has (see ``unlike``).
LEAST_SHARE = 0.5
#: ... unless a text has fewer letters than this: then its phrases say little.
LEAST_LETTERS = 100
UNKNOWN = "und"


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The automaton of all substrings: each state's next states by symbol. State 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in following[at]:
            following[at][c] = new
            at = link[at]
        if at >= 0:
            old = following[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(following)
                following.append(dict(following[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                link[old] = link[new] = copy
                while at >= 0 and following[at].get(c) == old:
                    following[at][c] = copy
                    at = link[at]
        last = new
    return following


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each run of other characters than letters as one 0; rows; letters by row."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    if not len(codes):
        return codes, row, np.zeros(len(texts), np.int64)
    found, back = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in found.tolist()])
    codes = np.where(letter, found, 0)[back]
    keep = codes != 0
    letters = np.bincount(row[keep], minlength=len(texts))
    keep[1:] |= (codes[:-1] != 0) & (row[1:] == row[:-1])
    return codes[keep], row[keep], letters


class CrossParser:
    """Phrases that each text takes from each language's sample."""

    def __init__(self, samples: dict[str, str]):
        """The table of moves has a row for each state of each language and a column for each of its commonest letters.

        A move is four times the next state, plus the phrases that end: one where the text so far has no
        such continuation (the next phrase starts with this symbol), and one for a symbol that never
        occurs, which is a phrase of its own and leads back to the root. At the root no phrase is open. So a
        large alphabet costs its occurrences, not its size times the states.
        """
        self.languages = sorted(samples)
        parts = [symbols_of([samples[name]])[0] for name in self.languages]
        self.alphabet, index = np.unique(np.concatenate([*parts, [0]]), return_inverse=True)
        self.unknown = len(self.alphabet)
        ends = np.cumsum([len(p) for p in parts])
        own = [index[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        count = np.stack([np.bincount(x, minlength=self.unknown) for x in own])
        self.width = min(DENSE, int((count > 0).sum(axis=1).max(initial=0))) + 2
        # Columns: common letters, then rarer ones (searched for), then symbols that the language hasn't.
        self.column = np.full((len(parts), self.unknown + 1), self.width - 1, np.int64)
        tables, roots, keys, moves, at = [], [], [], [], 0
        self.restart = np.zeros((len(parts), self.unknown + 1), np.int32)
        for k, symbols in enumerate(own):
            order = np.argsort(-count[k], kind="stable")[: int((count[k] > 0).sum())]
            self.column[k, order] = np.minimum(np.arange(len(order)), self.width - 2)
            following = suffix_automaton(symbols)
            states = np.repeat(np.arange(len(following)), [len(x) for x in following])
            chars = np.fromiter((c for x in following for c in x), np.int64, len(states))
            to = 4 * (at + np.fromiter((to for x in following for to in x.values()), np.int64, len(states)))
            root = np.full(self.width, 4 * at + 1, np.int32)  # a symbol that never occurs: back to the root, one phrase
            first = states == 0
            self.restart[k, chars[first]] = to[first] + 1
            column = self.column[k, chars]
            root[column[first]] = to[first]
            step = np.tile(root + 1, (len(following), 1)).astype(np.int32)
            step[0] = root
            step[states, column] = to
            rare = column == self.width - 2
            keys.append((at + states[rare]) * (self.unknown + 1) + chars[rare])
            moves.append(to[rare])
            tables.append(step.ravel())
            roots.append(at)
            at += len(following)
        self.step = np.concatenate(tables)
        self.roots = np.array(roots, np.int64)[:, None]
        key, move = np.concatenate(keys), np.concatenate(moves)
        order = np.argsort(key)
        self.rare, self.rare_move = key[order], move[order]
        self.bits = np.log2(np.maximum(2, [len(p) for p in parts]))

    @classmethod
    def of(cls, samples: dict[str, str]) -> CrossParser:
        """The one that a worker process holds."""
        return held(("languages", hash(tuple(sorted(samples.items())))), lambda: cls(samples))

    def index(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, self.unknown)

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The moves of each language's states (``languages x lanes``) by one symbol of each lane."""
        column = self.column[:, symbol]
        out = self.step[state * self.width + column]
        if len(self.rare):
            language, lane = np.nonzero(column == self.width - 2)
            if len(lane):
                key = state[language, lane] * (self.unknown + 1) + symbol[lane]
                at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
                # At the root the restart is the move itself, without a phrase that ends.
                out[language, lane] = np.where(self.rare[at] == key, self.rare_move[at], self.restart[language, symbol[lane]])
        return out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: phrases for each language (``languages x texts``), symbols, letters.

        All blocks of all texts advance together, a symbol a step, so a long text takes no more
        steps than a short one.
        """
        codes, row, letters = symbols_of(texts)
        count = np.bincount(row, minlength=len(texts))
        starts = np.cumsum(count) - count
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        if not len(codes):
            return total, count, letters
        blocks = -(-count // BLOCK)
        lane_row = np.repeat(np.arange(len(texts)), blocks)
        lane_no = np.arange(len(lane_row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lane_start = starts[lane_row] + lane_no * BLOCK
        lane_len = np.minimum(BLOCK, count[lane_row] - lane_no * BLOCK)
        order = np.argsort(-lane_len, kind="stable")
        lane_row, lane_start, lane_len = lane_row[order], lane_start[order], lane_len[order]
        symbols = self.index(codes)
        active = np.searchsorted(-lane_len, -np.arange(lane_len[0]), side="left")
        state = np.repeat(self.roots, len(lane_row), axis=1)
        ended = np.zeros((len(self.languages), len(lane_row)), np.int64)
        for k, n in enumerate(active.tolist()):
            move = self.move(state[:, :n], symbols[lane_start[:n] + k])
            ended[:, :n] += move & 3
            state[:, :n] = move >> 2
        ended += state != self.roots  # the phrase that the end of the block cuts off
        for i in range(len(self.languages)):
            total[i] = np.bincount(lane_row, ended[i], len(texts)).astype(np.int64)
        return total, count, letters


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, in_all: int = TRAIN_CHARS_IN_ALL) -> dict[str, str]:
    """Language to labelled text, from documents that aren't held out: at most ``rows`` different texts of each
    language (those of the smallest hashes, cut down before the shuffle) and ``chars`` characters, or fewer where
    there are so many languages that they would take more than ``in_all``.

    A text is one however many copies it has. Of one longer than a quarter of that, a passage from its middle is
    taken; none is left out for its length.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    digest = F.unhex(F.md5("text"))
    texts = labelled.select("lang", digest.alias("d")).distinct()
    # By language: no more rows than there are languages come back.
    languages = texts.select("lang").distinct().count()
    if not languages:
        return {}
    chars = max(1_000, min(chars, in_all // languages))
    part = chars // 4
    taken = texts.withColumn("_rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("d"), "d"))).where(F.col("_rn") <= rows)
    passage = F.substring("text", F.greatest(F.floor((F.length("text") - part) / 2), F.lit(0)).cast("int") + 1, F.lit(part))
    passages = labelled.select(F.col("lang").alias("l"), digest.alias("of"), passage.alias("text")).join(F.broadcast(taken), (F.col("l") == F.col("lang")) & (F.col("of") == F.col("d")))
    out: dict[str, str] = {}
    for r in passages.groupBy("lang", "_rn").agg(F.first("text").alias("text")).orderBy("lang", "_rn").collect():
        out[r.lang] = (f"{out[r.lang]} {r.text}" if r.lang in out else r.text)[:chars]
    return {k: v for k, v in out.items() if symbols_of([v])[2][0]}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` with ``lang_pred string, score double, phrase_letters double, letters long``; reads ``text`` alone.

    A text is parsed greedily into the longest phrases that occur in a language's sample, by walking
    the sample's suffix automaton. Phrases times log2 of the sample's size, over the text's symbols,
    is the cross-parsing entropy; the language of the least wins, the first in order among equals.
    ``score`` is 1 minus the least over the second least (1 if there is one language).
    ``phrase_letters`` is the mean phrase of the winner, in letters, of which the text has ``letters``.

    Null texts and texts without a letter are ``und`` with score 0; so is all, if there is no sample.
    Whole texts are parsed, of any length. Columns of ``docs`` of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "phrase_letters", "letters")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    place = kept.index("text")

    def predict(batch: pa.RecordBatch) -> dict:
        texts = batch.column(place).to_pylist()
        pred, score, mean, letters = [UNKNOWN] * len(texts), *(np.zeros(len(texts)) for _ in range(3))
        if samples:
            parser = CrossParser.of(samples)
            total, count, letters = parser.phrases(texts)
            entropy = total * parser.bits[:, None] / np.maximum(count, 1)
            best = np.argmin(entropy, axis=0)
            two = np.sort(entropy, axis=0)[:2]
            has = letters > 0
            ratio = two[0] / np.maximum(two[1], 1e-12) if len(two) > 1 else np.zeros(len(texts))
            score = np.where(has, 1 - ratio, 0.0)
            mean = np.where(has, letters / np.maximum(total[best, np.arange(len(texts))], 1), 0.0)
            pred = [parser.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        own = {c: batch.column(i) for i, c in enumerate(kept)}
        return own | {"lang_pred": pred, "score": score, "phrase_letters": mean, "letters": letters.astype(np.int64)}

    return map_batches(docs.select(*kept), predict, f"{schema}, lang_pred string, score double, phrase_letters double, letters long")


def shortest_phrases(samples: dict[str, str], share: float = LEAST_SHARE) -> dict[str, float]:
    """By language, the share ``share`` of the mean phrase, in letters, that one half of its sample has in the other.

    The whole sample gives longer phrases than half of it, so a text of the language lies well above.
    """
    out = {}
    for name, text in samples.items():
        half = len(text) // 2
        total, _, letters = CrossParser({name: text[:half]}).phrases([text[half:]])
        out[name] = share * float(letters[0]) / max(1, int(total[0, 0]))
    return out


def unlike(phrase_letters: Column, lang_pred: Column, letters: Column, least: dict[str, float], enough: int = LEAST_LETTERS) -> Column:
    """Texts that are no known language: without letters, or of ``enough`` letters and in phrases that are shorter than
    ``least`` (see ``shortest_phrases``) of the language that comes nearest."""
    short = F.lit(False)
    for name, size in least.items():
        short = short | ((lang_pred == name) & (phrase_letters < size))
    return (lang_pred == UNKNOWN) | (short & (letters >= enough))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), training_sample(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_letters")


QUERIES = {"op6_cross_parsing": op6_cross_parsing}
SQL: dict[str, str] = {}
