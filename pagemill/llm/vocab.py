"""Token ids of whole texts, by chunks between white space that a worker remembers."""

from __future__ import annotations

import os
import re

import numpy as np

from pagemill.llm.common import held

#: Chunks a worker remembers (about 150 bytes each); beyond it, it forgets them all and starts anew (only
#: speed changes).
REMEMBERED = 400_000
#: Words that the tokenizer gets at a time.
AT_ONCE = 200

#: White space as the tokenizers' patterns see it (Unicode White_Space): a fixed value.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Letters and digits, and marks, whose borders every pattern cuts at: fixed values. An apostrophe is
#: neither, as it may begin a contraction.
_LETTER = "0-9A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: One space leads the word it stands before; of other white space, the last character is apart.
_LEADING_FINE = re.compile(
    f" ?[{_LETTER}]+(?=[{_MARK}{_SPACE}])|[{_MARK}]+(?=[{_LETTER}{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Words of letters alone, with the space before them where that is kept: one piece for every pattern.
_ALONE = {True: re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), False: re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")}
_WORDS = re.compile("[^ \t-\r]+")
_WORDS_FINE = re.compile(f"[{_LETTER}]+(?=[{_MARK} \t-\r])|[{_MARK}]+(?=[{_LETTER} \t-\r])|{_WORDS.pattern}")


class ChunkEncoder:
    """Encode texts with a tokenizer file, a chunk at a time.

    Chunks end where the tokenizer's own pattern cuts for sure: at white space, and between letters and
    marks. A word-end vocabulary drops white space and writes A-Z small, so its chunks do too. Texts
    that may hold a special token are cut at white space only, or not at all. The ids are those of the
    tokenizer on the whole text (tests compare them), at the cost of a look-up for each chunk seen before.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Between words that are encoded in one go: the tokenizer cuts there before anything else.
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.drops_space = '"</w>"' in self.tokenizer.to_str()
        self.known: dict[str, bytes] = {}
        #: Whether an id ends a word, or begins one with its space.
        self.border = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.border[i] = piece.endswith("</w>") if self.drops_space else piece.startswith("Ġ")

    @classmethod
    def at(cls, path: str) -> ChunkEncoder:
        """The one that a worker process holds."""
        return held(("chunks", path), lambda: cls(path))

    def chunks(self, text: str) -> list[str]:
        if self.drops_space:
            return _WORDS.findall(text) if "<|" in text else _WORDS_FINE.findall(text.encode().lower().decode())
        # White space before a special token is cut as at the end of a text.
        return [text] if self.mark in text else _LEADING_FINE.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split).difference(self.known)) if split else []
        for word in [w for w in new if "<|" in w or self.mark_id is None]:
            self.known[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        plain = [w for w in new if w not in self.known]
        alone = [w for w in plain if _ALONE[self.drops_space].fullmatch(w)]
        for at in range(0, len(alone), AT_ONCE):
            self._encode_words(alone[at : at + AT_ONCE])
        plain = [w for w in plain if w not in self.known]
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            ids = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids
            raw = np.array([*ids, self.mark_id], "<u4")
            data, start = raw.tobytes(), 0
            for word, end in zip(part, (4 * np.flatnonzero(raw == self.mark_id)).tolist(), strict=True):
                self.known[word] = data[start:end]
                start = end + 4
        of = self.known.__getitem__
        return [b"".join(map(of, chunks)) for chunks in split]

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters alone: between spaces, each is known by the id that ends it, or begins it with its space.

        That takes the tokenizer half the time of marks between them. Any that don't come out one by one are
        left for that.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.drops_space else "").join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.border[ids])
        if len(at) == len(words):
            ends = (4 * (at + 1)).tolist() if self.drops_space else [*(4 * at[1:]).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.known.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends))
