"""Packing, tokens, lines, languages and quality against brute force on small tables."""

import random
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import cross_parsing, fit_packing, line_dedup, merge_dropout, quality, token_matrix
from pagemill.llm.vocab import ChunkEncoder

ODD = [
    None, "", " ", "\n", "one", "One  two\tthree\n\nfour", "a\x1cb \x85 c d e", "Don't we'll x<|endoftext|>y",
    "Éric ñandú straße ΣΊΣΥΦΟΣ 123 4567", "🙂🙂 zero\x00byte", " lead", "trail ", "▁low▁ line", "é e\u0301", "w" * 3000, "lorem ipsum " * 900,
]


@pytest.fixture()
def odd_docs(spark):
    """Odd texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "s", 1, date(2024, 1, 1)) for i, t in enumerate(ODD)] + [(4, "one", "s", 1, date(2024, 1, 1)), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept int, offset date")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_tokenizers_ids(name):
    path = public_tokenizers.path(name)
    texts = [t or "" for t in ODD]
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new chunks, then remembered ones
        assert [np.frombuffer(b, "<u4").tolist() for b in ChunkEncoder.at(path).encode(texts)] == whole


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return room


def test_local_search_keeps_bins_whole_and_empties_some():
    rng = random.Random(3)
    better = 0
    for _ in range(300):
        lengths = np.array([rng.randint(15, 60) for _ in range(rng.randint(1, 40))])
        number, offset = fit_packing.pack_lengths(lengths, 100)
        for b in set(number):
            own = np.flatnonzero(number == b)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == np.cumsum([0, *lengths[own][:-1]]).tolist() and lengths[own].sum() <= 100
        before = len(best_fit(lengths, 100))
        assert -(-lengths.sum() // 100) <= len(set(number)) <= before
        better += len(set(number)) < before
    assert better > 20
    assert len(set(fit_packing.pack_lengths(np.array([5, 4, 4, 3, 2, 2]), 10)[0])) == 2
    assert fit_packing.pack_lengths(np.array([], int))[0].tolist() == []
    assert len(set(fit_packing.pack_lengths(np.full(500, 1100))[0])) == 500


def test_pieces_and_sequences(spark, odd_docs):
    got = fit_packing.pack_documents(odd_docs, limit=64).toPandas()
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want[(r.doc_id, p, at, len(own), zlib.crc32(own.tobytes()))] += 1
    have = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object)
    assert Counter((None if d != d or d is None else int(d), *map(int, x)) for d, *x in have.itertuples(index=False)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == np.cumsum([0, *own["length"][:-1]]).tolist() and own["length"].sum() <= 64
    assert fit_packing.pack_documents(odd_docs.limit(0)).count() == 0


def test_segment_tree_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        bins = token_matrix.best_fit_decreasing(lengths, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(50 - sum(lengths[i] for i in b) for b in bins) == sorted(best_fit(lengths, 50))


def test_matrices_give_every_document_back(odd_docs):
    rows = token_matrix.packed_matrices(odd_docs, length=32, group=5).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = []
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 32 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            found.append((-1 if r.doc_ids[k] is None else r.doc_ids[k], r.starts[k], ids[a:b].tolist()))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d in {r.doc_id for r in odd_docs.collect()}:
        text = next(r.text for r in odd_docs.collect() if r.doc_id == d)
        want = [*encoder.encode(text or "", add_special_tokens=False).ids, 50256]
        own = sorted(x[1:] for x in found if x[0] == (-1 if d is None else d))
        assert sorted(sum((x[1] for x in own), [])) == sorted(want * (2 if d == 4 else 1))
        if d != 4:
            assert sum((x[1] for x in own), []) == want
    assert token_matrix.packed_matrices(odd_docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return merge_dropout.Pieces.at(public_tokenizers.path("piece_bpe_32k.model"))


def test_without_dropout_the_ids_are_the_models(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in ODD if t and "▁" not in t]
    got = merge_dropout.encode_texts(pieces, list(range(len(texts))), texts, 1, 0.0)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == model.encode(texts)


def test_words_together_and_by_agenda_agree(pieces):
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("abcdeinorst🙂éß") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    bases = merge_dropout._keys(words, 9)
    for dropout in (0.0, 0.1, 0.6, 1.0):
        many = merge_dropout.together(pieces, words, bases, dropout)
        one = [merge_dropout.agenda(pieces, w, int(b), dropout) for w, b in zip(words, bases)]
        assert [np.frombuffer(x, "<u2").tolist() for x in many] == one


def test_words_that_came_again_are_remembered(monkeypatch):
    pieces = merge_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = [" ".join(["often", "again", *("".join(rng.choice("abeinort") for _ in range(6)) for _ in range(40))]) for _ in range(12)]
    run = lambda: [merge_dropout.encode_texts(pieces, [i], [t], 3, 0.2) for i, t in enumerate(texts)]
    want = run()
    pieces.forget()
    monkeypatch.setattr(merge_dropout, "REMEMBERED", 100)
    made = []
    remember = merge_dropout._remember
    monkeypatch.setattr(merge_dropout, "_remember", lambda p, words: (made.extend(words), remember(p, words)))
    assert run() == want and len(pieces.known) < 200
    assert made.count("▁again") == 1 and len(made) >= 480 and list(pieces.known.values()) == list(range(len(pieces.known)))


def test_only_occurrences_that_skip_a_merge_of_theirs_are_taken_apart(pieces, monkeypatch):
    segmented, taken = merge_dropout._segmented, []
    monkeypatch.setattr(merge_dropout, "_segmented", lambda p, number, skipped, *a: (taken.extend([] if skipped is None else number), segmented(p, number, skipped, *a))[1])
    # Thirteen merges make one piece of it; many more places come up on the way there.
    merge_dropout.encode_texts(pieces, [0], [" ".join(["understanding"] * 2000)], 1, 0.1)
    assert 0 < len(taken) < 2000 * (1 - 0.9**13) + 100
    # Few places: many occurrences skip the same ones.
    taken.clear()
    ids = np.frombuffer(merge_dropout.encode_texts(pieces, [0], [" ".join(["of"] * 2000)], 1, 0.1)[0], "<u2")
    assert 0 < len(taken) < 20 < len(ids) - 2000


def test_draws_at_a_time_are_bounded_by_places(pieces, monkeypatch):
    texts = [" ".join(["internationalisationsunderstandingrepresentation"[:46], "of"] * 200)] * 2
    want = merge_dropout.encode_texts(pieces, [1, 2], texts, 1, 0.3)
    draws, most = merge_dropout._draws, []
    monkeypatch.setattr(merge_dropout, "DRAWN", 2_000)
    monkeypatch.setattr(merge_dropout, "_draws", lambda *a: (found := draws(*a), most.append(len(found)))[0])
    assert merge_dropout.encode_texts(pieces, [1, 2], texts, 1, 0.3) == want
    assert len(most) > 10 and max(most) < 2_500


def test_places_are_all_where_two_pieces_make_a_third(pieces):
    words = ["▁understanding", "aaaaaaaaaaaa", "▁▁▁x🙂yable", "", "▁internationalisation", "ß"]
    sizes = np.array([len(w) + 1 for w in words])
    spaced = np.concatenate([[*pieces.of_char[[ord(c) for c in w]], -1] for w in words]).astype(np.int32)
    found = merge_dropout._all_places(pieces, spaced, np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes))
    want = []
    for k, w in enumerate(words):
        held = {(i, i + 1): int(pieces.of_char[ord(c)]) for i, c in enumerate(w) if pieces.of_char[ord(c)] >= 0}
        for size in range(2, len(w) + 1):
            for a in range(len(w) - size + 1):
                for b in range(a + 1, a + size):
                    made = pieces.pairs.get(held.get((a, b), -1) << 32 | held.get((b, a + size), -1))
                    if made is not None:
                        held[a, a + size] = made
                        want.append((k, int(pieces.rank[made]), a, size, b, made))
    own, start, middle, end, made = (x.tolist() for x in found)
    assert [*zip(own, start, middle, end, made)] == [(k, a, b, a + size, made) for k, _, a, size, b, made in sorted(want)] and len(want) > 50


def test_dropout_varies_and_decodes_to_the_text(odd_docs):
    def run(seed, rate=0.2):
        return merge_dropout.decode(merge_dropout.encode(odd_docs, seed, rate)).collect()

    one, same, other, all_dropped = run(1), run(1), run(2), run(1, 1.0)
    for rows in (one, other, all_dropped):
        assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in rows)
        assert set(rows[0].asDict()) == {"doc_id", "text", "source", "kept", "offset", "ids", "decoded"}
    assert [r.ids for r in one] == [r.ids for r in same] != [r.ids for r in other]
    long = next(r.ids for r in one if r.text == "lorem ipsum " * 900)
    plain = [np.frombuffer(x, "<u2").tolist() for x in merge_dropout.encode_texts(merge_dropout.Pieces.at(merge_dropout._model(None)), [0], ["lorem"], 1, 0.0)][0]
    assert len(long) > 1.05 * 900 * 2 * len(plain) / 2 or len(set(map(tuple, [long[:8], long[8:16]]))) == 2


def test_each_occurrence_has_its_own_draws(pieces):
    rng = random.Random(5)
    texts = [" ".join(["understanding"] * 3000), "".join(rng.choice("abeinorst 🙂é") for _ in range(3000)), "x" * 70 + " ▁low " + "internationalisation " * 20]
    for rate in (0.0, 0.1, 0.5, 1.0):
        got = merge_dropout.encode_texts(pieces, [7, None, 9], texts, 3, rate)
        again = merge_dropout.encode_texts(pieces, [9, 7], [texts[2], texts[0]], 3, rate)
        assert again == [got[2], got[0]]
        for key, text, ids in zip([7, None, 9], texts, got):
            want, origin = [], int(merge_dropout._keys([str(key)], 3)[0])
            for i, unit in enumerate(merge_dropout.units_of(text)):
                base = merge_dropout.scramble(np.array([(origin + i * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]
                want += pieces.bytes_of("▁") if unit[0] == "\0" else merge_dropout.agenda(pieces, unit, int(base), rate)
            assert np.frombuffer(ids, "<u2").tolist() == want
    words = [np.frombuffer(x, "<u2").tolist() for x in merge_dropout.encode_texts(pieces, list(range(3000)), ["understanding"] * 3000, 1, 0.1)]
    assert len(set(map(tuple, words))) > 10  # four, when a word had four forms a seed


def brute_lines(rows, ratio, least):
    pages, seen = Counter(r.source for r in rows), Counter()
    for r in rows:
        for x in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
            seen[(r.source, x)] += 1
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0, 0))
            continue
        lines = r.text.split("\n")
        bad = lambda x: seen[(r.source, x)] >= least and seen[(r.source, x)] > ratio * pages[r.source]  # noqa: E731, B023
        kept = [x for x in lines if not (x.strip(" ") and bad(x.strip(" ")))]
        out.append((r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_of_a_host_above_the_ratio_go(spark, odd_docs, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        host = rng.choice(["hot", "hot", "a", "b", None])
        lines = [rng.choice(["menu", " menu", "", "  ", "footer", f"own {i}", "rare"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, None if i % 97 == 0 else "\n".join(lines), host, 7))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_lines int")
    for limit in (200_000, 0):  # by a broadcast, by a shuffle
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        for ratio in (0.2, 0.5):
            got = line_dedup.drop_boilerplate(docs, ratio=ratio)
            assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]
            key = lambda x: (x[0], str(x))
            assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key) == sorted(
                brute_lines(docs.collect(), ratio, line_dedup.MIN_PAGES), key=key
            )
    assert line_dedup.drop_boilerplate(odd_docs).count() == odd_docs.count()
    assert line_dedup.drop_boilerplate(odd_docs.limit(0)).count() == 0


def greedy_phrases(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample and text[at : at + n] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def test_phrases_are_the_greedy_longest_matches():
    rng = random.Random(4)
    samples = {k: "".join(rng.choice(letters) for _ in range(800)) for k, letters in {"x": "aab ", "y": "bbc ", "z": "cd "}.items()}
    texts = ["".join(rng.choice("abcdz ") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    parser = cross_parsing.CrossParser(samples)
    total, count, letters = parser.phrases([*texts, None, "", "12 !"])
    for i, t in enumerate(texts):
        squeezed = re.sub(" +", " ", t).lstrip()
        assert count[i] == len(squeezed) and letters[i] == len(squeezed.replace(" ", ""))
        assert [int(x) for x in total[:, i]] == [greedy_phrases(squeezed, re.sub(" +", " ", samples[k])) for k in "xyz"]
    assert letters[-3:].tolist() == [0, 0, 0]


def test_a_long_text_is_parsed_whole():
    parser = cross_parsing.CrossParser({"x": "the cat sat on the mat", "y": "un chat sur le tapis"})
    text = "the cat sat on the mat " * 400 + "un chat sur le tapis " * 1200
    total, count, _ = parser.phrases([text])
    assert count[0] == len(text) and total[1, 0] < total[0, 0]


def test_languages_of_held_out_documents(spark, odd_docs):
    words = {"en": "the of and to in that is was for it".split(), "de": "der die und das nicht von mit ein zu auf".split(), "fr": "le la et les des une est que dans pour".split()}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(5, 60))), lang, i) for i, lang in enumerate(rng.choices(list(words), k=300))]
    docs = spark.createDataFrame([*rows, (900, None, "en", 1), (901, "123 ###", "en", 1), (902, "null lang the of", None, 1), (None, "the of and", "en", 1)], "doc_id bigint, text string, lang string, score int")
    samples = cross_parsing.training_sample(docs)
    assert sorted(samples) == ["de", "en", "fr"]
    got = {r.doc_id: r for r in cross_parsing.identify(docs, samples).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == got[901].score == 0
    assert cross_parsing.identify(odd_docs, samples).count() == odd_docs.count()
    assert {r.lang_pred for r in cross_parsing.identify(odd_docs, {}).collect()} == {"und"}
    assert cross_parsing.identify(docs.limit(0), samples).count() == 0
    held = docs.select("doc_id", cross_parsing.held_out(docs["doc_id"]).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd_docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c # $x\n| é🙂".split(" ")) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += ["one two three four five six seven eight " * 3, "x y\nx y\n x y\n\n\n", *ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.judge(docs, None).collect()}
    for i, t in enumerate(texts):
        n, *_, repeated = want = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and r.kept == (not r.base_failed)
    assert quality.judge(odd_docs, None).columns[:3] == ["doc_id", "text", "source"]
    assert quality.judge(docs.limit(0), None).count() == 0


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality, "scramble", lambda x: np.zeros_like(x))
    texts = ["a b c d e f g h i j " * 2, "p q r s t u v w x y z", None]
    assert quality.Batch(texts).repeated_words().tolist() == [brute_counts(t)[-1] for t in texts]


def test_model_separates_held_out_rows(spark):
    rng = random.Random(9)
    syllables = ["ta", "ri", "mo", "len", "so", "ka"]

    def text(good):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(25, 80))]
        return " ".join(w if good else w + rng.choice(["###", "|", "%%"]) for w in words)

    good = [rng.random() < 0.7 for _ in range(500)]
    docs = spark.createDataFrame([(i, text(g)) for i, g in enumerate(good)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g), 5) for i, g in enumerate(good[:300])] + [(3, None, 1), (None, 1, 1), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert all(got[i].kept == (g and not got[i].base_failed) for i, g in enumerate(good))
    assert all(0 <= r.probability <= 1 for r in got.values()) and 0 < model["slope"] < 1e3
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.train(docs, labels.limit(0)) is None


def test_linear_score_matches_the_features():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = ["abc", "ab", "", "Some longer text, with words.", "é🙂 x", "tail"]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array(texts)], ["quality", "text"])
    weights = rng.normal(size=(1 + len(quality.CHAR_SIZES)) * quality.BUCKETS)
    rows = quality._features(batch)
    want = [float((weights[a] * v).sum()) for a, v in zip(rows["at"], rows["value"])]
    assert np.allclose(quality.Batch(texts).linear(weights), want, atol=1e-5)
