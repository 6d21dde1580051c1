"""Rows that share an id, numbers beyond doubles, large alphabets, languages that nobody taught."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import block_topk, cross_parsing, prob_minhash, warc
from test_tables_and_pairs import brute_classes, set_of


def test_two_texts_of_one_id_are_two_documents(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue white black brown pink grey gold teal"
    docs = spark.createDataFrame([(1, a, "en"), (1, b, "en"), (2, a, "en"), (3, b, "en"), (3, b, "en"), (4, None, "en"), (None, a, "en")], "doc_id bigint, text string, lang string")
    got = Counter((r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(docs).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 2, (4, 4): 1, (None, None): 1}
    classes = {(r.doc_id, bytes(r.digest)): r.comp for r in prob_minhash.text_classes(docs).collect() if r.digest}
    assert len(set(classes.values())) == 2
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in docs.collect() if r.doc_id in (1, 4, None)]))


def repeating(seed, n=80):
    """Texts of which many repeat passages, so that weights matter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-20:]).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.5:
                words += words[-20:] * rng.randint(1, 12)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(20, 80))))
    return texts


@pytest.mark.parametrize("small", [24, 1])
def test_links_of_texts_that_repeat_passages(spark, monkeypatch, small):
    monkeypatch.setattr(prob_minhash, "SMALL", small)
    rows = list(enumerate(repeating(11)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs).collect()} == brute_classes(rows)


def test_weighted_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    found, want = [], []
    for _ in range(60):
        x = rng.choice(2**62, 200, replace=False).astype(np.uint64)
        wx, wy = rng.integers(1, 20, 200).astype(float), rng.integers(1, 20, 200).astype(float)
        sig = prob_minhash._signed([(x[:150], wx[:150]), (x[50:], wy[50:])])
        found.append((sig[0] == sig[1]).mean())
        p, q = np.where(np.arange(200) < 150, wx, 0), np.where(np.arange(200) >= 50, wy, 0)
        both = (p > 0) & (q > 0)
        ratio = lambda u, v: np.maximum(u[both][:, None] ** -1 * u[None], v[both][:, None] ** -1 * v[None]).sum(axis=1)
        want.append((1 / ratio(p, q)).sum())
    assert abs(np.mean(found) - np.mean(want)) < 0.02


def test_given_documents_lose_no_link(spark):
    """All pairs of similarity 0.8 or more on the smallest given table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs).collect()} == brute_classes(rows)
    assert sum(bool(set_of(t)) for _, t in rows if t) > 100


def test_a_page_with_two_payloads_keeps_them_apart(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 50), (1, "http://b", "y" * 70), (2, "http://c", "x" * 50), (3, "http://d", "y" * 70), (5, "http://e", "z")], "page_id bigint, url string, html string")
    for keep in (True, False):
        path = str(tmp_path / str(keep))
        warc.write_archives(pages, path)
        back = warc.resolve_revisits(warc.read_archives(spark, path, keep), keep).collect()
        want = {"http://a": 50, "http://b": 70, "http://c": 50, "http://d": 70, "http://e": 1}
        assert {r.url: r.payload_bytes for r in back} == want and all(r.problem is None for r in back)
        assert len({r.payload_digest for r in back if r.payload_bytes == 50}) == 1
        if keep:
            assert {r.url: bytes(r.payload) for r in back} == {r.url: r.html.encode() for r in pages.collect()}
    alone = warc.read_archives(spark, path).where("record_type = 'revisit'")
    lost = warc.resolve_revisits(alone).collect()
    assert len(lost) == 2 and all(r.problem == "response missing" and r.payload_digest is None for r in lost)


@pytest.mark.parametrize("scale", [1, 1 << 30, 1 << 33])
def test_scores_beyond_doubles_are_ordered(scale):
    rng = random.Random(scale)
    vectors = np.array([[scale, i] for i in range(3)] + [[rng.randint(-9, 9) * scale // 9, rng.randint(-5, 5)] for _ in range(200)])
    ids = np.arange(len(vectors))
    queries = vectors[[1, 60, 61]]
    got = block_topk.block_at_a_time(queries, ids[[1, 60, 61]], vectors, ids, 5, 16)
    for q in (1, 60, 61):
        score = {i: sum(int(x) * int(y) for x, y in zip(vectors[q], vectors[i])) for i in ids.tolist() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [(i, s) for a, i, s in got if a == q] == [(i, score[i]) for i in best]


def greedy(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def test_rare_letters_are_searched_for(monkeypatch):
    monkeypatch.setattr(cross_parsing, "DENSE", 2)
    rng = random.Random(1)
    samples = {k: "".join(rng.choice(letters) for _ in range(900)) for k, letters in {"x": "abcdefg", "y": "efghij"}.items()}
    parser = cross_parsing.CrossParser(samples)
    for _ in range(40):
        text = "".join(rng.choice("abcdefghijz") for _ in range(rng.randint(1, 500)))
        assert parser.phrases([text])[0][:, 0].tolist() == [greedy(text, samples[k]) for k in "xy"]


def test_a_large_alphabet_takes_its_occurrences():
    rng = random.Random(2)
    signs = "".join(chr(0x4E00 + rng.randrange(2_114)) for _ in range(20_000))
    parser = cross_parsing.CrossParser({"zh": signs, "en": "the cat sat on the mat " * 800})
    assert parser.step.nbytes + parser.rare.nbytes + parser.rare_move.nbytes + parser.column.nbytes < 30 << 20
    assert parser.phrases([signs[5_000:5_400]])[0].tolist() == [[400], [1]]


def spoken(seed, syllables, n, words):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words)) for _ in range(n)]


def test_long_labels_teach_and_untaught_languages_are_rejected(spark):
    speech = {"a": "the and ing tion er".split(), "b": "ung sch ein der ich".split(), "c": "kua ilo neh tyy oja".split()}
    rows = []
    for k, (lang, syllables) in enumerate(speech.items()):
        # Those of language b are all longer than a text of the sample may be.
        texts = spoken(k, syllables, 40, 3_000 if lang == "b" else 120)
        rows += [(1_000 * k + i, t, lang) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    samples = cross_parsing.training_sample(docs)
    assert sorted(samples) == ["a", "b", "c"] and all(len(v) <= cross_parsing.TRAIN_CHARS for v in samples.values())
    got = cross_parsing.identify(docs, samples).collect()
    assert all(r.lang_pred == r.lang for r in got)
    taught = {k: v for k, v in samples.items() if k != "c"}
    least = cross_parsing.shortest_phrases(taught)
    found = cross_parsing.identify(docs, taught)
    gone = found.where(cross_parsing.unlike(found["phrase_letters"], found["lang_pred"], found["letters"], least))
    assert {r.lang for r in gone.collect()} == {"c"} and gone.count() == 40
    copies = docs.where("lang = 'a'").limit(1).crossJoin(spark.range(500).select()).union(docs.where("doc_id < 20"))
    assert len(cross_parsing.training_sample(copies)["a"]) > 5_000


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(i, f"words of tongue {i} " * 400, f"l{i}") for i in range(60)], "doc_id bigint, text string, lang string")
    samples = cross_parsing.training_sample(docs, in_all=120_000)
    assert 30 < len(samples) <= 60 and sum(map(len, samples.values())) <= 180_000
