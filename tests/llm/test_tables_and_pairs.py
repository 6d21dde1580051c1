"""Near duplicates, URLs, archives, search and the pipeline against brute force on small tables."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import block_topk, fit_packing, line_dedup, prob_minhash, url_filter, warc


def set_of(text):
    words = text.lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_classes(rows, least=0.8):
    """doc_id to class, by all pairs."""
    rows = [(d, t) for d, t in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, t, set_of(t) if t is not None else None) for d, t in rows]
    for i, (a, ta, x) in enumerate(sets):
        for b, tb, y in sets[:i]:
            if ta is None or tb is None:
                continue
            if ta == tb or x and y and len(x & y) >= least * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-40:]).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(8, 90))))
    return texts


@pytest.mark.parametrize("small_blocks", [False, True])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(prob_minhash, "OUTSIDERS", 3)
        monkeypatch.setattr(prob_minhash, "OTHERS", 4)
        monkeypatch.setattr(prob_minhash, "BROADCAST_NODES", 0)
    rows = list(enumerate(near_copies(1)))
    rows += [(500, None), (501, ""), (502, ""), (503, "  "), (504, "one two"), (505, "One  two"), (506, None), rows[3], (None, "lost id"), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, class_id int")
    got = prob_minhash.near_duplicates(docs).collect()
    want = brute_classes(rows)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.class_id is None for r in got if r.doc_id is None)
    assert prob_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_variants_of_a_hidden_base_stay_linked(spark):
    """Many variants of one text, most of which are near the base and not each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            words[at] = f"v{k}x{at}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(400, " ".join(base))]
    got = prob_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_near_copies_that_repeat_passages_are_found(spark):
    """In half of the pairs one text is the other with its passages said again and again; counts are not similarity."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(120)]
        other = list(words)
        for at in rng.sample(range(120), 2):
            other[at] = f"q{k}w{at}"
        if k % 2:
            other = other + other[:60] * 50 if k % 4 == 1 else other * 30
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = prob_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_classes(rows)
    assert sum(d != c for d, c in want.items()) >= 40
    assert {r.doc_id: r.class_id for r in got} == want


def test_registers_agree_as_the_probability_jaccard():
    rng = np.random.default_rng(2)
    a = {int(x): float(w) for x, w in zip(rng.integers(0, 2**63, 60), rng.uniform(0.5, 4, 60))}
    b = {x: w * float(rng.uniform(0.5, 2)) for x, w in list(a.items())[:45]} | {int(x): 1.0 for x in rng.integers(0, 2**63, 15)}
    exact = 0.0
    for d in a.keys() & b.keys():
        exact += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    doc = np.repeat([0, 1], [len(a), len(b)])
    element = np.array([*a, *b], np.uint64)
    weight = np.array([*a.values(), *b.values()])
    sig = prob_minhash.prob_minhash(doc, element, weight, 2, registers=4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    alone = prob_minhash.prob_minhash(doc[doc == 0], element[doc == 0], weight[doc == 0] * 7, 1, registers=4096)
    assert (alone[0] == sig[0]).all()  # scale doesn't matter, nor company


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = prob_minhash.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.comp for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://www.Example.ORG/es/1?q=/en/", "http://example.org/en/12", "http://example.org/en/2",
    "http://xexample.org/es/1", "http://b.com/fr/", "http://b.com/de/x#y", "http://b.com?u=http://c.org/", "http://c.net/fr/", "http://org", "http://d.org#/x", "x://y://z.com/de/", "http://" + "long/" * 5000,
]


def brute_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in (rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = []
    for rule, verdict in url_filter.RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_decide_as_by_hand(spark):
    urls = [*URLS, *(f"http://s{i}.{h}.{t}/{p}/{i}" for i in range(8) for h in ("example", "b") for t in ("org", "com", "net") for p in ("es", "en", "fr", "de"))]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(1, "", "x")], "page_id bigint, url string, verdict string")
    got = url_filter.judge_urls(pages.withColumn("tld", F.lit(3)), url_filter.RULES)
    assert got.columns == ["page_id", "tld", "url", "host", "path", "rule", "verdict", "block_probability"]
    rows = got.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict in (None, r.verdict)
    assert not {x for x in ("Python", "Arrow", "Pandas") if x in got._jdf.queryExecution().executedPlan().toString()}
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_trees_learn_from_the_labelled_urls(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.4
        tail = "".join(rng.choices("0123456789", k=12)) + "?a=1&b=2&c=3" if bad else rng.choice(["news", "about", "blog"])
        host = f"h{rng.randint(0, 40)}.example" if i % 3 else f"h{rng.randint(0, 40)}.other"
        rows.append((i, f"http://{host}/{'x' if bad else 'y'}/{tail}", bad))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    got = url_filter.judge_urls(pages, [("example/x/", "block"), ("example/", "allow")]).collect()
    unruled = [r for r in got if r.rule is None]
    assert len(unruled) > 100 and all((r.verdict == "block") == r.bad for r in unruled)
    alike = url_filter.judge_urls(pages, [("example/", "block")]).select("verdict").distinct().collect()
    assert [r.verdict for r in alike] == ["block"]
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("limit", [200_000, 0])  # by a broadcast, by a shuffle
def test_suffixes_are_counted_on_all_labelled_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_SUFFIXES", limit)
    rows = [(f"http://w{j}.site{i}.org/{i}/{j}", f"w{j}.site{i}.org", "block" if i % 3 == 0 else "allow") for i in range(200) for j in range(3)]
    given = [(u, h, "/x", v) for u, h, v in [*rows, *rows[:50], ("http://n.net/", "n.net", None)]]
    urls = spark.createDataFrame(given, "url string, host string, path string, verdict string")
    model, stats, overall = url_filter.train(urls, rows=40)
    assert overall == pytest.approx(sum(v == "block" for *_, v in rows) / len(rows))
    assert {tuple(r) for r in stats["suffix"].collect()} == {(f"site{i}.org", 3.0, 3.0 * (i % 3 == 0)) for i in range(200)}
    assert [tuple(r) for r in stats["tld"].collect()] == [("org", 600.0, 201.0)]
    judged = url_filter.judge_urls(urls.select("url"), [(f"site{i}.org/{i}", "block" if i % 3 == 0 else "allow") for i in range(30)], rows=40)
    assert judged.count() == len(given) and judged.where("verdict is null").count() == 0


def test_features_by_hand(spark):
    rows = spark.createDataFrame([("http://a.b-c.org/x/y1?p=1&q=2#f", "a.b-c.org", "/x/y1"), ("aabb", "", ""), (None, "", "")], "url string, host string, path string")
    one, two, three = url_filter.lexical_features(rows).collect()
    assert (one.f_length, one.f_host, one.f_labels, one.f_depth, one.f_hyphens, one.f_params) == (31, 9, 2, 2, 1, 2)
    assert one.f_digits == pytest.approx(3 / 31) and (one.tld, one.suffix) == ("org", "b-c.org")
    assert two.f_entropy == pytest.approx(1.0) and three.f_entropy == 0.0


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_give_the_pages_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)  # segments in several archives
    long = "é<p>x</p>\r\n\r\nWARC/1.1\r\n" * 4000
    html = ["<p>a</p>", None, "", long, "<p>a</p>", long, "x" * warc.SEGMENT, "🙂", "<p>a</p>"]
    rows = [(10 - i, f"http://x/{i}\r\n", h, i) for i, h in enumerate(html)] + [(None, None, "<p>a</p>", 0), (4, "http://r", "<p>own</p>", 0), (4, "http://r", "<p>own</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int").repartition(2)
    for limit in (200_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_GROUPS", limit)
        path = str(tmp_path / f"w{limit}")
        warc.write_archives(pages, path)
        got = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
        assert len(got) == len(rows)
        first = {}
        for d, _, h, _ in rows:
            key = (h or "").encode()
            first[key] = min(first.get(key, 1 << 60), 1 << 60 if d is None else d)
        have = sorted((str(r.page_id), r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest, bytes(r.payload), r.problem) for r in got)
        want = []
        for d, _, h, _ in rows:
            data = (h or "").encode()
            again = d != first[data]
            want.append((str(d), "revisit" if again else "response", first[data] if again else 0, len(data), sha(data), data, None))
        assert have == sorted(want)


def test_broken_archives_are_told(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 10)
    part = lambda k, data, total=None, kind="response": warc._record(
        {"WARC-Type": kind if k == 1 else "continuation", "WARC-Record-ID": f"<o{kind}{k}>", "WARC-Segment-Origin-ID": None if k == 1 else f"<o{kind}1>", "WARC-Segment-Number": str(k), "WARC-Segment-Total-Length": total}, data
    )
    records = [
        part(2, block[40:], str(len(block))), part(1, block[:40]),
        part(1, block[:40], kind="gap"), part(3, block[60:], str(len(block)), kind="gap"),
        part(1, block[:40], kind="short"), part(2, block[40:], "999", kind="short"),
        warc._record({"WARC-Type": "response", "WARC-Record-ID": "<whole>", "WARC-Payload-Digest": "sha1:WRONG"}, block),
        warc._record({"WARC-Type": "response", "WARC-Record-ID": "<frame>"}, block[:-3]),
        warc._record({"WARC-Type": "response", "WARC-Record-ID": "<plain>"}, b"HTTP/1.1 200 OK\r\n\r\nbody"),
        warc._record({"WARC-Type": "revisit", "WARC-Record-ID": "<lost>", "X-Refers-To-Page-ID": "77"}, b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    got = {r.record_id: r for r in warc.resolve_revisits(warc.read_archives(spark, str(tmp_path))).collect()}
    assert bytes(got["<oresponse1>"].payload) == b"payload" * 10 and got["<oresponse1>"].problem is None
    assert bytes(got["<plain>"].payload) == b"body"
    assert {k: r.problem for k, r in got.items() if r.problem} == {
        "<ogap1>": "segments missing", "<oshort1>": "total length differs", "<whole>": "digest differs", "<frame>": "broken framing", "<lost>": "response missing",
    }


def brute_top(rows, queries, k):
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [4, 2**28])
def test_top_k_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(block_topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(block_topk, "QUERY_ROWS", 20)
    rng = random.Random(11)
    rows = [(i, [rng.randint(-3, 3) * scale for _ in range(6)]) for i in range(400)]
    rows += [(i, [scale] * 6) for i in range(400, 480)] + [(480, [1, 2]), (500, [2, 2]), (510, [1, 1, 1])]
    frame = spark.createDataFrame([*rows, (None, [1] * 6), (600, None), (601, [])], "vec_id bigint, vector array<bigint>")
    got = block_topk.top_k(frame.where("vec_id % 10 = 0"), frame, block=16)
    want = brute_top(rows, {i: v for i, v in rows if i % 10 == 0}, 5)
    assert sorted(map(tuple, got.collect())) == want
    assert block_topk.top_k(frame.limit(0), frame).count() == 0 == block_topk.top_k(frame, frame.limit(0)).count()


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [0.5, -0.001]), (1, [None, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, None), (5, [1.999, 1e-9])]
    got = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", block_topk.quantised(F.col("embedding")).alias("v"))
    assert {r.vec_id: r.v for r in got.collect()} == {0: [128, -1], 1: None, 2: None, 3: None, 4: None, 5: [511, 0]}


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of the pipeline returns, on the smallest tables with odd rows added."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", "en", None, 0), (9003, "### 123", None, "src1", 7)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.unionByName(odd, allowMissingColumns=True).union(docs.where("doc_id < 3"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns_and_rows_of_their_input(stages):
    docs, spoken, good, cut, apart, packed = stages
    assert all(x.columns == docs.columns for x in (spoken, good, cut, apart))
    rows = lambda x: Counter(map(str, x.collect()))
    assert not rows(spoken) - rows(docs) and not rows(good) - rows(spoken) and not rows(apart) - rows(cut)
    assert good.count() == cut.count()
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in spoken.collect()}
    assert lost == {9001, 9002, 9003}


def test_a_copy_of_each_large_group_keeps_its_text(spark):
    own = lambda i: "\n".join(f"{w} {i} stands here by itself in text {i}" for w in ("alpha", "beta", "gamma"))
    copies = [f"copied {k} one two three four five\nsecond line of copy {k} six seven eight" for k in range(2)]
    rows = [(i, f"menu\n{own(i)}", "s") for i in range(60)] + [(100 + 10 * k + j, copies[k], "s") for k in range(2) for j in range(8)]
    rows += [(300 + j, None, "s") for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    cut = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, docs, DATA).collect()}
    assert all(cut[i] == own(i) for i in range(60)) and all(cut[i] is None for i in range(300, 330))
    assert all(cut[100 + 10 * k + j] == copies[k] for k in range(2) for j in range(8))
    apart = corpus_pipeline.near_duplicates(spark, corpus_pipeline.without_boilerplate(spark, docs, DATA), DATA)
    assert sorted(r.text for r in apart.where("doc_id >= 100 and doc_id < 300").collect()) == copies
    lines = line_dedup.boilerplate_lines(docs, ratio=60 / 63, distinct_texts=True)  # 60 of 63 texts: not above the share
    assert lines.count() == 0 and line_dedup.boilerplate_lines(docs, ratio=0.95, distinct_texts=True).count() == 1


def test_one_document_of_each_class_stays_and_is_packed(stages):
    *_, cut, apart, packed = stages
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    classes = brute_classes(rows)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(classes.values()))
    assert {r.doc_id for r in packed.collect()} == set(classes.values())
    again = fit_packing.pack_documents(apart).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_queries_that_have_sql_give_its_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    from pagemill.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        ours, theirs = registry.queries()[name](spark, DATA), con.execute(sql)
        names = [d[0] for d in theirs.description]
        assert sorted(ours.columns) == sorted(names)
        assert Counter(map(tuple, ours.select(*names).collect())) == Counter(theirs.fetchall()), name
