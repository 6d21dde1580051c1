"""Spelling variants, reversed search and disclosure against brute force, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from pagemill.llm import disclosure, pivotal_grams, registry, reversed_search

SCHEMA = "doc_id bigint, text string, lang string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least_length=6, least_n=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = top if top and counts[top] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def worded(seed, n_docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abeéÿt", k=rng.randint(5, 9))) for _ in range(12)]
    texts = []
    for _ in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 150)):
            w = stems[min(int(rng.expovariate(0.6)), 11)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abe") + w[i:], w[:i] + rng.choice("abe") + w[i + 1 :]])
            words.append(rng.choice([w, w.capitalize()]))
        texts.append(rng.choice([" ", ", ", "1", "\n"]).join(words))
    return texts


def test_variants_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivotal_grams, "COUNTED", 50)
    rows = list(enumerate(worded(3)))
    rows += [(900, None), (901, ""), (None, "aaaaaaa " * 9), (902, "Aaaaaaa aaaaaaaa " * 30), rows[0], (903, "x" * 50_000 + " "), (904, "abcdefgh " * 300 + "abcdefghi " * 40 + "abcdefghij " * 6)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id bigint, text string, n string")
    got = pivotal_grams.group_variants(docs).collect()
    want = brute_variants(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(r.form for r in got) and any(r.root != r.form for r in got if r.form)
    assert pivotal_grams.group_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pivotal_grams.group_variants(docs, least_length=3)


def test_variants_broadcast_nothing(spark, no_broadcasts):
    rows = list(enumerate(worded(3)))
    got = pivotal_grams.group_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(r.form for r in got)


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choices("ab", k=rng.randint(4, 12)))
        count = {g: rng.randint(1, 9) for g in {a + b for a in "ab" for b in "ab"}}
        prefix, pivots = pivotal_grams.prefix_and_pivots(word, count)
        assert set(pivots) <= set(prefix) and pivots[1] - pivots[0] >= 2
        weight = lambda i: count[word[i : i + 2]]
        assert sum(map(weight, pivots)) == min(weight(i) + weight(j) for i in prefix for j in prefix if j - i >= 2)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(items, rows, k=10):
    docs = [(d, terms(t)) for d, t in rows if terms(t)]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, own in docs for t in set(own))
    out = []
    for item_id, text in set(items):
        found = []
        for doc_id, own in docs:
            tf = Counter(own)
            m = 100 - 90 + (90 * len(own) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in set(terms(text)) if tf[t]
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings, cells", [(200_000, 1 << 20), (7, 8)])
def test_ranks_are_those_of_all_pairs(spark, monkeypatch, postings, cells):
    monkeypatch.setattr(reversed_search, "CELLS", cells)
    rng = random.Random(9)
    word = lambda: rng.choice(["Ab", "ab", "cé", "CÉ", "x1", "漢字", "zz", "q", "w" * 300])
    rows = [(i, rng.choice([" ", "-", "\x7f"]).join(word() for _ in range(rng.randint(0, 20)))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, " . "), rows[5], (5, "ab"), (None, "ab cé"), (None, "ab cé"), (103, "zz " * 30_000)]
    items = [(1, "ab cé"), (2, "unheard"), (3, None), (4, ""), (5, "ZZ x1 zz"), (5, "q"), (5, "q"), (6, "漢字"), (None, "Ab, q!")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, score int")
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, rank int")
    got = reversed_search.rank_documents(asked, docs, postings=postings).collect()
    assert sorted(map(tuple, got), key=str) == brute_ranks(items, rows)
    assert reversed_search.rank_documents(asked, docs.limit(0)).count() == 0
    assert reversed_search.rank_documents(asked.limit(0), docs).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                key = m[0].lower() if kind == "email" else m[0] if kind == "ip" else digits
                out.append((m.start(), k, m.end(), f"{kind}:{key}"))
    return sorted(out)


def brute_spans(rows, window=96, support=2, low=0.75, high=0.9):
    """Base spans and words of each row, with a count of everything."""
    texts = [t or "" for _, t in rows]
    base = [brute_base(t) for t in texts]
    word = regex.compile(r"\p{L}{3,}+")
    contexts = []
    for text, spans in zip(texts, base):
        own = set()
        for kind, pattern in enumerate(BASE.values()):
            raw = [m.span() for m in re.finditer(pattern, text)]
            if kind == 2:
                raw = [(a, b) for a, b in raw if 14 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19]
            for i, (a, b) in enumerate(raw):
                entity = next((e for s, k, _, e in spans if (s, k) == (a, kind)), None)
                if entity is None:
                    continue
                left = raw[i - 1][1] if i else 0
                right = raw[i + 1][0] if i + 1 < len(raw) else len(text)
                lo, hi = max(left, a - window), min(right, b + window)
                for m in word.finditer(text[lo:a]):
                    if not (lo > left and m.start() == 0):
                        own.add((entity, m[0].lower(), lo + m.start(), lo + m.end()))
                for m in word.finditer(text[b:hi]):
                    if not (hi < right and m.end() == hi - b):
                        own.add((entity, m[0].lower(), b + m.start(), b + m.end()))
        contexts.append(own)
    n = len(rows)
    e = Counter(x for spans in base for x in {s[3] for s in spans})
    t = Counter(x for text in texts for x in {w.lower() for w in word.findall(text)})
    j, seen = Counter(), defaultdict(set)
    for text, own in zip(texts, contexts):
        for pair in {c[:2] for c in own}:
            j[pair] += 1
            seen[pair].add(text)
    share = {
        p: 1 - math.log(t[p[1]] / j[p]) / math.log(n / e[p[0]]) for p in j if len(seen[p]) >= support and e[p[0]] < n
    }
    out = []
    for spans, own in zip(base, contexts):
        most = {}
        for entity, term, a, b in own:
            if share.get((entity, term), 0) >= low:
                most[a, b] = max(most.get((a, b), 0), share[entity, term])
        out.append((spans, sorted((a, 5 if d >= high else 4, b) for (a, b), d in most.items())))
    return out


def private_rows():
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(n))
    odd = [
        "a.b@c.de_x@y.zz a@b a@b@c.com @x.y -@-.- é@é.é J.Doe+1@Mail.Example.COM.", "1.2.3.4.5.6.7.8.9 300.1.2.3.4 001.02.003.255 1.2.3 9999.1.1.1",
        "4539 1488 0343 6467 8 4539-1488-0343-6467 45391488034364670000 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "4539148803436467  4539148803436467-4539148803436467",
        "+1 (743) 555-3824 +44 20 7946 0958. ++1 2 3 4 5 6 7 8 9 0 +12 +1 (5) +123456789012345678 +1 743 555 3824 +49",
        "id4539148803436467x 4000000000000002 378282246310005 30569309025904",
    ]
    rows = [(i, filler(rng.randint(0, 60))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(odd)]
    for i in range(12):
        rows.append((200 + i, f"{filler(30)} Zacharias Quellbrunn lives near {filler(3)} ana.berg@mail.example.com {filler(2)} grand fjordhaus {filler(30)}"))
        rows.append((300 + i, f"{filler(9)} call {filler(1)} +1 (743) 555-3824 {filler(25)} fjordhaus {filler(4)}"))
    return rows + [rows[-1], (400, None), (401, ""), (None, "x@y.com"), (402, "9" * 3_000 + " 1" * 3_000 + ".a" * 3_000 + "b@" * 3_000), (403, "é 🙂 x@y.com 🙂 10.0.0.1")]


def test_spans_are_those_of_a_plain_count(spark, monkeypatch):
    rows = private_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, spans int")
    for chunk, terms_sent in ((256, 200_000), (2, 0)):
        monkeypatch.setattr(disclosure, "CHUNK", chunk)
        monkeypatch.setattr(disclosure, "BROADCAST_TERMS", terms_sent)
        got = disclosure.find_spans(docs, ["doc_id", "text"]).collect()
        own = lambda row: (str(row[0]), str(row[1]), str([tuple(s) for s in row[2]]), str([tuple(s) for s in row[3]]))
        want = [(d, t, [s[:3] for s in spans], words) for (d, t), (spans, words) in zip(rows, brute_spans(rows))]
        assert sorted(own((r.row.doc_id, r.row.text, r.spans, r.terms)) for r in got) == sorted(map(own, want))
    assert any(k == 5 for r in got for _, k, _ in r.terms) and any(k == 4 for r in got for _, k, _ in r.terms)
    assert all(not r.terms for r in got if not r.spans)


def test_sanitised_texts(spark):
    rows = private_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, spans int")
    got = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    assert got[400].sanitised is None and got[401].sanitised == "" and got[0].sanitised == rows[0][1]
    assert got[403].sanitised == "é 🙂 [EMAIL] 🙂 [IP]" and got[403].spans == "email:4:11,ip:14:22"
    assert all("Zacharias" not in r.sanitised and "ana.berg" not in r.sanitised and "[EMAIL]" in r.sanitised for d, r in got.items() if d in range(200, 212))
    assert disclosure.sanitise(docs.limit(0)).count() == 0


def test_very_long_runs(spark):
    texts = ["1 " * 300_000, "a" * 600_000, "a.b" * 200_000 + "@", "1." * 300_000, "+" + "1 " * 200_000 + "x", "a@" + "b." * 300_000 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.row.doc_id: [tuple(s) for s in r.spans] for r in disclosure.find_spans(docs, ["doc_id"]).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [(8 * i, 1, 8 * i + 7) for i in range(75_000)], 4: [], 5: [(0, 0, 600_003)]}


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    rows = disclosure.op12_disclosure(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    names = list(BASE)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("name", ["op11_pivotal_grams", "op12_disclosure", "op13_reversed_search"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    theirs = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    ours = registry.queries()[name](spark, sf)
    assert sorted(names) == sorted(ours.columns)
    rows = sorted(map(str, (tuple(r) for r in ours.select(names).collect())))
    assert rows == sorted(map(str, theirs.fetchall())) and rows
