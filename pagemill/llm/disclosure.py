"""Personal data: patterns, and an information-theoretic sanitisation of the words that reveal it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.staged import computed, let
from pagemill.llm.common import table
from pagemill.session import settled

#: What is found, in the order of spans that start together: the patterns' kinds, then the method's.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: Characters on each side of protected data whose words may reveal it.
WINDOW = 96
#: A word must stand by a protected entity in so many different texts.
SUPPORT = 2
#: Share of the information about an entity that a word may disclose: above the first it is generalised, above
#: the second removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Words whose document counts are wanted: broadcast up to so many, beyond that joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Spans whose places are summed up at a time.
CHUNK = 256

# The kinds as the job states them, written so that no character is tried from many starts and no repetition needs
# a stack: a run is taken whole (possessive), and from its first character only.
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    # After a match, the next may begin in the middle of a run.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal run of digits with single separators, if it has 14 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WORD = r"\p{L}{3,}+"
_SPAN = "array<struct<start:int,kind:int,end:int,entity:string,before:string,after:string,cut_before:boolean,cut_after:boolean>>"
_CONTEXT = "array<struct<entity:string,term:string,start:int,end:int>>"
_none = lambda kind: F.from_json(F.lit("[]"), kind)
_total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda t, x: t + x)


def _passes(kind: str, match: Column) -> Column:
    """Whether a match of a pattern is what it looks like."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    if kind == "card":
        # Luhn: from the right, every second digit is doubled, and its digits are added.
        def doubled(digits: Column) -> Column:
            digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
            worth = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
            return _total(worth) % 10 == 0

        return let(F.reverse(F.regexp_replace(match, "[ -]", "")), doubled)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    """What a match stands for, however it is written."""
    same = F.lower(match) if kind == "email" else match if kind == "ip" else F.regexp_replace(match, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), same)


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of int, in chunks, so that long arrays aren't copied for each element."""
    step = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"] + x)).alias("o"))
    start = F.expr("struct(0 as t, cast(array() as array<int>) as o)")
    chunks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK)), lambda a: F.aggregate(F.slice(lengths, a, F.lit(CHUNK)), start, step))

    def put(parts: Column) -> Column:
        ends = F.aggregate(F.transform(parts, lambda p: p["t"]), start, step)["o"]
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        return F.flatten(F.transform(parts, lambda p, i: F.transform(p["o"], lambda x: x + before(i))))

    return F.when(F.size(lengths) > 0, let(chunks, put)).otherwise(F.expr("cast(array() as array<int>)"))


def _spans(kind: str, text: Column) -> Column:
    """The pattern's spans of a text with the text around each: matches and what lies between them, in turn."""
    pattern = PATTERNS[kind]
    found = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def placed(own: Column) -> Column:
        lengths = F.transform(own["match"], lambda m, i: F.length(F.get(own["between"], i)) + F.when(i > 0, F.length(F.get(own["match"], i - 1))).otherwise(0))

        def spans(starts: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                before, after = F.get(own["between"], i), F.get(own["between"], i + 1)
                left = F.greatest(F.length(before) - WINDOW, F.lit(0))
                return F.struct(
                    F.get(starts, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(starts, i) + F.length(m)).alias("end"),
                    _entity(kind, m).alias("entity"), F.substring(before, left + 1, F.lit(WINDOW)).alias("before"), F.substring(after, 1, WINDOW).alias("after"),
                    (left > 0).alias("cut_before"), (F.length(after) > WINDOW).alias("cut_after"), m.alias("match"),
                )

            held = F.filter(F.transform(own["match"], span), lambda s: _passes(kind, s["match"]))
            return F.transform(held, lambda s: s.dropFields("match"))

        return let(running_sums(lengths), spans)

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(_none(_SPAN))


def _words(window: Column, offset: Column, entity: Column, cut_first: Column, cut_last: Column) -> Column:
    """The words of a window with their places; a word that the window's border may cut is left out."""

    def placed(own: Column) -> Column:
        sizes = lambda name, n: _total(F.transform(F.slice(own[name], F.lit(1), n), F.length))

        def word(w: Column, i: Column) -> Column:
            start = offset + sizes("gap", i + 1) + sizes("word", i)
            return F.struct(entity.alias("entity"), F.lower(w).alias("term"), start.alias("start"), (start + F.length(w)).alias("end"))

        whole = F.transform(own["word"], word)
        first = F.when(cut_first & (F.get(own["gap"], F.lit(0)) == ""), 2).otherwise(1)
        last = F.size(whole) - F.when(cut_last & (F.element_at(own["gap"], -1) == ""), 1).otherwise(0)
        return F.when(last >= first, F.slice(whole, first, last - first + 1)).otherwise(_none(_CONTEXT))

    return let(F.struct(F.split(window, WORD, -1).alias("gap"), F.regexp_extract_all(window, F.lit(WORD), F.lit(0)).alias("word")), placed)


def _contexts(spans: Column) -> Column:
    """The words around each span: ``entity, term, start, end``."""
    no = F.lit(False)
    around = lambda s: F.concat(
        _words(s["before"], s["start"] - F.length(s["before"]), s["entity"], s["cut_before"], no),
        _words(s["after"], s["end"], s["entity"], no, s["cut_after"]),
    )
    return F.when(F.size(spans) > 0, F.flatten(F.transform(spans, around))).otherwise(_none(_CONTEXT))


def _revealing(found: DataFrame, docs: DataFrame, support: int, least: float) -> DataFrame:
    """``entity, term, disclosure`` of the words that disclose at least ``least`` of an entity.

    Disclosure is pointwise mutual information over the entity's information, ln(N j / (t e)) / ln(N / e): of N
    documents, e hold the entity, t the word, and in j it stands by the entity. 1 means that whoever has the
    word has the entity.
    """
    n_docs = found.count()
    held = found.where("size(contexts) > 0")
    pair = F.explode(F.array_distinct(F.transform("contexts", lambda c: F.struct(c["entity"].alias("entity"), c["term"].alias("term")))))
    by_text = held.select(pair.alias("p"), "digest").groupBy("p.entity", "p.term", "digest").agg(F.count("*").alias("n"))
    joint = settled(by_text.groupBy("entity", "term").agg(F.sum("n").alias("j"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"))
    entities = held.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("e"))
    wanted = joint.select("term").distinct()
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    distinct = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower))
    terms = docs.where("text is not null").select(F.explode(distinct).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("t"))
    share = F.lit(1.0) - F.log(F.col("t") / F.col("j")) / F.log(F.lit(float(n_docs)) / F.col("e"))
    told = joint.join(entities, "entity").join(terms, "term").where(F.col("e") < n_docs)
    return told.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= least)


def find_spans(docs: DataFrame, keep: list[str], support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``row struct<keep...>, spans, terms`` of each row of ``docs``.

    ``spans`` are the patterns' matches and ``terms`` the words to generalise or to remove: arrays of
    structs that begin with ``start, kind, end`` (code points, ``kind`` a number in ``KINDS``), in order.

    Per kind, matches are leftmost and don't overlap; one that isn't valid is dropped and not tried again.
    Each match is a protected entity. The words within ``WINDOW`` characters of it, as far as the next match of
    its kind, are its context. Over all documents it is counted how often a word stands by an entity, how many
    documents hold either, and so how much of the entity the word discloses (see ``_revealing``). A
    word is only judged if it stands by the entity in ``support`` different texts, and only where it does.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"))
    rows = computed(rows, **{kind: _spans(kind, F.col("text")) for kind in PATTERNS})
    rows = computed(rows, spans=F.array_sort(F.concat(*PATTERNS)))
    found = rows.select(
        F.monotonically_increasing_id().alias("id"), "row", "spans", _contexts(F.col("spans")).alias("contexts"),
        F.when(F.size("spans") > 0, F.unhex(F.md5("text"))).alias("digest"),
    )
    found = settled(found)
    told = settled(_revealing(found, docs.select("text"), support, generalise))
    around = found.where("size(contexts) > 0").select("id", F.explode("contexts").alias("c")).select("id", "c.*")
    if told.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        told = F.broadcast(told)
    words = around.join(told, ["entity", "term"]).groupBy("id", "start", "end").agg(F.max("disclosure").alias("most"))
    kind = F.when(F.col("most") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    marked = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", kind.alias("kind"), "end"))).alias("terms")).withColumnRenamed("id", "of")
    joined = found.join(marked, found["id"] == marked["of"], "left")
    return joined.select("row", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"), F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).alias("terms"))


def described(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def _replaced(text: Column, spans: Column) -> Column:
    """The text with a label for each span; spans that overlap become one, with the label of the first."""
    label = lambda s: F.when(s["kind"] < 4, F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4])), F.least(s["kind"], F.lit(3)) + 1)).when(
        s["kind"] == KINDS.index("remove"), ""
    ).otherwise(F.when(F.substring(text, s["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), "[NAME]").otherwise("[WORD]"))
    start = F.expr("struct(0 as at, cast(array() as array<string>) as out)")

    def add(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        own = F.when(apart, F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], own).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, done)).otherwise(text)


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with ``sanitised string`` and ``spans string``: personal data and the words that reveal it are gone.

    Matches of the patterns become ``[EMAIL]``, ``[IP]``, ``[CARD]`` and ``[PHONE]``; words that disclose most of an
    entity are removed, others above the lower threshold generalised to ``[NAME]`` (capitalised) or ``[WORD]``. See
    ``find_spans``. A text without personal data stays as it is. Null and empty texts stay, without spans;
    repeated rows are treated alike; an empty table gives no rows; columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("sanitised", "spans")]
    found = find_spans(docs, kept, support, generalise, remove)
    every = F.array_sort(F.concat("spans", "terms"))
    whole = found.select("row", every.alias("every"))
    return whole.select("row.*", _replaced(F.col("row.text"), F.col("every")).alias("sanitised"), described(F.col("every")).alias("spans"))


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    base = F.sha2(described(F.col("spans")), 256).alias("base_sha256")
    return found.select("row.doc_id", *map(count, PATTERNS), base, described(F.array_sort(F.concat("spans", "terms"))).alias("spans"))


QUERIES = {"op12_disclosure": op12_disclosure}
#: The patterns as the job states them, for the SQL.
_STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _pieces_sql(source: str, text: str, pattern: str, keep: str) -> str:
    """Matches ``m`` of a pattern in a text with their places ``a, b``, and the columns ``keep`` of the source."""
    return f"""SELECT {keep}, m, CAST(e - length(m) AS BIGINT) AS a, CAST(e AS BIGINT) AS b FROM (
        SELECT {keep}, m, sum(length(gap) + length(m)) OVER (PARTITION BY {keep} ORDER BY i) AS e FROM (
          SELECT {keep}, unnest(regexp_extract_all({text}, '{pattern}')) AS m, unnest(regexp_split_to_array({text}, '{pattern}')[:-2]) AS gap,
                 unnest(range(len(regexp_extract_all({text}, '{pattern}')))) AS i
          FROM {source}))"""


SQL = {
    "op12_disclosure": f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  {" UNION ALL ".join(f"SELECT r, {k} AS k, m, a, b FROM ({_pieces_sql('docs', 'text', p, 'r')})" for k, p in enumerate(_STATED.values()))}
), sized AS (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM found
  WHERE k <> 2 OR length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19
), beside AS (
  SELECT *, coalesce(lag(b) OVER w, 0) AS lo, lead(a) OVER w AS hi FROM sized WINDOW w AS (PARTITION BY r, k ORDER BY a)
), spans AS MATERIALIZED (
  SELECT r, k, a, b, lo, hi,
    CASE k WHEN 0 THEN 'email:' || lower(m) WHEN 1 THEN 'ip:' || m WHEN 2 THEN 'card:' || digits ELSE 'phone:' || digits END AS entity
  FROM beside
  WHERE CASE k
    WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || substr(ltrim(p, '0'), 1, 3) AS INTEGER) > 255)) = 0
    WHEN 2 THEN list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INTEGER)
           WHEN CAST(digits[i] AS INTEGER) > 4 THEN CAST(digits[i] AS INTEGER) * 2 - 9 ELSE CAST(digits[i] AS INTEGER) * 2 END)) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END
), windows AS MATERIALIZED (
  SELECT row_number() OVER () AS w, * FROM (
    SELECT r, entity, greatest(lo, a - {WINDOW}) AS base, substr(text, greatest(lo, a - {WINDOW}) + 1, a - greatest(lo, a - {WINDOW})) AS part,
           a - {WINDOW} > lo AS cut_first, false AS cut_last
    FROM spans JOIN docs USING (r)
    UNION ALL
    SELECT r, entity, b, substr(text, b + 1, least(coalesce(hi, length(text)), b + {WINDOW}) - b), false, b + {WINDOW} < coalesce(hi, length(text))
    FROM spans JOIN docs USING (r))
), words AS (
  {_pieces_sql('windows', 'part', '\\p{L}{3,}', 'w')}
), contexts AS MATERIALIZED (
  SELECT DISTINCT r, entity, lower(m) AS term, base + a AS a, base + b AS b FROM words JOIN windows USING (w)
  WHERE NOT (cut_first AND a = 0) AND NOT (cut_last AND b = length(part))
), joint AS (
  SELECT entity, term, count(*) AS j FROM (SELECT DISTINCT r, entity, term FROM contexts) JOIN docs USING (r)
  GROUP BY entity, term HAVING count(DISTINCT text) >= {SUPPORT}
), entities AS (
  SELECT entity, count(DISTINCT r) AS e FROM spans GROUP BY entity
), terms AS (
  SELECT term, count(*) AS t FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '\\p{{L}}{{3,}}'), lambda x: lower(x)))) AS term FROM docs) GROUP BY term
), told AS (
  SELECT entity, term, 1.0 - ln(CAST(t AS DOUBLE) / j) / ln(CAST(n AS DOUBLE) / e) AS share
  FROM joint JOIN entities USING (entity) JOIN terms USING (term), (SELECT count(*) AS n FROM docs) WHERE e < n
), marked AS (
  SELECT r, a, b, CASE WHEN max(share) >= {REMOVE} THEN 5 ELSE 4 END AS k
  FROM contexts JOIN told USING (entity, term) WHERE share >= {GENERALISE} GROUP BY r, a, b
), every AS (
  SELECT r, k, a, b, ['email', 'ip', 'card', 'phone', 'generalise', 'remove'][k + 1] || ':' || a || ':' || b AS said
  FROM (SELECT r, k, a, b FROM spans UNION ALL SELECT r, k, a, b FROM marked)
), by_row AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(said, ',' ORDER BY a, k, b) FILTER (k < 4) AS base, string_agg(said, ',' ORDER BY a, k, b) AS spans
  FROM every GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_row USING (r)
"""
}
