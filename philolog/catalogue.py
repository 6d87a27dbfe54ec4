"""Registered queries of the engine and their DuckDB text.

Driver tables stand in for a corpus: documents for texts (lang, source), conversations for aligned
pairs (a user's turn and the assistant's next), labels for the split into target and reference.
Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from philolog.functions import text as X
from philolog.operators import collocation, concordance, exports, index, lists, neighbours, ordering, pages, parallel, postings, retrieval
from philolog.plans.query import may_hold, parse_brackets, parse_simple
from philolog.sources import intake, versions
from philolog.streaming import auditing, delivery

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("lang = 'en'")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_table(documents(spark, sf_dir))


def english_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_table(english(spark, sf_dir))


def english_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_table(english(spark, sf_dir))


def rounded(c: Column | str) -> Column:
    return F.round(c, 6)


#: CTE `tok`: the token table. Sentences are cut with a control character, as the dialect knows no look-behind.
TOK = r"""WITH sen AS (
  SELECT doc_id, lang, list_filter([trim(s) for s in string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?])["''”’)]* ', '\1' || chr(1), 'g'), chr(1))], lambda s: s <> '') AS ss
  FROM documents),
sn AS (SELECT doc_id, lang, unnest(ss) AS s, generate_subscripts(ss, 1) AS sno FROM sen),
sa AS (SELECT doc_id, lang, sno, s, regexp_extract_all(s, '\p{L}+(?:[''’\-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\p{L}\p{N}\s]') AS ts FROM sn),
tk AS (SELECT doc_id, lang, sno, unnest(ts) AS surface, generate_subscripts(ts, 1) AS spos, len(ts) AS slen FROM sa),
tok AS (
  SELECT doc_id, lang, sno, spos, slen, surface, replace(lower(surface), 'ß', 'ss') AS norm, regexp_full_match(surface, '[\p{P}\p{S}]+') AS punct,
    row_number() OVER (PARTITION BY doc_id ORDER BY sno, spos) AS p, count(*) OVER (PARTITION BY doc_id) AS dlen
  FROM tk)"""
EN = TOK.replace("FROM documents)", "FROM documents WHERE lang = 'en')")


def grams(n: int, where: str = "lang = 'en'") -> str:
    """CTE `g`: all runs of n tokens of a sentence."""
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.sno = t0.sno AND t{i}.spos = t0.spos + {i}" for i in range(1, n))
    part = lambda c: " || ' ' || ".join(f"t{i}.{c}" for i in range(n))
    each = ", ".join(f"t{i}.norm AS n{i}, t{i}.surface AS s{i}" for i in range(n))
    return f"""{TOK.replace("FROM documents)", f"FROM documents WHERE {where})")},
g AS (SELECT t0.doc_id, t0.p, {part("norm")} AS term, {part("surface")} AS display, {" OR ".join(f"t{i}.punct" for i in range(n))} AS has_punct, {each} FROM tok t0 {joins})"""


# ---- word lists and n-grams


@query(EN + """, w AS (SELECT norm AS term, min(surface) AS display, count(*) AS frequency, count(DISTINCT doc_id) AS document_range FROM tok WHERE NOT punct GROUP BY norm)
SELECT term, display, frequency, document_range, round(frequency * 1e6 / (SELECT sum(frequency) FROM w), 6) AS per_million, row_number() OVER (ORDER BY frequency DESC, document_range DESC, term) AS rank
FROM w ORDER BY rank LIMIT 50""")
def word_list_en(spark, sf_dir):
    """Top 50 of the static list."""
    rows = lists.word_list(english_terms(spark, sf_dir)).orderBy(*lists.list_order("frequency")).limit(50)
    return lists.ranked(rows, *lists.list_order("frequency")).withColumn("per_million", rounded("per_million"))


@query(TOK + """ SELECT lang AS language, norm AS normalized, min(surface) AS display, count(*) AS frequency, count(DISTINCT doc_id) AS document_range, CAST(min(punct::INT) AS BIGINT) AS is_punctuation FROM tok GROUP BY lang, norm""")
def word_totals(spark, sf_dir):
    return index.word_totals(index.term_table(documents(spark, sf_dir)))


@query(TOK + """ SELECT lang AS language, norm AS normalized, '' AS pos, min(surface) AS display, count(*) AS frequency, count(DISTINCT doc_id) AS document_range, CAST(min(punct::INT) AS BIGINT) AS is_punctuation FROM tok GROUP BY lang, norm""")
def word_frequencies(spark, sf_dir):
    return index.word_totals(index.term_table(documents(spark, sf_dir)), "pos")


@query(TOK + """ SELECT surface AS term, count(*) AS frequency, count(DISTINCT doc_id) AS document_range, round(count(*) * 1e6 / (SELECT count(*) FROM tok WHERE NOT punct), 6) AS per_million FROM tok WHERE NOT punct GROUP BY surface HAVING count(*) >= 2""")
def word_list_case(spark, sf_dir):
    """Dynamic list of surfaces, case kept."""
    return lists.dynamic_list(tokens(spark, sf_dir), case_sensitive=True, min_frequency=2).select("term", "frequency", "document_range", rounded("per_million").alias("per_million"))


@query(TOK + """, f AS (SELECT norm, doc_id, surface, p FROM tok WHERE NOT punct)
SELECT norm || '_' AS term, arg_min(surface, doc_id * 10000000 + p) AS display, count(*) AS frequency, count(DISTINCT doc_id) AS document_range FROM f GROUP BY norm""")
def word_list_pos_type(spark, sf_dir):
    return lists.dynamic_list(tokens(spark, sf_dir), kind="type_pos").select("term", "display", "frequency", "document_range")


@query(EN + """ SELECT norm AS term, count(*) AS frequency, count(DISTINCT doc_id) AS document_range, row_number() OVER (ORDER BY reverse(norm), norm) AS rank FROM tok WHERE NOT punct AND norm NOT IN ('the', 'of', 'and') GROUP BY norm HAVING count(*) >= 5 ORDER BY rank LIMIT 200""")
def word_list_end_sort(spark, sf_dir):
    """First 200 words read from their ends, with a stop list."""
    rows = lists.dynamic_list(english_terms(spark, sf_dir), stop=["the", "of", "and"], min_frequency=5).select("term", "frequency", "document_range")
    order = [F.reverse("term"), F.col("term")]
    return lists.ranked(rows.orderBy(*order).limit(200), *order)


@query(TOK + """ SELECT norm AS term, count(*) AS frequency, count(DISTINCT doc_id) AS document_range, round(count(*) * 1e6 / (SELECT count(*) FROM tok WHERE NOT punct), 6) AS per_million FROM tok WHERE NOT punct AND norm IN ('the', 'der', 'les', 'que') GROUP BY norm""")
def word_list_allow(spark, sf_dir):
    return lists.dynamic_list(tokens(spark, sf_dir), allow=["The", "der", "les", "que"]).select("term", "frequency", "document_range", rounded("per_million").alias("per_million"))


def _ngram_sql(n: int) -> str:
    return grams(n) + """, k AS (SELECT term, arg_min(display, doc_id * 10000000 + p) AS display, arg_min(has_punct, doc_id * 10000000 + p) AS hp, count(*) AS frequency, count(DISTINCT doc_id) AS document_range FROM g GROUP BY term)
SELECT term, display, frequency, document_range FROM k WHERE frequency >= 2 AND NOT hp"""


@query(_ngram_sql(2))
def ngrams_2(spark, sf_dir):
    return lists.ngrams(documents(spark, sf_dir), 2)


@query(_ngram_sql(3))
def ngrams_3(spark, sf_dir):
    return lists.ngrams(documents(spark, sf_dir), 3)


def _longer_sql(n: int) -> str:
    """As _ngram_sql, with windows in place of joins."""
    runs = lambda c: " || ' ' || ".join(f"lead({c}, {i}) OVER w" if i else c for i in range(n))
    marks = " OR ".join(f"lead(punct, {i}) OVER w" if i else "punct" for i in range(n))
    return EN + f""", r AS (SELECT doc_id, p, spos, slen, {runs("norm")} AS term, {runs("surface")} AS display, {marks} AS has_punct FROM tok WINDOW w AS (PARTITION BY doc_id, sno ORDER BY spos)),
k AS (SELECT term, arg_min(display, doc_id * 10000000 + p) AS display, arg_min(has_punct, doc_id * 10000000 + p) AS hp, count(*) AS frequency, count(DISTINCT doc_id) AS document_range FROM r WHERE spos + {n - 1} <= slen GROUP BY term)
SELECT term, display, frequency, document_range FROM k WHERE frequency >= 2 AND NOT hp"""


@query(_longer_sql(4))
def ngrams_4(spark, sf_dir):
    return lists.ngrams(documents(spark, sf_dir), 4)


@query(_longer_sql(5))
def ngrams_5(spark, sf_dir):
    return lists.ngrams(documents(spark, sf_dir), 5)


@query(_longer_sql(3).replace("NOT hp", "NOT hp AND contains(lower(display), 'thing')"))
def ngrams_containing(spark, sf_dir):
    """Runs of three that hold a given text."""
    return lists.ngrams(documents(spark, sf_dir), 3, contains="Thing")


@query(grams(3) + """, v AS (SELECT n0 || ' <*> ' || n2 AS pattern, s1, count(*) AS n FROM g WHERE NOT has_punct GROUP BY ALL),
d AS (SELECT n0 || ' <*> ' || n2 AS pattern, count(DISTINCT doc_id) AS document_range FROM g WHERE NOT has_punct GROUP BY ALL),
k AS (SELECT pattern, sum(n)::BIGINT AS frequency, count(*) AS variants, sum(n * log2(n)) AS s FROM v GROUP BY pattern)
SELECT pattern, frequency, document_range, variants, round(variants / frequency, 6) AS type_token_ratio, round(log2(frequency) - s / frequency, 6) AS entropy FROM k JOIN d USING (pattern) WHERE frequency >= 3""")
def open_slot(spark, sf_dir):
    rows = lists.open_slot_ngrams(documents(spark, sf_dir), 3, 2, min_frequency=3)
    return rows.withColumns({"type_token_ratio": rounded("type_token_ratio"), "entropy": rounded("entropy")})


def _cluster_sql(condition: str) -> str:
    return grams(3) + f""", q AS (SELECT * FROM g WHERE NOT has_punct), x AS (SELECT n1, n2, count(*) AS m FROM q GROUP BY ALL)
SELECT term, count(*) AS frequency, count(DISTINCT doc_id) AS document_range, round(count(*) * 1e6 / (SELECT count(*) FROM tok), 6) AS per_million, round(count(*) / min(m), 6) AS transition_probability
FROM q JOIN x USING (n1, n2) WHERE {condition} GROUP BY term HAVING count(*) >= 2"""


def _clusters(spark, sf_dir, side):
    rows = lists.clusters(documents(spark, sf_dir), "the", side=side)
    return rows.select("term", "frequency", "document_range", rounded("per_million").alias("per_million"), rounded("transition_probability").alias("transition_probability"))


@query(_cluster_sql("n0 = 'the'"))
def clusters_left(spark, sf_dir):
    return _clusters(spark, sf_dir, "left")


@query(_cluster_sql("n2 = 'the'"))
def clusters_right(spark, sf_dir):
    return _clusters(spark, sf_dir, "right")


@query(TOK + """ SELECT lang AS language, count(DISTINCT norm) AS types, count(*) AS tokens FROM tok GROUP BY lang""")
def type_counts(spark, sf_dir):
    per = index.word_totals(tokens(spark, sf_dir))
    return per.groupBy("language").agg(F.count(F.lit(1)).alias("types"), F.sum("frequency").alias("tokens"))


@query(TOK + """ SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(len([x for x in string_split_regex(trim(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')), '\\n\\s*\\n+') if trim(x) <> ''])) FROM documents)::BIGINT AS paragraphs,
(SELECT count(*) FROM sn) AS sentences, count(*) AS tokens, count(DISTINCT lang || chr(1) || norm) AS types FROM tok""")
def corpus_counts(spark, sf_dir):
    return index.corpus_counts(documents(spark, sf_dir))


@query(f"""SELECT * FROM ({_SQL['corpus_counts']}), (SELECT count(DISTINCT source) AS files FROM documents), (SELECT count(*) AS pairs FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'), (SELECT sum(chunks)::BIGINT AS chunks FROM (__CHUNKS__))""")
def build_counts(spark, sf_dir):
    """All counters of a build; sources stand in for files."""
    files, chunks = table(spark, sf_dir, "documents").select("source").where("source is not null").distinct(), retrieval.build_chunks(documents(spark, sf_dir))
    return index.build_counts(files, documents(spark, sf_dir), pairs(spark, sf_dir), chunks)


@query(TOK + """ SELECT doc_id AS document_id, count(DISTINCT sno) AS sentences, count(*) AS tokens FROM tok GROUP BY doc_id""")
def sentence_counts(spark, sf_dir):
    rows = index.sentence_table(documents(spark, sf_dir)).where(F.size("tokens") > 0)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size("tokens").cast("long")).alias("tokens"))


@query(r"""SELECT doc_id AS document_id, CAST(len([x for x in string_split_regex(trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')), '\n\s*\n+') if trim(x) <> '']) AS BIGINT) AS paragraphs FROM documents""")
def para_counts(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.size(X.paragraphs(F.coalesce("text", F.lit("")))).cast("long").alias("paragraphs"))


@query(TOK + """ SELECT doc_id AS document_id, count(*) AS tokens, sum(length(surface))::BIGINT AS letters, max(p)::BIGINT AS last_position FROM tok GROUP BY doc_id""")
def token_offsets(spark, sf_dir):
    """Offsets fit the stream: letters are the sum of end - start."""
    rows = index.token_table(documents(spark, sf_dir), offsets=True)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("document_end") - F.col("document_start")).cast("long").alias("letters"), F.max("stream_position").alias("last_position"))


@query(TOK + """ SELECT doc_id AS document_id, count(*) AS tokens, min(r) AS first_position, max(r) AS last_position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id, p) AS r FROM tok) GROUP BY doc_id""")
def global_positions(spark, sf_dir):
    counts = index.word_counts(documents(spark, sf_dir))
    before = F.col("tokens_before_document")
    return counts.join(index.document_offsets(counts, ids(spark, sf_dir)), "document_id").select("document_id", F.col("n").alias("tokens"), (before + 1).alias("first_position"), (before + F.col("n")).alias("last_position"))


# ---- concordances


def _context_sql(length: int, extra: str = "") -> str:
    return f"""SELECT h.doc_id AS document_id, h.p AS stream_position, string_agg(CASE WHEN t.p < h.p THEN t.surface END, ' ' ORDER BY t.p) AS left_context,
  string_agg(CASE WHEN t.p >= h.p AND t.p < h.p + {length} THEN t.surface END, ' ' ORDER BY t.p) AS keyword, string_agg(CASE WHEN t.p >= h.p + {length} THEN t.surface END, ' ' ORDER BY t.p) AS right_context{extra}
FROM h JOIN tok t ON t.doc_id = h.doc_id AND t.p BETWEEN h.p - 5 AND h.p + {length + 4} GROUP BY h.doc_id, h.p"""


def _kwic_columns(rows: DataFrame, *extra: str) -> DataFrame:
    blank = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("left_context", "keyword", "right_context")]
    return rows.select("document_id", "stream_position", *blank, *extra)


@query(EN + ", h AS (SELECT doc_id, p FROM tok WHERE norm = 'thing') " + _context_sql(1))
def kwic_word(spark, sf_dir):
    return _kwic_columns(concordance.Kwic("Thing").hits(documents(spark, sf_dir)))


@query(EN + ", h AS (SELECT a.doc_id, a.p FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.p = a.p + 1 WHERE a.norm = 'of' AND b.norm = 'the') " + _context_sql(2))
def kwic_phrase(spark, sf_dir):
    return _kwic_columns(concordance.Kwic("of the").hits(documents(spark, sf_dir)))


@query(EN + """, h AS (SELECT a.doc_id, a.p, l.norm AS l1, r.norm AS r1 FROM tok a LEFT JOIN tok l ON l.doc_id = a.doc_id AND l.p = a.p - 1 LEFT JOIN tok r ON r.doc_id = a.doc_id AND r.p = a.p + 1 WHERE a.norm = 'with')
SELECT doc_id AS document_id, p AS stream_position, l1 AS "L1", r1 AS "R1", row_number() OVER (ORDER BY r1 IS NULL, r1, l1 IS NULL, l1, doc_id, p) AS rank FROM h ORDER BY rank LIMIT 500""")
def kwic_sorted(spark, sf_dir):
    """First 500 lines by R1, then L1."""
    rows = concordance.Kwic("with", sort_keys=["R1", "L1"]).hits(documents(spark, sf_dir))
    order = concordance.sort_columns(["R1", "L1"])
    return lists.ranked(rows.select("document_id", "stream_position", "L1", "R1").orderBy(*order).limit(500), *order)


@query(EN + """, h AS (SELECT a.doc_id, a.p, r.norm AS r1 FROM tok a LEFT JOIN tok r ON r.doc_id = a.doc_id AND r.p = a.p + 1 WHERE a.norm = 'with')
SELECT doc_id AS document_id, p AS stream_position, r1 AS "R1", count(*) OVER (PARTITION BY r1) AS kpf FROM h""")
def kwic_kpf(spark, sf_dir):
    return concordance.Kwic("with", sort_keys=["R1"], by_frequency=True).hits(documents(spark, sf_dir)).select("document_id", "stream_position", "R1", "kpf")


@query(TOK + """, n AS (SELECT doc_id, lang, p, norm, row_number() OVER (ORDER BY doc_id, p) AS gp FROM tok)
SELECT doc_id AS document_id, p AS stream_position, gp AS global_position FROM n WHERE lang = 'en' AND norm = 'the' ORDER BY (gp * 1103515245 + 42) & 2147483647, gp LIMIT 100""")
def kwic_sample(spark, sf_dir):
    """A seeded sample of 100 hits."""
    return concordance.Kwic("the", sample=100, seed=42).hits(documents(spark, sf_dir)).select("document_id", "stream_position", "global_position")


@query(EN + """, h AS (SELECT doc_id, p FROM tok WHERE norm = 'thing')
SELECT doc_id AS document_id, p AS stream_position FROM h WHERE EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = h.doc_id AND t.norm IN ('the', 'of') AND t.p BETWEEN h.p - 3 AND h.p + 3 AND t.p <> h.p)""")
def kwic_context(spark, sf_dir):
    """Hits with one of two words within three tokens."""
    rows = english_tokens(spark, sf_dir)
    hits = concordance.phrase_hits(rows, parse_simple("thing"))
    return concordance.filter_by_context(hits, rows, [*parse_simple("the"), *parse_simple("of")], low=-3, high=3).select("document_id", "stream_position")


@query(EN + """, h AS (SELECT doc_id, p FROM tok WHERE norm = 'thing')
SELECT doc_id AS document_id, p AS stream_position FROM h WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.doc_id = h.doc_id AND t.norm IN ('the', 'of') AND t.p BETWEEN h.p - 3 AND h.p + 3 AND t.p <> h.p)""")
def kwic_context_excluded(spark, sf_dir):
    rows = english_tokens(spark, sf_dir)
    hits = concordance.phrase_hits(rows, parse_simple("thing"))
    return concordance.filter_by_context(hits, rows, [*parse_simple("the"), *parse_simple("of")], low=-3, high=3, exclude=True).select("document_id", "stream_position")


@query(EN + """ SELECT DISTINCT doc_id AS document_id, p AS stream_position, CAST(1 AS BIGINT) AS token_length FROM tok WHERE norm IN ('thing', 'there') OR norm LIKE 'thin%'""")
def kwic_query_list(spark, sf_dir):
    """The union of three queries; a hit of several comes once."""
    hits = [concordance.row_hits(english(spark, sf_dir), parse_simple(q)) for q in ("thing", "there", "thin*")]
    return concordance.union_hits(hits).select("document_id", "stream_position", F.col("token_length").cast("long").alias("token_length"))


@query(EN + """, n AS (SELECT doc_id, p, norm, lead(norm, 2) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM tok) SELECT doc_id AS document_id, p AS stream_position FROM n WHERE norm = 'the' AND after = 'of'""")
def cqp_slot(spark, sf_dir):
    return concordance.row_hits(english(spark, sf_dir), parse_brackets('"the" [] "of"')).select("document_id", "stream_position")


@query(EN + """, n AS (SELECT doc_id, p, norm, lead(norm) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM tok) SELECT doc_id AS document_id, p AS stream_position FROM n WHERE norm LIKE 'th%ing' AND after LIKE '%er'""")
def cqp_wildcard(spark, sf_dir):
    return concordance.row_hits(english(spark, sf_dir), parse_brackets('[word="th*ing"] ends_with(er)')).select("document_id", "stream_position")


@query(EN + """ SELECT a.doc_id AS document_id, CAST(a.p - 1 AS BIGINT) AS stream_position FROM tok a WHERE a.norm = 'thing' AND a.p > 1 AND a.p < a.dlen""")
def cqp_outer_slots(spark, sf_dir):
    return concordance.row_hits(english(spark, sf_dir), parse_brackets('[] [lemma="thing"] []')).select("document_id", "stream_position")


@query(EN + """ SELECT doc_id AS document_id, p AS stream_position, surface FROM tok WHERE regexp_full_match(surface, '(?i)(th|wh)[a-z]{9,}ing')""")
def regex_tokens(spark, sf_dir):
    hits = concordance.row_hits(english(spark, sf_dir), parse_simple("(th|wh)[a-z]{9,}ing", regular=True), width=1)
    return hits.select("document_id", "stream_position", F.col("keyword").alias("surface"))


#: CTE `off`: every token of an English stream with its offsets; a token pattern as in TOK.
_OFFSETS = EN.split(",\nsn AS")[0] + r""",
st AS (SELECT doc_id, array_to_string(ss, chr(10)) AS stream FROM sen),
x AS (SELECT doc_id, stream, regexp_extract_all(stream, '{T}') AS ts, string_split_regex(stream, '{T}') AS gs FROM st WHERE {W}),
y AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS p, unnest(gs[1:len(ts)]) AS g, len(ts) AS n FROM x),
off AS (SELECT doc_id, p, n, t, sum(length(g) + length(t)) OVER (PARTITION BY doc_id ORDER BY p)::BIGINT AS e, e - length(t) AS s FROM y)"""
_OFFSETS = _OFFSETS.replace("{T}", r"\p{L}+(?:[''’\-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\p{L}\p{N}\s]")
#: Control characters mark words' ends, as the dialect's \b and \w know ASCII alone.
_MARKED = r"regexp_replace(stream, '([\p{L}\p{N}\p{M}_]+)', chr(1) || '\1' || chr(2), 'g')"
_SPAN = r"(?i)\x01thing\x02[^\x01\x02]+\x01[^\x01\x02]+ing\x02"


@query(_OFFSETS.replace("{W}", "contains(lower(stream), 'thing')") + f""", m AS (SELECT doc_id, regexp_extract_all({_MARKED}, '{_SPAN}') AS ms, string_split_regex({_MARKED}, '{_SPAN}') AS rest FROM x),
u AS (SELECT doc_id, unnest([translate(a, chr(1) || chr(2), '') for a in ms]) AS text, unnest([translate(a, chr(1) || chr(2), '') for a in rest[1:len(ms)]]) AS gap, generate_subscripts(ms, 1) AS k FROM m),
v AS (SELECT doc_id, text, sum(length(gap) + length(text)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS z, z - length(text) AS a FROM u)
SELECT v.doc_id AS document_id, a::INT AS start, z::INT AS "end", v.text, min(p) AS stream_position, count(*) AS token_length FROM v JOIN off ON off.doc_id = v.doc_id AND s < z AND e > a GROUP BY ALL""")
def full_regex_hits(spark, sf_dir):
    """A pattern over whole streams, which may cross tokens and sentences."""
    return concordance.pattern_hits(documents(spark, sf_dir), r"\bthing\b\W+\w+ing\b").select("document_id", "start", "end", "text", "stream_position", "token_length")


@query(_OFFSETS.replace("{W}", "contains(lower(stream), 'thing')") + r""", h AS (SELECT doc_id, p, s, e, least(n, p + 5) AS z, greatest(1, p - 5) AS a FROM off WHERE lower(t) = 'thing')
SELECT h.doc_id AS document_id, 'en' AS language, h.p AS stream_position, CAST(1 AS INT) AS token_length, trim(regexp_replace(substr(stream, f.s + 1, h.s - f.s), '\s+', ' ', 'g')) AS "left", substr(stream, h.s + 1, h.e - h.s) AS keyword, trim(regexp_replace(substr(stream, h.e + 1, l.e - h.e), '\s+', ' ', 'g')) AS "right"
FROM h JOIN off f ON f.doc_id = h.doc_id AND f.p = h.a JOIN off l ON l.doc_id = h.doc_id AND l.p = h.z JOIN st ON st.doc_id = h.doc_id""")
def kwic_snippets(spark, sf_dir):
    """Contexts as they stand in the text."""
    return concordance.snippets(english(spark, sf_dir), parse_simple("thing"))


@query(EN + """, h AS (SELECT count(*) AS n FROM tok WHERE norm = (SELECT norm FROM (SELECT norm, count(*) AS n, min(doc_id * 10000000 + p) AS f FROM tok WHERE NOT punct GROUP BY norm ORDER BY n DESC, f LIMIT 1)))
SELECT norm AS term, count(*) AS frequency, (SELECT n FROM h) AS hits FROM tok WHERE NOT punct GROUP BY norm ORDER BY count(*) DESC, min(doc_id * 10000000 + p) LIMIT 1""")
def validation_sample(spark, sf_dir):
    """The most frequent word has as many hits as its frequency says."""
    rows = english_tokens(spark, sf_dir)
    top = rows.where(~F.col("is_punctuation")).groupBy("normalized").agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct("document_id", "stream_position")).alias("first")).orderBy(F.desc("frequency"), "first").limit(1)
    hits = rows.join(F.broadcast(top.select("normalized")), "normalized", "left_semi").agg(F.count(F.lit(1)).alias("hits"))  # one row
    return top.crossJoin(hits).select(F.col("normalized").alias("term"), "frequency", "hits")


# ---- statistics


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Token tables of documents labelled good and bad."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = documents(spark, sf_dir).join(labels, "doc_id")
    return tuple(index.token_table(docs.where(F.col("quality") == q)) for q in (1, 0))


@query(TOK + """, w AS (SELECT norm AS term, count(*) FILTER (quality = 1) AS tf, count(*) FILTER (quality = 0) AS rf FROM tok JOIN labels USING (doc_id) WHERE NOT punct AND quality IN (0, 1) GROUP BY norm),
s AS (SELECT sum(tf)::DOUBLE AS nt, sum(rf)::DOUBLE AS nr FROM w),
e AS (SELECT *, nt * (tf + rf) / (nt + nr) AS e1, nt * (nt + nr - tf - rf) / (nt + nr) AS e2, nr * (tf + rf) / (nt + nr) AS e3, nr * (nt + nr - tf - rf) / (nt + nr) AS e4 FROM w, s WHERE greatest(tf, rf) >= 5),
k AS (SELECT term, tf AS target_frequency, rf AS reference_frequency,
  2 * (CASE WHEN tf > 0 THEN tf * ln(tf / e1) ELSE 0 END + CASE WHEN nt > tf THEN (nt - tf) * ln((nt - tf) / e2) ELSE 0 END + CASE WHEN rf > 0 THEN rf * ln(rf / e3) ELSE 0 END + CASE WHEN nr > rf THEN (nr - rf) * ln((nr - rf) / e4) ELSE 0 END) AS ll,
  (tf - e1)**2 / e1 + (nt - tf - e2)**2 / e2 + (rf - e3)**2 / e3 + (nr - rf - e4)**2 / e4 AS x2,
  log2((CASE WHEN tf = 0 THEN 0.5 ELSE tf END / nt) / (CASE WHEN rf = 0 THEN 0.5 ELSE rf END / nr)) AS lr FROM e)
SELECT term, target_frequency, reference_frequency, round(ll, 4) AS log_likelihood, round(x2, 4) AS chi_square, round(lr, 6) AS log_ratio FROM k WHERE lr >= 0""")
def keywords(spark, sf_dir):
    rows = lists.keywords(*_split(spark, sf_dir), min_frequency=5)
    return rows.select("term", "target_frequency", "reference_frequency", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("chi_square", 4).alias("chi_square"), rounded("log_ratio").alias("log_ratio"))


_COLLOCATES = EN + """, c AS (
  SELECT t.norm, t.surface, t.doc_id, t.spos < h.spos AS is_left FROM tok h JOIN tok t ON t.doc_id = h.doc_id AND t.sno = h.sno AND t.spos BETWEEN h.spos - 3 AND h.spos + 3 AND t.spos <> h.spos WHERE h.norm = 'thing' AND NOT t.punct),
o AS (SELECT norm AS term, min(surface) AS display, count(*) AS frequency, count(*) FILTER (is_left) AS left_frequency, count(*) FILTER (NOT is_left) AS right_frequency, count(DISTINCT doc_id) AS document_range FROM c GROUP BY norm HAVING count(*) >= 2),
f AS (SELECT norm AS term, count(*) AS corpus_frequency FROM tok WHERE NOT punct GROUP BY norm),
j AS (SELECT *, (SELECT count(*) FROM c) AS r, (SELECT count(*) FROM tok WHERE NOT punct) AS size FROM o JOIN f USING (term)),
k AS (SELECT *, least(frequency, r, corpus_frequency)::DOUBLE AS o11 FROM j),
m AS (SELECT *, greatest(size, r + corpus_frequency - o11)::DOUBLE AS n FROM k),
x AS (SELECT *, r - o11 AS o12, corpus_frequency - o11 AS o21, n - r - corpus_frequency + o11 AS o22, r * corpus_frequency / n AS e11, r * (n - corpus_frequency) / n AS e12, (n - r) * corpus_frequency / n AS e21, (n - r) * (n - corpus_frequency) / n AS e22 FROM m)
SELECT term, display, frequency, left_frequency, right_frequency, document_range, corpus_frequency, round(log2(o11 / e11), 6) AS mi, round((o11 - e11) / sqrt(o11), 6) AS t_score, round(14 + log2(2 * o11 / (r + corpus_frequency)), 6) AS log_dice,
  round(2 * o11 / (r + corpus_frequency), 6) AS dice, round(log2(o11**2 / e11), 6) AS mi2, round(log2(o11**3 / e11), 6) AS mi3, round(least(o11 / r, o11 / corpus_frequency), 6) AS minimum_sensitivity, round(o11 / e11, 6) AS mu,
  round((n - r) * o11 / (r * CASE WHEN o21 = 0 THEN 0.5 ELSE o21 END), 6) AS rrf, round(o11 / r - o21 / (n - r), 6) AS drf, round((o11 - e11) / sqrt(e11), 6) AS z_score, round(log2((o11 / r) / (CASE WHEN o21 = 0 THEN 0.5 ELSE o21 END / (n - r))), 6) AS log_ratio,
  round((o11 - e11)**2 / e11 + (o12 - e12)**2 / e12 + (o21 - e21)**2 / e21 + (o22 - e22)**2 / e22, 4) AS chi_square,
  round(2 * (o11 * ln(o11 / e11) + CASE WHEN o12 > 0 THEN o12 * ln(o12 / e12) ELSE 0 END + CASE WHEN o21 > 0 THEN o21 * ln(o21 / e21) ELSE 0 END + CASE WHEN o22 > 0 THEN o22 * ln(o22 / e22) ELSE 0 END), 4) AS log_likelihood FROM x"""


@query(_COLLOCATES)
def collocates(spark, sf_dir):
    held = english(spark, sf_dir).where(may_hold(F.col("text"), parse_simple("thing")))
    rows = collocation.collocates(english_tokens(spark, sf_dir), "thing", left=3, right=3, min_frequency=2, within=index.token_table(held))
    exact = ["term", "display", "frequency", "left_frequency", "right_frequency", "document_range", "corpus_frequency"]
    six = ["mi", "t_score", "log_dice", "dice", "mi2", "mi3", "minimum_sensitivity", "mu", "rrf", "drf", "z_score", "log_ratio"]
    return rows.select(*exact, *[rounded(c).alias(c) for c in six], *[F.round(c, 4).alias(c) for c in ("chi_square", "log_likelihood")])


_PLOT = EN + """, b AS (SELECT doc_id, CASE WHEN dlen = 1 THEN 0 ELSE least(49, floor((p - 1) * 49 / (dlen - 1))) END::BIGINT AS bin FROM tok WHERE norm = 'thing'),
c AS (SELECT doc_id, bin, count(*) AS hits FROM b GROUP BY ALL)"""


@query(_PLOT + " SELECT doc_id AS document_id, bin, hits FROM c")
def plot_bins(spark, sf_dir):
    return collocation.plot_bins(english_tokens(spark, sf_dir), "thing", 50)


@query(_PLOT + """, t AS (SELECT doc_id, sum(hits)::BIGINT AS h FROM c GROUP BY doc_id)
SELECT doc_id AS document_id, h AS hits, round(CASE WHEN h <= 1 THEN 0.0 ELSE greatest(0, least(1, 1 - (sum(abs(hits / h - 1 / 50)) + (50 - count(*)) / 50) / (2 * (1 - 1 / 50)))) END, 6) AS dispersion FROM c JOIN t USING (doc_id) GROUP BY doc_id, h""")
def dispersion(spark, sf_dir):
    rows = collocation.dispersion(collocation.plot_bins(english_tokens(spark, sf_dir), "thing", 50), 50)
    return rows.withColumn("dispersion", rounded("dispersion"))


@query(EN + """ SELECT doc_id AS document_id, count(*) AS tokens, count(*) FILTER (norm = 'thing') AS hits, count(*) FILTER (norm = 'the') AS overlay_hits, round(count(*) FILTER (norm = 'thing') * 1e6 / count(*), 6) AS per_million FROM tok GROUP BY doc_id HAVING count(*) FILTER (norm IN ('thing', 'the')) > 0""")
def plot_documents(spark, sf_dir):
    rows = collocation.plot(english_tokens(spark, sf_dir), "thing", "the", 20)
    return rows.select("document_id", "tokens", "hits", "overlay_hits", rounded("per_million").alias("per_million"))


@query(EN + """, w AS (SELECT norm AS term, count(*) AS frequency, count(DISTINCT doc_id) AS document_range FROM tok WHERE NOT punct AND norm NOT IN ('the', 'of') GROUP BY norm ORDER BY frequency DESC, document_range DESC, term LIMIT 100)
SELECT *, round(18 + 54 * (ln(1 + frequency) - (SELECT ln(1 + min(frequency)) FROM w)) / ((SELECT ln(1 + max(frequency)) FROM w) - (SELECT ln(1 + min(frequency)) FROM w)), 2) AS font_size FROM w""")
def wordcloud_terms(spark, sf_dir):
    return lists.cloud_terms(lists.word_list(english_terms(spark, sf_dir)), 100, ["the", "of"])


@query()
def wordcloud_layout(spark, sf_dir):
    """Places of the 60 largest terms, worked out on the driver."""
    rows = lists.cloud_terms(lists.word_list(english_terms(spark, sf_dir)), 60).orderBy(*lists.list_order("frequency")).collect()
    placed = lists.cloud_layout([(r["term"], r["frequency"], r["font_size"]) for r in rows])
    return spark.createDataFrame([tuple(p.values()) for p in placed], "term string, frequency long, font_size double, x double, y double, color string")


# ---- pairs

PAIRS = """WITH pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS pair_no, a.text AS a_text, b.text AS b_text, 'sentence' AS alignment_unit, 'conv' || (a.conv_id % 7) || '.tsv' AS filename, ((a.conv_id * 7 + a.turn * 13) % 110) / 100 AS confidence
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"""


def pairs(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a_text"))
    b = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b_text"))
    name = F.concat(F.lit("conv"), (F.col("conv_id") % 7).cast("string"), F.lit(".tsv"))
    sure = (F.col("conv_id") * 7 + F.col("turn") * 13) % 110 / 100
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_no"), "a_text", "b_text", F.lit("sentence").alias("alignment_unit"), name.alias("filename"), sure.alias("confidence"))


@query(PAIRS + """ SELECT pair_no, filename, round(confidence, 6) AS confidence FROM pairs WHERE contains(replace(lower(a_text), 'ß', 'ss'), 'the') AND NOT contains(replace(lower(b_text), 'ß', 'ss'), 'thing') AND contains(lower(filename), 'conv') AND confidence >= 0.2""")
def parallel_contains(spark, sf_dir):
    q = parallel.PairQuery("the", b_lacks="thing", filename_has="CONV", min_confidence=0.2)
    return parallel.matching_pairs(pairs(spark, sf_dir), q).select("pair_no", "filename", rounded("confidence").alias("confidence"))


_OCCUR = PAIRS + """, o AS (SELECT pair_no, unnest(range(1, CAST(floor((length(f) - length(replace(f, 'the', ''))) / 3) AS BIGINT) + 1)) AS occurrence_ordinal FROM (SELECT pair_no, replace(lower(a_text), 'ß', 'ss') AS f FROM pairs))"""


@query(_OCCUR + " SELECT pair_no, occurrence_ordinal FROM o")
def parallel_occurrences(spark, sf_dir):
    return parallel.occurrences(pairs(spark, sf_dir), parallel.PairQuery("the")).select("pair_no", F.col("occurrence_ordinal").cast("long").alias("occurrence_ordinal"))


@query(_OCCUR + ", n AS (SELECT *, row_number() OVER (ORDER BY pair_no, occurrence_ordinal) AS r FROM o) SELECT pair_no, occurrence_ordinal FROM n WHERE (r - 1) % 5 = 0")
def parallel_nth(spark, sf_dir):
    """Every fifth occurrence."""
    return parallel.occurrences(pairs(spark, sf_dir), parallel.PairQuery("the", every=5)).select("pair_no", F.col("occurrence_ordinal").cast("long").alias("occurrence_ordinal"))


_TOKEN_SQL = r"\p{L}+(?:[''’\-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\p{L}\p{N}\s]"


@query(PAIRS + f""", o AS (SELECT pair_no, a_text, string_split(lower(a_text), 'the') AS parts FROM pairs),
v AS (SELECT pair_no, a_text, unnest([CAST(list_sum([length(y) for y in parts[1:k]]) AS BIGINT) + 3 * (k - 1) for k in range(1, len(parts))]) AS st FROM o),
w AS (SELECT *, row_number() OVER (PARTITION BY pair_no ORDER BY st) AS occurrence_ordinal FROM v WHERE NOT (st > 0 AND regexp_matches(substr(a_text, st, 1), '\\p{{L}}')) AND NOT regexp_matches(substr(a_text, st + 4, 1), '\\p{{L}}')),
x AS (SELECT *, regexp_extract_all(substr(a_text, 1, st), '{_TOKEN_SQL}') AS l, regexp_extract_all(substr(a_text, st + 4), '{_TOKEN_SQL}') AS r FROM w)
SELECT pair_no, CAST(occurrence_ordinal AS INT) AS occurrence_ordinal, CASE WHEN len(l) > 5 THEN '…' ELSE '' END || array_to_string(l[greatest(1, len(l) - 4):], ' ') AS "left", substr(a_text, st + 1, 3) AS keyword, array_to_string(r[1:5], ' ') || CASE WHEN len(r) > 5 THEN '…' ELSE '' END AS "right",
  replace(lower(l[-1]), 'ß', 'ss') AS "L1", 'the' AS "CEN", replace(lower(r[1]), 'ß', 'ss') AS "R1" FROM x""")
def parallel_context(spark, sf_dir):
    """Whole-word occurrences with contexts and sort keys."""
    q = parallel.PairQuery("the", whole_words=True)
    return parallel.with_context(parallel.occurrences(pairs(spark, sf_dir), q), q).select("pair_no", "occurrence_ordinal", "left", "keyword", "right", "L1", "CEN", "R1")


@query(PAIRS + " SELECT pair_no, a_text, b_text FROM pairs ORDER BY pair_no LIMIT 20")
def parallel_preview(spark, sf_dir):
    """The first 20 pairs."""
    return pairs(spark, sf_dir).orderBy("pair_no").limit(20).select("pair_no", "a_text", "b_text")


_STOP = ", ".join(f"'{w}'" for w in X.ENGLISH_STOPWORDS)


@query(PAIRS + f""", b AS (SELECT pair_no, contains(replace(lower(a_text), 'ß', 'ss'), 'the')::INT AS hit, b_text FROM pairs),
t AS (SELECT pair_no, hit, unnest([replace(lower(x), 'ß', 'ss') for x in regexp_extract_all(b_text, '{_TOKEN_SQL}')]) AS surface FROM b),
k AS (SELECT pair_no, hit, surface, CASE WHEN length(surface) > 4 AND surface LIKE '%ies' THEN left(surface, -3) || 'y' WHEN length(surface) > 4 AND regexp_matches(surface, '(ch|sh|x|z|ss)es$') THEN left(surface, -2)
  WHEN length(surface) > 3 AND regexp_matches(surface, '[^isu]s$') THEN left(surface, -1) ELSE surface END AS key FROM t WHERE length(surface) >= 3 AND surface NOT IN ({_STOP})),
n AS (SELECT sum(hit) AS m, sum(1 - hit) AS g FROM b),
d AS (SELECT key, sum(hit) AS mk, sum(1 - hit) AS gk FROM (SELECT DISTINCT pair_no, hit, key FROM k) GROUP BY key),
s AS (SELECT key, ln(((mk + 0.5) / (m - mk + 0.5)) / ((gk + 0.5) / (g - gk + 0.5))) * ln(1 + mk) AS score FROM d, n WHERE m >= 5 AND g > 0 AND mk >= 0.2 * m),
r AS (SELECT key, score FROM s WHERE score >= 3 QUALIFY score >= 0.55 * max(score) OVER () AND row_number() OVER (ORDER BY score DESC, key DESC) <= 2),
f AS (SELECT key, surface, round(any_value(score), 6) AS score, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, length(surface) DESC, surface) AS place FROM r JOIN k USING (key) WHERE hit = 1 GROUP BY key, surface)
SELECT key, surface, score, CAST(place AS INT) AS place FROM f WHERE place <= 4""")
def highlight_terms(spark, sf_dir):
    return parallel.infer_highlights(pairs(spark, sf_dir), parallel.PairQuery("the")).select("key", "surface", rounded("score").alias("score"), "place")


_AUDIT = PAIRS + r""", n AS (SELECT *, trim(regexp_replace(lower(a_text), '\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(b_text), '\s+', ' ', 'g')) AS b,
  length(regexp_replace(a_text, '[\p{P}\p{S}\s]', '', 'g')) AS ua, len(regexp_extract_all(b_text, '[\p{L}\p{N}]+')) AS ub FROM pairs),
w AS (SELECT *, min(pair_no) OVER (PARTITION BY a, b) AS fp, first_value(b) OVER (PARTITION BY a ORDER BY pair_no) AS ft, CASE WHEN ua > 0 AND ub > 0 THEN round(ub / ua, 4) END AS length_ratio FROM n),
f AS (SELECT pair_no, confidence, length_ratio, a = '' OR b = '' AS r1, fp < pair_no AND a <> '' AND b <> '' AS r2, ft <> b AND a <> '' AND b <> '' AS r3, confidence < 0 OR confidence > 1 AS r4, confidence >= 0 AND confidence < 0.6 AS r5, coalesce(length_ratio < 0.12 OR length_ratio > 1.8, false) AS r6 FROM w)"""


@query(_AUDIT + """ SELECT pair_no, length_ratio, array_to_string([x for x in [CASE WHEN r1 THEN 'empty_side' END, CASE WHEN r2 THEN 'duplicate_pair' END, CASE WHEN r3 THEN 'source_translation_variant' END, CASE WHEN r4 THEN 'invalid_confidence' END, CASE WHEN r5 THEN 'low_confidence' END, CASE WHEN r6 THEN 'length_ratio_outlier' END] if x IS NOT NULL], ',') AS reasons FROM f""")
def audit_flags(spark, sf_dir):
    return parallel.audit(pairs(spark, sf_dir)).select("pair_no", "length_ratio", F.array_join("reasons", ",").alias("reasons"))


@query(_AUDIT + """ SELECT count(*) AS total_pairs, count(*) FILTER (r1) AS empty_side_pairs, count(*) FILTER (r2) AS duplicate_pairs, count(*) FILTER (r3) AS translation_variants, count(*) FILTER (r4) AS invalid_confidence_pairs, count(*) FILTER (r5) AS low_confidence_pairs, count(*) FILTER (r6) AS length_ratio_outliers,
 count(*) FILTER (r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS anomalous_pairs, least(1000, count(*) FILTER (r1 OR r2 OR r3 OR r4 OR r5 OR r6)) AS written_anomalies, greatest(0, count(*) FILTER (r1 OR r2 OR r3 OR r4 OR r5 OR r6) - 1000) AS suppressed_anomalies, round(avg(confidence) FILTER (confidence BETWEEN 0 AND 1), 6) AS mean_confidence FROM f""")
def audit_summary(spark, sf_dir):
    return parallel.audit_summary(parallel.audit(pairs(spark, sf_dir)))


# ---- orders and exports


def _top(sql: str, order: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({sql}) ORDER BY rank LIMIT {k}"


def _ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return lists.ranked(rows.orderBy(*order).limit(k), *order)


@query(_top(_COLLOCATES, "mi DESC, frequency DESC, term", 50))
def collocates_by_mi(spark, sf_dir):
    """The 50 collocates of greatest mutual information."""
    return _ranked(collocates(spark, sf_dir), ordering.collocates("mi"), 50)


@query(_top(_COLLOCATES, "log_likelihood DESC, frequency DESC, term", 50))
def collocates_by_likelihood(spark, sf_dir):
    return _ranked(collocates(spark, sf_dir), ordering.collocates("log_likelihood"), 50)


@query(_top(_COLLOCATES, "term, frequency DESC", 50))
def collocates_by_term(spark, sf_dir):
    return _ranked(collocates(spark, sf_dir), ordering.collocates("term"), 50)


@query(_top(_SQL["keywords"].replace(" WHERE lr >= 0", ""), "abs(log_ratio) DESC, target_frequency DESC, term", 100))
def keywords_by_strength(spark, sf_dir):
    """The 100 words most typical of either side."""
    rows = lists.keywords(*_split(spark, sf_dir), min_frequency=5, negatives=True)
    rows = rows.select("term", "target_frequency", "reference_frequency", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("chi_square", 4).alias("chi_square"), rounded("log_ratio").alias("log_ratio"))
    return _ranked(rows, ordering.keywords("log_ratio"), 100)


@query(_top(_SQL["clusters_left"], "transition_probability DESC, frequency DESC, term", 100))
def clusters_by_probability(spark, sf_dir):
    return _ranked(clusters_left(spark, sf_dir), ordering.clusters("probability"), 100)


@query(_top(_SQL["ngrams_2"], "document_range DESC, frequency DESC, term", 100))
def ngrams_by_range(spark, sf_dir):
    return _ranked(ngrams_2(spark, sf_dir), ordering.runs("range"), 100)


@query(_top(_SQL["open_slot"], "pattern, frequency DESC", 100))
def slots_by_term(spark, sf_dir):
    return _ranked(open_slot(spark, sf_dir), ordering.runs("term", "pattern"), 100)


@query(_top(EN + """ SELECT doc_id AS document_id, count(*) AS tokens, count(*) FILTER (norm = 'thing') AS hits, count(*) FILTER (norm = 'the') AS overlay_hits, round(count(*) FILTER (norm = 'thing') * 1e6 / count(*), 6) AS per_million FROM tok GROUP BY doc_id""", "per_million DESC, document_id", 300))
def plot_by_frequency(spark, sf_dir):
    """The 300 documents with most hits for their length, those without any included."""
    rows = collocation.plot(english_tokens(spark, sf_dir), "thing", "the", 20, zero_hits=True)
    return _ranked(rows.select("document_id", "tokens", "hits", "overlay_hits", rounded("per_million").alias("per_million")), ordering.plots("normalized_frequency", invert=True), 300)


@query(_top(_SQL["parallel_context"], 'coalesce("R1", \'\'), coalesce("L1", \'\'), pair_no, occurrence_ordinal', 100))
def parallel_sorted(spark, sf_dir):
    """The first 100 whole-word occurrences by the words after and before."""
    return _ranked(parallel_context(spark, sf_dir), ordering.occurrences(["R1", "L1"]), 100)


@query(_OCCUR + ", x AS (SELECT pair_no, occurrence_ordinal, row_number() OVER (ORDER BY pair_no, occurrence_ordinal) AS r FROM o) SELECT pair_no, CAST(occurrence_ordinal AS INT) AS occurrence_ordinal, filename, a_text, b_text, alignment_unit, round(confidence, 6) AS confidence FROM x JOIN pairs USING (pair_no) WHERE (r - 1) % 3 = 0")
def parallel_export(spark, sf_dir):
    """Every third occurrence as an export writes it."""
    return exports.occurrence_rows(pairs(spark, sf_dir), parallel.PairQuery("the", every=3)).withColumn("confidence", rounded("confidence"))


_PLACES = EN + r""", g AS (SELECT doc_id, [x for x in string_split_regex(trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')), '\n\s*\n+') if trim(x) <> ''] AS ps FROM documents),
c AS (SELECT doc_id, [len(regexp_extract_all(x, '{T}')) for x in ps] AS ns FROM g), u AS (SELECT doc_id, unnest([coalesce(list_sum(ns[1:k - 1]), 0) for k in range(1, len(ns) + 1)]) AS ahead FROM c),
h AS (SELECT doc_id, p, sno FROM tok WHERE norm = 'thing'), f AS (SELECT h.doc_id, h.p, any_value(sno) AS sentence_no, count(*) AS paragraph_no FROM h JOIN u ON u.doc_id = h.doc_id AND ahead < p GROUP BY h.doc_id, h.p)""".replace("{T}", _TOKEN_SQL)


@query(_PLACES + " SELECT f.doc_id AS document_id, f.p AS stream_position, sentence_no, paragraph_no, source FROM f JOIN documents USING (doc_id)")
def kwic_places(spark, sf_dir):
    """Hits with their sentence, paragraph and document's source."""
    hits = concordance.Kwic("thing").hits(documents(spark, sf_dir), places=True)
    found = exports.with_metadata(hits, table(spark, sf_dir, "documents"), "source")
    return found.select("document_id", "stream_position", "sentence_no", "paragraph_no", "source")


@query(_PLACES + """, x AS (SELECT doc_id, p, sentence_no, paragraph_no, 'doc' || doc_id || '.txt' AS filename FROM f)
SELECT string_agg(CASE WHEN t.p < x.p THEN t.surface END, ' ' ORDER BY t.p) AS "left", max(CASE WHEN t.p = x.p THEN t.surface END) AS keyword, string_agg(CASE WHEN t.p > x.p THEN t.surface END, ' ' ORDER BY t.p) AS "right", filename, paragraph_no, sentence_no,
  max(CASE WHEN t.p = x.p - 3 THEN t.norm END) AS "L3", max(CASE WHEN t.p = x.p - 2 THEN t.norm END) AS "L2", max(CASE WHEN t.p = x.p - 1 THEN t.norm END) AS "L1", max(CASE WHEN t.p = x.p + 1 THEN t.norm END) AS "R1", max(CASE WHEN t.p = x.p + 2 THEN t.norm END) AS "R2", max(CASE WHEN t.p = x.p + 3 THEN t.norm END) AS "R3"
FROM x JOIN tok t ON t.doc_id = x.doc_id AND t.p BETWEEN x.p - 5 AND x.p + 5 GROUP BY x.doc_id, x.p, filename, paragraph_no, sentence_no""")
def kwic_export(spark, sf_dir):
    """All lines as an export writes them."""
    docs = documents(spark, sf_dir).withColumn("filename", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))
    rows = exports.line_rows(concordance.Kwic("thing", sort_keys=["R1"]), docs)
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("left", "right")})


# ---- retrieval

_BM = EN.replace("WHERE lang = 'en'", "") + """, t AS (SELECT doc_id, norm FROM tok WHERE length(norm) > 1 AND regexp_full_match(norm, '[\\p{L}\\p{N}]+')),
l AS (SELECT d.doc_id, count(t.norm) AS len FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id), a AS (SELECT avg(len) AS mean, count(*) AS n FROM l),
q AS (SELECT doc_id, norm, count(*) AS tf FROM t WHERE norm IN ('thing', 'the', 'for') GROUP BY ALL), d AS (SELECT norm, count(*) AS df FROM q GROUP BY norm),
s AS (SELECT q.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.0 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN d USING (norm) JOIN l USING (doc_id), a GROUP BY q.doc_id)"""


@query(_BM + " SELECT id, round(score, 6) AS score FROM s")
def bm25(spark, sf_dir):
    return retrieval.bm25(documents(spark, sf_dir), "The thing for").withColumn("score", rounded("score"))


def _first_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_DENSE = "SELECT vec_id AS id, round(list_cosine_similarity([x::DOUBLE for x in embedding], (SELECT [x::DOUBLE for x in embedding] FROM embeddings ORDER BY vec_id LIMIT 1)), 9) AS score FROM embeddings ORDER BY score DESC, id LIMIT 100"


@query(f"SELECT id, round(score, 6) AS score FROM ({_DENSE})")
def cosine_topk(spark, sf_dir):
    """The 100 vectors nearest to the first."""
    return retrieval.dense_search(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 100).withColumn("score", rounded("score"))


@query(_BM + f""", v AS ({_DENSE}), vr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS semantic_rank FROM v), lr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lexical_rank FROM (SELECT id, round(score, 9) AS score FROM s ORDER BY score DESC, id LIMIT 100))
SELECT id, CAST(semantic_rank AS INT) AS semantic_rank, CAST(lexical_rank AS INT) AS lexical_rank, round(coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + lexical_rank), 0), 6) AS score FROM vr FULL JOIN lr USING (id)
ORDER BY coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + lexical_rank), 0) DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST, id LIMIT 10""")
def rrf(spark, sf_dir):
    """The 10 best of the fusion of two lists of 100."""
    semantic = retrieval.dense_search(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 100)
    lexical = retrieval.ranked_scores(retrieval.bm25(documents(spark, sf_dir), "The thing for"), 100)
    return retrieval.fuse(semantic, lexical, 10).withColumn("score", rounded("score"))


@query("""WITH r AS (SELECT conv_id AS case_id, turn AS rank, turn AS id, conv_id % 97 AS latency_ms FROM conversations WHERE turn >= 1), x AS (SELECT DISTINCT conv_id AS case_id, 2 AS id FROM conversations UNION SELECT DISTINCT conv_id, 4 FROM conversations),
h AS (SELECT x.case_id, count(DISTINCT x.id) AS wanted, count(DISTINCT r.id) AS found, min(r.rank) AS first FROM x LEFT JOIN r ON r.case_id = x.case_id AND r.id = x.id AND r.rank <= 3 GROUP BY x.case_id),
l AS (SELECT case_id, max(latency_ms) AS ms FROM r GROUP BY case_id)
SELECT count(*) AS cases, round(avg(found / wanted), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, quantile_disc(coalesce(ms, 0), 0.95)::BIGINT AS p95_ms FROM h LEFT JOIN l USING (case_id)""")
def eval_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    results = turns.where("turn >= 1").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("rank"), F.col("turn").alias("id"), (F.col("conv_id") % 97).alias("latency_ms"))
    expected = turns.select(F.col("conv_id").alias("case_id")).distinct().withColumn("id", F.explode(F.array(F.lit(2), F.lit(4))))
    return retrieval.evaluate(results, expected, 3).withColumns({c: rounded(c) for c in ("recall", "mrr", "hit_rate")})


@query(r"""WITH RECURSIVE q AS (SELECT doc_id, unnest([trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split_regex(trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')), '\n\s*\n+') if trim(x) <> '']) AS rest FROM documents),
p AS (SELECT row_number() OVER () AS k, doc_id, rest FROM q WHERE rest <> ''),
c AS (SELECT k, doc_id, '' AS piece, rest, 0 AS n FROM p UNION ALL
  SELECT k, doc_id, trim(substr(rest, 1, cut)), trim(substr(rest, cut + 1)), n + 1 FROM (
    SELECT *, CASE WHEN length(rest) <= 1800 THEN length(rest) WHEN last <= 600 THEN 1800 ELSE last END AS cut FROM (
      SELECT *, list_max([1802 - strpos(reverse(substr(rest, 1, 1801)), m) for m in ['。', '！', '？', '!', '?', ';', '；', ',', '，', ' '] if contains(substr(rest, 1, 1801), m)]) AS last0, coalesce(last0, 0) AS last FROM c WHERE rest <> '')))
SELECT doc_id AS document_id, count(*) AS chunks, sum(length(piece))::BIGINT AS letters, CAST(max(length(piece)) AS INT) AS longest FROM c WHERE n > 0 GROUP BY doc_id""")
def chunk_counts(spark, sf_dir):
    rows = retrieval.build_chunks(documents(spark, sf_dir))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("letters"), F.max(F.length("text")).alias("longest"))


_SQL["build_counts"] = _SQL["build_counts"].replace("__CHUNKS__", _SQL["chunk_counts"])


# ---- intake, catalogue and delivery


@query(r"""WITH h AS (SELECT doc_id, substr(coalesce(text, ''), 1, 12000) AS s FROM documents), c AS (SELECT doc_id, s, len(regexp_extract_all(s, '[一-鿿]')) AS cjk, len(regexp_extract_all(s, '[A-Za-z]')) AS latin FROM h)
SELECT doc_id, CASE WHEN cjk >= greatest(20, latin * 2) THEN 'zh' WHEN latin >= greatest(20, cjk * 2) THEN 'en' WHEN cjk > 0 AND latin > 0 THEN 'mixed' ELSE 'unknown' END AS language FROM c""")
def detect_language(spark, sf_dir):
    head = documents(spark, sf_dir).select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, intake.SAMPLE).alias("s"))
    return head.select("doc_id", intake.detect_language(F.regexp_count("s", F.lit(intake.CJK)), F.regexp_count("s", F.lit(intake.LATIN))).alias("language"))


@query()
def classify(spark, sf_dir):
    files = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("filename"))
    return intake.classify(files).select("doc_id", "detected_type", "detected_language", "confidence", "title_guess", "date_guess", F.array_join("notes", ";").alias("notes"))


@query()
def classify_pages(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.col("url").alias("filename"))
    return intake.classify(files).select("page_id", "detected_type", "detected_language", "confidence")


@query("""WITH p AS (SELECT source, lang, count(*) AS files FROM documents WHERE lang IN ('en', 'fr') GROUP BY source, lang)
SELECT source AS pair_key, 'pair-' || lpad(CAST(row_number() OVER (ORDER BY source) AS VARCHAR), 4, '0') AS probable_pair_id, sum(files)::BIGINT AS files FROM p GROUP BY source HAVING count(*) = 2""")
def pair_detect(spark, sf_dir):
    """English and French documents of a source stand in for two languages of a folder."""
    docs = table(spark, sf_dir, "documents").where("lang in ('en', 'fr')")
    side = F.when(F.col("lang") == "en", "en").otherwise("zh")
    rows = docs.select(F.concat("source", F.lit(".txt")).alias("original_path"), side.alias("detected_language"), F.concat(F.lit("raw_"), side).alias("detected_type"), F.lit(0.78).alias("confidence"))
    return intake.detect_pairs(rows).where("pair_key is not null").groupBy("pair_key", "probable_pair_id").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def events_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return delivery.first_by_key(rows, "key", "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, CAST(least(3600, 5 * pow(2, least(greatest(event_id % 14 - 1, 0), 10))) AS BIGINT) AS delay, CASE WHEN event_id % 14 >= 12 THEN 'dead' ELSE 'pending' END AS status FROM events")
def retry_delay(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 14)
    return rows.select("event_id", delivery.retry_delay(F.col("n")).alias("delay"), F.when(F.col("n") >= delivery.ATTEMPTS, "dead").otherwise("pending").alias("status"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return delivery.latest_by_key(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def access_semi_join(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def access_policy(spark, sf_dir):
    """Rows that are open to all, or of a group, or granted one by one."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    group = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("in_group"))
    granted = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("granted", F.lit(True))
    seen = customers.join(F.broadcast(group), "c_nationkey", "left").join(granted, "c_custkey", "left")  # nations are 25
    return seen.where((F.col("c_mktsegment") == "BUILDING") | F.col("in_group") | F.col("granted")).select("c_custkey", "c_mktsegment")


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS cost, min(event_id) AS first_event FROM events GROUP BY event_type")
def ops_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("cost"), F.min("event_id").alias("first_event"))


_WANTED = ("running", "succeeded", "failed", "cancelled", "queued")


@query("""WITH w AS (SELECT user_id, ts, event_id, ['running', 'succeeded', 'failed', 'cancelled', 'queued'][event_id % 5 + 1] AS wanted FROM events)
SELECT user_id AS job_id, list_reduce(list_prepend('queued', list(wanted ORDER BY ts, event_id)), lambda s, x: CASE WHEN (s = 'queued' AND x IN ('running', 'cancelled')) OR (s = 'running' AND x IN ('succeeded', 'failed', 'cancelled', 'queued')) THEN x ELSE s END) AS state FROM w GROUP BY user_id""")
def job_states(spark, sf_dir):
    """Each user's events as wanted states of a job; an hour's events are one part."""
    rows = table(spark, sf_dir, "events")
    wanted = F.element_at(F.array(*map(F.lit, _WANTED)), (F.col("event_id") % len(_WANTED) + 1).cast("int"))
    return delivery.job_states(rows.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("seq"), wanted.alias("wanted")), F.date_trunc("hour", F.col("seq.ts")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Extension: event-time windows, here over a batch."""
    rows = delivery.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "1 hour", "event_type")
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


# ---- the stored positional index


def stored_index(spark: SparkSession, sf_dir: str) -> postings.PositionalIndex:
    return postings.of_documents(documents(spark, sf_dir), sf_dir)


@query(EN + ", h AS (SELECT a.doc_id, a.p FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.p = a.p + 1 WHERE a.norm = 'of' AND b.norm = 'the') " + _context_sql(2))
def index_phrase(spark, sf_dir):
    """kwic_phrase from the stored index."""
    return _kwic_columns(stored_index(spark, sf_dir).kwic("of the"))


@query(EN + ", h AS (SELECT a.doc_id, a.p FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.p = a.p + 2 WHERE a.norm LIKE 'th%' AND b.norm = 'of') " + _context_sql(3))
def index_wildcards(spark, sf_dir):
    """A wildcard, any token, and a word, from the stored index."""
    return _kwic_columns(stored_index(spark, sf_dir).kwic(parse_brackets("th* [] of")))


@query(_COLLOCATES)
def index_collocates(spark, sf_dir):
    rows = stored_index(spark, sf_dir).collocates("thing", left=3, right=3, min_frequency=2)
    exact = ["term", "display", "frequency", "left_frequency", "right_frequency", "document_range", "corpus_frequency"]
    six = ["mi", "t_score", "log_dice", "dice", "mi2", "mi3", "minimum_sensitivity", "mu", "rrf", "drf", "z_score", "log_ratio"]
    return rows.select(*exact, *[rounded(c).alias(c) for c in six], *[F.round(c, 4).alias(c) for c in ("chi_square", "log_likelihood")])


@query(_SQL["word_list_en"])
def index_word_list(spark, sf_dir):
    rows = stored_index(spark, sf_dir).word_list().orderBy(*lists.list_order("frequency")).limit(50)
    return lists.ranked(rows, *lists.list_order("frequency")).withColumn("per_million", rounded("per_million"))


@query(_PLOT + " SELECT doc_id AS document_id, bin, hits FROM c")
def index_plot_bins(spark, sf_dir):
    return stored_index(spark, sf_dir).plot_bins("thing")


# ---- an audit in batches


def _audited(spark: SparkSession, sf_dir: str) -> auditing.Audit:
    """All pairs in three batches, in the order of their numbers."""
    audit = auditing.Audit(spark, f"{versions.workspace(spark)}/audit-{uuid.uuid4().hex}", buckets=16)
    rows = pairs(spark, sf_dir)
    rows = rows.withColumn("_part", index.part_of(rows, "pair_no", 3))
    for k in range(3):
        audit.add(rows.where(F.col("_part") == k).drop("_part"), k)
    return audit


@query(_SQL["audit_flags"])
def audit_batches(spark, sf_dir):
    """audit_flags of three batches that follow each other."""
    return _audited(spark, sf_dir).flags().select("pair_no", "length_ratio", F.array_join("reasons", ",").alias("reasons"))


@query(_SQL["audit_summary"])
def audit_running_summary(spark, sf_dir):
    """audit_summary from the counts of three batches."""
    return _audited(spark, sf_dir).summary()


# ---- approximate neighbours


def _neighbour_index(spark: SparkSession, sf_dir: str) -> neighbours.NeighbourIndex:
    """Built anew: languages are dealt by label, as the table has none."""
    rows = table(spark, sf_dir, "embeddings")
    language = F.when(F.col("label") % 5 == 4, "zh_en").when(F.col("label") % 2 == 0, "en").otherwise("zh")
    return neighbours.build(rows.withColumn("language", language), f"{versions.workspace(spark)}/neighbours-{uuid.uuid4().hex}", language_col="language")


@query()
def neighbours_approximate(spark, sf_dir):
    """The 10 nearest other vectors of each whose id is divisible by 50, from the index."""
    return _neighbour_index(spark, sf_dir).search(table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0"), 10, others=True)


@query()
def neighbours_by_language(spark, sf_dir):
    """The same among vectors of one language and of pairs."""
    return _neighbour_index(spark, sf_dir).search(table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0"), 10, language="en", others=True)


# ---- pages and patterns


@query(EN + """, h AS (SELECT a.doc_id, a.p, l.norm AS l1, r.norm AS r1 FROM tok a LEFT JOIN tok l ON l.doc_id = a.doc_id AND l.p = a.p - 1 LEFT JOIN tok r ON r.doc_id = a.doc_id AND r.p = a.p + 1 WHERE a.norm = 'the')
SELECT doc_id AS document_id, p AS stream_position, l1 AS "L1", r1 AS "R1" FROM h ORDER BY r1 IS NULL, r1, l1 IS NULL, l1, doc_id, p LIMIT 100 OFFSET 300""")
def kwic_page(spark, sf_dir):
    """The fourth page of 100 lines by R1, then L1."""
    hits = concordance.Kwic("the", sort_keys=["R1", "L1"]).hits(documents(spark, sf_dir), only=["stream_position", "L1", "R1"]).select("document_id", "stream_position", "L1", "R1")
    return pages.page(hits, pages.concordance_keys(["R1", "L1"]), 4, 100, at_once=2000).rows


@query(EN + """, h AS (SELECT norm, count(*) AS kpf FROM tok GROUP BY norm)
SELECT doc_id AS document_id, p AS stream_position, norm AS "C", kpf FROM tok JOIN h USING (norm) WHERE norm LIKE 'th%' ORDER BY kpf DESC, norm, doc_id, p LIMIT 50 OFFSET 450""")
def kwic_page_by_frequency(spark, sf_dir):
    """The tenth page of 50 lines, frequent words first."""
    hits = concordance.Kwic("th*", sort_keys=["C"]).hits(documents(spark, sf_dir), only=["stream_position", "C"]).select("document_id", "stream_position", "C")
    return pages.page(concordance.pattern_frequency(hits, ["C"], spread=True), pages.concordance_keys(["C"], True), 10, 50, at_once=2000).rows


@query(EN + """ SELECT doc_id AS document_id, p AS stream_position, surface FROM tok WHERE regexp_full_match(surface, 'th(e|ing)+r?', 'i')""")
def pattern_tokens(spark, sf_dir):
    """A pattern tried on each distinct surface once."""
    return concordance.pattern_tokens(english_tokens(spark, sf_dir), "th(e|ing)+r?").select("document_id", "stream_position", "surface")


# ---- more measures

_MORE = _COLLOCATES[: _COLLOCATES.rindex("SELECT term, display")] + """SELECT term, frequency,
  round(greatest(0, abs(o11 - e11) - 0.5)**2 / e11 + greatest(0, abs(o12 - e12) - 0.5)**2 / e12 + greatest(0, abs(o21 - e21) - 0.5)**2 / e21 + greatest(0, abs(o22 - e22) - 0.5)**2 / e22, 4) AS chi_square_yates,
  round(2 * (o11 * ln(o11 / e11) + CASE WHEN o21 > 0 THEN o21 * ln(o21 / e21) ELSE 0 END), 4) AS log_likelihood_simple,
  2 * (o11 * ln(o11 / e11) + CASE WHEN o12 > 0 THEN o12 * ln(o12 / e12) ELSE 0 END + CASE WHEN o21 > 0 THEN o21 * ln(o21 / e21) ELSE 0 END + CASE WHEN o22 > 0 THEN o22 * ln(o22 / e22) ELSE 0 END) > 3.841458820694124 AS significant FROM x"""


@query(_MORE)
def collocates_significance(spark, sf_dir):
    """Corrected and simple statistics, and whether the p value is below 0.05, from the stored index."""
    rows = stored_index(spark, sf_dir).collocates("thing", left=3, right=3, min_frequency=2)
    return rows.select("term", "frequency", F.round("chi_square_yates", 4).alias("chi_square_yates"), F.round("log_likelihood_simple", 4).alias("log_likelihood_simple"), (F.col("p_value") < 0.05).alias("significant"))
