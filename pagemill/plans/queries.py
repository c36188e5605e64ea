"""The queries of the engine's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations, fitting, numeric, predicates, risk, scripts, text
from ..operators import batching, layout, render, sampling, scope, sections, spatial, tables, translate, units
from ..sources.synth import text_items
from ..streaming import limiter
from . import detection, more

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        _Q[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space as RE2 writes it, and the cache's class.
S = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x0b"
_LINES = f"""
lines AS (
  SELECT doc_id, i - 1 AS ord, trim(regexp_replace(l[i], '[{S}\\x{{200b}}]+', ' ', 'g'), ' ') AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
blocks AS (SELECT * FROM lines WHERE text <> '')"""
_NUMERIC_ONLY = rf"""(regexp_replace(regexp_replace({{t}}, '\b(n|N|p|P|r|R|NS|ns|NA|N/A|vs)\b', '', 'g'), '[\d{S}.,;:±+\-−–—%‰()\[\]{{}}<>=≤≥*∗†‡§¶#/×x^~≈]', '', 'g') = ''
  AND (regexp_matches({{t}}, '\d') OR regexp_matches({{t}}, '^[-−–—{S}]+$')))"""
_SKIP = rf"""CASE WHEN length({{t}}) < 2 THEN 'empty'
  WHEN regexp_matches({{t}}, '(?i)^(doi:?[{S}]*)?(https?://(dx\.)?doi\.org/)?10\.\d{{4,9}}/[^{S}]+$') THEN 'doi'
  WHEN regexp_matches({{t}}, '(?i)^(https?://[^{S}]+|www\.[^{S}]+)$') THEN 'url'
  WHEN regexp_matches({{t}}, '(?i)^[\w.+-]+@[\w-]+(\.[\w-]+)+$') THEN 'email'
  WHEN regexp_matches({{t}}, '^[\[(]?[{S}]*\d+([{S}]*[,;–-][{S}]*\d+)*[{S}]*[\])]?$') THEN 'citation-marker'
  WHEN regexp_matches({{t}}, '(?i)^(page[{S}]+)?\d{{1,4}}([{S}]+(of|/)[{S}]+\d{{1,4}})?$') THEN 'page-number'
  WHEN len(regexp_extract_all({{t}}, '[A-Za-z]')) < 3 THEN CASE WHEN {_NUMERIC_ONLY} THEN 'NUMERIC_ONLY' ELSE 'no-letters' END END"""
_CJK = r"[\x{2e80}-\x{2fdf}\x{3000}-\x{30ff}\x{3100}-\x{312f}\x{3190}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}]"
_TOKENS = f"ceil((length({{t}}) - len(regexp_extract_all({{t}}, '{_CJK}'))) / 4 + len(regexp_extract_all({{t}}, '{_CJK}')) * 1.2::DOUBLE)::BIGINT"


def _of(template: str, column: str) -> str:
    """A template's expression over a column."""
    return template.replace("{t}", column)


_ITEMS = """
items AS (
  SELECT doc_id, i - 1 AS item_id, (i - 1) // 50 + 1 AS page, l[i] AS text, 50.0::DOUBLE AS x, (742 - ((i - 1) % 50) * 12)::DOUBLE AS y,
    CASE WHEN (doc_id + i - 1) % 11 = 0 THEN 14.0 WHEN (doc_id + i - 1) % 7 = 0 THEN 8.5 ELSE 10.0 END::DOUBLE AS font_size
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


# ---------------------------------------------------------------- requests


@_query(
    f"""WITH RECURSIVE {_LINES},
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r, length(text) AS chars, {_of(_TOKENS, "text")} AS tokens FROM blocks WHERE ({_of(_SKIP, "text")}) IS NULL),
fold AS (
  SELECT doc_id, r, 0 AS batch, 1 AS cnt, chars AS total FROM kept WHERE r = 1
  UNION ALL
  SELECT k.doc_id, k.r, f.batch + (CASE WHEN f.cnt >= 25 OR f.total + k.chars > 10000 THEN 1 ELSE 0 END),
    CASE WHEN f.cnt >= 25 OR f.total + k.chars > 10000 THEN 1 ELSE f.cnt + 1 END,
    CASE WHEN f.cnt >= 25 OR f.total + k.chars > 10000 THEN k.chars ELSE f.total + k.chars END
  FROM fold f JOIN kept k ON k.doc_id = f.doc_id AND k.r = f.r + 1)
SELECT f.doc_id, f.batch, count(*)::BIGINT AS units, sum(k.chars)::BIGINT AS chars, (650 + sum(k.tokens + 12))::BIGINT AS tokens
FROM fold f JOIN kept k ON f.doc_id = k.doc_id AND f.r = k.r GROUP BY 1, 2"""
)
def doc_batch_plan(spark, sf_dir):
    return batching.batch_plan(_t(spark, sf_dir, "documents"))


@_query(f"SELECT doc_id, {_of(_TOKENS, 'text')} AS tokens, length(text)::BIGINT AS chars FROM documents")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("chars"))


@_query(f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS lines, count(DISTINCT text)::BIGINT AS keys, (count(*) - count(DISTINCT text))::BIGINT AS hits FROM blocks GROUP BY 1")
def cache_keys(spark, sf_dir):
    lines = batching.line_blocks(_t(spark, sf_dir, "documents"))
    per = lines.groupBy("doc_id", "text").agg(F.count("*").alias("n")).groupBy("doc_id")
    return per.agg(F.sum("n").alias("lines"), F.count("*").alias("keys")).select("doc_id", "lines", "keys", (F.col("lines") - F.col("keys")).alias("hits"))


@_query(f"WITH {_LINES} SELECT coalesce({_of(_SKIP, 'text')}, 'translate') AS kind, count(*)::BIGINT AS n FROM lines GROUP BY 1")
def untranslatable_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\n")).alias("raw"))
    kind = F.coalesce(predicates.skip_kind(text.normalize_cache_text(F.col("raw"))), F.lit("translate"))
    return lines.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_CELL = "CASE l_linenumber % 5 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN l_quantity::BIGINT::VARCHAR || ' ± ' || l_linenumber::VARCHAR WHEN 2 THEN l_returnflag WHEN 3 THEN 'n = ' || l_orderkey::VARCHAR ELSE l_quantity::BIGINT::VARCHAR || ' kg' END"


@_query(
    f"""WITH c AS (SELECT l_returnflag, {_CELL} AS cell FROM lineitem)
SELECT l_returnflag, count(*)::BIGINT AS cells, count(*) FILTER ({_of(_NUMERIC_ONLY, "cell")} OR regexp_matches(cell, '^(NA|NR|ND|NS|NE|NC)$') OR regexp_matches(cell, '^\\d+ [A-Za-z]{{1,2}}$'))::BIGINT AS numeric_cells,
  count(*) FILTER (regexp_matches(cell, '^[^A-Za-z]*(N|R|[nptrz])([^A-Za-z0-9]|$)') AND NOT regexp_matches(cell, '[A-Za-z][A-Za-z]'))::BIGINT AS notation
FROM c GROUP BY 1"""
)
def numeric_cells(spark, sf_dir):
    q = F.col("l_quantity").cast("long").cast("string")
    n = F.col("l_linenumber") % 5
    cell = F.when(n == 0, q).when(n == 1, F.concat(q, F.lit(" ± "), F.col("l_linenumber").cast("string"))).when(n == 2, F.col("l_returnflag")).when(n == 3, F.concat(F.lit("n = "), F.col("l_orderkey").cast("string"))).otherwise(F.concat(q, F.lit(" kg")))
    cells = _t(spark, sf_dir, "lineitem").select("l_returnflag", cell.alias("cell"))
    return cells.groupBy("l_returnflag").agg(F.count("*").alias("cells"), F.count_if(predicates.is_numeric_cell(F.col("cell"))).alias("numeric_cells"), F.count_if(predicates.is_stat_notation(F.col("cell"))).alias("notation"))


_WORDS = "', '".join(text.FUNCTION_WORDS)
_MARKERS = r"regexp_replace(regexp_replace({t}, '[SS]*[\[(][^\])]{0,60}[\])]$', ''), '[SS\"''”’)\]]+$', '')".replace("SS", S)


def _thrice(t: str) -> str:
    for _ in range(3):
        t = _of(_MARKERS, t)
    return t


_ABBR = r"(?i)\b(e\.g|i\.e|et al|etc|vs|cf|viz|fig|figs|eq|eqs|no|nos|vol|pp|approx|resp|ca|ibid|op\. cit|inc|ltd|co|dr|mr|mrs|ms|prof|jr|sr|st)\.$"


@_query(
    f"""WITH {_LINES},
m AS (SELECT text AS raw, {_thrice("text")} AS t FROM blocks),
w AS (SELECT *, replace(lower(regexp_extract(t, '([A-Za-z''’]+)$', 1)), '’', '''') AS word FROM m)
SELECT CASE WHEN regexp_matches(raw, '[.!?。！？]$') AND NOT regexp_matches(raw, '{_ABBR}') THEN 'terminal-punctuation' WHEN t = '' THEN 'only-markers'
  WHEN regexp_matches(t, '{_ABBR}') THEN 'abbreviation' WHEN regexp_matches(t, '[.!?。！？]$') THEN 'terminal-punctuation' WHEN regexp_matches(t, '[:;：；]$') THEN 'colon-or-semicolon'
  WHEN regexp_matches(t, '[,，、]$') THEN 'trailing-comma' WHEN regexp_matches(t, '[-–—]$') THEN 'trailing-dash' WHEN regexp_matches(t, '[(\\[{{“"]$') THEN 'open-bracket'
  WHEN word IN ('{_WORDS}') THEN 'ends-with-function-word:' || word ELSE 'no-terminal-punctuation' END AS reason, count(*)::BIGINT AS n
FROM w GROUP BY 1"""
)
def completeness(spark, sf_dir):
    lines = batching.line_blocks(_t(spark, sf_dir, "documents"))
    return lines.select(text.completeness(F.col("text"))["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@_query(
    r"""WITH l AS (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
a AS (SELECT doc_id, i - 1 AS ord, l[i] || CASE WHEN (doc_id + i) % 3 = 0 THEN '-' ELSE '' END AS a, lower(l[i + 1]) AS b FROM l),
q AS (SELECT doc_id, ord, regexp_replace(a, '[SS]+$', '') AS p, regexp_replace(b, '^[SS]+', '') AS n FROM a),
t AS (SELECT *, regexp_extract(p, '([^SS]+)-$', 1) AS token, regexp_replace(regexp_extract(p, '([^SS]+)-$', 1), '^[^A-Za-z0-9]+', '') AS core FROM q)
SELECT doc_id, ord::INTEGER AS ord, md5(CASE WHEN p = '' THEN n WHEN n = '' THEN p WHEN token = '' THEN p || ' ' || n
  WHEN regexp_matches(n, '^[a-z]') AND regexp_matches(core, '^[A-Za-z]{2,}$') AND lower(core) NOT IN ('well', 'self', 'cross', 'quasi', 'pseudo', 'ex', 'ill', 'so') THEN left(p, length(p) - 1) || n
  ELSE p || n END) AS joined FROM t""".replace("SS", S)
)
def hyphen_join(spark, sf_dir):
    lines = F.split("text", r"\n")
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(pairs).alias("ord", "p")).where("p.b IS NOT NULL")
    a = F.concat("p.a", F.when((F.col("doc_id") + F.col("ord") + 1) % 3 == 0, "-").otherwise(""))
    return each.select("doc_id", "ord", F.md5(text.join_fragments(a, F.lower("p.b"))).alias("joined"))


@_query(
    """SELECT doc_id, (2 * len(regexp_extract_all(text, '\\b[A-Z][A-Z0-9]{1,8}\\b')) + len(regexp_extract_all(text, '\\b[a-z]+-[a-z]+(?:-[a-z]+)?\\b'))
  + len(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:[\\s]+[A-Z][a-z]+)+\\b')))::BIGINT AS density FROM documents"""
)
def term_density(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", batching.term_density(F.col("text")).cast("long").alias("density"))


@_query(
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+'))::BIGINT AS emails,
  len(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+', ' ', 'g'), '(?:https?://|www\\.)[^SS<>"''）)\\]]+[^SS<>"''）)\\].,;:]'))::BIGINT AS urls FROM documents""".replace("SS", S)
)
def entity_counts(spark, sf_dir):
    found = dict(citations.PATTERNS[:2])
    rest = F.regexp_replace("text", found["EMAIL"], " ")
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(found["EMAIL"])).cast("long").alias("emails"), F.regexp_count(rest, F.lit(found["URL"])).cast("long").alias("urls"))


@_query(
    """WITH p AS (SELECT doc_id, doc_id % 90 + 1 AS k, CASE WHEN doc_id % 7 = 0 THEN doc_id % 90 + 2 ELSE doc_id % 90 + 1 END AS j FROM documents),
f AS (SELECT doc_id, k = j AS ok, CASE doc_id % 4 WHEN 0 THEN '[' || k || ']' WHEN 1 THEN '(Smith et al.,' || (1900 + k) || ')' WHEN 2 THEN 'Table ' || k ELSE '[' || k || ',' || (k + 2) || '-' || (k + 5) || ']' END AS a,
  CASE doc_id % 4 WHEN 0 THEN '[' || j || ']' WHEN 1 THEN '(Smith et al.,' || (1900 + j) || ')' WHEN 2 THEN 'Table ' || j ELSE '[' || j || ',' || (j + 2) || '-' || (j + 5) || ']' END AS b FROM p)
SELECT doc_id, ok, CASE WHEN ok THEN '' ELSE a END AS missing, CASE WHEN ok THEN '' ELSE b END AS added FROM f"""
)
def citation_diff(spark, sf_dir):
    k = F.col("doc_id") % 90 + 1
    j = F.when(F.col("doc_id") % 7 == 0, k + 1).otherwise(k)
    form = F.col("doc_id") % 4
    said = lambda n: n.cast("string")
    cited = lambda n: F.when(form == 0, F.concat(F.lit("["), said(n), F.lit("]"))).when(form == 1, F.concat(F.lit("(Smith et al., "), said(n + 1900), F.lit(")"))).when(form == 2, F.concat(F.lit("Table "), said(n))).otherwise(F.concat(F.lit("["), said(n), F.lit(", "), said(n + 2), F.lit("–"), said(n + 5), F.lit("]")))
    # the whole text, with a marker before and one after it, in two editions
    edition = lambda n: F.concat(F.lit("See "), cited(n), F.lit(": "), "text", F.lit(" and [3]."))
    diff = _t(spark, sf_dir, "documents").select("doc_id", citations.compare(edition(k), edition(j)).alias("d"))
    return diff.select("doc_id", "d.ok", F.array_join("d.missing", "|").alias("missing"), F.array_join("d.added", "|").alias("added"))


@_query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS a, CASE WHEN l_orderkey % 7 = 0 THEN l_quantity::BIGINT + 100 ELSE l_quantity::BIGINT END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a = b AS ok, CASE WHEN a = b THEN '' ELSE a || '|n=' || a END AS missing, CASE WHEN a = b THEN '' ELSE b || '|n=' || b END AS added FROM p"""
)
def number_diff(spark, sf_dir):
    a = F.col("l_quantity").cast("long")
    b = F.when(F.col("l_orderkey") % 7 == 0, a + 100).otherwise(a)
    said = lambda n: F.concat(F.lit("with 1,000 cases, n = "), n.cast("string"), F.lit(" at 5.0 %"))
    diff = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.compare(said(a), said(b)).alias("d"))
    return diff.select("l_orderkey", "l_linenumber", "d.ok", F.array_join("d.missing", "|").alias("missing"), F.array_join("d.added", "|").alias("added"))


@_query()
def numeric_signature(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").select("doc_id", numeric.signature(F.col("text")).alias("s"))
    return s.select("doc_id", F.array_join("s.numbers", "|").alias("numbers"), F.array_join("s.stats", "|").alias("stats"))


@_query(
    """WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)
SELECT CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'hard' WHEN 2 THEN 'hard' WHEN 3 THEN 'soft' ELSE 'hard' END AS level,
  CASE k WHEN 1 THEN 'NEGATION_WITH_OUTCOME' WHEN 2 THEN 'UNCERTAINTY_WITH_OUTCOME' WHEN 4 THEN 'NUMERIC_MISMATCH' ELSE '' END AS triggers, count(*)::BIGINT AS n
FROM p GROUP BY 1, 2"""
)
def risk_levels(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    source = F.when(k == 1, "There was no significant difference in mortality.").when(k == 2, "This may reduce risk by 15%.").when(k == 3, "This may reflect a habit.").when(k == 4, "A plain 7 here").otherwise("A plain line here")
    target = F.when(k == 2, "15%").when(k == 4, "8").otherwise("a")
    orders = _t(spark, sf_dir, "orders").select(source.alias("s"), target.alias("t"))
    no = F.lit(False)
    r = risk.assess(F.col("s"), F.col("t"), no, no, no, numeric.compare(F.col("s"), F.col("t"))["ok"], citations.compare(F.col("s"), F.col("t"))["ok"], F.lit(0))
    return orders.select(r.alias("r")).groupBy(F.col("r.level").alias("level"), F.array_join("r.triggers", "|").alias("triggers")).agg(F.count("*").alias("n"))


@_query(
    """WITH p AS (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT % 12 AS score, CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 4 WHEN '4' THEN 6 ELSE 8 END AS rank FROM orders),
b AS (SELECT greatest(1, ceil(count(*) * 0.30))::BIGINT AS budget, count(*) FILTER (rank < 3)::BIGINT AS critical FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY rank < 3 ORDER BY rank, score DESC, id) AS n FROM p)
SELECT id, score, rank < 3 OR n <= greatest(0, budget - critical) AS selected FROM r, b"""
)
def qa_selection(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    name = F.when(first == "1", risk.TRIGGERS[1]).when(first == "2", risk.TRIGGERS[3]).when(first == "3", risk.TRIGGERS[4]).when(first == "4", risk.TRIGGERS[6]).otherwise(risk.TRIGGERS[8])
    blocks = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), (F.floor("o_totalprice") % 12).cast("long").alias("score"), F.array(name).alias("triggers"))
    return batching.select_review(blocks, blocks.count(), 0.30).select("id", "score", "selected")


@_query(
    """WITH RECURSIVE t AS (SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 4 <> 0), p_partkey) AS r, p_partkey AS ord, lower(p_type) AS source, 'a' || p_partkey % 9 AS abbr, p_partkey % 4 <> 0 AS auto FROM part),
f AS (
  SELECT key, r, [source, abbr] AS taken, [ord] AS kept FROM t WHERE r = 1
  UNION ALL
  SELECT f.key, t.r, CASE WHEN list_contains(taken, source) OR (auto AND list_contains(taken, abbr)) THEN taken ELSE taken || [source, abbr] END,
    CASE WHEN list_contains(taken, source) OR (auto AND list_contains(taken, abbr)) THEN kept ELSE kept || [ord] END
  FROM f JOIN t ON f.key = t.key AND t.r = f.r + 1)
SELECT key, unnest(kept)::BIGINT AS ord FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1"""
)
def glossary_merge(spark, sf_dir):
    terms = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("source"), F.concat(F.lit("a"), (F.col("p_partkey") % 9).cast("string")).alias("abbreviation"), F.when(F.col("p_partkey") % 4 == 0, "user").otherwise("auto").alias("origin"))
    return batching.merge_terms(terms).select("key", F.col("ord").cast("long").alias("ord"))


@_query(
    """WITH w AS (SELECT DISTINCT lower(r_name) AS source FROM region UNION SELECT DISTINCT lower(left(n_name, 3)) FROM nation UNION SELECT 'tions' UNION SELECT 'the en'),
t AS (SELECT source, CASE WHEN length(source) > 3 AND source LIKE '%s' THEN left(source, length(source) - 1) ELSE source END AS stem FROM w)
SELECT d.doc_id AS id, t.source FROM documents d JOIN t ON contains(regexp_replace(lower(d.text), '[-SS]+', ' ', 'g'), regexp_replace(t.stem, '[-SS]+', ' ', 'g'))""".replace("SS", S)
)
def relevant_terms(spark, sf_dir):
    names = _t(spark, sf_dir, "region").select(F.lower("r_name").alias("source")).union(_t(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 3)))).union(spark.range(1).select(F.explode(F.array(F.lit("tions"), F.lit("the en"))))).distinct()
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return batching.relevant_terms(docs, names.withColumn("abbreviation", F.lit(None).cast("string")))


@_query(
    """WITH RECURSIVE n AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region),
f AS (SELECT name, 0 AS i, 2166136261::BIGINT AS h FROM n
  UNION ALL SELECT name, i + 1, ((xor(h, ascii(substr(name, i + 1, 1))::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT FROM f WHERE i < length(name))
SELECT name, lpad(lower(hex(h)), 8, '0') AS key FROM f WHERE i = length(name)"""
)
def fnv_keys(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(_t(spark, sf_dir, "region").select("r_name"))
    return names.select("name", text.fnv1a(F.col("name")).alias("key"))


@_query(
    """SELECT CASE WHEN grouping(event_type) = 1 THEN 'TOTAL' ELSE event_type END AS stage, count(*)::BIGINT AS requests, sum(event_id % 900)::BIGINT AS input, sum(user_id % 70)::BIGINT AS output,
  sum(event_id % 90)::BIGINT AS cached, (sum(event_id % 900) + sum(user_id % 70))::BIGINT AS processed FROM events GROUP BY ROLLUP(event_type)"""
)
def usage_rollup(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 900).alias("input"), (F.col("user_id") % 70).alias("output"), (F.col("event_id") % 90).alias("cached"))
    return batching.usage_rollup(events)


@_query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (
  SELECT user_id, event_id, secs, r, 1 AS cnt, secs + 86400 AS reset, TRUE AS allowed, NULL::INTEGER AS retry_after FROM e WHERE r = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.secs, e.r, CASE WHEN f.reset <= e.secs THEN 1 WHEN f.cnt + 1 > 3 THEN f.cnt ELSE f.cnt + 1 END, CASE WHEN f.reset <= e.secs THEN e.secs + 86400 ELSE f.reset END,
    f.reset <= e.secs OR f.cnt + 1 <= 3, CASE WHEN f.reset <= e.secs OR f.cnt + 1 <= 3 THEN NULL ELSE greatest(1, ceil(f.reset - e.secs))::INTEGER END
  FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, event_id, allowed, retry_after FROM f"""
)
def rate_limit(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), F.col("event_id").alias("seq"))
    got = limiter.admit_batch(events, (("day", 3, 86_400),))
    return got.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "allowed", "retry_after")


@_query(
    """WITH t AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS tr, regexp_matches(text, '[^\\s]') AS full_ FROM conversations),
m AS (SELECT conv_id, turn, lower(regexp_extract(tr, '.$')) AS last_char, length(tr) AS n FROM t)
SELECT conv_id, turn, n::BIGINT AS chars, lag(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS before_chars, lead(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS after_chars FROM m"""
)
def turn_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length(text.trim(F.col("text"))).cast("long")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("chars"), F.lag(n).over(w).alias("before_chars"), F.lead(n).over(w).alias("after_chars"))


@_query()
def turn_neighbours(spark, sf_dir):
    return batching.neighbour_context(_t(spark, sf_dir, "conversations")).drop("text")


@_query(
    """SELECT conv_id AS request, code, n FROM (
  SELECT conv_id, count(*)::BIGINT AS blocks, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) > 400)::BIGINT AS long_, (count(*) - count(DISTINCT turn))::BIGINT AS repeated FROM conversations GROUP BY 1) c,
  LATERAL (SELECT * FROM (VALUES ('too_many_blocks', blocks, blocks > 6), ('request_too_long', chars, chars > 3000), ('block_too_long', long_, long_ > 0), ('repeated_id', repeated, repeated > 0)) v(code, n, broken) WHERE broken)"""
)
def validation(spark, sf_dir):
    units = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("id"), "text")
    return scope.validation(units, 6, 400, 3000)


# ---------------------------------------------------------------- layout


@_query(
    f"""WITH {_ITEMS}, s AS (SELECT doc_id, floor(font_size * 2 + 0.5) / 2 AS size, sum(length(trim(text)))::BIGINT AS weight, min(item_id) AS first FROM items GROUP BY 1, 2)
SELECT doc_id, arg_max(size, weight * 1000000 - first) AS body_size FROM s WHERE size > 0 GROUP BY 1"""
)
def body_size(spark, sf_dir):
    return layout.body_font_size(text_items(_t(spark, sf_dir, "documents")))


@_query(
    """SELECT l_returnflag, l_extendedprice AS percentile FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
WHERE r = floor(0.9::DOUBLE * (n - 1))::BIGINT + 1"""
)
def floor_percentile(spark, sf_dir):
    return layout.floor_percentile(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.9)


@_query(
    f"""WITH {_ITEMS}, s AS (SELECT doc_id, floor(font_size * 2 + 0.5) / 2 AS size, sum(length(trim(text)))::BIGINT AS weight, min(item_id) AS first FROM items GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(size, weight * 1000000 - first) AS body FROM s WHERE size > 0 GROUP BY 1),
l AS (SELECT i.doc_id, page, CASE WHEN item_id % 2 = 0 THEN x ELSE 320 END AS x, CASE WHEN item_id % 2 = 0 THEN x ELSE 320 END + least(length(text) * 0.5 * font_size, 220 + length(text) % 3 * 40) AS r
  FROM items i JOIN b USING (doc_id) WHERE font_size >= body * 0.75 AND font_size <= body * 1.3 AND length(text) >= 3),
c AS (SELECT doc_id, page, count(*) FILTER (r <= 306)::BIGINT AS n_left, count(*) FILTER (x >= 306)::BIGINT AS n_right, count(*) FILTER (x < 306 AND r > 306)::BIGINT AS n_crossing FROM l GROUP BY 1, 2)
SELECT *, n_left >= 5 AND n_right >= 5 AND n_crossing <= n_left + n_right AS two_columns FROM c"""
)
def page_columns(spark, sf_dir):
    items = text_items(_t(spark, sf_dir, "documents"))
    odd = F.col("item_id") % 2 == 1
    lines = items.withColumn("x", F.when(odd, F.lit(320.0)).otherwise(F.col("x"))).withColumn("width", F.least("width", 220 + F.length("text") % 3 * 40))
    return layout.page_columns(lines, layout.body_font_size(items))


_WORD_ITEMS = """
words AS (
  SELECT doc_id, k AS item_id, 1 AS page, 700.0::DOUBLE - (k // 8) * 12 AS y, w[k + 1] AS text, 10.0::DOUBLE AS font_size, length(w[k + 1]) * 5.0::DOUBLE AS width, 50.0 + (k % 8) * 60 + (k % 3) * 7.0 AS x
  FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS k FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))"""


def _word_items(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "text"))
    return words.select("doc_id", F.col("k").cast("long").alias("item_id"), F.lit(1).alias("page"), (F.lit(700.0) - F.floor(F.col("k") / 8) * 12).alias("y"), "text", F.lit(10.0).alias("font_size"), (F.length("text") * 5.0).alias("width"), (50.0 + (F.col("k") % 8) * 60 + (F.col("k") % 3) * 7.0).cast("double").alias("x"))


@_query(
    f"""WITH {_WORD_ITEMS}, r AS (SELECT *, max(x + width) OVER (PARTITION BY doc_id, y ORDER BY x, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words),
o AS (SELECT *, sum(CASE WHEN reach IS NOT NULL AND x - reach > 8.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, y ORDER BY x, item_id) AS line FROM r)
SELECT doc_id, y, line::BIGINT AS line, count(*)::BIGINT AS items, min(x)::DOUBLE AS x0, max(x + width)::DOUBLE AS x1 FROM o GROUP BY 1, 2, 3"""
)
def gap_lines(spark, sf_dir):
    lined = layout.gap_lines(_word_items(spark, sf_dir))
    return lined.groupBy("doc_id", "y", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("items"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"))


_BLOCKS = """
blk AS (SELECT doc_id, page, item_id AS block_id, y AS top, x, CASE item_id % 6 WHEN 0 THEN 'SPANNING' WHEN 1 THEN 'LEFT' WHEN 2 THEN 'RIGHT' WHEN 3 THEN 'LEFT' WHEN 4 THEN 'RIGHT' ELSE 'LEFT' END AS col FROM items)"""


@_query(
    f"""WITH {_ITEMS}, {_BLOCKS}, b AS (SELECT *, coalesce(sum(CASE WHEN col = 'SPANNING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY top DESC, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM blk)
SELECT doc_id, page, block_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE col WHEN 'RIGHT' THEN 1 WHEN 'SPANNING' THEN 2 ELSE 0 END, top DESC, x, block_id)::BIGINT AS rank FROM b"""
)
def reading_order(spark, sf_dir):
    k = F.col("item_id") % 6
    col = F.when(k == 0, "SPANNING").when((k == 2) | (k == 4), "RIGHT").otherwise("LEFT")
    blocks = text_items(_t(spark, sf_dir, "documents")).select("doc_id", "page", F.col("item_id").alias("block_id"), F.col("y").alias("top"), "x", col.alias("column"))
    return layout.reading_order(blocks).select("doc_id", "page", "block_id", F.col("rank").cast("long").alias("rank"))


@_query(
    f"""WITH {_ITEMS}, k AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(lower(text), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM items WHERE length(text) <= 160)
SELECT doc_id, key, count(DISTINCT page)::BIGINT AS pages FROM k WHERE length(key) >= 2 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2"""
)
def running_headers(spark, sf_dir):
    return layout.running_headers(text_items(_t(spark, sf_dir, "documents")))


@_query(
    """WITH i AS (SELECT l_suppkey, l_partkey % 5000 AS lo, l_partkey % 5000 + l_quantity AS hi FROM lineitem),
r AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY lo, hi) AS band FROM r)
SELECT l_suppkey, band::BIGINT AS band, min(lo)::DOUBLE AS "start", max(hi)::DOUBLE AS "end", count(*)::BIGINT AS n FROM b GROUP BY 1, 2"""
)
def column_bands(spark, sf_dir):
    lo = (F.col("l_partkey") % 5000).cast("double")
    return layout.bands(_t(spark, sf_dir, "lineitem").select("l_suppkey", lo.alias("lo"), (lo + F.col("l_quantity")).alias("hi")), "l_suppkey", F.lit(3.0))


@_query(
    """WITH c AS (SELECT doc_id % 50 AS doc_id, doc_id AS block_id, d FROM documents, (VALUES (1), (2), (3)) v(d) WHERE doc_id % (d + 1) = 0),
f AS (SELECT doc_id, block_id, min(d) AS d, count(*) AS n FROM c GROUP BY 1, 2)
SELECT doc_id, 'd' || d AS owner, count(*)::BIGINT AS blocks, sum(n - 1)::BIGINT AS turned_down FROM f GROUP BY 1, 2"""
)
def ownership(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("block_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("priority"))
    claims = docs.where(F.col("block_id") % (F.col("priority") + 1) == 0).withColumn("detector", F.concat(F.lit("d"), F.col("priority").cast("string")))
    return layout.ownership(claims)


@_query(
    f"""WITH RECURSIVE {_WORD_ITEMS}, j AS (SELECT doc_id, item_id, x, y + CASE item_id % 4 WHEN 1 THEN 1.5 WHEN 2 THEN 3.5 ELSE 0.0 END AS y, length(trim(text)) > 2 AS is_real FROM words),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, item_id) AS r FROM j),
f AS (
  SELECT doc_id, r, 0 AS row_, y AS base, is_real AS had FROM o WHERE r = 1
  UNION ALL
  SELECT o.doc_id, o.r, CASE WHEN abs(o.y - f.base) <= 2.5 THEN f.row_ ELSE f.row_ + 1 END, CASE WHEN abs(o.y - f.base) > 2.5 OR (o.is_real AND NOT f.had) THEN o.y ELSE f.base END, o.is_real OR (abs(o.y - f.base) <= 2.5 AND f.had)
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, row_::INTEGER AS row, count(*)::BIGINT AS items FROM f GROUP BY 1, 2"""
)
def baseline_groups(spark, sf_dir):
    jitter = F.when(F.col("item_id") % 4 == 1, 1.5).when(F.col("item_id") % 4 == 2, 3.5).otherwise(0.0)
    return layout.baseline_groups(_word_items(spark, sf_dir).withColumn("y", F.col("y") + jitter)).groupBy("doc_id", "row").agg(F.count("*").alias("items"))


# ---------------------------------------------------------------- pages, chapters, rectangles


@_query(
    """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey % 400 AS page FROM lineitem), r AS (SELECT *, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS run FROM p),
e AS (SELECT l_suppkey, min(page) AS a, max(page) AS b FROM r GROUP BY l_suppkey, run)
SELECT l_suppkey, '_p' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, '_' ORDER BY a) AS suffix FROM e GROUP BY 1"""
)
def page_runs(spark, sf_dir):
    pages = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 400).alias("page"))
    return scope.run_suffix(scope.page_runs(pages, "l_suppkey"), "l_suppkey")


@_query("SELECT doc_id AS unit_id FROM (SELECT doc_id, doc_id % 40 + 1 AS a, doc_id % 40 + 1 + doc_id % 3 AS b FROM documents) WHERE b >= 10 AND a <= 20")
def scope_pages(spark, sf_dir):
    units = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), (F.col("doc_id") % 40 + 1).alias("start_page"), (F.col("doc_id") % 40 + 1 + F.col("doc_id") % 3).alias("end_page"))
    return scope.units_in_pages(units, 10, 20).select("unit_id")


@_query(
    """WITH u AS (SELECT doc_id % 20 AS d, doc_id AS unit_id, (doc_id % 97) * 40.0 AS lo, (doc_id % 97) * 40.0 + 10 + doc_id % 90 AS hi FROM documents),
c AS (SELECT d, d * 100.0 AS c_lo, d * 100.0 + 800 AS c_hi FROM (SELECT unnest(range(0, 20)) AS d))
SELECT u.d AS doc_id, unit_id, max(least(hi, c_hi) - greatest(lo, c_lo) >= greatest(hi - lo, 1) - 1) AS whole FROM u JOIN c USING (d)
WHERE lo < c_hi AND hi > c_lo AND (least(hi, c_hi) - greatest(lo, c_lo) >= greatest(hi - lo, 1) * 0.5 OR least(hi, c_hi) - greatest(lo, c_lo) >= 24) GROUP BY 1, 2"""
)
def scope_chapters(spark, sf_dir):
    lo = (F.col("doc_id") % 97 * 40).cast("double")
    units = _t(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("doc_id"), F.col("doc_id").alias("unit_id"), lo.alias("lo"), (lo + 10 + F.col("doc_id") % 90).alias("hi"))
    chapters = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") * 100.0).alias("c_lo"), (F.col("id") * 100.0 + 800).alias("c_hi"))
    return scope.units_in_chapters(units, chapters)


@_query(
    """WITH h AS (SELECT doc_id % 25 AS doc_id, doc_id AS ord, (doc_id * 7) % 4 + 1 AS level FROM documents)
SELECT a.doc_id, a.ord, a.level::BIGINT AS level, (SELECT max(b.ord) FROM h b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent,
  (SELECT min(b.ord) FROM h b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level) AS until FROM h a"""
)
def chapter_tree(spark, sf_dir):
    return scope.chapter_tree(_t(spark, sf_dir, "documents").select((F.col("doc_id") % 25).alias("doc_id"), F.col("doc_id").alias("ord"), (F.col("doc_id") * 7 % 4 + 1).alias("level")))


def _boxes(spark, sf_dir):
    """Rectangles made of customers: 40 on each page of a document per nation."""
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    x, y = (k * 37 % 500).cast("double"), (k * 53 % 700).cast("double")
    return c.select(F.col("c_nationkey").cast("long").alias("doc_id"), (k % 3).cast("int").alias("page"), k.alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 20 + k % 60).alias("x1"), (y + 15 + k % 45).alias("y1"))


_BOX = "box AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey % 3 AS page, c_custkey AS box_id, (c_custkey * 37 % 500)::DOUBLE AS x0, (c_custkey * 53 % 700)::DOUBLE AS y0, (c_custkey * 37 % 500 + 20 + c_custkey % 60)::DOUBLE AS x1, (c_custkey * 53 % 700 + 15 + c_custkey % 45)::DOUBLE AS y1 FROM customer)"
_POINT = "pt AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey % 3 AS page, c_custkey AS item_id, (c_custkey * 41 % 520)::DOUBLE AS px, (c_custkey * 59 % 720)::DOUBLE AS py FROM customer)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), (k % 3).cast("int").alias("page"), k.alias("item_id"), (k * 41 % 520).cast("double").alias("px"), (k * 59 % 720).cast("double").alias("py"))


@_query(
    f"""WITH {_BOX}, {_POINT}, b AS (SELECT pt.doc_id, item_id, box_id, row_number() OVER (PARTITION BY pt.doc_id, pt.page, item_id ORDER BY (x1 - x0) * (y1 - y0), box_id) AS r FROM pt JOIN box ON pt.doc_id = box.doc_id AND pt.page = box.page AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1)
SELECT pt.doc_id, pt.item_id, b.box_id FROM pt LEFT JOIN b ON pt.doc_id = b.doc_id AND pt.item_id = b.item_id AND r = 1"""
)
def smallest_container(spark, sf_dir):
    return spatial.smallest_container(_points(spark, sf_dir), _boxes(spark, sf_dir)).select("doc_id", "item_id", "box_id")


@_query(
    f"""WITH {_BOX}, {_POINT}, b AS (SELECT pt.doc_id, item_id, '#' || lpad(hex(box_id % 4096), 6, '0') AS color, row_number() OVER (PARTITION BY pt.doc_id, pt.page, item_id ORDER BY box_id DESC) AS r FROM pt JOIN box ON pt.doc_id = box.doc_id AND pt.page = box.page AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1)
SELECT pt.doc_id, pt.item_id, b.color FROM pt LEFT JOIN b ON pt.doc_id = b.doc_id AND pt.item_id = b.item_id AND r = 1"""
)
def topmost_fill(spark, sf_dir):
    fills = _boxes(spark, sf_dir).withColumn("seq", F.col("box_id")).withColumn("color", F.concat(F.lit("#"), F.lpad(F.hex(F.col("box_id") % 4096), 6, "0")))
    return spatial.topmost_fill(_points(spark, sf_dir), fills).select("doc_id", "item_id", "color")


@_query(
    f"""WITH {_BOX}, {_POINT}, n AS (SELECT box.doc_id, box_id, item_id, greatest(y0 - py, py - y1, 0) AS gap FROM box JOIN pt ON box.doc_id = pt.doc_id AND box.page = pt.page AND px < x1 AND px + 80 > x0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, box_id ORDER BY gap, item_id) AS r FROM n WHERE gap <= 170)
SELECT box.doc_id, box.box_id AS cluster_id, r.item_id AS caption_id, r.gap FROM box LEFT JOIN r ON box.doc_id = r.doc_id AND box.box_id = r.box_id AND r.r = 1"""
)
def nearest_caption(spark, sf_dir):
    captions = _points(spark, sf_dir).select("doc_id", "page", F.col("item_id").alias("caption_id"), F.col("px").alias("cx0"), (F.col("px") + 80).alias("cx1"), F.col("py").alias("cy"), F.col("item_id").alias("ord"))
    return spatial.nearest_caption(_boxes(spark, sf_dir).withColumnRenamed("box_id", "cluster_id"), captions).select("doc_id", "cluster_id", "caption_id", "gap")


@_query(
    f"""WITH RECURSIVE {_BOX}, e AS (SELECT a.box_id AS a, b.box_id AS b FROM box a JOIN box b ON a.doc_id = b.doc_id AND a.page = b.page AND a.x0 - 24 <= b.x1 AND b.x0 <= a.x1 + 24 AND a.y0 - 24 <= b.y1 AND b.y0 <= a.y1 + 24),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS box_id, min(b)::BIGINT AS cluster FROM r GROUP BY 1"""
)
def clusters(spark, sf_dir):
    return spatial.clusters(_boxes(spark, sf_dir)).select("box_id", "cluster")


@_query(
    """WITH c AS (SELECT p_partkey, '#' || lpad(lower(hex(p_partkey * 7919 % 16777216)), 6, '0') AS color, p_partkey * 7919 % 16777216 AS v FROM part),
h AS (SELECT p_partkey, color, (v // 65536) / 255.0::DOUBLE AS r, (v // 256 % 256) / 255.0::DOUBLE AS g, (v % 256) / 255.0::DOUBLE AS b FROM c),
l AS (SELECT p_partkey, color, 0.2126 * (CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END) + 0.7152 * (CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END) + 0.0722 * (CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END) AS lum FROM h)
SELECT p_partkey, color, CASE WHEN greatest((lum + 0.05) / 0.05, 1.05 / (lum + 0.05)) < 4.5 THEN NULL WHEN (lum + 0.05) / 0.05 >= 1.05 / (lum + 0.05) THEN 'dark' ELSE 'light' END AS ink FROM l"""
)
def contrast(spark, sf_dir):
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))
    return _t(spark, sf_dir, "part").select("p_partkey", color.alias("color"), spatial.text_color(color).alias("ink"))


# ---------------------------------------------------------------- units, requests, fitting


@_query()
def translation_units(spark, sf_dir):
    size = F.when(F.col("turn") % 5 == 3, 8.0).otherwise(10.0)
    turns = _t(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id"), (F.floor(F.col("turn") / 3) + 1).cast("int").alias("page"),
        F.lit("BODY").alias("type"), F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", r"[.!?]+$", "")).otherwise(F.lower("text")).alias("text"), F.lit(True).alias("translate"), size.alias("font_size"),
        F.lit("FULL").alias("column"), F.lit("BODY").alias("role"), F.lit(None).cast("string").alias("container_id"), (700.0 - F.col("turn") % 3 * 60).alias("top"), (650.0 - F.col("turn") % 3 * 60).alias("y"),
        F.lit(50.0).alias("x"), F.lit(400.0).alias("width"), F.lit(4).alias("line_count"), F.lit(False).alias("cell"),
    )
    made = units.build_units(turns)
    return made.select("doc_id", "ord", "unit_id", "was_merged", "incomplete", F.length("text").alias("chars"))


@_query(
    """WITH t AS (SELECT conv_id AS doc_id, turn::VARCHAR AS id, regexp_split_to_array(trim(text), '\\s+') AS w FROM conversations WHERE trim(text) <> '')
SELECT doc_id, id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[\\d±≤≥°µμΔα-ωΣ]|^[A-Z]{2,}$|__[A-Z]+_\\d+__') THEN x ELSE '文' END), ' ') AS translation, 'done' AS status FROM t"""
)
def translated_turns(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").where(text.trim(F.col("text")) != "").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("turn").cast("string").alias("id"), "text")
    return translate.translate(turns).select("doc_id", "id", "translation", "status")


@_query()
def fit_cells(spark, sf_dir):
    cells = _t(spark, sf_dir, "part").select("p_partkey", fitting.fit_cells(F.col("p_name"), (F.lit(40.0) + F.col("p_size")).cast("double"), F.lit(22.0), F.lit(8.0)).alias("f"))
    return cells.select("p_partkey", "f.size", F.size("f.lines").alias("lines"), "f.overflow")


@_query()
def block_classes(spark, sf_dir):
    items = text_items(_t(spark, sf_dir, "documents"))
    blocks = items.select(
        "doc_id", F.col("item_id").alias("ord"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("block_id"), F.col("page").cast("int").alias("page"), "text", "font_size",
        F.lit(None).cast("string").alias("font_name"), F.lit(1).alias("line_count"), F.lit("FULL").alias("column"), "y", (F.col("y") + F.col("font_size")).alias("top"), "width",
    )
    return sections.classify(blocks, layout.body_font_size(items)).groupBy("type", "section").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, (doc_id % 90 + 1)::VARCHAR || '|' || (doc_id % 9 + 1) || ',' || (doc_id % 9 + 12) || '-' || (doc_id % 9 + 14) AS markers FROM documents")
def glued_markers(spark, sf_dir):
    n, k = (F.col("doc_id") % 90 + 1).cast("string"), F.col("doc_id") % 9
    cited = F.concat(F.lit("in 3.5 words."), n, F.lit(" and more,"), (k + 1).cast("string"), F.lit(", "), (k + 12).cast("string"), F.lit("-"), (k + 14).cast("string"), F.lit(" then 2024"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(scripts.glued_markers(cited), "|").alias("markers"))


@_query()
def term_samples(spark, sf_dir):
    items = text_items(_t(spark, sf_dir, "documents"))
    kind = F.when(F.col("item_id") == 0, "TITLE").when(F.col("item_id") % 9 == 4, "HEADING").when(F.col("item_id") % 11 == 6, "CAPTION").otherwise("BODY")
    made = items.select("doc_id", F.col("item_id").alias("ord"), F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("unit_id"), F.col("page").cast("int").alias("page"), kind.alias("type"), "text")
    return sampling.term_samples(made).groupBy("pass").agg(F.count("*").alias("n"), F.sum(F.length("excerpt")).alias("chars"))


@_query()
def table_cells(spark, sf_dir):
    k = F.col("l_linenumber")
    cell = F.when(k % 3 == 0, F.concat(F.lit("Line "), k.cast("string"))).otherwise(F.col("l_quantity").cast("long").cast("string"))
    lines = _t(spark, sf_dir, "lineitem")
    items = lines.select(
        (F.col("l_orderkey") % 97).alias("doc_id"), F.floor(F.col("l_orderkey") / 1000).cast("int").alias("table_id"), F.lit(1).alias("page"), (F.col("l_orderkey") * 10 + k).alias("item_id"), cell.alias("text"),
        (F.lit(50.0) + k * 80).alias("x"), (F.lit(700.0) - F.floor(F.col("l_orderkey") / 97) % 10 * 12).cast("double").alias("y"), (F.length(cell) * 4.0).alias("width"), F.lit(8.0).alias("font_size"),
    )
    return tables.table_cells(items).groupBy("status").agg(F.count("*").alias("cells"))


@_query(
    f"""WITH {_BOX}, {_POINT}, b AS (SELECT pt.doc_id, item_id, box_id, '#' || lower(lpad(hex(box_id * 7919 % 16777216), 6, '0')) AS color, row_number() OVER (PARTITION BY pt.doc_id, pt.page, item_id ORDER BY (x1 - x0) * (y1 - y0), box_id) AS r
  FROM pt JOIN box ON pt.doc_id = box.doc_id AND pt.page = box.page AND x0 - 0.75 <= px AND y0 - 0.75 <= py AND x1 + 0.75 >= px + 8 AND y1 + 0.75 >= py + 6)
SELECT pt.doc_id, pt.item_id, CASE WHEN b.box_id IS NULL THEN 'white' ELSE 'fill' END AS source, b.color AS ground FROM pt LEFT JOIN b ON pt.doc_id = b.doc_id AND pt.item_id = b.item_id AND r = 1"""
)
def block_backgrounds(spark, sf_dir):
    fills = _boxes(spark, sf_dir).withColumn("seq", F.col("box_id")).withColumn("color", F.concat(F.lit("#"), F.lpad(F.hex(F.col("box_id") * 7919 % 16777216), 6, "0"))).drop("box_id")
    points = _points(spark, sf_dir)
    blocks = points.select("doc_id", "page", F.col("item_id").alias("block_id"), F.col("px").alias("x0"), F.col("py").alias("y0"), (F.col("px") + 8).alias("x1"), (F.col("py") + 6).alias("y1"), F.lit(None).cast("string").alias("container_fill"))
    pages = points.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0).alias("rotation"), F.lit(0.0).alias("px0"), F.lit(0.0).alias("py0"), F.lit(612.0).alias("px1"), F.lit(792.0).alias("py1"))
    return render.background(blocks, fills, pages).select("doc_id", F.col("block_id").alias("item_id"), "source", "ground")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _Q | more.queries() | detection.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | more.oracle_sql() | detection.oracle_sql()
