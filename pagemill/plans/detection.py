"""Queries of detectors, fonts, paragraphs and outlines over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fonts, reporting
from ..operators import detectors, layout, outputs, regions
from .more import _LINES, _lines

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(fn):
        _Q[fn.__name__], _SQL[fn.__name__] = fn, sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- fonts


@_query(
    """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha256(translate(text, 'abcdeNP', 'αβχδε≥\uf0d2')) ELSE sha256(translate(text, 'abcdeNP', '\uf061\uf062\uf063\uf064\uf065\uf0b3\uf0d2')) END AS shown,
  CASE WHEN doc_id % 3 < 2 THEN length(text) - length(translate(text, 'abcdeN', '')) ELSE 0 END::BIGINT AS mapped FROM documents"""
)
def symbol_text(spark, sf_dir):
    n = F.col("doc_id") % 3
    coded = F.translate("text", "abcdeNP", "\uf061\uf062\uf063\uf064\uf065\uf0b3\uf0d2")
    font = F.when(n == 0, "AAAAAT+SymbolMT").when(n == 1, "Symbol,Bold").otherwise("SymbolNeu")
    plain = _t(spark, sf_dir, "documents").select("doc_id", fonts.normalize_symbol_font(coded, font).alias("s"))
    return plain.select("doc_id", F.sha2("s.text", 256).alias("shown"), F.col("s.mapped").cast("long").alias("mapped"))


_BLANKS = r"[\t\n\x0B\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@_query(
    rf"""WITH b AS (SELECT doc_id, regexp_replace(translate(text, 'aeis', '∗−ﬁ★'), '{_BLANKS}', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, replace(replace(replace(replace(replace(translate(t, '∗⁎−‐‑‒', '**----'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') AS t FROM b)
SELECT doc_id, sha256(regexp_replace(t, '[^ -~]', '□', 'g')) AS shown, (length(t) - length(regexp_replace(t, '[^ -~]', '', 'g')))::BIGINT AS replaced FROM p"""
)
def font_stand_ins(spark, sf_dir):
    plain = _t(spark, sf_dir, "documents").select("doc_id", fonts.sanitize_for_font(F.translate("text", "aeis", "∗−ﬁ★"), [(0x21, 0x7E)]).alias("s"))
    return plain.select("doc_id", F.sha2("s.text", 256).alias("shown"), F.col("s.replaced").cast("long").alias("replaced"))


# ---------------------------------------------------------------- paragraphs and columns


@_query(
    f"""WITH {_LINES}, r AS (
  SELECT doc_id, page, line_id, font_size, x + CASE WHEN line_id % 13 = 4 THEN 8 ELSE 0 END AS x, "right", CASE WHEN line_id % 17 = 0 THEN 'Bold' ELSE 'Roman' END AS font,
    y + CASE WHEN line_id % 23 = 22 THEN 11 ELSE 0 END AS y, CASE WHEN in_band OR (x < 299 AND "right" > 313) THEN 'SPANNING' WHEN (x + "right") / 2 <= 306 THEN 'LEFT' ELSE 'RIGHT' END AS region FROM ln),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, region ORDER BY x, line_id) AS rx, row_number() OVER (PARTITION BY doc_id, page, region ORDER BY "right", line_id) AS rr, count(*) OVER (PARTITION BY doc_id, page, region) AS n FROM r),
e AS (SELECT doc_id, page, region, max(CASE WHEN rx = floor(0.1::DOUBLE * (n - 1)) + 1 THEN x END) AS lo, max(CASE WHEN rr = floor(0.9::DOUBLE * (n - 1)) + 1 THEN "right" END) AS hi FROM k GROUP BY 1, 2, 3),
s AS (SELECT r.*, abs((x + "right") / 2 - (lo + hi) / 2) < (hi - lo) * 0.08::DOUBLE AND "right" - x < (hi - lo) * 0.85::DOUBLE AS centred, hi - "right" > (hi - lo) * 0.2::DOUBLE AS short FROM r JOIN e USING (doc_id, page, region)),
b AS (SELECT *, lag(line_id) OVER w AS pl, lag(font_size) OVER w AS em, lag(y) OVER w - y AS pitch, lag(font) OVER w AS pf, lag(short) OVER w AS ps, lag(centred) OVER w AS pc, x - lag(x) OVER w AS dx FROM s WINDOW w AS (PARTITION BY doc_id, page, region ORDER BY y DESC, x, line_id)),
c AS (SELECT CASE WHEN pl IS NULL THEN 'start' WHEN pitch <= em * 0.3::DOUBLE THEN 'side-by-side' WHEN font_size / em < 0.85::DOUBLE OR font_size / em > 1.15::DOUBLE THEN 'font-size' WHEN font <> pf THEN 'font-change'
  WHEN pitch > CASE WHEN ps THEN 1.45::DOUBLE ELSE 1.8::DOUBLE END * em THEN 'line-gap' WHEN NOT (centred AND pc) AND dx > em * 0.6::DOUBLE THEN 'indent' END AS reason FROM b)
SELECT reason, count(*)::BIGINT AS n FROM c WHERE reason IS NOT NULL GROUP BY 1"""
)
def paragraphs(spark, sf_dir):
    n = F.col("line_id")
    at = regions.region(F.col("x"), F.col("right"), F.lit(300.0), F.lit(312.0), F.col("in_band"))
    lines = _lines(spark, sf_dir).withColumn("region", at).withColumn("font", F.when(n % 17 == 0, "Bold").otherwise("Roman"))
    moved = lines.withColumn("x", F.col("x") + F.when(n % 13 == 4, 8.0).otherwise(0.0)).withColumn("y", F.col("y") + F.when(n % 23 == 22, 11.0).otherwise(0.0))
    return layout.paragraphs(moved).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@_query(
    """WITH f AS (SELECT l_suppkey AS table_id, l_linenumber * 70.0::DOUBLE AS x0, l_linenumber * 70.0::DOUBLE + CASE WHEN l_partkey % 10 = 0 THEN 136 ELSE 66 END AS x1, l_orderkey % 40 * 12.0::DOUBLE AS y0 FROM lineitem),
t AS (SELECT DISTINCT table_id, CASE WHEN table_id % 3 = 0 THEN 900.0 ELSE 600.0 END::DOUBLE AS hi FROM f),
d AS (SELECT table_id, x0, x1 FROM f GROUP BY 1, 2, 3 HAVING count(DISTINCT y0) >= 2),
g AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS i WHERE i.table_id = d.table_id AND i.x0 >= d.x0 - 0.5 AND i.x1 <= d.x1 + 0.5 AND i.x1 - i.x0 < d.x1 - d.x0 - 0.5)),
l AS (SELECT g.*, hi, coalesce(x0 < lag(x1) OVER (PARTITION BY table_id ORDER BY x0, x1 DESC) - 1, false) AS clash FROM g JOIN t USING (table_id)),
w AS (SELECT table_id FROM l GROUP BY table_id, hi HAVING count(*) >= 3 AND NOT bool_or(clash) AND sum(greatest(0.0, least(x1, hi) - greatest(x0, 60.0))) >= (hi - 60) * 0.7::DOUBLE)
SELECT table_id::BIGINT AS table_id, x0 AS "left", x1 AS "right" FROM l WHERE table_id IN (SELECT table_id FROM w)"""
)
def shaded_columns(spark, sf_dir):
    x, y = F.col("l_linenumber") * 70.0, F.col("l_orderkey") % 40 * 12.0
    lines = _t(spark, sf_dir, "lineitem").withColumn("table_id", F.col("l_suppkey").cast("long"))
    fills = lines.select("table_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"), x.alias("x0"), (x + F.when(F.col("l_partkey") % 10 == 0, 136).otherwise(66)).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))
    named = lines.select("table_id").distinct()
    tables = named.select("table_id", F.lit(60.0).alias("left"), F.when(F.col("table_id") % 3 == 0, 900.0).otherwise(600.0).alias("right"), F.lit(500.0).alias("top"), F.lit(0.0).alias("bottom"))
    return regions.shaded_columns(fills, tables)


# ---------------------------------------------------------------- labels


_LABELS = """
p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ':' ELSE p_name END AS t, p_partkey % 3 AS m, p_partkey % 7 AS s, p_size FROM part),
l AS (SELECT *, len(string_split(t, ' ')) AS words, regexp_matches(t, '^[^a-z]*$') AS caps FROM p)"""


@_query(
    rf"""WITH {_LABELS}
SELECT k::BIGINT AS part, least(100, greatest(0, CASE m WHEN 0 THEN 45 WHEN 1 THEN 35 ELSE 25 END + CASE WHEN s = 0 THEN 15 WHEN s = 1 THEN 8 ELSE 0 END + CASE WHEN caps THEN 15 WHEN s = 2 THEN 5 ELSE 0 END
  + CASE WHEN p_size / 50.0 >= 0.5 THEN 15 WHEN p_size > 10 THEN 8 ELSE 0 END + CASE WHEN words <= 4 THEN 5 ELSE 0 END + CASE WHEN t LIKE '%:' THEN 5 ELSE 0 END
  + CASE m WHEN 0 THEN CASE WHEN s % 2 = 0 THEN 15 ELSE -20 END WHEN 1 THEN 10 ELSE CASE WHEN s % 2 = 0 THEN 15 ELSE -30 END END + CASE WHEN s = 3 THEN 10 ELSE 0 END
  + CASE WHEN s = 4 THEN -20 WHEN s = 5 THEN -15 ELSE 0 END + CASE WHEN words > 8 THEN -50 ELSE 0 END + CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 3 THEN -25 ELSE 0 END
  + CASE WHEN regexp_matches(t, '^[a-z]') THEN -40 ELSE 0 END + CASE WHEN m = 0 AND s = 6 THEN -30 ELSE 0 END))::INTEGER AS points FROM l"""
)
def label_scores(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    s = k % 7
    text = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(name, F.lit(":"))).otherwise(name)
    hint = F.when(F.col("p_size") >= 25, 0.5).when(F.col("p_size") > 10, 0.2).otherwise(0.0)
    labels = _t(spark, sf_dir, "part").select(
        k.cast("long").alias("part"), text.alias("text"), F.when(k % 3 == 0, "run-in").when(k % 3 == 1, "own-line").otherwise("standalone").alias("placement"), F.size(F.split(text, " ")).alias("words"),
        (s == 0).alias("bold"), (s == 1).alias("medium"), F.regexp_like(text, F.lit("^[^a-z]*$")).alias("caps"), (s == 2).alias("title_case"), hint.alias("hint"), (s % 2 == 0).alias("follows"), (s == 3).alias("rule_above"),
        F.when(s == 4, 0.8).when(s == 5, 1.7).otherwise(1.0).alias("ratio"), F.when(s == 6, 0.7).otherwise(0.5).alias("width_share"),
    )
    return labels.select("part", detectors.label_evidence()["points"].alias("points"))


@_query(
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey * 100000 + l_suppkey AS b, 50.0 + l_partkey % 5 * 1.0 + CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 0 END AS x, 40 + l_suppkey % 60 AS points, l_partkey % 4 < 3 AS inl, l_partkey % 20 AS lines,
    CASE l_partkey % 3 WHEN 0 THEN 'abstract' WHEN 1 THEN 'other' END AS above, CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END AS blockers FROM lineitem WHERE l_suppkey % 60 >= 10),
o AS (SELECT *, CASE WHEN abs(x - lag(x) OVER w) <= 3 AND blockers = lag(blockers) OVER w THEN 0 ELSE 1 END AS opens FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord, b)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord, b ROWS UNBOUNDED PRECEDING) AS run FROM o),
g AS (SELECT doc_id, run, count(*) AS n, sum(points) AS s, count(*) FILTER (inl) AS i, max(x) - min(x) AS spread, count(*) FILTER (lines > 16) AS long, arg_min_null(above, (ord, b)) AS above FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT doc_id, run, n, least(100, greatest(0, floor(s / n::DOUBLE + CASE WHEN n >= 4 THEN 15 WHEN n = 3 THEN 10 ELSE 0 END + CASE WHEN i * 2 >= n THEN 10 ELSE 0 END + CASE WHEN spread <= 3 THEN 5 ELSE 0 END + CASE WHEN above = 'abstract' THEN 15 WHEN above = 'other' THEN 5 ELSE 0 END - long * 15 + 0.5::DOUBLE))) AS points FROM g)
SELECT doc_id::BIGINT AS doc_id, run::BIGINT AS run, n::BIGINT AS n, points::INTEGER AS points FROM q WHERE points >= 60"""
)
def label_regions(spark, sf_dir):
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    labels = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("LEFT").alias("column"), (part * 100000 + supp).alias("block_id"), n.alias("ord"), (F.lit(50.0) + part % 5 + F.when(supp % 7 == 0, 20).otherwise(0)).alias("x"),
        F.lit("Bold").alias("font"), F.lit(10.0).alias("font_size"), F.when(n > 5, 1).otherwise(0).alias("blockers"), (supp % 60 + 40).cast("int").alias("points"), (part % 4 < 3).alias("inline"), (part % 20).alias("lines"),
        F.lit(1).alias("blocks"), F.when(part % 3 == 0, "abstract").when(part % 3 == 1, "other").alias("above"),
    )
    found = detectors.label_regions(detectors.label_runs(labels))
    return found.select("doc_id", F.col("run").cast("long").alias("run"), "n", "points")


# ---------------------------------------------------------------- panels


_PANELS = """
fi AS (SELECT c_custkey AS doc_id, 30.0::DOUBLE AS x0, 100.0::DOUBLE AS y0, 30.0::DOUBLE + 100 + c_custkey % 4 * 120 AS x1, 400.0::DOUBLE AS y1, CASE WHEN c_custkey % 5 = 0 THEN '#ffffff' ELSE '#eeeeee' END AS colour, c_custkey % 3 AS m FROM customer),
pa AS (SELECT doc_id, 1 AS box_id, x0, y0, x1, y1, nullif(colour, '#ffffff') AS fill, CASE WHEN m = 0 THEN 'frame' WHEN m = 1 THEN 'rules' END AS border FROM fi WHERE colour <> '#ffffff' OR m < 2
  UNION ALL SELECT doc_id, 2, 200.0, 450.0, 460.0, 700.0, NULL, 'frame' FROM fi WHERE m > 0),
bl AS (SELECT o_custkey AS doc_id, o_orderkey AS block_id, 40.0::DOUBLE + o_orderkey % 5 * 80 AS x0, 90.0::DOUBLE + o_orderkey * 7 % 50 * 12 AS y0,
  CASE o_orderkey % 9 WHEN 0 THEN 'HEADER' WHEN 1 THEN 'CAPTION' ELSE 'BODY' END AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'LEFT' ELSE 'FULL' END AS col, 1 + o_orderkey % 4 AS lines, o_orderkey % 11 = 0 AS owned, o_orderkey % 6 = 0 AS numeric, o_orderkey % 4 = 0 AS heading FROM orders),
pr AS (SELECT p.*, b.block_id, b.type, b.col, b.lines, b.owned, b.numeric, b.heading, greatest(0, least(p.x1, b.x0 + 70) - greatest(p.x0, b.x0)) * greatest(0, least(p.y1, b.y0 + 10) - greatest(p.y0, b.y0)) / 700 AS share FROM pa p JOIN bl b USING (doc_id)),
sh AS (SELECT *, NOT owned AND type <> 'HEADER' AS free, NOT owned AND type <> 'HEADER' AND share >= 0.85 AS child FROM pr WHERE share >= 0.2),
ag AS (SELECT doc_id, box_id, x0, y0, x1, y1, fill, border, count(*) FILTER (child) AS n, count(*) FILTER (free AND share < 0.85) AS st, count(*) FILTER (owned AND share >= 0.5) AS fo, coalesce(sum(lines) FILTER (child), 0) AS ln,
  arg_min(heading, block_id) FILTER (child) AS hd, count(*) FILTER (child AND lines >= 2 AND type = 'BODY') AS bo, count(*) FILTER (child AND type = 'CAPTION') AS ca, count(*) FILTER (child AND numeric) AS nu,
  count(*) FILTER (child AND col = 'LEFT') AS le FROM sh GROUP BY ALL),
sc AS (SELECT *, (x1 - x0) / 500 AS wide, n * 700 / ((x1 - x0) * (y1 - y0)) AS dens FROM ag WHERE n >= 2 OR (n = 1 AND ln >= 3)),
po AS (SELECT *, least(100, greatest(0, CASE WHEN fill IS NOT NULL THEN 30 ELSE 0 END + CASE border WHEN 'frame' THEN 30 WHEN 'rules' THEN 20 ELSE 0 END + CASE WHEN wide <= 0.65 THEN 15 WHEN wide <= 0.85 THEN 5 ELSE 0 END
  + CASE WHEN dens BETWEEN 0.12 AND 0.9 THEN 10 WHEN dens < 0.06 THEN -20 ELSE 0 END + CASE WHEN hd THEN 15 ELSE 0 END + CASE WHEN bo > 0 THEN 5 ELSE 0 END + CASE WHEN ca > 0 THEN -50 ELSE 0 END
  + CASE WHEN nu * 10 >= n * 3 THEN -40 ELSE 0 END + CASE WHEN st > n THEN -30 ELSE 0 END + CASE WHEN fo > 0 THEN -40 ELSE 0 END + CASE WHEN wide >= 0.95 AND n >= 10 THEN -20 ELSE 0 END)) AS points FROM sc)"""


def _panels(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    box = [F.lit(30.0).alias("x0"), F.lit(100.0).alias("y0"), (F.lit(130.0) + k % 4 * 120).alias("x1"), F.lit(400.0).alias("y1")]
    at = [k.cast("long").alias("doc_id"), F.lit(1).alias("page")]
    customer = _t(spark, sf_dir, "customer")
    fills = customer.select(*at, F.lit(1).cast("long").alias("box_id"), *box, F.lit("fill").alias("kind"), F.when(k % 5 == 0, "#ffffff").otherwise("#eeeeee").alias("colour"))
    twins = customer.where(k % 3 == 0).select(*at, F.lit(2).cast("long").alias("box_id"), *box, F.lit("frame").alias("kind"), F.lit(None).cast("string").alias("colour"))
    other = [F.lit(v).alias(c) for v, c in ((200.0, "x0"), (450.0, "y0"), (460.0, "x1"), (700.0, "y1"))]
    frames = customer.where(k % 3 > 0).select(*at, F.lit(2).cast("long").alias("box_id"), *other, F.lit("frame").alias("kind"), F.lit(None).cast("string").alias("colour"))
    side = lambda y: customer.where(k % 3 == 1).select(*at, F.lit(True).alias("horizontal"), F.lit(30.0).alias("x0"), F.lit(y).alias("y0"), (F.lit(130.0) + k % 4 * 120).alias("x1"), F.lit(y).alias("y1"))
    pages = customer.select(*at, F.lit(0.0).alias("px0"), F.lit(0.0).alias("py0"), F.lit(612.0).alias("px1"), F.lit(792.0).alias("py1"))
    panels = detectors.candidate_panels(fills.unionByName(twins).unionByName(frames), pages, side(101.0).unionByName(side(399.0)))
    x, y = F.lit(40.0) + o % 5 * 80, F.lit(90.0) + o * 7 % 50 * 12
    blocks = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("doc_id"), F.lit(1).alias("page"), o.alias("block_id"), o.alias("ord"), x.alias("x0"), y.alias("y0"), (x + 70).alias("x1"), (y + 10).alias("y1"),
        F.when(o % 9 == 0, "HEADER").when(o % 9 == 1, "CAPTION").otherwise("BODY").alias("type"), F.when(o % 2 == 0, "LEFT").otherwise("FULL").alias("column"), (o % 4 + 1).alias("lines"), F.lit(9).alias("words"),
        (o % 11 == 0).alias("owned"), (o % 6 == 0).alias("numeric"), (o % 4 == 0).alias("heading_like"), F.lit(None).cast("boolean").alias("label"),
    )
    return panels.withColumn("text_width", F.lit(500.0)).withColumn("striped", F.lit(False)), blocks


@_query(f"WITH {_PANELS} SELECT doc_id::BIGINT AS doc_id, box_id::BIGINT AS box_id, n::BIGINT AS children, CASE WHEN wide <= 0.65 THEN 'SIDEBAR' ELSE 'CALLOUT_BOX' END AS container, points::INTEGER AS points FROM po")
def panel_scores(spark, sf_dir):
    return detectors.score_panels(*_panels(spark, sf_dir)).select("doc_id", "box_id", "children", "container", "points")


@_query(
    f"""WITH {_PANELS} SELECT doc_id::BIGINT AS doc_id, block_id::BIGINT AS block_id, arg_min(box_id, (-points) * 1000000.0 + (x1 - x0) * (y1 - y0) / 1000 + box_id * 1e-6)::BIGINT AS box_id
FROM (SELECT sh.doc_id, sh.block_id, po.* EXCLUDE (doc_id) FROM sh JOIN po USING (doc_id, box_id) WHERE child AND points >= 60) GROUP BY 1, 2"""
)
def panel_children(spark, sf_dir):
    panels, blocks = _panels(spark, sf_dir)
    return detectors.claim_children(detectors.score_panels(panels, blocks), blocks).select("doc_id", "block_id", "box_id")


# ---------------------------------------------------------------- outlines, roles, reports


@_query(
    """WITH RECURSIVE i AS (SELECT p_partkey % 5 AS doc_id, p_partkey // 5 AS item, CASE WHEN p_partkey // 5 >= 3 THEN p_partkey // 5 // 3 END AS parent, p_partkey // 5 * 7 % 11 AS ord FROM part),
t AS (SELECT doc_id, item, 0 AS depth, [ord * 100000000 + item] AS path FROM i WHERE parent IS NULL UNION ALL SELECT i.doc_id, i.item, t.depth + 1, list_append(t.path, i.ord * 100000000 + i.item) FROM t JOIN i ON i.doc_id = t.doc_id AND i.parent = t.item WHERE t.depth < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rank FROM t)
SELECT doc_id::BIGINT AS doc_id, item::BIGINT AS item_id, depth::INTEGER AS depth, rank::BIGINT AS rank, CASE item % 4 WHEN 0 THEN 700 - item % 50 WHEN 1 THEN 300 + item % 50 WHEN 2 THEN 40 END::DOUBLE AS top FROM r WHERE rank <= 2000"""
)
def outline_order(spark, sf_dir):
    i = F.floor(F.col("p_partkey") / 5)
    items = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 5).cast("long").alias("doc_id"), i.alias("item_id"), F.when(i >= 3, F.floor(i / 3)).alias("parent_id"), (i * 7 % 11).alias("ord"))
    n = F.col("item_id") % 4
    kind = F.when(n == 0, "XYZ").when(n == 1, "FitH").when(n == 2, "FitR").otherwise("Fit")
    place = F.col("item_id") % 50
    args = F.when(n == 0, F.array(F.lit(10.0), 700.0 - place)).when(n == 1, F.array(300.0 + place)).when(n == 2, F.array(*[F.lit(v) for v in (10.0, 20.0, 30.0, 40.0)])).otherwise(F.array().cast("array<double>"))
    return outputs.outline_order(items).select("doc_id", "item_id", "depth", F.col("rank").cast("long").alias("rank"), outputs.destination_top(kind, args).alias("top"))


@_query(
    """WITH b AS (SELECT CASE o_orderkey % 9 WHEN 0 THEN 'HEADING' WHEN 1 THEN 'TITLE' WHEN 2 THEN 'CAPTION' WHEN 3 THEN 'TABLE' WHEN 4 THEN 'FIGURE' WHEN 5 THEN 'FOOTNOTE' WHEN 6 THEN 'REFERENCE' WHEN 7 THEN 'OTHER' END AS t, CASE WHEN o_custkey % 4 = 0 THEN 'SIDEBAR_BODY' END AS r FROM orders)
SELECT coalesce(r, CASE WHEN t IN ('HEADING', 'TITLE') THEN 'HEADING' WHEN t IN ('CAPTION', 'TABLE', 'FIGURE', 'FOOTNOTE', 'REFERENCE') THEN t ELSE 'BODY' END) AS role, count(*)::BIGINT AS blocks FROM b GROUP BY 1"""
)
def block_roles(spark, sf_dir):
    kinds = ["HEADING", "TITLE", "CAPTION", "TABLE", "FIGURE", "FOOTNOTE", "REFERENCE", "OTHER"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 9).cast("int"))
    role = reporting.role_of(kind, F.when(F.col("o_custkey") % 4 == 0, "SIDEBAR_BODY"))
    return _t(spark, sf_dir, "orders").groupBy(role.alias("role")).agg(F.count("*").alias("blocks"))


@_query(
    """WITH u AS (SELECT o_orderkey AS k, (o_orderkey * 1234)::BIGINT AS i, (o_custkey * 7)::BIGINT AS c, (o_custkey * 100003)::BIGINT AS o, (o_orderkey % 3000)::BIGINT AS r FROM orders)
SELECT k::BIGINT AS o_orderkey, concat_ws(chr(10), '  ' || rpad('input tokens', 26, ' ') || lpad(format('{:,}', i), 12, ' '), '  ' || rpad('cached input tokens', 26, ' ') || lpad(format('{:,}', c), 12, ' '),
  '  ' || rpad('output tokens', 26, ' ') || lpad(format('{:,}', o), 12, ' '), '  ' || rpad('reasoning tokens', 26, ' ') || lpad(format('{:,}', r), 12, ' '), '  ' || rpad('processed (in + out)', 26, ' ') || lpad(format('{:,}', i + o), 12, ' '),
  '  ' || rpad('time', 26, ' ') || lpad(printf('%.1f', (k % 100)::DOUBLE) || 's', 12, ' ')) AS report FROM u"""
)
def usage_report(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    usage = F.struct((k * 1234).alias("input"), (c * 7).cast("long").alias("cached"), (c.cast("long") * 100003).alias("output"), (k % 3000).alias("reasoning"), (k % 100 * 1000).alias("ms"))
    return _t(spark, sf_dir, "orders").select(k.cast("long").alias("o_orderkey"), F.array_join(reporting.usage_lines(usage), "\n").alias("report"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
