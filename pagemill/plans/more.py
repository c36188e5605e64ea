"""Queries of regions, outputs, glossaries and reports over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reporting, text
from ..operators import glossary, outputs, regions
from ..sources.synth import text_items

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(fn):
        _Q[fn.__name__], _SQL[fn.__name__] = fn, sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ITEMS = """
items AS (
  SELECT doc_id, i - 1 AS item_id, (i - 1) // 50 + 1 AS page, l[i] AS text, (742 - ((i - 1) % 50) * 12)::DOUBLE AS y,
    CASE WHEN (doc_id + i - 1) % 11 = 0 THEN 14.0 WHEN (doc_id + i - 1) % 7 = 0 THEN 8.5 ELSE 10.0 END::DOUBLE AS font_size
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def _lines(spark, sf_dir) -> DataFrame:
    """The lines of every document, alternately left and right of a gutter, some across it."""
    k = F.col("item_id") % 5
    items = text_items(_t(spark, sf_dir, "documents"))
    x = F.when(k == 3, 320.0).otherwise(50.0)
    right = x + F.when(k == 0, 500.0).otherwise(F.least(F.length("text") * 4.0, F.lit(230.0)))
    return items.select("doc_id", "page", F.col("item_id").alias("line_id"), "text", "y", "font_size", x.alias("x"), right.alias("right"), (k == 4).alias("in_band"))


_LINES = (
    _ITEMS
    + """,
ln AS (SELECT doc_id, page, item_id AS line_id, text, y, font_size, CASE WHEN item_id % 5 = 3 THEN 320.0 ELSE 50.0 END::DOUBLE AS x,
  CASE WHEN item_id % 5 = 3 THEN 320.0 ELSE 50.0 END + CASE WHEN item_id % 5 = 0 THEN 500.0 ELSE least(length(text) * 4.0, 230.0) END AS "right", item_id % 5 = 4 AS in_band FROM items)"""
)


# ---------------------------------------------------------------- regions


@_query(
    f"""WITH {_LINES}
SELECT doc_id, CASE WHEN in_band OR (x < 299 AND "right" > 313) THEN 'SPANNING' WHEN (x + "right") / 2 <= 306 THEN 'LEFT' ELSE 'RIGHT' END AS region, count(*)::BIGINT AS lines
FROM ln GROUP BY 1, 2"""
)
def line_regions(spark, sf_dir):
    at = regions.region(F.col("x"), F.col("right"), F.lit(300.0), F.lit(312.0), F.col("in_band"))
    return _lines(spark, sf_dir).groupBy("doc_id", at.alias("region")).agg(F.count("*").alias("lines"))


@_query(
    f"""WITH {_LINES}, r AS (SELECT doc_id, page, x, "right", row_number() OVER (PARTITION BY doc_id, page ORDER BY x, line_id) AS rx, row_number() OVER (PARTITION BY doc_id, page ORDER BY "right", line_id) AS rr, count(*) OVER (PARTITION BY doc_id, page) AS n FROM ln)
SELECT doc_id, page::INTEGER AS page, max(CASE WHEN rx = floor(0.1::DOUBLE * (n - 1)) + 1 THEN x END) AS "left", max(CASE WHEN rr = floor(0.9::DOUBLE * (n - 1)) + 1 THEN "right" END)::DOUBLE AS right_edge FROM r GROUP BY 1, 2"""
)
def region_extents(spark, sf_dir):
    return regions.region_extents(_lines(spark, sf_dir), ["doc_id", "page"]).select("doc_id", F.col("page").cast("int").alias("page"), "left", "right_edge")


_WORDS = """
w AS (SELECT doc_id, k AS line_id, (k // 8)::BIGINT AS page, 700.0::DOUBLE - (k % 8) // 4 * 14 - CASE WHEN k % 4 = 1 THEN 2 ELSE 0 END AS y, 10.0::DOUBLE AS font_size, t[k + 1] AS text,
    50.0::DOUBLE + (k % 4) * 40 AS x, 50.0::DOUBLE + (k % 4) * 40 + least(length(t[k + 1]) * 4.0, 60.0) AS "right"
  FROM (SELECT doc_id, t, unnest(range(0, len(t))) AS k FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)))"""


@_query(
    f"""WITH RECURSIVE {_WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, line_id) AS r FROM w),
f AS (
  SELECT doc_id, page, r, line_id, line_id AS merged, "right" AS reach, y AS base FROM o WHERE r = 1
  UNION ALL
  SELECT o.doc_id, o.page, o.r, o.line_id, CASE WHEN abs(f.base - o.y) <= 5 AND o.x - f.reach BETWEEN -5 AND 20 THEN f.merged ELSE o.line_id END,
    CASE WHEN abs(f.base - o.y) <= 5 AND o.x - f.reach BETWEEN -5 AND 20 THEN greatest(f.reach, o."right") ELSE o."right" END,
    CASE WHEN abs(f.base - o.y) <= 5 AND o.x - f.reach BETWEEN -5 AND 20 THEN f.base ELSE o.y END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.r = f.r + 1)
SELECT doc_id, merged::BIGINT AS merged, count(*)::BIGINT AS lines FROM f GROUP BY 1, 2"""
)
def merged_baselines(spark, sf_dir):
    k = F.col("k")
    words = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "text"))
    x = (F.lit(50.0) + k % 4 * 40).cast("double")
    y = F.lit(700.0) - F.floor(k % 8 / 4) * 14 - F.when(k % 4 == 1, 2).otherwise(0)
    lines = words.select("doc_id", F.floor(k / 8).alias("page"), F.lit("LEFT").alias("region"), k.cast("long").alias("line_id"), x.alias("x"), (x + F.least(F.length("text") * 4.0, F.lit(60.0))).alias("right"), y.cast("double").alias("y"), F.lit(10.0).alias("font_size"))
    return regions.merge_baselines(lines).groupBy("doc_id", "merged").agg(F.count("*").alias("lines"))


@_query(f"WITH {_ITEMS} SELECT doc_id, page::INTEGER AS page, arg_max(font_size, length(text) * 1000000 - item_id) AS font_size FROM items GROUP BY 1, 2")
def dominant_items(spark, sf_dir):
    items = text_items(_t(spark, sf_dir, "documents"))
    return regions.dominant(items, ["doc_id", "page"], "item_id", "font_size").select("doc_id", F.col("page").cast("int").alias("page"), "font_size")


@_query(
    """WITH c AS (SELECT l_orderkey // 100 AS table_id, l_partkey % 3 AS page, CASE WHEN l_linenumber % 3 = 0 THEN 'TABLE_TEXT_LABEL' ELSE 'TABLE_CELL' END AS t, (l_suppkey % 70)::DOUBLE AS y FROM lineitem),
f AS (SELECT table_id, page, max(y + 8) AS h FROM c WHERE t = 'TABLE_CELL' GROUP BY 1, 2)
SELECT table_id, CASE WHEN t = 'TABLE_TEXT_LABEL' AND y >= h - 0.5 THEN 'TABLE_HEADER' ELSE t END AS block_type, count(*)::BIGINT AS cells FROM c LEFT JOIN f USING (table_id, page) GROUP BY 1, 2"""
)
def table_headers(spark, sf_dir):
    y = (F.col("l_suppkey") % 70).cast("double")
    cells = _t(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("table_id"), (F.col("l_partkey") % 3).alias("page"), F.when(F.col("l_linenumber") % 3 == 0, "TABLE_TEXT_LABEL").otherwise("TABLE_CELL").alias("block_type"), (y + 8).alias("top"), y.alias("y"))
    return regions.table_headers(cells).groupBy("table_id", "block_type").agg(F.count("*").alias("cells"))


@_query(
    r"""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN l_returnflag || 'IL' WHEN 2 THEN 'sold by ' || l_returnflag ELSE '10.1000/' || l_partkey END AS v, l_suppkey % 5 = 0 AS maskless FROM lineitem)
SELECT coalesce(CASE WHEN regexp_matches(v, '^\d+$') THEN 'NUMERIC_ONLY' WHEN length(v) <= 24 AND regexp_matches(v, '^[A-Z][A-Z0-9.\s+/&-]*$') AND regexp_matches(v, '[A-Z]{2}') THEN 'ABBREVIATION_ONLY'
  WHEN regexp_matches(v, '^10\.\d{4,9}/\S+$') THEN 'UNTRANSLATABLE' WHEN maskless THEN 'CELL_NOT_MASKABLE' END, 'translate') AS reason, count(*)::BIGINT AS cells FROM c GROUP BY 1"""
)
def cell_skips(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    v = F.when(n == 0, F.col("l_quantity").cast("long").cast("string")).when(n == 1, F.concat("l_returnflag", F.lit("IL"))).when(n == 2, F.concat(F.lit("sold by "), "l_returnflag")).otherwise(F.concat(F.lit("10.1000/"), F.col("l_partkey").cast("string")))
    cells = _t(spark, sf_dir, "lineitem").select(v.alias("v"), (n == 0).alias("numeric"), (F.col("l_suppkey") % 5 != 0).alias("maskable"))
    reason = regions.cell_skip(F.col("v"), F.col("numeric"), F.lit(False), F.col("maskable"))
    return cells.groupBy(F.coalesce(reason, F.lit("translate")).alias("reason")).agg(F.count("*").alias("cells"))


@_query(
    """WITH b AS (SELECT l_orderkey % 50 AS doc_id, l_partkey % 4 AS page, l_orderkey * 10 + l_linenumber AS block_id, (l_suppkey % 90) * 8.0 AS y, l_linenumber % 3 = 0 AS vals FROM lineitem),
h AS (SELECT DISTINCT block_id, page FROM b JOIN (SELECT unnest(range(0, 4)) AS page, unnest([100.0, 200.0, 300.0, 400.0]) AS lo, unnest([160.0, 290.0, 330.0, 600.0]) AS hi) k USING (page) WHERE vals AND y + 5 BETWEEN lo AND hi)
SELECT doc_id, count(*)::BIGINT AS blocks, count(*) FILTER ((block_id, page) IN (SELECT (block_id, page) FROM h))::BIGINT AS suppressed FROM b GROUP BY 1"""
)
def band_suppression(spark, sf_dir):
    n = F.col("l_linenumber") % 3 == 0
    q = F.col("l_quantity").cast("long").cast("string")
    blocks = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("doc_id"), (F.col("l_partkey") % 4).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), F.lit("BODY").alias("type"),
        F.when(n, F.concat_ws(" ", F.lit("Age"), q, q, F.lit("0.5"))).otherwise("a line of words").alias("text"), (F.col("l_suppkey") % 90 * 8.0).alias("y"), F.lit(10.0).alias("height"), F.lit(True).alias("translate"), F.lit(None).cast("string").alias("skip_reason"),
    )
    page = F.col("id") % 4
    low, high = F.get(F.array(*[F.lit(v) for v in (100.0, 200.0, 300.0, 400.0)]), page.cast("int")), F.get(F.array(*[F.lit(v) for v in (160.0, 290.0, 330.0, 600.0)]), page.cast("int"))
    bands = spark.range(200).select(F.floor(F.col("id") / 4).alias("doc_id"), page.alias("page"), low.alias("bottom"), high.alias("top"))
    found = regions.suppress_in_bands(blocks, bands)
    return found.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("skip_reason") == "TABLE_BAND_UNRESOLVED").alias("suppressed"))


_RULES = "ru AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey % 3 AS page, (c_custkey * 29 % 560)::DOUBLE AS x0, (c_custkey * 29 % 560 + 10 + c_custkey % 600)::DOUBLE AS x1, (c_custkey * 71 % 780)::DOUBLE AS y FROM customer)"
_CELLS = "ce AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey % 3 AS page, c_custkey AS cell_id, (c_custkey * 37 % 500)::DOUBLE AS l, (c_custkey * 37 % 500 + 40)::DOUBLE AS r, (c_custkey * 53 % 700 + 12)::DOUBLE AS hi, (c_custkey * 53 % 700)::DOUBLE AS lo FROM customer)"


def _rules(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    x = (k * 29 % 560).cast("double")
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), (k % 3).cast("int").alias("page"), x.alias("x0"), (x + 10 + k % 600).alias("x1"), (k * 71 % 780).cast("double").alias("y"))


def _cells(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k * 37 % 500).cast("double"), (k * 53 % 700).cast("double")
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), (k % 3).cast("int").alias("page"), k.alias("cell_id"), x.alias("left"), (x + 40).alias("right"), (y + 12).alias("min_top"), y.alias("max_bottom"))


@_query(
    f"""WITH {_RULES}, {_CELLS}
SELECT ce.cell_id, min(CASE WHEN x1 > l AND x0 < r AND y >= hi THEN y END) AS rule_above, max(CASE WHEN x1 > l AND x0 < r AND y <= lo THEN y END) AS rule_below
FROM ce LEFT JOIN ru ON ce.doc_id = ru.doc_id AND ce.page = ru.page GROUP BY 1"""
)
def nearest_rules(spark, sf_dir):
    return regions.nearest_rules(_cells(spark, sf_dir), _rules(spark, sf_dir)).select("cell_id", "rule_above", "rule_below")


@_query(
    f"""WITH {_RULES}, {_CELLS}
SELECT cell_id, EXISTS (SELECT 1 FROM ru WHERE ru.doc_id = ce.doc_id AND ru.page = ce.page AND y > lo + 0.55 * 8.0 AND y < hi + 20 - 0.2 * 8.0 AND x1 > l AND x0 < r) AS ruled FROM ce"""
)
def ruled_pairs(spark, sf_dir):
    pairs = _cells(spark, sf_dir).select("doc_id", "page", F.col("cell_id").alias("pair_id"), "left", "right", (F.col("min_top") + 20).alias("upper_y"), F.col("max_bottom").alias("lower_y"), F.lit(8.0).alias("font_size"))
    return regions.ruled_apart(pairs, _rules(spark, sf_dir)).select(F.col("pair_id").alias("cell_id"), "ruled")


@_query(f"WITH {_RULES} SELECT doc_id, count(*)::BIGINT AS rules, count(*) FILTER (x1 - x0 >= 0.8 * 612 AND (y <= 0.12 * 792 OR y >= 792 - 0.12 * 792))::BIGINT AS furniture FROM ru GROUP BY 1")
def furniture_rules(spark, sf_dir):
    test = regions.is_page_furniture(F.col("x0"), F.col("x1"), F.col("y"), F.lit(True), (0.0, 0.0, 612.0, 792.0))
    return _rules(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("rules"), F.count_if(test).alias("furniture"))


@_query(
    """WITH b AS (SELECT conv_id AS doc_id, turn AS ord, 'b' || turn AS block_id, CASE WHEN turn % 4 IN (1, 2) THEN 'g' || turn // 4 END AS g FROM conversations),
f AS (SELECT doc_id, g, min(ord) AS pos, arg_min(block_id, ord) AS first_id FROM b WHERE g IS NOT NULL GROUP BY 1, 2),
c AS (SELECT f.doc_id, g, k, g || 'c' || k AS cell_id FROM f, (SELECT unnest(range(0, 3)) AS k) WHERE f.doc_id % 3 <> 0),
e AS (SELECT doc_id, ord AS a, 0 AS k, block_id FROM b WHERE g IS NULL UNION ALL SELECT f.doc_id, pos, coalesce(k, 0), coalesce(cell_id, first_id) FROM f LEFT JOIN c ON f.doc_id = c.doc_id AND f.g = c.g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, k, block_id) - 1)::INTEGER AS ord, block_id FROM e"""
)
def cells_for_blocks(spark, sf_dir):
    turn = F.col("turn").cast("int")
    group = F.when((turn % 4 == 1) | (turn % 4 == 2), F.concat(F.lit("g"), F.floor(turn / 4).cast("string")))
    blocks = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("ord"), F.concat(F.lit("b"), turn.cast("string")).alias("block_id"), group.alias("group"))
    cells = blocks.where("group IS NOT NULL AND doc_id % 3 <> 0").select("doc_id", "group").distinct().select("doc_id", "group", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cell_ord"))
    cells = cells.withColumn("block_id", F.concat(F.col("group"), F.lit("c"), F.col("cell_ord").cast("string")))
    return regions.replace_by_cells(blocks.withColumn("ord", F.col("ord")), cells)


@_query(
    """WITH b AS (SELECT conv_id AS doc_id, turn AS ord, 'b' || turn AS block_id FROM conversations),
e AS (SELECT doc_id, ord AS a, 1 AS k, block_id FROM b UNION ALL SELECT doc_id, ord, 0, 'label-' || block_id FROM b WHERE ord % 3 = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, k, block_id) - 1)::INTEGER AS ord, block_id FROM e"""
)
def labels_before_blocks(spark, sf_dir):
    turn = F.col("turn").cast("int")
    blocks = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("ord"), F.concat(F.lit("b"), turn.cast("string")).alias("block_id"))
    labels = blocks.where("ord % 3 = 1").select("doc_id", F.col("block_id").alias("before"), F.concat(F.lit("label-"), "block_id").alias("block_id"))
    return regions.insert_before(blocks, labels)


@_query(
    r"""WITH c AS (SELECT l_orderkey AS t, l_linenumber // 2 AS r, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN l_quantity::BIGINT::VARCHAR ELSE l_returnflag || ' by' END AS v FROM lineitem),
r AS (SELECT t, r, count(*) AS n, max(regexp_matches(v, '^\d+$')) AS num FROM c GROUP BY 1, 2)
SELECT t AS table_id, coalesce(min(CASE WHEN n >= 2 AND num THEN r END), 0)::INTEGER AS data_row FROM r GROUP BY 1"""
)
def first_data_rows(spark, sf_dir):
    n = (F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0
    cells = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("row"), F.when(n, F.col("l_quantity").cast("long").cast("string")).otherwise(F.concat("l_returnflag", F.lit(" by"))).alias("text"))
    return regions.first_data_row(cells, ["table_id"])


# ---------------------------------------------------------------- outputs


@_query(
    """WITH r AS (SELECT l_suppkey, l_partkey % 40 AS a, l_partkey % 40 + l_linenumber AS b FROM lineitem),
p AS (SELECT DISTINCT l_suppkey, unnest(range(least(greatest(a, 1), 30), least(greatest(b, 1), 30) + 1)) AS page FROM r),
g AS (SELECT *, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS run FROM p),
e AS (SELECT l_suppkey, min(page) AS a, max(page) AS b FROM g GROUP BY l_suppkey, run)
SELECT l_suppkey, (SELECT count(*) FROM p WHERE p.l_suppkey = e.l_suppkey)::BIGINT AS kept, (SELECT count(*) FROM p WHERE p.l_suppkey = e.l_suppkey) >= 30 AS "full", '_p' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, '_' ORDER BY a) AS suffix FROM e GROUP BY 1"""
)
def output_pages(spark, sf_dir):
    first = (F.col("l_partkey") % 40).cast("long")
    ranges = _t(spark, sf_dir, "lineitem").select("l_suppkey", first.alias("start_page"), (first + F.col("l_linenumber")).alias("end_page"), F.lit(30).cast("long").alias("pages"))
    return outputs.output_pages(ranges, "l_suppkey")


@_query(
    """WITH RECURSIVE e AS (SELECT o_orderkey % 40 AS doc_id, o_orderkey // 40 AS node, CASE WHEN o_orderkey // 40 > 0 THEN (o_orderkey // 40 - 1) // 3 END AS parent FROM orders),
d AS (SELECT DISTINCT doc_id, 0::BIGINT AS root, 0::BIGINT AS node FROM e UNION ALL SELECT d.doc_id, d.root, e.node FROM d JOIN e ON e.doc_id = d.doc_id AND e.parent = d.node)
SELECT doc_id, root, count(*)::BIGINT AS nodes, sum(node)::BIGINT AS total FROM d GROUP BY 1, 2"""
)
def chapter_subtrees(spark, sf_dir):
    node = F.floor(F.col("o_orderkey") / 40)
    edges = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("doc_id"), node.alias("node"), F.when(node > 0, F.floor((node - 1) / 3)).alias("parent"))
    roots = edges.select("doc_id", F.lit(0).cast("long").alias("root")).distinct()
    return outputs.subtree(edges, roots).groupBy("doc_id", "root").agg(F.count("*").alias("nodes"), F.sum("node").alias("total"))


@_query(
    """WITH s AS (SELECT l_suppkey, list_sort(list_distinct(list('c' || l_partkey % 60))) AS ids, min(l_linenumber) AS a, max(l_partkey % 60) AS b FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE l_suppkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'pages:' || a || '-' || b ELSE 'chapters:' || len(ids) END AS scope FROM s"""
)
def scope_fingerprints(spark, sf_dir):
    chosen = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.concat(F.lit("c"), (F.col("l_partkey") % 60).cast("string"))).alias("ids"), F.min("l_linenumber").alias("a"), F.max(F.col("l_partkey") % 60).alias("b"))
    n = F.col("l_suppkey") % 3
    mode = F.when(n == 0, "all").when(n == 1, "pages").otherwise("chapters")
    whole = outputs.scope_fingerprint(mode, F.col("a"), F.col("b"), F.col("ids"))
    # the ids of a chapter scope are hashed beyond 60 characters, so only their number is compared
    return chosen.select("l_suppkey", F.regexp_replace(whole, r"^(chapters:\d+):.*$", "$1").alias("scope"))


_UNITS = f"""{_ITEMS},
u AS (SELECT doc_id, item_id AS ord, 'u' || item_id AS unit_id, page, CASE WHEN item_id = 0 THEN 'TITLE' WHEN item_id % 9 = 4 THEN 'HEADING' WHEN item_id % 11 = 6 THEN 'CAPTION' ELSE 'BODY' END AS type, CASE WHEN item_id = 3 THEN 'Abstract ' || text ELSE text END AS text FROM items)"""


def _units(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    kind = F.when(i == 0, "TITLE").when(i % 9 == 4, "HEADING").when(i % 11 == 6, "CAPTION").otherwise("BODY")
    body = F.when(i == 3, F.concat(F.lit("Abstract "), "text")).otherwise(F.col("text"))
    return text_items(_t(spark, sf_dir, "documents")).select("doc_id", i.alias("ord"), F.concat(F.lit("u"), i.cast("string")).alias("unit_id"), F.col("page").cast("int").alias("page"), kind.alias("type"), body.alias("text"))


@_query(
    f"""WITH {_UNITS},
f AS (SELECT doc_id, unit_id, ord, 0 AS a, list_position(['TITLE', 'HEADING', 'CAPTION', 'FOOTNOTE'], type)::BIGINT AS b FROM u WHERE type <> 'BODY' QUALIFY row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) = 1),
o AS (SELECT doc_id, unit_id, ord, CASE WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) = 1 THEN 1 ELSE 2 END AS a, ord::BIGINT AS b FROM u WHERE type = 'BODY' AND length(text) >= 120)
SELECT doc_id, unit_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, ord) AS place FROM (SELECT * FROM f UNION ALL SELECT * FROM o)) WHERE place <= 8"""
)
def developer_samples(spark, sf_dir):
    return outputs.developer_sample(_units(spark, sf_dir))


@_query(f"WITH {_UNITS} SELECT doc_id, unit_id FROM u WHERE type = 'TITLE' OR ord = 3")
def terminology_context(spark, sf_dir):
    return outputs.terminology_context(_units(spark, sf_dir)).select("doc_id", "unit_id")


@_query(f"WITH {_UNITS} SELECT doc_id, count(*)::BIGINT AS units, min(ord)::BIGINT AS first_ord, max(ord)::BIGINT AS last_ord FROM u WHERE ord = 3 GROUP BY 1")
def abstract_units(spark, sf_dir):
    return outputs.abstract_units(_units(spark, sf_dir).withColumn("translate", F.lit(True))).groupBy("doc_id").agg(F.count("*").alias("units"), F.min("ord").cast("long").alias("first_ord"), F.max("ord").cast("long").alias("last_ord"))


@_query(
    r"""WITH o AS (SELECT p_partkey % 30 AS doc_id, p_partkey AS entry, p_name AS title, p_partkey % 5 AS page FROM part),
k AS (SELECT p_partkey % 30 AS doc_id, p_partkey AS block_id, (p_partkey * 7) % 9 AS b_page, (p_partkey * 13 % 700)::DOUBLE AS top, CASE WHEN p_partkey % 2 = 0 THEN 'HEADING' ELSE 'BODY' END AS type, upper(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' more' ELSE '' END AS txt FROM part),
n AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS a FROM o), m AS (SELECT *, regexp_replace(lower(txt), '[^a-z0-9]+', '', 'g') AS b FROM k),
j AS (SELECT n.doc_id, entry, block_id, CASE WHEN type = 'HEADING' THEN 0 ELSE 1 END AS r, b_page, top FROM n JOIN m ON n.doc_id = m.doc_id AND (a = b OR (length(a) >= 6 AND length(b) >= 6 AND (starts_with(a, b) OR starts_with(b, a)))) AND ((type = 'HEADING' AND b_page >= page) OR b_page = page))
SELECT o.doc_id, o.entry, (SELECT arg_min(block_id, (r * 100 + b_page) * 100000 + (1000 - top) + block_id / 10000000.0) FROM j WHERE j.entry = o.entry) AS block_id FROM o"""
)
def outline_headings(spark, sf_dir):
    k = F.col("p_partkey")
    part = _t(spark, sf_dir, "part")
    outline = part.select((k % 30).alias("doc_id"), k.alias("entry"), F.col("p_name").alias("title"), (k % 5).alias("page"))
    blocks = part.select((k % 30).alias("doc_id"), k.alias("block_id"), (k * 7 % 9).alias("page"), (k * 13 % 700).cast("double").alias("top"), F.when(k % 2 == 0, "HEADING").otherwise("BODY").alias("type"), F.lit(1).alias("line_count"), F.lit(False).alias("cell"), F.concat(F.upper("p_name"), F.when(k % 3 == 0, " more").otherwise("")).alias("text"))
    return outputs.snap_outline(outline, blocks)


# ---------------------------------------------------------------- glossaries


def _terms(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), k.alias("ord"), F.col("p_type").alias("source"), F.concat(F.lit("詞"), (k % 7).cast("string")).alias("target"), F.when(k % 3 == 0, F.concat(F.lit("A"), (k % 9).cast("string"))).alias("abbreviation"))


_TERMS = "t AS (SELECT p_brand AS key, p_partkey AS ord, p_type AS source, '詞' || p_partkey % 7 AS target, CASE WHEN p_partkey % 3 = 0 THEN 'A' || p_partkey % 9 END AS abbreviation FROM part)"


@_query(f"WITH {_TERMS}, l AS (SELECT key, lower(source) AS name, arg_max(target || coalesce('（' || abbreviation || '）', ''), ord) AS rendering FROM t GROUP BY 1, 2) SELECT * FROM l")
def batch_glossaries(spark, sf_dir):
    terms = _terms(spark, sf_dir).withColumn("block", F.col("ord")).withColumn("place", F.lit(0))
    got = glossary.batch_glossary(terms, ["key"])
    return got.select("key", "name", glossary.rendering(F.col("target"), F.col("abbreviation")).alias("rendering"))


@_query(
    f"""WITH {_TERMS}, d AS (SELECT * FROM t WHERE p_ok(source) QUALIFY row_number() OVER (PARTITION BY key, lower(source) ORDER BY ord) = 1)
SELECT key, ord::BIGINT AS ord FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) <= 50""".replace("p_ok(source)", "length(source) BETWEEN 2 AND 80 AND lower(source) <> 'promo burnished tin'")
)
def capped_terms(spark, sf_dir):
    return glossary.valid_terms(_terms(spark, sf_dir), ["promo burnished tin"]).select("key", F.col("ord").cast("long").alias("ord"))


def _fnv(value: str) -> str:
    """FNV-1a over a short ASCII text in SQL, folded over its characters."""
    return f"lpad(lower(hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({value}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT))), 8, '0')"


@_query(
    "WITH t AS (SELECT c_nationkey::BIGINT AS key, 'term' || c_custkey % 40 AS source, 'x' || c_custkey % 7 AS target FROM customer), "
    f"l AS (SELECT key, string_agg(lower(source) || chr(1) || target || chr(1), chr(10) ORDER BY lower(source) || chr(1) || target || chr(1)) AS joined FROM t GROUP BY 1) SELECT key, {_fnv('joined')} AS term_hash FROM l"
)
def term_hashes(spark, sf_dir):
    k = F.col("c_custkey")
    terms = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("key"), F.concat(F.lit("Term"), (k % 40).cast("string")).alias("source"), F.concat(F.lit("x"), (k % 7).cast("string")).alias("target"), F.lit(None).cast("string").alias("abbreviation"))
    return glossary.list_hash(terms, "key")


@_query(
    "WITH l AS (SELECT n_regionkey::BIGINT AS key, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS joined, count(*) AS n, sum(length(n_name)) AS chars FROM nation GROUP BY 1) "
    f"SELECT key, n || ':' || chars || ':' || {_fnv('joined')} AS fingerprint FROM l"
)
def text_fingerprints(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("key"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text"))
    return glossary.fingerprints(names, "key", "ord")


@_query(
    """WITH RECURSIVE t AS (SELECT p_size % 5 AS key, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) AS r, p_partkey AS ord, lower(p_type) AS source, 'a' || p_partkey % 40 AS abbr FROM part),
f AS (
  SELECT key, r, [source, abbr] AS taken, [ord] AS kept FROM t WHERE r = 1
  UNION ALL
  SELECT f.key, t.r, CASE WHEN list_contains(taken, source) OR list_contains(taken, abbr) THEN taken ELSE taken || [source, abbr] END, CASE WHEN list_contains(taken, source) OR list_contains(taken, abbr) THEN kept ELSE kept || [ord] END
  FROM f JOIN t ON f.key = t.key AND t.r = f.r + 1)
SELECT key, unnest(kept)::BIGINT AS ord FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1"""
)
def scope_terms(spark, sf_dir):
    k = F.col("p_partkey")
    terms = _t(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("key"), k.alias("ord"), F.col("p_type").alias("source"), F.concat(F.lit("a"), (k % 40).cast("string")).alias("abbreviation"))
    return glossary.union_scopes(terms).select("key", F.col("ord").cast("long").alias("ord"))


@_query(
    """WITH m AS (SELECT c_nationkey AS document, c_custkey % 4 AS scope, c_custkey AS term FROM customer), f AS (SELECT c_nationkey AS document, c_custkey % 4 AS scope, c_custkey + 1000000 AS term FROM customer WHERE c_custkey % 4 = c_nationkey % 4)
SELECT document::BIGINT AS document, scope::BIGINT AS scope, count(*)::BIGINT AS terms, sum(term)::BIGINT AS total FROM (SELECT * FROM m WHERE (document, scope) NOT IN (SELECT (document, scope) FROM f) UNION ALL SELECT * FROM f) GROUP BY 1, 2"""
)
def scope_memory(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    memory = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("document"), (k % 4).alias("scope"), k.alias("term"))
    fresh = memory.where(F.col("scope") == F.col("document") % 4).withColumn("term", F.col("term") + 1_000_000)
    return glossary.keep_newest(memory, fresh).groupBy("document", "scope").agg(F.count("*").alias("terms"), F.sum("term").alias("total"))


# ---------------------------------------------------------------- reports


@_query(
    """SELECT l_orderkey, l_linenumber, 'p.' || l_linenumber || CASE WHEN l_suppkey % 9 > l_linenumber THEN '–' || l_suppkey % 9 ELSE '' END AS label, format('{:,}', (l_partkey * 1234)::BIGINT) AS tokens,
  CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE printf('%.1f', round((l_suppkey % 9) * 100.0::DOUBLE / 8, 1)) || '%' END AS rate FROM lineitem"""
)
def report_labels(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_suppkey") % 9
    lines = _t(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", reporting.page_label(n, k).alias("label"), reporting.tokens((F.col("l_partkey") * 1234).cast("double")).alias("tokens"), reporting.correction_rate(k, F.when(n % 3 == 0, 0).otherwise(8)).alias("rate"))


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '文' || o_orderkey WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 90 + 1) || ' 文' || o_orderkey WHEN o_orderkey % 4 = 2 THEN '† 文' || o_orderkey ELSE '文' || o_orderkey END AS note FROM orders"""
)
def footnote_markers(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k % 4
    source = F.when(n == 1, F.concat((k % 90 + 1).cast("string"), F.lit(" A note"))).when(n == 2, F.lit("  †See the text")).otherwise(F.lit("A note"))
    bare = F.concat(F.lit("文"), k.cast("string"))
    said = F.when((n == 1) & (k % 8 == 1), F.concat((k % 90 + 1).cast("string"), F.lit(" "), bare)).otherwise(bare)
    return _t(spark, sf_dir, "orders").select("o_orderkey", reporting.keep_footnote_marker(F.when(n == 0, "BODY").otherwise("FOOTNOTE"), source, said).alias("note"))


@_query(
    r"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z\s-]', ' ', 'g'), '[\s-]+'), lambda x: length(x) >= 2 AND x NOT IN ('and', 'of', 'the', 'in')) AS ws FROM part)
SELECT p_partkey, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: x IN ('part', 'methods', 'green', 'blue'))) / len(ws)::DOUBLE ELSE 0.0::DOUBLE END AS hints FROM w"""
)
def label_hints(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", reporting.label_hint_share(F.col("p_name"), ["part", "methods", "green", "blue"]).alias("hints"))


@_query(
    """WITH k AS (SELECT doc_id, text, encode('a key of the service') AS key_ FROM documents),
i AS (SELECT doc_id, sha256(from_hex('{inner}') || encode(text)) AS h FROM k)
SELECT doc_id, substr(sha256(from_hex('{outer}') || from_hex(h)), 1, 12) AS digest FROM i""".format(
        inner=bytes(b ^ 0x36 for b in b"a key of the service".ljust(64, b"\0")).hex(), outer=bytes(b ^ 0x5C for b in b"a key of the service".ljust(64, b"\0")).hex()
    )
)
def keyed_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", reporting.keyed_hash("a key of the service", F.col("text"), 12).alias("digest"))


@_query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INTEGER AS verdicts, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END::BIGINT AS used FROM orders"""
)
def reply_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k % 4
    whole = '{"verdicts": [{"id": "a", "ok": true}, {"id": "b", "ok": false, "correction": "x"}]}'
    reply = F.when(n == 0, whole).when(n == 1, '{"verdicts": [{"id": "a", "ok": true}, {"ok": true}, {"id": "c"}]}').when(n == 2, "no json").otherwise('{"other": 1}')
    used = F.when(k % 5 == 0, F.lit(-3.0)).otherwise(k + 0.5)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.size(reporting.reply_verdicts(reply)).alias("verdicts"), reporting.usage_count(used).alias("used"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
