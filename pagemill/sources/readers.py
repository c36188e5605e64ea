"""Readers and sinks: text items, PDF sniffing, glossaries, render plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "doc_id long, item_id long, page int, text string, x double, y double, width double, height double, font_size double, font_name string, font_family string, font_real_name string, has_eol boolean, transform array<double>"
GRAPHICS = "doc_id long, page int, seq long, kind string, orientation string, x0 double, y0 double, x1 double, y1 double, width double, height double, thickness double, color string"
PAGES = "doc_id long, page int, width double, height double, rotation int, view array<double>"


def read_items(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Text items with the fixed schema; blank ones are left out, coordinates get two decimals."""
    items = spark.read.schema(ITEMS).format(form).load(path)
    two = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    size = F.when(F.size("transform") == 6, F.hypot(F.get("transform", F.lit(2)), F.get("transform", F.lit(3)))).otherwise(F.col("font_size"))
    return items.where(F.regexp_like("text", F.lit(r"[^\s]"))).withColumns({c: two(c) for c in ("x", "y", "width", "height")} | {"font_size": size})


def read_graphics(spark: SparkSession, path: str, form: str = "parquet", per_page: int = 4000) -> DataFrame:
    """Rules, fills and frames that pass the size tests, the first ``per_page`` of each page in paint order.

    The limit is the documented guard of the clustering operators, not a way out of skew.
    """
    from pyspark.sql import Window

    g = spark.read.schema(GRAPHICS).format(form).load(path)
    long, thin = F.greatest("width", "height"), F.least("width", "height")
    ok = ((F.col("kind") == "rule") & (thin <= 2.5) & (long >= 6) & (long >= thin * 3)) | ((F.col("kind") == "fill") & (F.col("width") * F.col("height") >= 40)) | ((F.col("kind") == "frame") & (thin >= 8)) | (F.col("kind") == "image")
    return g.where(ok).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq"))).where(F.col("n") <= per_page).drop("n")


def is_pdf(content: Column, name: Column) -> Column:
    """By name and by the mark in the first 1,024 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.regexp_like(name, F.lit(r"(?i)\.pdf$")) & F.contains(head, F.lit("%PDF-"))


def transform_box(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Bounding box of a rectangle under a 2 x 3 affine matrix [a, b, c, d, e, f]."""
    at = lambda i: F.get(m, F.lit(i))
    xs = [at(0) * x + at(2) * y + at(4) for x in (x0, x1) for y in (y0, y1)]
    ys = [at(1) * x + at(3) * y + at(5) for x in (x0, x1) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def compose(m: Column, n: Column) -> Column:
    """The matrix that applies ``n`` first, then ``m``."""
    a, b = lambda i: F.get(m, F.lit(i)), lambda i: F.get(n, F.lit(i))
    return F.array(
        a(0) * b(0) + a(2) * b(1), a(1) * b(0) + a(3) * b(1), a(0) * b(2) + a(2) * b(3), a(1) * b(2) + a(3) * b(3),
        a(0) * b(4) + a(2) * b(5) + a(4), a(1) * b(4) + a(3) * b(5) + a(5),
    )


def flat_shading(stops: Column) -> Column:
    """The colour of a gradient whose visible stops are all one, else null."""
    seen = F.array_distinct(F.transform(F.filter(stops, lambda s: s["alpha"] > 0), lambda s: s["color"]))
    return F.when(F.size(seen) == 1, F.get(seen, F.lit(0)))


def parse_glossary(texts: DataFrame) -> DataFrame:
    """(key, text) of a JSON object or of lines "term = target" -> key, line, source, target, abbreviation, error.

    =, ->, the arrow and : separate; lines that start with # are comments; a line without a separator is
    an error that carries its number.
    """
    as_json = F.from_json("text", "map<string,string>")
    from_json = texts.where(as_json.isNotNull()).select("key", F.posexplode(F.map_entries(as_json)).alias("p", "e")).select("key", (F.col("p") + 1).alias("line"), F.col("e.key").alias("raw"), F.col("e.value").alias("target"), F.lit(False).alias("error"))
    lines = texts.where(as_json.isNull()).select("key", F.posexplode(F.split("text", r"\r?\n")).alias("p", "s")).select("key", (F.col("p") + 1).alias("line"), F.trim("s").alias("s")).where((F.col("s") != "") & ~F.startswith("s", F.lit("#")))
    form = r"^(.+?)\s*(?:=|→|->|:)\s*(.+)$"
    from_lines = lines.select("key", "line", F.regexp_extract("s", form, 1).alias("raw"), F.regexp_extract("s", form, 2).alias("target"), (~F.regexp_like("s", F.lit(form))).alias("error"))
    both = from_json.unionByName(from_lines)
    named = r"^(.+?)\s*\(([A-Za-z0-9][A-Za-z0-9\-/+.]{0,14})\)$"
    has = F.regexp_like("raw", F.lit(named))
    return both.select("key", "line", F.when(has, F.regexp_extract("raw", named, 1)).otherwise(F.col("raw")).alias("source"), "target", F.when(has, F.regexp_extract("raw", named, 2)).alias("abbreviation"), "error")


def worker_glossary(terms: DataFrame) -> DataFrame:
    """(key, glossary): one map per key; the later of two entries for a source wins; abbreviations are appended."""
    shown = F.when(F.col("abbreviation").isNotNull() & ~F.contains("target", F.col("abbreviation")), F.concat("target", F.lit("（"), "abbreviation", F.lit("）"))).otherwise(F.col("target"))
    last = terms.groupBy("key", "source").agg(F.max_by(shown, "line").alias("target"))
    return last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "target")))).alias("glossary"))


def write_render_plan(plan: DataFrame, path: str) -> None:
    """Masks before texts on every page, dealt out by document."""
    order = F.when(F.col("op") == "mask", 0).otherwise(1)
    plan.withColumn("layer", order).repartition("doc_id").sortWithinPartitions("doc_id", "page", "layer", "seq").drop("layer").write.mode("overwrite").parquet(path)
