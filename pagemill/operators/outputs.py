"""What a job puts out: pages to keep, chapters below a chapter, headings that outline entries mean, samples of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .folds import held
from .scope import page_runs, run_suffix

# Fixed value: letters that a title shares at least with a longer one.
PREFIX = 6


def scope_fingerprint(mode: Column, start: Column, end: Column, chapters: Column) -> Column:
    """``all``, ``pages:a-b`` or ``chapters:n:ids``; long lists of ids as their hash."""
    ids = F.array_sort(F.array_distinct(F.coalesce(chapters, F.array().cast("array<string>"))))
    named = text.bound(F.array_join(ids, ","), lambda j: F.when(F.length(j) <= 60, j).otherwise(text.fnv1a(j)))
    listed = F.concat(F.lit("chapters:"), F.size(ids).cast("string"), F.lit(":"), named)
    paged = F.concat(F.lit("pages:"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(mode == "all", F.lit("all")).when(mode == "pages", paged).otherwise(listed)


def clamped(page: Column, total: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), total)


def range_pages(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page): the distinct pages of ranges (keys, start_page, end_page, pages), clamped to the document."""
    total = F.greatest(F.col("pages"), F.lit(1))
    first, last = clamped(F.col("start_page"), total), clamped(F.coalesce("end_page", "start_page"), total)
    return ranges.select(*keys, F.explode(F.sequence(first, F.greatest(first, last))).alias("page")).distinct()


def output_pages(ranges: DataFrame, key: str) -> DataFrame:
    """(key, kept, full, suffix): how many pages a document's output keeps, and the suffix of its name.

    A selection of all pages is the whole document.
    """
    pages = range_pages(ranges, [key])
    kept = pages.groupBy(key).agg(F.count("*").alias("kept"))
    named = run_suffix(page_runs(pages, key), key)
    total = ranges.groupBy(key).agg(F.greatest(F.max("pages"), F.lit(1)).alias("total"))
    return kept.join(total, key).join(named, key).select(key, "kept", (F.col("kept") >= F.col("total")).alias("full"), "suffix")


def subtree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, node): the chapters at or below each root; ``edges`` (doc_id, node, parent) form trees.

    Every round doubles the steps upwards that have been followed, so a tree may be of any depth and size, and the
    rounds are the logarithm of its depth.  A chapter below itself is an error.
    """
    own = ["doc_id", "node"]
    steps = edges.where(F.col("parent").isNotNull()).select(*own, F.col("parent").alias("up"))
    found = roots.select("doc_id", "root", F.col("root").alias("node"))
    followed, most = 1, None
    while True:
        below = steps.join(found.withColumnRenamed("node", "up"), ["doc_id", "up"]).select("doc_id", "root", "node")
        found = held(found.unionByName(below))
        steps = held(steps.join(steps.select("doc_id", F.col("node").alias("up"), F.col("up").alias("next")), ["doc_id", "up"]).select(*own, F.col("next").alias("up")))
        followed *= 2
        if steps.isEmpty():
            return found
        most = edges.count() if most is None else most
        if followed > most:
            raise ValueError("a chapter stands below itself")


def snap_outline(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outline entries (doc_id, entry, title, page) with the block that they mean, or null.

    Headings and titles on the entry's page or later come first, by page and height; then short blocks on
    its page.  Titles match when one is the other or a prefix of it of six letters or more.  Equal titles of a page
    collapse on both sides; a title and its prefixes meet the texts and their prefixes, so no pairs are made, and the next
    page with a heading is a running minimum.
    """
    heading = F.col("type").isin("HEADING", "TITLE")
    loose = (F.col("line_count") <= 2) & ~F.col("type").isin("HEADER", "FOOTER") & ~F.col("cell")
    name = lambda c: text.normalize_title(F.col(c)).alias("name")
    short = F.length("name") < PREFIX
    prefixes = F.when(short, F.array("name")).otherwise(F.transform(F.sequence(F.lit(PREFIX), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n)))
    rank = F.struct(F.when(heading, 0).otherwise(1).alias("r"), F.col("page").alias("b_page"), (-F.col("top")).alias("t"), "block_id").alias("best")
    fits = F.coalesce(heading, F.lit(False)) | F.coalesce(loose, F.lit(False))
    b = blocks.select("doc_id", "page", name("text"), rank, fits.alias("fits")).where("fits AND name <> '' AND page IS NOT NULL")
    b = b.groupBy("doc_id", "page", "name", F.col("best.r").alias("r")).agg(F.min("best").alias("best"))
    o = outline.select("doc_id", "entry", "page", name("title")).where("name <> '' AND page IS NOT NULL")
    asked = o.select("doc_id", "page", "name").distinct()
    # a text under its prefixes meets whole titles; whole texts meet titles under their prefixes of six letters or more
    wide = lambda df, *own: df.select("doc_id", "page", "name", *own, F.explode(prefixes).alias("part"))
    no_block, no_title = F.lit(None).cast(b.schema["best"].dataType).alias("best"), F.lit(None).cast("string").alias("name")
    met = None
    for there, here in ((wide(b, "r", "best"), asked.select("doc_id", "page", "name", F.col("name").alias("part"))), (b.select("*", F.col("name").alias("part")), wide(asked))):
        texts = there.groupBy("doc_id", "part", "page", "r").agg(F.min("best").alias("best"))
        both = texts.select("doc_id", "part", "page", "r", "best", no_title).unionByName(here.select("doc_id", "part", "page", F.lit(None).cast("int").alias("r"), no_block, "name"))
        # pages from the last to the first; a page's own blocks are peers of its titles
        later = Window.partitionBy("doc_id", "part").orderBy(F.col("page").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        own = Window.partitionBy("doc_id", "part", "page")
        found = both.withColumn("next", F.min(F.when(F.col("r") == 0, F.col("best"))).over(later)).withColumn("own", F.min(F.when(F.col("r") == 1, F.col("best"))).over(own))
        found = found.where("name IS NOT NULL").select("doc_id", "page", "name", F.coalesce("next", "own").alias("best"))
        met = found if met is None else met.unionByName(found)
    titles = met.groupBy("doc_id", "page", "name").agg(F.min("best").alias("best"))
    best = o.join(titles, ["doc_id", "page", "name"]).groupBy("doc_id", "entry").agg(F.min("best").alias("best"))
    return outline.join(best, ["doc_id", "entry"], "left").select("doc_id", "entry", F.col("best.block_id").alias("block_id"))


def developer_sample(units: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, unit_id, place) of a small sample: the first title, heading, caption and footnote, then long body text.

    Body text of 120 characters or more comes first from a page each, then in order.
    """
    doc = Window.partitionBy("doc_id")
    kinds = ["TITLE", "HEADING", "CAPTION", "FOOTNOTE"]
    first = units.where(F.col("type").isin(kinds)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("ord"))).where("n = 1")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("type"))
    body = units.where((F.col("type") == "BODY") & (F.length("text") >= 120)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")))
    every = first.select("doc_id", "unit_id", "ord", F.lit(0).alias("a"), rank.cast("long").alias("b")).unionByName(body.select("doc_id", "unit_id", "ord", F.when(F.col("n") == 1, 1).otherwise(2).alias("a"), F.col("ord").cast("long").alias("b")))
    return every.withColumn("place", F.row_number().over(doc.orderBy("a", "b", "ord"))).where(F.col("place") <= most).select("doc_id", "unit_id", "place")


def terminology_context(units: DataFrame) -> DataFrame:
    """Units (doc_id, ord, page, type, text) that terms are asked for: titles, the abstract, and its body after a bare heading."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    abstract = (F.col("page") <= 2) & F.regexp_like(text.trim(F.col("text")), F.lit(rf"(?i)^abstract{text.B1}"))
    marked = units.withColumn("a_first", abstract & (F.coalesce(F.sum(abstract.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0))
    marked = marked.withColumn("a_after", F.coalesce(F.lag("a_first").over(w) & (F.lag("type").over(w) == "HEADING"), F.lit(False)) & (F.col("type") == "BODY") & (F.col("page") <= 2))
    return marked.where((F.col("type") == "TITLE") | F.col("a_first") | F.col("a_after")).drop("a_first", "a_after")


def abstract_units(blocks: DataFrame, most: int = 5) -> DataFrame:
    """Blocks (doc_id, ord, page, type, text, translate) of the abstract: from its first block on pages 1-2 to the next heading."""
    doc, w = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("ord")
    opens = (F.col("page") <= 2) & F.regexp_like("text", F.lit(rf"(?i)^abstract{text.B1}"))
    started = blocks.withColumn("s_ord", F.min(F.when(opens, F.col("ord"))).over(doc)).where(F.col("ord") >= F.col("s_ord"))
    started = started.withColumn("s_page", F.first("page").over(w))
    stop = (F.col("ord") > F.col("s_ord")) & (F.col("type").isin("HEADING", "TITLE") | (F.col("page") > F.col("s_page") + 1))
    before = started.withColumn("s_stops", F.sum(stop.cast("int")).over(w)).where("s_stops = 0 AND translate").where(~F.col("type").isin("HEADER", "FOOTER"))
    return before.withColumn("s_n", F.row_number().over(w)).where(F.col("s_n") <= most).drop("s_ord", "s_page", "s_stops", "s_n")


def destination_top(kind: Column, args: Column) -> Column:
    """The y that an outline's destination names among its arguments, by its kind; null for kinds without one."""
    place = F.when(kind == "XYZ", 1).when(kind.isin("FitH", "FitBH"), 0).when(kind == "FitR", 3)
    top = F.get(args, place)
    return F.when(~F.isnan(top) & (F.abs(top) < F.lit(float("inf"))), top)


def outline_order(items: DataFrame, levels: int = 8, most: int = 2000) -> DataFrame:
    """Outline items (doc_id, item_id, parent_id, ord) with ``depth`` and ``rank`` in depth-first order.

    Items deeper than ``levels`` below the top, those beyond the first ``most`` of a document and those whose parent is not
    there are left out, as an outline's reader does.  A parent that stands below its own child is never reached.
    """
    step = F.struct("ord", "item_id")
    level = items.where(F.col("parent_id").isNull()).withColumn("path", F.array(step)).withColumn("depth", F.lit(0))
    found = level
    for depth in range(1, levels + 1):
        above = level.select("doc_id", F.col("item_id").alias("parent_id"), F.col("path").alias("above"))
        level = items.join(above, ["doc_id", "parent_id"]).select(*[F.col(c) for c in items.columns], F.concat("above", F.array(step)).alias("path"), F.lit(depth).alias("depth"))
        found = found.unionByName(level)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")))
    return ranked.where(F.col("rank") <= most).drop("path")
