"""Overlay tests, backgrounds, room and the order of drawing."""

from pyspark.sql import functions as F

from pagemill.operators import render

BLOCK = "doc_id long, page int, block_id string, type string, x0 double, y0 double, x1 double, y1 double, skew double, container_fill string, translation string"


def blocks(spark):
    return spark.createDataFrame([
        (1, 1, "ok", "BODY", 50.0, 600.0, 250.0, 650.0, 0.0, None, "文"), (1, 1, "type", "HEADER", 50.0, 760.0, 250.0, 770.0, 0.0, None, "文"), (1, 1, "out", "BODY", 50.0, 600.0, 700.0, 650.0, 0.0, None, "文"),
        (1, 1, "turned", "BODY", 50.0, 500.0, 250.0, 550.0, 0.5, None, "文"), (1, 1, "image", "BODY", 50.0, 300.0, 250.0, 350.0, 0.0, None, "文"), (1, 2, "rotated", "BODY", 50.0, 300.0, 250.0, 350.0, 0.0, None, "文"),
        (1, 3, "page", "BODY", 50.0, 300.0, 250.0, 350.0, 0.0, None, "文"), (1, 1, "flat", "BODY", 50.0, 300.0, 250.0, 300.0, 0.0, None, "文"), (1, 1, "side", "BODY", 300.0, 100.0, 400.0, 120.0, 0.0, "#1F3864", "文"),
    ], BLOCK)


def pages(spark):
    return spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 612.0, 792.0), (1, 2, 90, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, rotation int, px0 double, py0 double, px1 double, py1 double")


def test_the_first_failing_test_is_the_reason(spark):
    images = spark.createDataFrame([(1, 1, 60.0, 290.0, 200.0, 360.0), (1, 1, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r["block_id"]: r["reason"] for r in render.overlay_reason(blocks(spark), pages(spark), images).collect()}
    assert got == {"ok": None, "side": None, "type": "TYPE_HEADER", "out": "OUT_OF_PAGE", "turned": "ROTATED_TEXT", "image": "IMAGE_OVERLAP", "rotated": "PAGE_ROTATED", "page": "PAGE_MISSING", "flat": "INVALID_COORDINATES"}


def test_grounds_and_plan(spark):
    fills = spark.createDataFrame([(1, 1, 1, 0.0, 590.0, 300.0, 660.0, "#000000"), (1, 1, 2, 40.0, 595.0, 260.0, 655.0, "#F4F3EC"), (1, 2, 1, 0.0, 0.0, 612.0, 792.0, "#EEEEEE")], "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, color string")
    got = render.background(blocks(spark).where("block_id in ('ok', 'side', 'rotated', 'image')"), fills, pages(spark))
    by = {r["block_id"]: (r["source"], r["ground"], r["ink"]) for r in got.collect()}
    assert by == {"ok": ("fill", "#f4f3ec", "dark"), "side": ("container", "#1f3864", "light"), "rotated": ("page", "#eeeeee", "dark"), "image": ("white", None, "dark")}
    plan = render.render_plan(got.where("page = 1").withColumn("reason", F.lit(None).cast("string"))).orderBy("seq").collect()
    assert [p["op"] for p in plan] == ["mask"] * 3 + ["text"] * 3 and [p["block_id"] for p in plan[:3]] == ["ok", "image", "side"] and plan[2]["color"] == "#1f3864" and plan[5]["color"] == "#ffffff"


def test_room_and_placement(spark):
    one = blocks(spark).where("block_id = 'ok'")
    obstacles = spark.createDataFrame([(1, 1, 0.0, 610.0, 20.0, 620.0), (1, 1, 100.0, 700.0, 120.0, 710.0), (1, 1, 400.0, 0.0, 420.0, 10.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    r = render.room_around(one, obstacles, pages(spark)).first()
    assert (r["room_x0"], r["room_x1"], r["room_y0"], r["room_y1"]) == (20.75, 612.0, 0.0, 699.25)
    at = lambda turn: spark.range(1).select(render.placement(F.lit(turn), F.lit(600.0), F.lit(800.0), F.lit(10.0)).alias("p")).first()["p"].asDict()
    assert at(0) == {"x": 10.0, "y": 0.0, "rotate": 0, "width": 600.0, "height": 800.0}
    assert at(90) == {"x": 10.0, "y": 600.0, "rotate": -90, "width": 800.0, "height": 600.0}
    assert at(180) == {"x": 610.0, "y": 800.0, "rotate": -180, "width": 600.0, "height": 800.0} and at(270)["x"] == 810.0
