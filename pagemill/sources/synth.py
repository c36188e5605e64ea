"""Positioned text items built from documents, by the fixed rule of the fixtures.

Line i of a document is on page i / 50 + 1 at y = 742 - 12 (i mod 50), x = 50; its font size depends on
doc_id and i, its width is half an em a character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_items(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\n")).alias("item_id", "text"))
    size = F.when((F.col("doc_id") + F.col("item_id")) % 11 == 0, 14.0).when((F.col("doc_id") + F.col("item_id")) % 7 == 0, 8.5).otherwise(10.0)
    placed = lines.select(
        "doc_id", F.col("item_id").cast("long").alias("item_id"), (F.floor(F.col("item_id") / 50) + 1).cast("long").alias("page"), "text",
        F.lit(50.0).alias("x"), (F.lit(742.0) - (F.col("item_id") % 50) * 12).alias("y"), size.alias("font_size"),
    )
    return placed.withColumn("width", F.length("text") * 0.5 * F.col("font_size")).withColumn("height", F.col("font_size"))
