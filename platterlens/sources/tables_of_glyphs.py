"""Tables of shapes as JSON text: written commonest first, read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHAPE = "struct<key:string,count:bigint,text:string>"


def saved(shapes: DataFrame) -> DataFrame:
    """(table, json) of shapes (table, key, count, text): a file is one value."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "key", "count", "text")))
    glyphs = F.transform(order, lambda g: F.struct(g["key"].alias("key"), g["count"].alias("count"), g["text"].alias("text")))
    return shapes.groupBy("table").agg(F.to_json(F.struct(glyphs.alias("glyphs"))).alias("json"))


def read(files: DataFrame) -> DataFrame:
    """(table, pos, key, count, text) of files (table, json); a file that is no table of shapes has no rows."""
    rows = files.select("table", F.posexplode(F.from_json("json", f"struct<glyphs:array<{_SHAPE}>>")["glyphs"]).alias("pos", "g"))
    return rows.select("table", "pos", "g.key", "g.count", "g.text")
