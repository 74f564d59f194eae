"""HTML of a page's regions as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAGE_HEAD = '<!DOCTYPE html>\n<html>\n  <head>\n    <meta charset="utf-8"/>\n  </head>\n  <body>\n    <div id="root">\n'
PAGE_TAIL = "\n    </div>\n  </body>\n</html>\n"
#: Fixed value.
IMAGE_STYLE = "width: 100%; height: 100%; object-fit: fill;"


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def style(top: Column, left: Column, height: Column, width: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("top: "), s(top), F.lit("vh; left: "), s(left), F.lit("vw; height: "), s(height), F.lit("vh; width: "), s(width), F.lit("vw;"))


def fragment(kind: Column, css: Column, text: Column, src: Column) -> Column:
    """A region's element; null for classes that are not shown."""
    div = lambda name, inner: F.concat(F.lit(f'<div class="{name}" style="'), css, F.lit('">'), inner, F.lit("</div>"))
    written = F.concat(F.lit("<p>"), escaped(text), F.lit("</p>"))
    picture = F.concat(F.lit('<img src="'), F.replace(escaped(src), F.lit('"'), F.lit("&quot;")), F.lit(f'" style="{IMAGE_STYLE}"/>'))
    return F.when(kind == "paragraph", div("paragraph", written)).when(kind == "text_box", div("text_box", written)).when(kind == "image", div("image", picture))


def fragments(regions: DataFrame) -> DataFrame:
    """Regions with `fragment`."""
    css = style(F.col("top"), F.col("left"), F.col("elem_height"), F.col("elem_width"))
    return regions.withColumn("fragment", fragment(F.col("class"), css, F.col("text"), F.col("img_src")))


def documents(regions: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, html) of each page, its shown regions in order; pages without one have an empty body. With images, those without any region have a page too."""
    shown = F.when(F.col("fragment").isNotNull(), F.struct("region_idx", "fragment"))
    parts = fragments(regions).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(shown)), lambda r: r["fragment"]).alias("parts"))
    if images is not None:
        parts = images.select("image_id").distinct().join(parts.hint("merge"), "image_id", "left")
    return parts.select("image_id", F.concat(F.lit(PAGE_HEAD), F.coalesce(F.array_join("parts", "\n"), F.lit("")), F.lit(PAGE_TAIL)).alias("html"))
