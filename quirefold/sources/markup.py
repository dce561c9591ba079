"""Tagged text as rows: HTML pages, DocTags, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = ["br", "meta", "img", "hr", "input", "link"]
RAW = r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<!doctype[^>]*>"


def tag_rows(pages: DataFrame) -> DataFrame:
    """A row for each tag: doc_id, ord, tag, closing. Scripts, styles and comments are removed first."""
    bare = pages.select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", RAW, "").alias("h"))
    tags = bare.select("doc_id", F.posexplode(F.regexp_extract_all("h", F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("ord", "t"))
    return tags.select("doc_id", "ord", F.lower(F.ltrim(F.col("t"), F.lit("/"))).alias("role"), F.startswith("t", F.lit("/")).alias("closing"))


def tag_depth(tags: DataFrame) -> DataFrame:
    """Opening tags with their depth: those open before them less those closed; void ones don't open. Markup that isn't balanced may go below 0, which counts as 0."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("role").isin(*VOID), 0).when(F.col("closing"), -1).otherwise(1)
    return tags.withColumn("depth", F.greatest(F.lit(0), F.coalesce(F.sum(step).over(w), F.lit(0))).cast("int")).where(~F.col("closing"))


def html_headings(pages: DataFrame) -> DataFrame:
    bare = pages.select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", RAW, "").alias("h"))
    found = bare.select("doc_id", F.posexplode(F.regexp_extract_all("h", F.lit(r"(?is)<(?:h[1-6]|title)(?:\s[^>]*)?>.*?</"), F.lit(0))).alias("ix", "t"))
    level = F.when(F.startswith(F.lower("t"), F.lit("<title")), 1).otherwise(F.substring("t", 3, 1).try_cast("int") + 1)
    return found.select("doc_id", F.col("ix").alias("sec_ix"), level.cast("int").alias("level"), F.regexp_extract("t", r"(?s)^<[^>]*>(.*)</$", 1).alias("title"))


def doctags_blocks(texts: DataFrame) -> DataFrame:
    """Elements of DocTags text: role, level, text and box on the grid of 500; page_break moves to the next page."""
    pattern = r"(?s)<(page_break)>|<(title|text|paragraph|section_header_level_\d|list_item|caption|code|footnote|page_header|page_footer|formula)>(.*?)</\2>"
    rows = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("block_ix", "e"))
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    kind = F.regexp_extract("e", r"^<([a-z_0-9]+)>", 1)
    page = F.sum(F.when(kind == "page_break", 1).otherwise(0)).over(w) + 1
    body = F.trim(F.regexp_replace(F.regexp_replace("e", r"^<[^>]*>|</[^>]*>$", ""), r"<loc_\d+>", ""))
    locs = F.transform(F.slice(F.regexp_extract_all("e", F.lit(r"<loc_(\d+)>"), F.lit(1)), 1, 4), lambda x: x.cast("int"))
    level = F.when(kind == "title", 1).when(kind.startswith("section_header"), F.substring(kind, -1, 1).try_cast("int") + 1)
    role = F.when(level.isNotNull(), "heading").when(kind == "list_item", "list_item").when(kind == "code", "code").when(kind == "caption", "caption").when(kind.isin("page_header", "page_footer"), "artifact").otherwise("paragraph")
    out = rows.select("doc_id", "block_ix", page.cast("int").alias("page"), kind.alias("kind"), role.alias("role"), level.cast("int").alias("level"), body.alias("text"), F.when(F.size(locs) == 4, locs).alias("locs"))
    return out.where("kind <> 'page_break'")


def page_ranges(spec: Column, n: Column) -> Column:
    """Sorted distinct pages of a specification such as 1,4-9,20-; an error where it names none, or one beyond n."""
    part = lambda p: F.when(F.contains(p, F.lit("-")), F.sequence(F.substring_index(p, "-", 1).cast("int"), F.coalesce(F.nullif(F.substring_index(p, "-", -1), F.lit("")).cast("int"), n))).otherwise(F.array(p.cast("int")))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), part))))
    ok = spec.rlike(r"^\d+(-\d*)?(,\d+(-\d*)?)*$") & (F.array_min(pages) >= 1) & (F.array_max(pages) <= n)
    return F.when(spec == "", F.sequence(F.lit(1), n)).when(ok, pages).otherwise(F.raise_error(F.concat(F.lit("bad pages: "), spec)).cast("array<int>"))
