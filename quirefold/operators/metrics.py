"""Measures of extracted text, and reports over pages and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import scalars as S


def extraction_metrics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Characters, share of white space, words, long words and the longest, over all texts of a group."""
    words = F.filter(F.split("text", rf"{S.WS}+"), lambda x: x != "")
    per = docs.select(*keys, F.length("text").alias("chars"), F.length(F.regexp_replace("text", S.WS, "")).alias("solid"), words.alias("words"))
    agg = per.select(*keys, "chars", "solid", F.size("words").alias("words"), F.size(F.filter("words", lambda x: F.length(x) > 25)).alias("long"), F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).alias("longest"))
    total = lambda c: F.sum(c).cast("long").alias(c)
    out = agg.groupBy(*keys).agg(total("chars"), total("solid"), total("words"), total("long"), F.max("longest").alias("longest"))
    return out.withColumn("space_pct", F.round(100.0 * (F.col("chars") - F.col("solid")) / F.greatest(F.col("chars"), F.lit(1)), 4))


LONG_WORD = 25


def word_quality(docs: DataFrame, keys: list[str], samples: int = 3) -> DataFrame:
    """Words that are mostly letters and digits: how many are long, the longest, and the longest few (by bytes, then by text) of each group."""
    words = docs.select(*keys, F.explode_outer(F.filter(F.split("text", rf"{S.WS}+"), lambda x: x != "")).alias("w"))
    solid = F.length(F.regexp_replace("w", r"[^\p{L}\p{Nd}]", ""))
    like = solid * 2 > F.length("w")
    long = like & (F.length("w") > LONG_WORD)
    few = F.slice(F.array_sort(F.collect_set(F.when(long, F.struct((-F.octet_length("w")).alias("n"), "w")))), 1, samples)
    return words.groupBy(*keys).agg(
        F.count("w").alias("words"), F.count_if(long).alias("long_words"), F.coalesce(F.max(F.when(like, F.length("w"))), F.lit(0)).alias("longest"), F.array_join(F.transform(few, lambda x: x["w"]), " ").alias("samples")
    )


def page_coverage(blocks: DataFrame) -> DataFrame:
    """The share of a page that the bounding box of its blocks has; blocks without an area don't count."""
    from quirefold.functions import geometry as G

    r = G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    x0, y0, x1, y1 = G.union_bounds(r)
    b = blocks.groupBy("doc_id", "page").agg(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.max("page_area").alias("page_area"))
    return b.select("doc_id", "page", F.round(G.coverage((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("page_area")), 6).alias("coverage"))


def ocr_route(coverage: DataFrame, threshold: float = 0.05) -> DataFrame:
    return coverage.withColumn("ocr", F.col("coverage") < threshold)


def probe_route(encrypted: Column, headings: Column, paragraphs: Column, fonts: Column) -> Column:
    return F.when(encrypted, "encrypted").when((headings > 0) | (paragraphs > 0), "tagged").when(fonts > 0, "layout").otherwise("ocr")


def image_report(images: DataFrame, least: int = 0) -> DataFrame:
    """Counts by codec; an image is skipped only where both sides are small."""
    kept = images.where(~((F.col("width") < least) & (F.col("height") < least)))
    optional = [F.count_if(F.col(c)).alias(n) for c, n in (("premultiplied", "premultiplied"), ("blended", "blended")) if c in images.columns]
    return kept.groupBy("codec").agg(F.count("*").alias("n"), F.count(F.when(F.col("alpha"), 1)).alias("with_alpha"), F.count(F.when(S.image_extension(F.col("codec")).isNull(), 1)).alias("unsupported"), *optional)
