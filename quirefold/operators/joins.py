"""The joins of the document pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mcid_join(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans that a reference claims by (page, mcid). The first reference in order has all spans of its key, so it is chosen before the one join."""
    key = ["doc_id", "page", "mcid"]
    first = refs.groupBy(*key).agg(F.min(F.struct("ord", "elem_id")).alias("__first"))
    return spans.join(first, key).withColumn("elem_id", F.col("__first.elem_id")).withColumn("ord", F.col("__first.ord")).drop("__first")


def unplaced(spans: DataFrame, refs: DataFrame) -> DataFrame:
    """Spans whose key no reference has."""
    return spans.join(refs.select("doc_id", "page", "mcid"), ["doc_id", "page", "mcid"], "left_anti")


def adopt_indents(spans: DataFrame) -> DataFrame:
    """A blank span without an element that starts its line and touches the next span takes that span's element."""
    w = Window.partitionBy("doc_id", "line_id").orderBy("x0", "span_id")
    near = F.abs(F.lead("x0").over(w) - F.col("x1")) <= F.lit(0.15) * F.lit(0.5) * F.col("size")
    ok = F.col("mcid").isNull() & (F.trim("text") == "") & (F.row_number().over(w) == 1) & near
    return spans.withColumn("mcid", F.when(ok, F.lead("mcid").over(w)).otherwise(F.col("mcid")))


def crossed_gaps(gaps: DataFrame, rules: DataFrame) -> DataFrame:
    """Gaps that a vertical rule of their page crosses: open in x, closed in y. The range test runs within a page."""
    r = rules.where("vertical").select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "pos", "lo", "hi")
    on = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("pos") > F.col("x0")) & (F.col("pos") < F.col("x1")) & (F.col("lo") <= F.col("y1")) & (F.col("hi") >= F.col("y0"))
    return gaps.join(r, on, "left_semi")


def xref_links(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """Mentions of a clause number with the section that has it (the first of equals); a section doesn't link to itself."""
    index = sections.where("number IS NOT NULL").groupBy("doc_id", "number").agg(F.min("sec_ix").alias("target_ix"))
    return mentions.join(index, ["doc_id", "number"]).where("target_ix <> sec_ix")


def cell_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """The first column whose right edge lies beyond a cell's left one.

    A column that doesn't reach beyond all columns before it is the first for no cell, so cells only meet the others.
    """
    c = columns.select(F.col("doc_id").alias("__d"), F.col("col").alias("__c"), F.col("right").alias("__right"))
    before = Window.partitionBy("__d").orderBy(F.col("__c").asc_nulls_last(), F.col("__right").desc()).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__most", F.max("__right").over(before)).where("__most IS NULL OR __right > __most").drop("__most")
    joined = cells.join(c, (F.col("doc_id") == F.col("__d")) & (F.col("x0") < F.col("__right")))
    return joined.groupBy("doc_id", "cell_ix").agg(F.min("__c").alias("col"))


def replace_pages(extracted: DataFrame, recognised: DataFrame) -> DataFrame:
    """Recognised text takes a page's place where it isn't empty."""
    r = recognised.select("doc_id", "page", F.col("text").alias("__new"))
    return extracted.join(r, ["doc_id", "page"], "left").withColumn("text", F.coalesce(F.nullif(F.col("__new"), F.lit("")), F.col("text"))).drop("__new")
