"""Section trees without recursion: previous-smaller-element windows by level, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVEL = 6


def section_tree(headings: DataFrame) -> DataFrame:
    """parent_ix: the nearest earlier heading of a smaller level; null at the top."""
    w = Window.partitionBy("doc_id").orderBy("sec_ix").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("sec_ix"))).over(w) for k in range(1, MAX_LEVEL)]
    parent = F.greatest(F.lit(None).cast("long"), *[F.when(F.col("level") > k, c) for k, c in enumerate(last, 1)])
    return headings.withColumn("parent_ix", parent)


def section_paths(headings: DataFrame) -> DataFrame:
    """path: the titles from the root on. A section's ancestors are the last headings of each smaller level, as far as no smaller one came after."""
    w = Window.partitionBy("doc_id").orderBy("sec_ix").rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    for k in range(1, MAX_LEVEL):
        out = out.withColumn(f"__a{k}", F.max(F.when(F.col("level") == k, F.struct("sec_ix", "title"))).over(w))
    chain = []
    for k in range(1, MAX_LEVEL):
        later = [F.coalesce(F.col(f"__a{j}.sec_ix") > F.col(f"__a{k}.sec_ix"), F.lit(False)) for j in range(1, k)]
        ok = (F.col("level") > k) & F.col(f"__a{k}").isNotNull()
        for x in later:
            ok = ok & ~x
        chain.append(F.when(ok, F.col(f"__a{k}.title")))
    return out.withColumn("path", F.concat_ws(" / ", *chain, F.col("title"))).drop(*[f"__a{k}" for k in range(1, MAX_LEVEL)])


def assign_sections(blocks: DataFrame) -> DataFrame:
    """sec_ix: the last heading at or before a block; null in the preamble."""
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    return blocks.withColumn("sec_ix", F.last(F.when(F.col("level").isNotNull(), F.col("block_ix")), ignorenulls=True).over(w))


def section_pages(placed: DataFrame) -> DataFrame:
    return placed.where("sec_ix IS NOT NULL").groupBy("doc_id", "sec_ix").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("blocks"))


def outline_stats(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(
        F.count("*").alias("sections"), F.count(F.nullif(F.col("title"), F.lit(""))).alias("titled"), F.count("number").alias("numbered"), F.max("level").alias("max_level")
    )


def tag_stats(elems: DataFrame) -> DataFrame:
    role = F.col("role")
    n = lambda cond: F.count(F.when(cond, 1))
    return elems.groupBy("doc_id").agg(
        F.count("*").alias("elements"), n(role.rlike("^h[1-6]?$")).alias("headings"), n(role == "p").alias("paragraphs"), n(role == "table").alias("tables"), n(role.isin("ul", "ol")).alias("lists"), F.max("depth").alias("max_depth")
    )


def top_roles(elems: DataFrame, n: int = 6) -> DataFrame:
    counts = elems.groupBy("doc_id", "role").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "role")))
    return ranked.where(F.col("rank") <= n)


MAX_ROLES = 10_000


def normalise_roles(elems: DataFrame, role_map: DataFrame, hops: int = 8) -> DataFrame:
    """final: where a role leads in up to eight steps of the map (source, target). The map is that of a tag set; more than MAX_ROLES rows are an error.

    The map is followed to its end first, so that elements meet it once.
    """
    rows = role_map.select("source", "target").limit(MAX_ROLES + 1).collect()
    if len(rows) > MAX_ROLES:
        raise ValueError("a map of roles with too many rows")
    step = {r["source"]: r["target"] for r in rows}

    def end(role: str) -> str:
        for _ in range(hops):
            role = step.get(role, role)
        return role

    ends = elems.sparkSession.createDataFrame([(k, end(k)) for k in step], "__role string, __final string")
    return elems.join(F.broadcast(ends), F.col("role") == F.col("__role"), "left").withColumn("final", F.coalesce("__final", "role")).drop("__role", "__final")
