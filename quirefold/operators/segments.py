"""Lines into blocks, blocks into lists and headings: gaps and islands over ordered rows, partitioned by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.document import words
from quirefold.functions import scalars as S
from quirefold.sources.pdf.page import Policy, Shape

SPACE, LINE, PARA, SIZE_BREAK, LIST_STEP, EDGE, MAX_LEVEL, MAX_HEADING = 0.40, 0.5, 1.5, 1.06, 1.0, 0.5, 6, 80


def islands(df: DataFrame, new: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """name: the number, from 1, of the run that a row is in; new: whether it starts one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(w).cast("int"))


def space_inference(glyphs: DataFrame) -> DataFrame:
    """A space before each glyph whose gap on its line is wide enough and has no space on either side."""
    w = Window.partitionBy("doc_id", "page", "line_id").orderBy("seq")
    pen, before = F.lag(F.col("x") + F.col("advance")).over(w), F.lag("text").over(w)
    gap = (F.col("x") - pen) > F.lit(SPACE) * F.col("space")
    return glyphs.withColumn("space_before", F.coalesce(gap & ~before.rlike(rf"{S.WS}$") & ~F.col("text").rlike(rf"^{S.WS}"), F.lit(False)))


def block_segments(lines: DataFrame) -> DataFrame:
    """block_ix: a line goes on with the block before it at a small step down, in the same direction and at a like size."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_ix")
    step = F.lag("cross_pos").over(w) - F.col("cross_pos")
    size, prev = F.col("dom_size"), F.lag("dom_size").over(w)
    jump = (F.greatest(size, prev) / F.least(size, prev)) > SIZE_BREAK
    same_element = F.coalesce(F.lag("mcid").over(w) == F.col("mcid"), F.lit(False))
    on = (F.lag("orient").over(w) == F.col("orient")) & (step >= 0) & (step <= F.lit(PARA) * F.lag("height").over(w)) & (~jump | same_element)
    return islands(lines.withColumn("__on", F.coalesce(on, F.lit(False))), ~F.col("__on"), ["doc_id", "page"], ["line_ix"], "block_ix").drop("__on")


def join_lines(lines: DataFrame, keys: list[str], order: str, text: str = "line") -> DataFrame:
    """The lines of a block, each in a row, as one text. Where a text is one row to begin with, scalars.joined_lines does it without a shuffle."""
    grouped = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("__lines"))
    return grouped.select(*keys, S.joined_lines(F.col("__lines")).alias("text"))


def list_runs(blocks: DataFrame) -> DataFrame:
    """Maximal runs of blocks that open with a bullet: run and level, from the tiers of their left edges."""
    w = Window.partitionBy("doc_id", "page").orderBy("block_ix")
    marked = blocks.withColumn("marker", S.list_marker(F.col("text")))
    start = F.col("marker").isNotNull() & F.lag("marker").over(w).isNull()
    runs = islands(marked.withColumn("__start", start), F.col("__start"), ["doc_id", "page"], ["block_ix"], "run").where("marker IS NOT NULL")
    grouped = runs.groupBy("doc_id", "page", "run").agg(F.array_sort(F.collect_set("x0")).alias("edges"), F.max("size").alias("__size"))
    far = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= F.col("__size") * LIST_STEP), F.concat(acc, F.array(x))).otherwise(acc)
    tiers = grouped.select("doc_id", "page", "run", F.aggregate("edges", F.array().cast("array<double>"), far).alias("tiers"))
    level = F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(1), F.size(F.filter("tiers", lambda t: t <= F.col("x0")))))
    return runs.join(tiers, ["doc_id", "page", "run"]).select("doc_id", "page", "block_ix", "marker", "run", level.cast("int").alias("level"))


def ordered_runs(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Runs of labels that count up by one in one form at one left edge, that of the run's first item; an item at another edge begins a run.

    Chains that count up are islands. A chain has fewer rows than labels have values (999), and within it the edge is a fold of its array.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("block_ix")
    b = blocks.withColumn("label", S.ordered_label(F.col("text"))).withColumn("value", S.label_value(F.col("label"))).withColumn("form", S.label_form(F.col("label")))
    on = (F.lag("value").over(w) + 1 == F.col("value")) & (F.lag("form").over(w) == F.col("form"))
    chains = islands(b.withColumn("__on", F.coalesce(on, F.lit(False))), ~F.col("__on"), ["doc_id", "page"], ["block_ix"], "chain").where("label IS NOT NULL")
    rows = chains.groupBy("doc_id", "page", "chain").agg(F.array_sort(F.collect_list(F.struct("block_ix", "x0", "label", "value"))).alias("rows"))
    begin = F.struct(F.lit(None).cast("double").alias("edge"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["edge"].isNull() | (F.abs(x["x0"] - acc["edge"]) >= EDGE)
        run = acc["run"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, x["x0"]).otherwise(acc["edge"]).alias("edge"), run.alias("run"), F.concat(acc["runs"], F.array(run)).alias("runs"))

    runs = rows.select("doc_id", "page", "rows", F.aggregate("rows", begin, step, lambda acc: acc["runs"]).alias("runs"))
    each = runs.select("doc_id", "page", "runs", F.posexplode("rows").alias("i", "r"))
    length = F.size(F.filter("runs", lambda k: k == F.get(F.col("runs"), F.col("i"))))
    out = each.select("doc_id", "page", "r.block_ix", "r.label", "r.value", length.alias("run_length"))
    return out.where(F.col("run_length") >= least)


def body_cluster(spans: DataFrame) -> DataFrame:
    """The size most characters of a document have (ties: the smaller), and whether they are mostly bold."""
    by = spans.groupBy("doc_id", S.quantize(F.col("size")).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("b"))
    top = by.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "size"))).where("__r = 1")
    return top.select("doc_id", "size", F.col("n").cast("long").alias("runes"), (F.col("b") > F.col("n") - F.col("b")).alias("bold"))


def headings(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Short blocks that stand out from the body and carry a number; the level is its depth, 6 at most."""
    b = body.select("doc_id", F.col("size").alias("__size"), F.col("bold").alias("__bold"))
    out = (F.col("size") > F.col("__size")) | ((S.quantize(F.col("size")) == F.col("__size")) & F.col("bold") & ~F.col("__bold"))
    level = F.coalesce(S.numbered_level(F.col("text")), S.annex_level(F.col("text")))
    rows = blocks.join(b, "doc_id").where(out & (F.length("text") <= MAX_HEADING)).withColumn("level", level)
    return rows.where("level IS NOT NULL").withColumn("level", F.least(F.lit(MAX_LEVEL), "level")).select("doc_id", "block_ix", "level", "text")


def column_clusters(cells: DataFrame, keys: list[str]) -> DataFrame:
    """col: a cell opens a new column where its left edge is at or beyond the right end of all before it."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    right = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("x0") >= right, F.lit(False))
    marked = cells.withColumn("__new", new)
    return marked.withColumn("col", F.sum(F.col("__new").cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def fold(df: DataFrame, keys: list[str], columns: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """fn on the rows of each group, sorted by their columns; its rows follow the group's keys. Many groups share a batch.

    For greedy steps, where each decision depends on those before it: they aren't windows. A group is a page or a document.
    """
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__rows"))
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    names, kinds = arrow.names, arrow.types

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(*k, *r) for *k, rows in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in fn(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names)

    return grouped.mapInArrow(each, schema)


def indent_breaks(lines: DataFrame) -> DataFrame:
    """Paragraph starts by indentation, page by page; columns doc_id, page, line_ix, x0, space."""

    def starts(page: list[dict]) -> list[tuple]:
        out, shape = [], None
        for r in page:
            new = shape is None or shape.begins_another(r["x0"], Policy())
            if new:
                shape = Shape(r["x0"], r["space"])
            else:
                shape.observe(r["x0"])
            out.append((r["line_ix"], new))
        return out

    return fold(lines, ["doc_id", "page"], ["line_ix", "x0", "space"], starts, "doc_id long, page int, line_ix int, starts boolean")


def unique_names(rows: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Names made distinct within a parent by -2, -3, ... in order, stepping over names that are taken or reserved.

    Names that differ but in such endings can clash, others can't: they are folded by what is left without the endings.
    """

    def names(group: list[dict]) -> list[tuple]:
        taken = set(reserved)
        return [(r["ix"], words.unique(taken, r["name"])) for r in group]

    rooted = rows.withColumn("root", F.regexp_replace("name", "(?:-[0-9]+)+$", ""))
    return fold(rooted, ["parent", "root"], ["ix", "name"], names, "parent long, root string, ix long, name string").drop("root")
