"""Blocks in rows as Markdown, and rows as files. For whole files see operators/files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import scalars as S


def render(role: Column, level: Column, text: Column, marker: Column) -> Column:
    """One block: heading, list item, quote, code, caption or paragraph."""
    body = S.escape_markdown(S.one_line(S.sanitize(text)))
    depth = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(level, F.lit(1))))
    item = F.concat(F.repeat(F.lit("  "), depth - 1), F.when(S.arabic_marker(F.coalesce(marker, F.lit(""))), F.concat(marker, F.lit(" "))).otherwise("- "), body)
    return (
        F.when(role == "heading", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), body))
        .when(role == "list_item", item)
        .when(role == "quote", F.concat(F.lit("> "), body))
        .when(role == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(role.isin("caption", "figure"), F.concat(F.lit("*"), body, F.lit("*")))
        .otherwise(body)
    )


def document(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The Markdown of each document (or page): blocks in order, list items on adjacent lines, else a blank line between."""
    w = Window.partitionBy(*keys).orderBy("block_ix")
    tight = (F.col("role") == "list_item") & (F.lag("role").over(w) == "list_item")
    gap = F.when(F.lag("role").over(w).isNull(), "").when(tight, "\n").otherwise("\n\n")
    piece = blocks.where((F.col("text") != "") & (F.col("role") != "artifact")).withColumn("__md", F.concat(gap, render(F.col("role"), F.col("level"), F.col("text"), F.col("marker"))))
    return piece.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "__md"))), lambda x: x["__md"]), ""), F.lit("\n")).alias("markdown"))


def pipe_tables(cells: DataFrame) -> DataFrame:
    """GFM tables of cells (tbl, row, col, text, header): gaps are empty cells, the first row is the header if any of its cells is."""
    width = cells.groupBy("doc_id", "tbl").agg((F.max("col") + 1).cast("int").alias("width"), F.max(F.when(F.col("row") == 0, F.col("header"))).alias("has_header"))
    rows = cells.groupBy("doc_id", "tbl", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", S.escape_markdown(S.one_line(F.col("text")))))).alias("m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), " | "), F.lit(" |"))
    lines = rows.join(width, ["doc_id", "tbl"]).select("doc_id", "tbl", "row", "width", "has_header", line.alias("line"))
    body = lines.groupBy("doc_id", "tbl", "width", "has_header").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("ls"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), F.col("width")), " | "), F.lit(" |"))
    out = F.when(F.col("has_header"), F.concat(F.array(F.element_at("ls", 1), rule), F.slice("ls", F.lit(2), F.size("ls")))).otherwise(F.concat(F.array(blank, rule), F.col("ls")))
    return body.select("doc_id", "tbl", F.array_join(out, "\n").alias("markdown"))


def frontmatter(fields: dict[str, Column], flags: dict[str, Column]) -> Column:
    """YAML in a fixed order of keys; empty ones are left out, flags are always there."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}: "), S.yaml_string(c))) for k, c in fields.items()]
    lines += [F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit(False)).cast("string")) for k, c in flags.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def write_files(files: DataFrame, root: str) -> None:
    """Each row (doc_id, path, content as text or bytes) becomes a file below root, written by the executors, so root is a folder that all of them share.

    A path that occurs twice is an error, and rows without a path or content are left out. A task that runs again writes the same files.
    """
    kept = files.select("doc_id", "path", "content").where("path IS NOT NULL AND content IS NOT NULL")
    twice = kept.groupBy("doc_id", "path").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"two files have one path: {twice[0]['path']}")

    def put(rows) -> None:  # noqa: ANN001
        from pathlib import Path

        for r in rows:
            p = Path(root) / str(r["doc_id"]) / r["path"].lstrip("/")
            p.parent.mkdir(parents=True, exist_ok=True)
            data = r["content"]
            p.write_bytes(data.encode() if isinstance(data, str) else bytes(data))

    kept.foreachPartition(put)
