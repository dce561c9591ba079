"""Files as rows: sources, page tasks, sinks, recognition and the stream."""

import pytest
from pyspark.sql import functions as F

from quirefold.operators import files as P
from quirefold.operators import markdown
from quirefold.operators import recognise as R
from quirefold.plans.files import _report, queries
from quirefold.sources.pdf import writer as w
from quirefold.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    (path / "a.pdf").write_bytes(w.document(w.text_pages([f"line {i}" for i in range(120)])))
    (path / "b.pdf").write_bytes(_report([3, 1, 2], ["x", "y", "z"], True, 4))
    (path / "c.pdf").write_bytes(b"no file of this kind")
    (path / "d.pdf").write_bytes(b"")
    (path / "e.txt").write_text("other")
    return path


def test_sources_and_odd_files(spark, folder):
    found = P.read_files(spark, str(folder), glob="*.pdf")
    names = {r["doc_id"]: r["path"].rsplit("/", 1)[-1] for r in found.collect()}
    assert sorted(names.values()) == ["a.pdf", "b.pdf", "c.pdf"]  # the source leaves empty files out
    found = found.union(spark.createDataFrame([(0, "d.pdf", bytearray()), (1, "e.pdf", None)], found.schema))
    reports = {names[r["doc_id"]]: r for r in P.probe(found).collect()}
    assert set(reports) == {"a.pdf", "b.pdf", "c.pdf"} and reports["c.pdf"]["error"] and reports["c.pdf"]["path"] == "unknown"
    assert (reports["a.pdf"]["path"], reports["a.pdf"]["pages"], reports["b.pdf"]["path"], reports["b.pdf"]["mark_info"]) == ("layout", 3, "tagged", True)
    text = {names[r["doc_id"]]: r for r in P.report_text(P.probe(found)).collect()}
    assert text["c.pdf"]["text"].startswith("error ValueError") and "structure StructTreeRoot + Marked" in text["b.pdf"]["text"] and "roles H2=2 P=2 " in text["b.pdf"]["text"] and '"pages":3' in text["a.pdf"]["json"]
    nothing = found.limit(0)
    for fn in (P.pages, P.glyphs, P.lines, P.blocks, P.sections, P.elements, P.images, P.bundles, P.markdown_files, P.markdown_pages, P.objects, P.metadata, P.stats, P.operators, P.rules, P.probe):
        assert fn(nothing).count() == 0
        assert fn(found).where("doc_id IS NULL").count() == 0


def test_made_files_are_spread(spark, tmp_path):
    """A small table in one row group is read by one task; building and reading its files isn't."""
    rows = spark.range(600).selectExpr("id AS p_partkey", "id AS o_orderkey", "id % 300 AS o_custkey", "'1-URGENT' AS o_orderpriority").coalesce(1)
    for name in ("part", "orders"):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, n in (("pdf_page_boxes", 900), ("pdf_sections", 600)):
        found = queries()[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in found) == n
        assert len(found) >= 8 and max(r["count"] for r in found) < n / 4


def test_page_tasks_give_the_same_rows(spark, folder):
    found = P.read_files(spark, str(folder), glob="*.pdf")
    tasks = P.page_tasks(found, 1)
    assert tasks.count() == 4
    for fn in (P.lines, P.blocks, P.pages, P.glyphs, P.rules, P.operators, P.markdown_pages):
        a, b = fn(found), fn(tasks)
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_repeated_rows_and_clashing_columns(spark, folder):
    found = P.read_files(spark, str(folder / "a.pdf")).select("doc_id", "payload", F.lit("x").alias("page"), F.lit("y").alias("text"))
    twice = found.union(found)
    assert P.lines(twice).count() == 2 * P.lines(found).count() == 240


def test_sinks(spark, folder, tmp_path):
    found = P.read_files(spark, str(folder / "b.pdf"))
    files = P.bundles(found)
    markdown.write_files(files, str(tmp_path))
    wrote = sorted(p.relative_to(tmp_path).as_posix().split("/", 1)[1] for p in tmp_path.rglob("*.md"))
    assert wrote == sorted(r["path"].lstrip("/") for r in files.collect()) and "index.md" in wrote
    with pytest.raises(ValueError):
        markdown.write_files(files.union(files), str(tmp_path))
    flat = P.markdown_files(found, front=True, flat=True).first()["markdown"]
    assert flat.startswith("---\n") and "tagged: true" in flat and "**1 Part y**" in flat
    assert [r["kind"] for r in P.objects(found).where("kind = 'stream'").limit(1).collect()] == ["stream"]


def test_routing(spark):
    pages = spark.createDataFrame([(1, 1, 0.05, False), (1, 2, 0.0499, False), (1, 3, 1.0, False), (1, 4, 0.0, True)], "doc_id long, page int, coverage double, rasterized boolean")
    assert [r["ocr"] for r in R.routed(pages).orderBy("page").collect()] == [False, True, False, False]
    assert [r["ocr"] for r in R.routed(pages, force=True).orderBy("page").collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        R.routed(pages, 1.5)


def test_rasters_and_binary_files(spark, folder, tmp_path):
    found = P.read_files(spark, str(folder / "a.pdf"))

    def draw(payload, page, width, height):
        if page == 2:
            raise RuntimeError("no ink")
        return b"%d %d %d" % (page, width, height)

    made = R.rasters(found, draw, dpi=144.0)
    rows = {r["page"]: r for r in made.collect()}
    assert bytes(rows[1]["content"]) == b"1 1224 1584" and rows[2]["error"] == "RuntimeError: no ink" and rows[3]["path"] == "page-3.png"
    assert {r["width"] for r in R.rasters(found, draw, max_pixels=1e4).collect()} == {87}
    markdown.write_files(made, str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*.png")) == ["page-1.png", "page-3.png"]


def test_stream(spark, folder, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.pdf").write_bytes((folder / "a.pdf").read_bytes())
    tables = {"lines": P.lines, "probe": P.probe}
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.file_stream(spark, str(source)), tables, str(target), once=True).awaitTermination(120)
        assert spark.read.parquet(f"{target}/lines").count() == 120
    (source / "c.pdf").write_bytes(b"broken")
    (source / "b.pdf").write_bytes((folder / "b.pdf").read_bytes())
    ingest.ingest(ingest.file_stream(spark, str(source)), tables, str(target), once=True).awaitTermination(120)
    assert spark.read.parquet(f"{target}/lines").count() == 126 and spark.read.parquet(f"{target}/probe").count() == 3
