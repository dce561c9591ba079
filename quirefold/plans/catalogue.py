"""Every query of the library outside the corpus operators, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import codecs
from quirefold.functions import geometry as G
from quirefold.functions import scalars as S
from quirefold.operators import joins, markdown, metrics, outline, segments
from quirefold.plans import files, texts
from quirefold.plans.derived import derive, with_sql
from quirefold.sources import markup

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WS = r"[\s\x0b\x{85}\p{Z}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _metrics_sql(keys: str) -> str:
    return f"""WITH w AS (SELECT {keys}, length(text) AS chars, length(regexp_replace(text, '{WS}', '', 'g')) AS solid, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS ws FROM documents),
    m AS (SELECT {keys}, chars, solid, len(ws) AS words, len(list_filter(ws, lambda x: length(x) > 25)) AS long, coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest FROM w)
    SELECT {keys}, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(solid) AS BIGINT) AS solid, CAST(sum(words) AS BIGINT) AS words, CAST(sum(long) AS BIGINT) AS long, CAST(max(longest) AS INT) AS longest, round(100.0::DOUBLE * (sum(chars) - sum(solid)) / greatest(sum(chars), 1), 4) AS space_pct FROM m GROUP BY {keys}"""


@query(_metrics_sql("doc_id"))
def extraction_metrics(spark, sf):
    return metrics.extraction_metrics(read(spark, sf, "documents"), ["doc_id"])


@query(_metrics_sql("lang, source"))
def metrics_by_lang(spark, sf):
    return metrics.extraction_metrics(read(spark, sf, "documents"), ["lang", "source"])


_LEVEL = "CASE WHEN {n} <> '' THEN CAST(len(string_split({n}, '.')) AS INT) END"


@query(with_sql("titles", query=f"SELECT doc_id, block_ix, text, {_LEVEL.format(n=f"regexp_extract(text, '^([0-9]+(?:[.][0-9]+)*)[.]?{WS}', 1)")} AS level FROM titles"))
def numbered_level(spark, sf):
    return derive(spark, sf, "titles").withColumn("level", S.numbered_level(F.col("text")))


@query(with_sql("titles", query=f"SELECT doc_id, block_ix, text, {_LEVEL.format(n=f"regexp_extract(text, '^([A-Z](?:[.][0-9]+)+)[.]?{WS}', 1)")} AS level FROM titles"))
def annex_level(spark, sf):
    return derive(spark, sf, "titles").withColumn("level", S.annex_level(F.col("text")))


@query(with_sql("titles", query=r"SELECT block_ix, nullif(regexp_extract(text, '^([0-9]+(?:\.[0-9]+)*)\.*[ \t]', 1), '') AS clause, nullif(regexp_extract(text, '^((?:[0-9]+|[A-Z])(?:\.[0-9]+)+)', 1), '') AS reference FROM titles"))
def clause_number(spark, sf):
    return derive(spark, sf, "titles").select("block_ix", S.clause_number(F.col("text")).alias("clause"), S.reference_number(F.col("text")).alias("reference"))


_MARK = f"nullif(regexp_extract(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '^([•‣⁃■▪○●◦–—]){WS}', 1), '')"


@query(with_sql("items", query=f"SELECT block_ix, {_MARK} AS marker, CASE WHEN {_MARK} IS NOT NULL THEN regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '^[•‣⁃■▪○●◦–—]{WS}+', '') ELSE text END AS body FROM items"))
def list_marker(spark, sf):
    return derive(spark, sf, "items").select("block_ix", S.list_marker(F.col("text")).alias("marker"), S.strip_marker(F.col("text")).alias("body"))


_LABEL = rf"nullif(regexp_extract(text, '^{WS}*(\d{{1,3}}[.)]|\[\d{{1,3}}\]|[a-z][.)]){WS}+[^\s]', 1), '')"
_VALUE = r"CASE WHEN regexp_full_match(regexp_replace(label, '[.)\[\]]', '', 'g'), '\d+') THEN CAST(regexp_replace(label, '[.)\[\]]', '', 'g') AS INT) ELSE ascii(label) - 96 END"
_FORM = r"regexp_replace(regexp_replace(label, '\d+', '9', 'g'), '[a-z]', 'a', 'g')"


@query(with_sql("numbered", query=f"SELECT doc_id, block_ix, label, CAST({_VALUE} AS INT) AS value, {_FORM} AS form FROM (SELECT *, {_LABEL} AS label FROM numbered)"))
def ordered_label(spark, sf):
    label = S.ordered_label(F.col("text"))
    return derive(spark, sf, "numbered").select("doc_id", "block_ix", label.alias("label"), S.label_value(label).cast("int").alias("value"), S.label_form(label).alias("form"))


_CHAINS = f"""lab AS (SELECT *, CAST({_VALUE} AS INT) AS value, {_FORM} AS form FROM (SELECT *, {_LABEL} AS label FROM numbered)),
    seq AS (SELECT *, value IS NOT NULL AND lag(value) OVER w + 1 = value AND lag(form) OVER w = form AS follows FROM lab WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_ix)),
    walk AS (SELECT doc_id, page, block_ix, x0, label, value, x0 AS edge, block_ix AS head FROM seq WHERE label IS NOT NULL AND NOT coalesce(follows, false)
    UNION ALL SELECT s.doc_id, s.page, s.block_ix, s.x0, s.label, s.value, CASE WHEN abs(s.x0 - w.edge) < 0.5 THEN w.edge ELSE s.x0 END, CASE WHEN abs(s.x0 - w.edge) < 0.5 THEN w.head ELSE s.block_ix END FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.page = w.page AND s.block_ix = w.block_ix + 1 WHERE s.follows)"""


@query(with_sql("numbered", query="SELECT doc_id, page, block_ix, label, value, CAST(count(*) OVER (PARTITION BY doc_id, page, head) AS INT) AS run_length FROM walk QUALIFY count(*) OVER (PARTITION BY doc_id, page, head) >= 2").replace("WITH numbered", "WITH RECURSIVE numbered").replace(" SELECT doc_id, page, block_ix, label, value, CAST(count", f", {_CHAINS} SELECT doc_id, page, block_ix, label, value, CAST(count"))
def ordered_runs(spark, sf):
    return segments.ordered_runs(derive(spark, sf, "numbered")).withColumn("value", F.col("value").cast("int"))


@query(
    with_sql("items", query=f"""SELECT i.doc_id, i.page, i.block_ix, i.marker, CAST(i.run AS INT) AS run, CAST(least(6, greatest(1, len(list_filter(tiers, lambda t: t <= i.x0)))) AS INT) AS level FROM runs i JOIN (SELECT doc_id, page, run,
    list_reduce(list_transform(list_sort(list_distinct(list(x0))), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 10 THEN list_concat(a, x) ELSE a END) AS tiers FROM runs GROUP BY 1, 2, 3) USING (doc_id, page, run)""").replace(
        " SELECT i.doc_id", f""", m AS (SELECT *, {_MARK} AS marker FROM items), s AS (SELECT *, marker IS NOT NULL AND lag(marker) OVER (PARTITION BY doc_id, page ORDER BY block_ix) IS NULL AS fresh FROM m),
    runs AS (SELECT * FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, page ORDER BY block_ix) AS run FROM s) WHERE marker IS NOT NULL) SELECT i.doc_id""")
)
def list_runs(spark, sf):
    return segments.list_runs(derive(spark, sf, "items"))


@query(with_sql("spans", query="SELECT doc_id, size, runes, bold FROM (SELECT doc_id, floor(size * 100 + 0.5) / 100 AS size, CAST(sum(length(text)) AS BIGINT) AS runes, sum(CASE WHEN bold THEN length(text) ELSE 0 END) > sum(CASE WHEN bold THEN 0 ELSE length(text) END) AS bold FROM spans GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY runes DESC, size) = 1"))
def body_cluster(spark, sf):
    return segments.body_cluster(derive(spark, sf, "spans"))


@query(
    with_sql("titles", query=f"""SELECT doc_id, block_ix, least(6, coalesce({_LEVEL.format(n=f"regexp_extract(text, '^([0-9]+(?:[.][0-9]+)*)[.]?{WS}', 1)")}, {_LEVEL.format(n=f"regexp_extract(text, '^([A-Z](?:[.][0-9]+)+)[.]?{WS}', 1)")})) AS level, text FROM titles
    WHERE (block_ix % 3 = 0 OR (block_ix % 3 = 1 AND block_ix % 2 = 0)) AND length(text) <= 80 AND (regexp_matches(text, '^([0-9]+(?:[.][0-9]+)*)[.]?{WS}') OR regexp_matches(text, '^([A-Z](?:[.][0-9]+)+)[.]?{WS}'))""")
)
def headings(spark, sf):
    blocks = derive(spark, sf, "titles").withColumn("size", F.when(F.col("block_ix") % 3 == 0, 14.0).otherwise(10.0)).withColumn("bold", (F.col("block_ix") % 3 == 1) & (F.col("block_ix") % 2 == 0))
    body = blocks.select("doc_id").distinct().select("doc_id", F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    return segments.headings(blocks, body)


@query(
    with_sql("lines", query="""SELECT doc_id, page, line_ix, CAST(sum(CASE WHEN po = orient AND pc - cross_pos >= 0 AND pc - cross_pos <= 1.5 * ph AND (NOT greatest(dom_size, ps) / least(dom_size, ps) > 1.06 OR coalesce(pm = mcid, false)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_ix) AS INT) AS block_ix
    FROM (SELECT *, lag(orient) OVER w AS po, lag(cross_pos) OVER w AS pc, lag(height) OVER w AS ph, lag(dom_size) OVER w AS ps, lag(mcid) OVER w AS pm FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_ix))""")
)
def block_segments(spark, sf):
    return segments.block_segments(derive(spark, sf, "lines")).select("doc_id", "page", "line_ix", "block_ix")


@query(
    with_sql("glyphs", query="""SELECT doc_id, seq, coalesce(x - pen > 0.40::DOUBLE * space AND NOT right(before, 1) = ' ' AND NOT left(text, 1) = ' ', false) AS space_before
    FROM (SELECT *, lag(x + advance) OVER w AS pen, lag(text) OVER w AS before FROM glyphs WINDOW w AS (PARTITION BY doc_id, page, line_id ORDER BY seq))""")
)
def space_inference(spark, sf):
    return segments.space_inference(derive(spark, sf, "glyphs")).select("doc_id", "seq", "space_before")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM l)
    SELECT doc_id, string_agg(CASE WHEN before IS NULL OR before = '' OR line = '' OR regexp_matches(before, '\s$') OR regexp_matches(line, '^\s') OR regexp_matches(before, '[\p{L}\p{Nd}][\p{Pd}\x{AD}\x{2212}]+$') THEN line ELSE ' ' || line END, '' ORDER BY no) AS text FROM p GROUP BY doc_id"""
)
def line_join(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.joined_lines(F.split("text", "\n")).alias("text"))


@query(
    with_sql("boxes", query="""SELECT doc_id, page, cell_ix, CAST(sum(f) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS INT) AS col FROM (SELECT *, CASE WHEN x0 >= max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM boxes)""")
)
def column_clusters(spark, sf):
    return segments.column_clusters(derive(spark, sf, "boxes"), ["doc_id", "page"]).select("doc_id", "page", "cell_ix", "col")


@query(with_sql("sections", query="SELECT s.doc_id, s.sec_ix, s.level, s.title, (SELECT max(p.sec_ix) FROM sections p WHERE p.doc_id = s.doc_id AND p.sec_ix < s.sec_ix AND p.level < s.level) AS parent_ix FROM sections s"))
def section_tree(spark, sf):
    return outline.section_tree(derive(spark, sf, "sections")).select("doc_id", "sec_ix", "level", "title", "parent_ix")


@query(
    with_sql("sections", query="""SELECT s.doc_id, s.sec_ix, (SELECT string_agg(a.title, ' / ' ORDER BY a.sec_ix) FROM sections a WHERE a.doc_id = s.doc_id AND (a.sec_ix = s.sec_ix OR (a.sec_ix < s.sec_ix AND a.level < s.level AND NOT EXISTS (SELECT 1 FROM sections b WHERE b.doc_id = s.doc_id AND b.sec_ix > a.sec_ix AND b.sec_ix < s.sec_ix AND b.level <= a.level)))) AS path FROM sections s""")
)
def section_path(spark, sf):
    return outline.section_paths(derive(spark, sf, "sections")).select("doc_id", "sec_ix", "path")


@query(with_sql("placed", query="SELECT doc_id, block_ix, (SELECT max(p.block_ix) FROM placed p WHERE p.doc_id = b.doc_id AND p.block_ix <= b.block_ix AND p.level IS NOT NULL) AS sec_ix FROM placed b"))
def section_blocks(spark, sf):
    return outline.assign_sections(derive(spark, sf, "placed")).select("doc_id", "block_ix", "sec_ix")


@query(with_sql("placed", query="SELECT doc_id, sec_ix, min(page) AS first_page, max(page) AS last_page, count(*) AS blocks FROM (SELECT *, (SELECT max(p.block_ix) FROM placed p WHERE p.doc_id = b.doc_id AND p.block_ix <= b.block_ix AND p.level IS NOT NULL) AS sec_ix FROM placed b) WHERE sec_ix IS NOT NULL GROUP BY 1, 2"))
def section_pages(spark, sf):
    return outline.section_pages(outline.assign_sections(derive(spark, sf, "placed")))


@query(with_sql("sections", query="SELECT doc_id, count(*) AS sections, count(nullif(title, '')) AS titled, count(number) AS numbered, max(level) AS max_level FROM sections GROUP BY doc_id"))
def outline_stats(spark, sf):
    return outline.outline_stats(derive(spark, sf, "sections"))


_CLAIMED = "SELECT DISTINCT ON (s.doc_id, s.span_id) s.doc_id, s.span_id, r.elem_id, s.text FROM refs r JOIN spans s ON r.doc_id = s.doc_id AND r.page = s.page AND r.mcid = s.mcid ORDER BY s.doc_id, s.span_id, r.ord, r.elem_id"


@query(with_sql("refs", "spans", query=_CLAIMED))
def mcid_join(spark, sf):
    return joins.mcid_join(derive(spark, sf, "refs"), derive(spark, sf, "spans")).select("doc_id", "span_id", "elem_id", "text")


@query(with_sql("refs", "spans", query=f"SELECT doc_id, span_id, text FROM spans s ANTI JOIN ({_CLAIMED}) c ON s.doc_id = c.doc_id AND s.span_id = c.span_id"))
def unplaced_text(spark, sf):
    return joins.unplaced(derive(spark, sf, "spans"), derive(spark, sf, "refs")).select("doc_id", "span_id", "text")


@query(with_sql("boxes", "rules", query="SELECT doc_id, page, cell_ix FROM boxes b WHERE EXISTS (SELECT 1 FROM rules r WHERE r.vertical AND r.doc_id = b.doc_id AND r.page = b.page AND r.pos > b.x0 AND r.pos < b.x1 AND r.lo <= b.y1 AND r.hi >= b.y0)"))
def rule_crossing(spark, sf):
    return joins.crossed_gaps(derive(spark, sf, "boxes"), derive(spark, sf, "rules")).select("doc_id", "page", "cell_ix")


@query(with_sql("sections", query="SELECT s.doc_id, s.sec_ix, s.number, t.target_ix FROM sections s JOIN (SELECT doc_id, number, min(sec_ix) AS target_ix FROM sections WHERE number IS NOT NULL GROUP BY 1, 2) t ON s.doc_id = t.doc_id AND s.number = t.number WHERE t.target_ix <> s.sec_ix"))
def xref_links(spark, sf):
    s = derive(spark, sf, "sections")
    return joins.xref_links(s.select("doc_id", "sec_ix", "number"), s).select("doc_id", "sec_ix", "number", "target_ix")


@query(with_sql("boxes", query="SELECT b.doc_id, b.cell_ix, min(c.col) AS col FROM boxes b JOIN (SELECT doc_id, cell_ix AS col, x1 AS right_edge FROM boxes) c ON b.doc_id = c.doc_id AND b.x0 < c.right_edge GROUP BY 1, 2"))
def cell_grid(spark, sf):
    b = derive(spark, sf, "boxes")
    return joins.cell_columns(b, b.select("doc_id", F.col("cell_ix").alias("col"), F.col("x1").alias("right")))


@query("SELECT d.doc_id, d.doc_id % 5 AS page, CASE WHEN d.doc_id % 3 = 0 THEN concat('page ', d.doc_id) ELSE d.source END AS text FROM documents d")
def page_upsert(spark, sf):
    d = read(spark, sf, "documents")
    new = d.where("doc_id % 3 <> 2").select("doc_id", (F.col("doc_id") % 5).alias("page"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("page "), "doc_id")).otherwise("").alias("text"))
    return joins.replace_pages(d.select("doc_id", (F.col("doc_id") % 5).alias("page"), F.col("source").alias("text")), new).select("doc_id", "page", "text")


_COVER = "SELECT doc_id, page, round(CASE WHEN max(x1) FILTER (WHERE y1 > y0 AND x1 > x0) IS NULL THEN 0.0::DOUBLE ELSE (least(1.0::DOUBLE, (max(x1) FILTER (WHERE y1 > y0 AND x1 > x0) - min(x0) FILTER (WHERE y1 > y0 AND x1 > x0)) * (max(y1) FILTER (WHERE y1 > y0 AND x1 > x0) - min(y0) FILTER (WHERE y1 > y0 AND x1 > x0)) / max(page_area))) END, 6) AS coverage FROM boxes GROUP BY 1, 2"


@query(with_sql("boxes", query=_COVER))
def page_coverage(spark, sf):
    return metrics.page_coverage(derive(spark, sf, "boxes"))


@query(with_sql("boxes", query=f"SELECT *, coverage < 0.05 AS ocr FROM ({_COVER})"))
def ocr_route(spark, sf):
    return metrics.ocr_route(metrics.page_coverage(derive(spark, sf, "boxes")))


@query(with_sql("boxes", query="SELECT doc_id, cell_ix, round((x1 - x0) * (y1 - y0), 6) AS area, CASE WHEN least(x1, 300) > greatest(x0, 100) AND least(y1, 400) > greatest(y0, 100) THEN round((least(x1, 300) - greatest(x0, 100)) * (least(y1, 400) - greatest(y0, 100)), 6) END AS shared FROM boxes"))
def rect_ops(spark, sf):
    r = G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    clip = G.intersect(r, G.rect(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(400.0)))
    return derive(spark, sf, "boxes").select("doc_id", "cell_ix", F.round(G.area(r), 6).alias("area"), F.round(G.area(clip), 6).alias("shared"))


@query(
    """SELECT p_partkey, CAST(CASE WHEN w * h > 2000000 THEN greatest(1, floor(w * sqrt(2000000 / (w * h)))) ELSE greatest(1, ceil(w)) END AS BIGINT) AS width, CAST(CASE WHEN w * h > 2000000 THEN greatest(1, floor(h * sqrt(2000000 / (w * h)))) ELSE greatest(1, ceil(h)) END AS BIGINT) AS height
    FROM (SELECT p_partkey, CAST(100 + p_size * 13 AS DOUBLE) * CAST(72 + p_partkey % 300 AS DOUBLE) / 72 AS w, CAST(792 AS DOUBLE) * CAST(72 + p_partkey % 300 AS DOUBLE) / 72 AS h FROM part)"""
)
def fit_dpi(spark, sf):
    w, h = G.fit((F.lit(100) + F.col("p_size") * 13).cast("double"), F.lit(792.0), (F.lit(72) + F.col("p_partkey") % 300).cast("double"), F.lit(2000000.0))
    return read(spark, sf, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("SELECT p_partkey, CAST(2 * p_size + 3 * (p_partkey % 7) + 5 AS DOUBLE) AS x, CAST(p_size - 4 * (p_partkey % 7) + 6 AS DOUBLE) AS y, round(sqrt(CAST(5 AS DOUBLE)), 6) AS sx FROM part")
def matrix_apply(spark, sf):
    m = {k: F.lit(float(v)) for k, v in zip("abcdef", (2, 1, 3, -4, 5, 6), strict=True)}
    one = {k: F.lit(float(v)) for k, v in zip("abcdef", (1, 0, 0, 1, 0, 0), strict=True)}
    x, y = G.apply_matrix(G.multiply(m, one), F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return read(spark, sf, "part").select("p_partkey", x.alias("x"), y.alias("y"), F.round(G.scale_factors(m)[0], 6).alias("sx"))


_RAW = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<!doctype[^>]*>"
_TAGS = f"t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(regexp_replace(html, '{_RAW}', '', 'g'), '<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS t, generate_subscripts(regexp_extract_all(regexp_replace(html, '{_RAW}', '', 'g'), '<(/?[A-Za-z][A-Za-z0-9]*)', 1), 1) AS ord FROM pages), tags AS (SELECT doc_id, ord, lower(ltrim(t, '/')) AS role, t[1] = '/' AS closing FROM t)"
_DEPTH = f"WITH {_TAGS}, elems AS (SELECT doc_id, ord, role, closing, CAST(greatest(0, coalesce(sum(CASE WHEN role IN ('br','meta','img','hr','input','link') THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS INT) AS depth FROM tags)"


def _elems(spark, sf):
    return markup.tag_depth(markup.tag_rows(read(spark, sf, "pages")))


@query(f"{_DEPTH} SELECT doc_id, CAST(ord - 1 AS INT) AS ord, role, depth FROM elems WHERE NOT closing")
def tree_depth(spark, sf):
    return _elems(spark, sf).select("doc_id", "ord", "role", "depth")


@query(f"{_DEPTH} SELECT doc_id, count(*) AS elements, count(*) FILTER (WHERE regexp_full_match(role, 'h[1-6]?')) AS headings, count(*) FILTER (WHERE role = 'p') AS paragraphs, count(*) FILTER (WHERE role = 'table') AS tables, count(*) FILTER (WHERE role IN ('ul', 'ol')) AS lists, max(depth) AS max_depth FROM elems WHERE NOT closing GROUP BY doc_id")
def tag_inventory(spark, sf):
    return outline.tag_stats(_elems(spark, sf))


@query(f"{_DEPTH} SELECT doc_id, role, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, role) AS INT) AS rank FROM elems WHERE NOT closing GROUP BY doc_id, role QUALIFY rank <= 6")
def top_roles(spark, sf):
    return outline.top_roles(_elems(spark, sf))


_MAP = [("b", "strong"), ("strong", "span"), ("nav", "artifact"), ("footer", "artifact"), ("ul", "list"), ("li", "list_item"), ("p", "paragraph"), ("h1", "heading"), ("title", "heading")]


@query(f"{_DEPTH} SELECT final, count(*) AS n FROM (SELECT CASE role WHEN 'b' THEN 'span' WHEN 'strong' THEN 'span' WHEN 'nav' THEN 'artifact' WHEN 'footer' THEN 'artifact' WHEN 'ul' THEN 'list' WHEN 'li' THEN 'list_item' WHEN 'p' THEN 'paragraph' WHEN 'h1' THEN 'heading' WHEN 'title' THEN 'heading' ELSE role END AS final FROM elems WHERE NOT closing) GROUP BY final")
def role_normalised(spark, sf):
    return outline.normalise_roles(_elems(spark, sf), spark.createDataFrame(_MAP, "source string, target string")).groupBy("final").agg(F.count("*").alias("n"))


@query(rf"WITH h AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(regexp_replace(html, '{_RAW}', '', 'g'), '(?is)<(?:h[1-6]|title)(?:\s[^>]*)?>.*?</')) AS t, generate_subscripts(regexp_extract_all(regexp_replace(html, '{_RAW}', '', 'g'), '(?is)<(?:h[1-6]|title)(?:\s[^>]*)?>.*?</'), 1) AS n FROM pages) SELECT doc_id, CAST(n - 1 AS INT) AS sec_ix, CASE WHEN starts_with(lower(t), '<title') THEN 1 ELSE CAST(t[3] AS INT) + 1 END AS level, regexp_extract(t, '(?s)^<[^>]*>(.*)</$', 1) AS title FROM h")
def outline_from_html(spark, sf):
    return markup.html_headings(read(spark, sf, "pages"))


_KEBAB = "regexp_replace(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(
    with_sql("sections", query=f"""SELECT doc_id, sec_ix, CASE WHEN both_parts <> '' THEN both_parts ELSE concat('section-', sec_ix + 1) END AS slug FROM (SELECT *, concat_ws('-', nullif({_KEBAB.format(c="coalesce(number, '')")}, ''), nullif({_KEBAB.format(c='title')}, '')) AS both_parts FROM sections)""")
)
def slug(spark, sf):
    return derive(spark, sf, "sections").select("doc_id", "sec_ix", S.slug(F.col("number"), F.col("title"), F.col("sec_ix")).alias("slug"))


@query(
    f"""SELECT o_orderkey, t AS title, coalesce(CASE WHEN regexp_extract(t, '^ISO(?:/[A-Z]+)*[ ]([0-9]+(?:-[0-9]{{1,2}})?)(?:[:-]([12][0-9]{{3}}))?', 1) <> '' THEN concat('iso', regexp_extract(t, '^ISO(?:/[A-Z]+)*[ ]([0-9]+(?:-[0-9]{{1,2}})?)(?:[:-]([12][0-9]{{3}}))?', 1), CASE WHEN regexp_extract(t, '^ISO(?:/[A-Z]+)*[ ]([0-9]+(?:-[0-9]{{1,2}})?)(?:[:-]([12][0-9]{{3}}))?', 2) <> '' THEN ':' || regexp_extract(t, '^ISO(?:/[A-Z]+)*[ ]([0-9]+(?:-[0-9]{{1,2}})?)(?:[:-]([12][0-9]{{3}}))?', 2) ELSE '' END) END, nullif({_KEBAB.format(c='t')}, ''), 'document') AS id
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('ISO 32000-', o_custkey % 3 + 1, ':2020(en)') WHEN 1 THEN concat('ISO/TS ', o_custkey) WHEN 2 THEN o_orderpriority ELSE '--' END AS t FROM orders)"""
)
def doc_id(spark, sf):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.concat(F.lit("ISO 32000-"), F.col("o_custkey") % 3 + 1, F.lit(":2020(en)"))).when(k == 1, F.concat(F.lit("ISO/TS "), "o_custkey")).when(k == 2, F.col("o_orderpriority")).otherwise("--")
    return read(spark, sf, "orders").select("o_orderkey", t.alias("title"), S.doc_id(t).alias("id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 14 = 0 OR o_custkey % 14 > 12 THEN NULL ELSE concat('2020-', lpad(CAST(o_custkey % 14 AS VARCHAR), 2, '0'), '-31') END AS day FROM orders")
def iso_date(spark, sf):
    raw = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "X:").otherwise("D:"), F.lit("2020"), F.lpad((F.col("o_custkey") % 14).cast("string"), 2, "0"), F.lit("31120000Z"))
    return read(spark, sf, "orders").select("o_orderkey", S.iso_date(raw).alias("day"))


_INITIAL = r"regexp_replace({0}, '(\s[A-Za-z])\.(\s)', '\1' || chr(1) || '\2', 'g')"
_SENTENCE = rf"""WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[\n\r\t ]') THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE text END AS t FROM documents),
    m AS (SELECT doc_id, t, replace(regexp_extract({_INITIAL.format(_INITIAL.format("t"))}, '(?s)^(.*?[.!?])\s', 1), chr(1), '.') AS f FROM c),
    k AS (SELECT *, left(t, CAST(list_max(list_filter(range(0, 298), lambda i: octet_length(encode(left(t, i))) <= 297)) AS BIGINT)) AS cut FROM m), b AS (SELECT *, regexp_extract(cut, '(?s)^(.*)\s', 1) AS back FROM k)
    SELECT doc_id, CASE WHEN f <> '' AND octet_length(encode(f)) <= 300 THEN f WHEN octet_length(encode(t)) <= 300 THEN t ELSE concat(regexp_replace(CASE WHEN octet_length(encode(back)) > 150 THEN back ELSE cut END, '[\s,;:]+$', ''), '…') END AS sentence FROM b"""


@query(_SENTENCE)
def first_sentence(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.first_sentence(S.collapse(F.col("text"))).alias("sentence"))


@query(r"SELECT doc_id, regexp_replace(text, '([\\`*|])', '\\\1', 'g') AS escaped, regexp_replace(regexp_replace(text, chr(173), '', 'g'), '\r\n|\r|\n', ' ', 'g') AS inline FROM documents")
def md_escape_core(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.escape_markdown(F.col("text")).alias("escaped"), S.inline_text(F.col("text")).alias("inline"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '\"true\"' WHEN 1 THEN concat('\"', o_custkey, '\"') WHEN 2 THEN concat('\"a: ', o_custkey, '\"') WHEN 3 THEN '\"say \\\"x\\\" #\"' WHEN 4 THEN '\"\"' ELSE concat('plain ', o_custkey) END AS y FROM orders")
def yaml_quote(spark, sf):
    k = F.col("o_orderkey") % 6
    v = F.when(k == 0, "true").when(k == 1, F.col("o_custkey").cast("string")).when(k == 2, F.concat(F.lit("a: "), "o_custkey")).when(k == 3, 'say "x" #').when(k == 4, "").otherwise(F.concat(F.lit("plain "), "o_custkey"))
    return read(spark, sf, "orders").select("o_orderkey", S.yaml_string(v).alias("y"))


@query("SELECT doc_id, concat('---', chr(10), 'title: ', source, chr(10), 'lang: ', lang, chr(10), 'tagged: ', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, chr(10), 'encrypted: false', chr(10), '---', chr(10)) AS front FROM documents")
def frontmatter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", markdown.frontmatter({"title": F.col("source"), "author": F.lit(""), "lang": F.col("lang")}, {"tagged": F.col("doc_id") % 2 == 0, "encrypted": F.lit(False)}).alias("front"))


@query(with_sql("images", query="SELECT codec, count(*) AS n, count(*) FILTER (WHERE alpha) AS with_alpha, count(*) FILTER (WHERE codec NOT IN ('jpeg', 'raw')) AS unsupported FROM images WHERE NOT (width < 10 AND height < 10) GROUP BY codec"))
def image_report(spark, sf):
    return metrics.image_report(derive(spark, sf, "images"), 10)


@query("SELECT p_partkey, list_sort(list_distinct(list_concat([1], range(p_size % 5 + 2, p_size % 5 + 5), [9]))) AS pages FROM part")
def page_ranges(spark, sf):
    spec = F.concat(F.lit("1,"), F.col("p_size") % 5 + 2, F.lit("-"), F.col("p_size") % 5 + 4, F.lit(",9-"))
    return read(spark, sf, "part").select("p_partkey", markup.page_ranges(spec, F.lit(9)).cast("array<bigint>").alias("pages"))


@query(
    with_sql("placed", query="""SELECT doc_id, concat(string_agg(CASE WHEN pr IS NULL THEN '' WHEN role = 'list_item' AND pr = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END || CASE role WHEN 'heading' THEN '# ' WHEN 'list_item' THEN '- ' WHEN 'quote' THEN '> ' ELSE '' END || text, '' ORDER BY block_ix), chr(10)) AS markdown
    FROM (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY block_ix) AS pr FROM placed) GROUP BY doc_id""")
)
def markdown_doc(spark, sf):
    return markdown.document(derive(spark, sf, "placed"), ["doc_id"])


@query(
    with_sql("cells", query="""SELECT doc_id, tbl, concat(CASE WHEN header THEN '' ELSE concat(blank, chr(10), rule, chr(10)) END, string_agg(concat('| ', line, ' |', CASE WHEN r = 0 AND header THEN chr(10) || rule ELSE '' END), chr(10) ORDER BY r)) AS markdown FROM (
    SELECT doc_id, tbl, header, cell_ix // 2 AS r, CASE WHEN n > 1 THEN '|  |  |' ELSE '|  |' END AS blank, CASE WHEN n > 1 THEN '| --- | --- |' ELSE '| --- |' END AS rule,
    concat(max(a) FILTER (WHERE cell_ix % 2 = 0), CASE WHEN n > 1 THEN concat(' | ', coalesce(max(a) FILTER (WHERE cell_ix % 2 = 1), '')) ELSE '' END) AS line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tbl) AS n FROM cells) GROUP BY doc_id, tbl, header, n, cell_ix // 2) GROUP BY doc_id, tbl, header, blank, rule""")
)
def pipe_tables(spark, sf):
    return markdown.pipe_tables(derive(spark, sf, "cells").selectExpr("doc_id", "tbl", "cell_ix DIV 2 AS row", "CAST(cell_ix % 2 AS BIGINT) AS col", "a AS text", "header"))


_INDENTS = """, ln AS (SELECT doc_id, page, block_ix AS line_ix, x0 FROM numbered), walk AS (SELECT doc_id, page, line_ix, true AS starts, x0 AS first, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM ln WHERE line_ix = 1
    UNION ALL SELECT doc_id, page, line_ix, starts, CASE WHEN starts THEN x0 ELSE first END, CASE WHEN starts THEN NULL ELSE least(x0, coalesce(lo, x0)) END, CASE WHEN starts THEN NULL ELSE greatest(x0, coalesce(hi, x0)) END FROM (
    SELECT l.doc_id, l.page, l.line_ix, l.x0, w.first, w.lo, w.hi, coalesce(w.hi - w.lo <= 2.5 AND l.x0 - w.lo BETWEEN 5 AND 30 AND abs((l.x0 - w.lo) / 5 - (w.first - w.lo) / 5) <= 0.5, false) AS starts FROM walk w JOIN ln l ON l.doc_id = w.doc_id AND l.page = w.page AND l.line_ix = w.line_ix + 1))"""


@query(with_sql("numbered", query="SELECT doc_id, page, line_ix, starts FROM walk").replace("WITH numbered", "WITH RECURSIVE numbered").replace(" SELECT doc_id, page, line_ix, starts FROM walk", f"{_INDENTS} SELECT doc_id, page, line_ix, starts FROM walk"))
def indent_breaks(spark, sf):
    return segments.indent_breaks(derive(spark, sf, "numbered").selectExpr("doc_id", "page", "block_ix AS line_ix", "x0", "CAST(5 AS DOUBLE) AS space"))


_NAMES = """, nm AS (SELECT doc_id AS parent, sec_ix AS ix, concat('t', CAST(level AS VARCHAR), CASE WHEN sec_ix % 4 = 0 THEN '-2' ELSE '' END) AS name FROM sections), walk AS (SELECT parent, ix, name, [name] AS taken FROM nm WHERE ix = 1
    UNION ALL SELECT parent, ix, new, list_append(taken, new) FROM (SELECT n.parent, n.ix, w.taken, CASE WHEN list_contains(w.taken, n.name) THEN concat(n.name, '-', list_min(list_filter(range(2, len(w.taken) + 3), lambda k: NOT list_contains(w.taken, concat(n.name, '-', k))))) ELSE n.name END AS new
    FROM walk w JOIN nm n ON n.parent = w.parent AND n.ix = w.ix + 1))"""


@query(with_sql("sections", query="SELECT parent, ix, name FROM walk").replace("WITH sections", "WITH RECURSIVE sections").replace(" SELECT parent, ix, name FROM walk", f"{_NAMES} SELECT parent, ix, name FROM walk"))
def unique_names(spark, sf):
    return segments.unique_names(derive(spark, sf, "sections").selectExpr("doc_id AS parent", "sec_ix AS ix", "concat('t', CAST(level AS STRING), CASE WHEN sec_ix % 4 = 0 THEN '-2' ELSE '' END) AS name"))


@query("SELECT doc_id, text, sha256(text) AS digest FROM documents")
def filter_roundtrip(spark, sf):
    hexed = codecs.decoded("ASCIIHexDecode", F.hex(F.col("text").cast("binary")).cast("binary"))
    return files.spread_texts(read(spark, sf, "documents")).select("doc_id", hexed.cast("string").alias("text")).withColumn("digest", F.sha2("text", 256))


@query(
    """SELECT doc_id, CAST(0 AS INT) AS block_ix, CAST(1 AS INT) AS page, 'heading' AS role, CAST(doc_id % 3 + 2 AS INT) AS level, source AS text FROM documents UNION ALL SELECT doc_id, 2, 2, 'list_item', NULL, lang FROM documents"""
)
def doctags_blocks(spark, sf):
    tag = F.concat(F.lit("<doctag><section_header_level_"), F.col("doc_id") % 3 + 1, F.lit("><loc_1><loc_2><loc_3><loc_4>"), "source", F.lit("</section_header_level_"), F.col("doc_id") % 3 + 1, F.lit("><page_break><list_item>"), "lang", F.lit("</list_item></doctag>"))
    return markup.doctags_blocks(read(spark, sf, "documents").select("doc_id", tag.alias("text"))).select("doc_id", "block_ix", "page", "role", "level", "text")


def queries() -> dict[str, Query]:
    return _QUERIES | files.queries() | texts.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | files.oracle_sql() | texts.oracle_sql()
