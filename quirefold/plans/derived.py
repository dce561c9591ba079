"""Relations that the driver's tables lack, as SQL text that Spark and DuckDB both read; {name} is a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators.files import spread

DERIVED = {
    "titles": """SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS block_ix, CASE o_orderkey % 9
        WHEN 0 THEN concat(CAST(o_custkey % 9 + 1 AS STRING), ' ', o_orderpriority) WHEN 1 THEN concat(CAST(o_custkey % 9 + 1 AS STRING), '.', CAST(o_orderkey % 12 + 1 AS STRING), ' Scope of ', o_orderpriority)
        WHEN 2 THEN concat(CAST(o_custkey % 7 + 1 AS STRING), '.', CAST(o_orderkey % 5 + 1 AS STRING), '.', CAST(o_orderkey % 3 + 1 AS STRING), '. Terms') WHEN 3 THEN concat('A.', CAST(o_custkey % 9 + 1 AS STRING), ' Annex terms')
        WHEN 4 THEN concat('B.', CAST(o_custkey % 9 + 1 AS STRING), '.', CAST(o_orderkey % 4 + 1 AS STRING), '. Notes') WHEN 5 THEN o_orderpriority WHEN 6 THEN concat(CAST(o_custkey % 9 + 1 AS STRING), 'th ', o_orderpriority)
        WHEN 7 THEN concat(CAST(o_custkey % 9 + 1 AS STRING), '..', CAST(o_orderkey % 12 AS STRING), ' x') ELSE concat('A', CAST(o_orderkey % 12 AS STRING), ' paper') END AS text FROM {orders}""",
    "items": """SELECT CAST(o_custkey AS BIGINT) AS doc_id, 1 AS page, CAST(o_orderkey AS INT) AS block_ix, CAST(72 + (o_orderkey % 4) * 12.5 AS DOUBLE) AS x0, CAST(10 AS DOUBLE) AS size, CASE o_orderkey % 6
        WHEN 0 THEN concat('• ', o_orderpriority) WHEN 1 THEN concat('– ', o_orderpriority) WHEN 2 THEN concat('• item ', CAST(o_orderkey AS STRING)) WHEN 3 THEN concat('•', o_orderpriority) WHEN 4 THEN concat('  ◦ ', o_orderpriority) ELSE o_orderpriority END AS text FROM {orders}""",
    "numbered": """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS block_ix, CAST(72 + CASE WHEN l_orderkey % 11 = 0 THEN (l_linenumber % 2) * 20 ELSE 0 END AS DOUBLE) AS x0,
        concat(CASE l_orderkey % 5 WHEN 0 THEN concat(CAST(l_linenumber AS STRING), '. ') WHEN 1 THEN concat('[', CAST(l_linenumber AS STRING), '] ') WHEN 2 THEN concat(CAST(l_linenumber + l_partkey % 2 AS STRING), ') ') WHEN 3 THEN concat(substring('abcdefgh', l_linenumber, 1), ') ') ELSE '' END, l_linestatus) AS text FROM {lineitem}""",
    "spans": """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS span_id, CAST(l_linenumber % 3 + 1 AS INT) AS page, CAST(CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 4 END AS INT) AS mcid,
        CAST(8 + l_partkey % 4 AS DOUBLE) AS size, l_suppkey % 3 = 0 AS bold, concat('span ', CAST(l_partkey AS STRING)) AS text FROM {lineitem}""",
    "refs": "SELECT CAST(o_orderkey AS BIGINT) AS doc_id, n_nationkey AS elem_id, n_nationkey % 7 AS ord, CAST(n_nationkey % 3 + 1 AS INT) AS page, CAST(n_nationkey % 5 AS INT) AS mcid FROM {orders} CROSS JOIN {nation}",
    "lines": """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_ix, CAST(l_partkey % 9 = 0 AS INT) AS orient, CAST(800 - l_linenumber * 14 - CASE WHEN l_partkey % 5 = 0 THEN 10 ELSE 0 END AS DOUBLE) AS cross_pos,
        CAST(10 AS DOUBLE) AS height, CAST(10 + CASE WHEN l_suppkey % 4 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS dom_size, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE NULL END AS INT) AS mcid FROM {lineitem}""",
    "glyphs": """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, 1 AS page, 1 AS line_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq, CASE WHEN l_partkey % 6 = 0 THEN 'a ' ELSE 'b' END AS text, CAST(l_linenumber * 10 + l_suppkey % 4 AS DOUBLE) AS x, CAST(8 AS DOUBLE) AS advance, CAST(6 AS DOUBLE) AS space FROM {lineitem}""",
    "boxes": """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber % 3 + 1 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS cell_ix, CAST(l_partkey % 40 * 10 AS DOUBLE) AS x0, CAST(l_suppkey % 60 * 10 AS DOUBLE) AS y0,
        CAST(l_partkey % 40 * 10 + l_linenumber * 5 AS DOUBLE) AS x1, CAST(l_suppkey % 60 * 10 + CASE WHEN l_partkey % 8 = 0 THEN 0 ELSE 20 END AS DOUBLE) AS y1, CAST(612 * 792 AS DOUBLE) AS page_area FROM {lineitem}""",
    "rules": "SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(n_nationkey % 3 + 1 AS INT) AS page, n_nationkey % 2 = 0 AS vertical, CAST((o_custkey + n_nationkey * 37) % 400 AS DOUBLE) AS pos, CAST(n_nationkey * 20 AS DOUBLE) AS lo, CAST(n_nationkey * 20 + 200 AS DOUBLE) AS hi FROM {orders} CROSS JOIN {nation}",
    "sections": """SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS sec_ix, CAST(o_orderkey % 5 + 1 AS INT) AS level, concat('T', CAST(o_orderkey % 50 AS STRING)) AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey % 4 + 1 AS STRING), '.', CAST(o_orderkey % 6 + 1 AS STRING)) ELSE NULL END AS number FROM {orders}""",
    "placed": """SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS block_ix, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE NULL END AS level, CASE o_orderkey % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' WHEN 2 THEN 'list_item' WHEN 3 THEN 'quote' ELSE 'paragraph' END AS role, o_orderpriority AS text, CAST(NULL AS STRING) AS marker FROM {orders}""",
    "cells": "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, 0 AS tbl, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS INT) AS cell_ix, l_returnflag AS a, l_orderkey % 2 = 0 AS header FROM {lineitem}",
    "images": "SELECT p_partkey AS image_id, CASE p_size % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'raw' WHEN 2 THEN 'ccitt' WHEN 3 THEN 'jbig2' ELSE 'jpx' END AS codec, CAST(p_size AS INT) AS width, CAST(p_partkey % 50 AS INT) AS height, p_partkey % 3 = 0 AS alpha FROM {part}",
}


#: So many rows of a table are sorted in one task at most, but for skew of its key.
ROWS_A_TASK = 500_000


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation; where rows are numbered within a key, in as many tasks as the table needs: shuffled rows are small, and adaptive execution would sort very many of them in one task."""
    sql = DERIVED[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if key := re.search(r"PARTITION BY (\w+)", sql):
        tables = {t: spread(df, key[1], least=-(-df.count() // ROWS_A_TASK)) for t, df in tables.items()}
    return spark.sql(sql, **tables)


def with_sql(*names: str, query: str) -> str:
    """The query for DuckDB, with the derived relations as common table expressions."""
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', DERIVED[n])})" for n in names)
    return f"WITH {ctes} {query}"
