"""The queries of this package, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import bpe, fingerprint, language, lines, media, packing, pii, quality, simhash, toxicity
from quirefold.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_all(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.bpe_counts(table(spark, sf_dir, "documents")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(media.containers(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_bpe, op3_fingerprints, op4_line_dedup, op5_pii, op6_simhash, op7_quality, op8_packing, op9_media, op10_toxicity]
    import corpus_pipeline

    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


OP4_SQL = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
l AS (SELECT doc_id, no, line, list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> '') AS w FROM raw),
counted AS (SELECT doc_id, no, w, len(w) AS n, row(doc_id, no) AS place FROM l WHERE len(w) >= {lines.MIN_WORDS}),
firsts AS (SELECT w, n, min(place) AS head FROM counted GROUP BY w, n),
edit AS (SELECT * FROM firsts WHERE n >= {lines.EDIT_WORDS}),
cut AS (SELECT head, n, p, md5(array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ')) AS v FROM (SELECT w, head, n, unnest(range(1, n + 1)) AS p FROM edit)),
sub AS (SELECT head, min(head) OVER (PARTITION BY v, p) AS other FROM cut),
whole AS (SELECT head, md5(array_to_string(w, ' ')) AS v FROM edit),
ins AS (SELECT c.head AS a, f.head AS b FROM cut c JOIN whole f ON c.v = f.v WHERE c.n > {lines.EDIT_WORDS}),
near AS (SELECT head FROM sub WHERE other < head UNION SELECT greatest(a, b) FROM ins WHERE a <> b),
gone AS (SELECT x.doc_id, x.no FROM counted x JOIN firsts f ON x.w = f.w WHERE f.head < x.place UNION SELECT head[1], head[2] FROM near),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) AS text FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text, d.lang, d.source, CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL}
