"""Queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, distinctive, leakage, markup, names, neardup, reading, sentences

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_t(spark, sf, "text_files"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_units(spark, sf).select("file_id", "sent_end")


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.score_terms(_t(spark, sf, "sentence_structs"), "struct_id", F.col("diff.sentence"))
    return scored.withColumn("score", F.round("score", 6))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = distinctive.score_terms(_t(spark, sf, "sentence_structs"), "struct_id", F.col("diff.sentence"), 3, 20)
    return scored.select("struct_id", "term")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = names.same_name_pairs(_t(spark, sf, "authors"))
    return pairs.select(F.col("id_a").alias("author_row_a"), F.col("id_b").alias("author_row_b"))


def p3_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = names.variant_rows(_t(spark, sf, "authors"))
    links = rows.groupBy("entity").agg(F.countDistinct("spelling").alias("spellings"), F.count("*").alias("n_rows"))
    return rows.join(links, "entity").select(F.col("id").alias("author_row"), "entity", "spellings", "n_rows")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.similar_texts(_t(spark, sf, "sentence_structs"), "struct_id", F.col("diff.sentence"))
    return pairs.select(
        F.col("id_a").alias("struct_id_a"), F.col("id_b").alias("struct_id_b"), F.round("similarity", 6).alias("similarity")
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pairs(spark, sf).select("struct_id_a", "struct_id_b")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    seen = markup.read_elements(_t(spark, sf, "latex_files")).where(F.col("kind").isin(*markup.KINDS))
    left = markup.residue_files(_t(spark, sf, "text_files"))
    return (
        seen.select("file_id", "kind", "item")
        .distinct()
        .unionByName(left.select("file_id", F.lit("residue").alias("kind"), F.lit("").alias("item")))
    )


def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    marked = markup.clean_text(markup.read_elements(_t(spark, sf, "latex_files")))
    return marked.unionByName(markup.cleaned_files(_t(spark, sf, "text_files")))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(_t(spark, sf, "documents"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return leakage.drop_leaking(docs, p7_leaks(spark, sf))


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    bands = reading.reading_bands(_t(spark, sf, "documents"), _t(spark, sf, "labels"))
    return bands.withColumn("level", F.round("level", 4))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_bands(_t(spark, sf, "documents"), _t(spark, sf, "labels")).select("doc_id", "band")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_units, p2_found, p2_scores, p3_found, p3_entities, p4_found, p4_pairs, p5_found, p5_text, p6_ids, p7_found, p7_leaks, p7_clean, p8_found, p8_levels)}


_SQL = {
    "p2_found": """WITH t AS (SELECT struct_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(diff.sentence), '\\p{L}+'), lambda w: length(w) >= 4))) AS term
        FROM sentence_structs WHERE diff.sentence IS NOT NULL)
      SELECT struct_id, term FROM t WHERE term IN (SELECT term FROM t GROUP BY term HAVING count(*) BETWEEN 3 AND 20)""",
    "p4_found": """WITH s AS (SELECT min(struct_id) AS id, list_distinct(regexp_extract_all(lower(diff.sentence), '[\\p{L}\\p{N}]+')) AS ws
        FROM sentence_structs WHERE diff.sentence IS NOT NULL GROUP BY diff.sentence),
      k AS (SELECT id, ws, len(ws) AS n FROM s WHERE len(ws) >= 8), u AS (SELECT id, n, unnest(ws) AS t FROM k), f AS (SELECT t, count(*) AS c FROM u GROUP BY t),
      r AS (SELECT u.id, u.n, u.t, row_number() OVER (PARTITION BY u.id ORDER BY f.c, u.t) AS rn FROM u JOIN f USING (t)),
      x AS (SELECT id, t FROM r WHERE rn <= n - CAST(ceil(0.6 * n) AS BIGINT) + 1),
      m AS (SELECT DISTINCT a.id AS i, b.id AS j FROM x a JOIN x b ON a.t = b.t AND a.id < b.id),
      p AS (SELECT i, j, a.n + b.n AS n, len(list_intersect(a.ws, b.ws)) AS o FROM m JOIN k a ON a.id = i JOIN k b ON b.id = j)
      SELECT i AS struct_id_a, j AS struct_id_b FROM p WHERE 5 * o >= 3 * (n - o)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
