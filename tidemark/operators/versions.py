"""From the texts of two versions to diff rows, and from there to a whole machine alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import udfs
from tidemark.operators import align as A
from tidemark.operators.align import PAIR
from tidemark.plans.runtime import cut, spread
from tidemark.sources import tables as T

#: A paragraph's sentences as one line of a paragraph diff.
SENTENCE = "<SENT>"


def version_lines(files: DataFrame, arxiv_id: str = "arxivid", version: str = "version_no", body: str = "body") -> DataFrame:
    """``(arxivid, version, paragraphs, lines)`` of each version that has a text: sentences in paragraphs, and one after
    another with a blank line after each paragraph. Of several texts of one version the longest is taken."""
    texts = files.where(F.col(arxiv_id).isNotNull() & F.col(version).isNotNull() & F.col(body).isNotNull())
    texts = texts.groupBy(F.col(arxiv_id).alias("arxivid"), F.col(version).alias("version")).agg(F.max_by(body, F.struct(F.length(body), F.col(body))).alias("b"))
    return texts.select("arxivid", "version", T.sentence_arrays("b").alias("paragraphs")).withColumn("lines", X.paragraphs_to_lines("paragraphs"))


def _met(lines: DataFrame, pairs: DataFrame | None, what: Column) -> DataFrame:
    """``(pair, old, new)`` of the given pairs, or of all successive versions."""
    side = lambda k: lines.select("arxivid", F.col("version").alias(f"v{k}"), what.alias(f"l{k}"))
    if pairs is None:
        return side(1).withColumn("v2", F.col("v1") + 1).join(side(2), ["arxivid", "v2"]).select(*PAIR, "l1", "l2")
    return pairs.select(*PAIR).where("v1 < v2").join(side(1), ["arxivid", "v1"]).join(side(2), ["arxivid", "v2"]).select(*PAIR, "l1", "l2")


def line_diff_rows(lines: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(pair, idx, code, text, id1, id2)``: the diff of the sentences of two versions; blank rows close paragraphs.

    Codes below 1 give the old version's lines in order, codes above -1 the new one's. Each pair is one
    row until its diff is made, so a task holds one pair at a time.
    """
    rows = _met(lines, pairs, F.col("lines")).select(*PAIR, F.posexplode(udfs.line_diff("l1", "l2")).alias("idx", "d"))
    ids = [F.when(F.col(f"d.p{k}") >= 0, X.format_sentence_id("arxivid", f"v{k}", F.col(f"d.p{k}"), F.col(f"d.s{k}"))).alias(f"id{k}") for k in (1, 2)]
    return rows.select(*PAIR, "idx", F.col("d.code").alias("code"), F.col("d.text").alias("text"), *ids)


def paragraph_diff_rows(lines: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(pair, idx, code, sentences)``: the diff of whole paragraphs."""
    whole = F.transform("paragraphs", lambda p: F.array_join(p, SENTENCE))
    rows = _met(lines, pairs, whole).select(*PAIR, F.posexplode(udfs.line_diff("l1", "l2")).alias("idx", "d"))
    return rows.select(*PAIR, "idx", F.col("d.code").alias("code"), F.split("d.text", SENTENCE).alias("sentences"))


def rich_in_math(rows: DataFrame, most: int = 5000) -> DataFrame:
    """``(pair, product, kept)``: how many pairs of sentences there are that hold three inline formulas each."""
    heavy = F.size(F.filter(X.words(X.preprocess_sent("text")), lambda w: w == "[MATH]")) >= 3
    c = rows.groupBy(*PAIR).agg(F.count_if(heavy & (F.col("code") <= 0)).alias("a"), F.count_if(heavy & (F.col("code") >= 0)).alias("b"))
    return c.select(*PAIR, (F.col("a") * F.col("b")).alias("product"), (F.col("a") * F.col("b") <= most).alias("kept"))


def uses_harvmac(body: Column | str) -> Column:
    body = F.col(body) if isinstance(body, str) else body
    return body.rlike(r"(?m)^[^%\n]*\\input harvmac")


def machine_alignment(texts: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diff rows and edges ``(pair, id1, id2, method)`` of all successive versions: versions whose source inputs
    harvmac and pairs too rich in inline math are left out, the rest is diffed and aligned in four steps."""
    barred = sources.where(uses_harvmac("body")).select("arxivid", F.col("version_no").alias("version")).distinct()
    lines = version_lines(spread(texts)).join(barred, ["arxivid", "version"], "left_anti")
    rows = cut(line_diff_rows(lines))
    rows = rows.join(rich_in_math(rows).where("not kept").select(*PAIR), PAIR, "left_anti")
    return rows, A.align(rows)
