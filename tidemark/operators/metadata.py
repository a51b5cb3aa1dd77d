"""Papers, versions, categories and authors: assembly, pairs, deltas, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X


def version_times(versions: DataFrame) -> DataFrame:
    """One row a version; of repeated rows the earliest time."""
    return versions.where("arxiv_id is not null and number is not null").groupBy("arxiv_id", "number").agg(F.min("version_time").alias("version_time"))


def multi_version(versions: DataFrame, least: int = 2) -> DataFrame:
    """``(arxiv_id, version_count)`` of papers whose highest version is at least ``least``."""
    return versions.groupBy("arxiv_id").agg(F.max("number").alias("version_count")).where(F.col("version_count") >= least)


def expand_versions(counted: DataFrame) -> DataFrame:
    return counted.select("arxiv_id", F.explode(F.sequence(F.lit(1), F.col("version_count"))).alias("version"))


def announced_pairs(counted: DataFrame) -> DataFrame:
    """``(arxiv_id, v1, v2)`` for each v below the highest version, present or not."""
    many = counted.where("version_count > 1")
    return many.select("arxiv_id", F.explode(F.sequence(F.lit(1), F.col("version_count") - 1)).alias("v1")).withColumn("v2", F.col("v1") + 1)


def curated_pairs(ids: DataFrame, present: DataFrame) -> DataFrame:
    """``(arxiv_id, v1, v2)`` of chosen papers ``(arxiv_id, version_count)`` where both versions are among ``present (arxiv_id, number)``."""
    have = present.select("arxiv_id", "number").distinct()
    side = lambda k: have.withColumnRenamed("number", f"v{k}")
    return announced_pairs(ids).join(side(1), ["arxiv_id", "v1"], "left_semi").join(side(2), ["arxiv_id", "v2"], "left_semi").select("arxiv_id", "v1", "v2")


def version_pairs(times: DataFrame) -> DataFrame:
    """Successive versions that are both present, with their times."""
    later = times.select("arxiv_id", (F.col("number") - 1).alias("number"), F.col("version_time").alias("t2"))
    return times.join(later, ["arxiv_id", "number"]).select(
        "arxiv_id", F.col("number").alias("v1"), (F.col("number") + 1).alias("v2"), F.col("version_time").alias("t1"), "t2"
    )


def day_deltas(pairs: DataFrame) -> DataFrame:
    return pairs.select("arxiv_id", "v1", "v2", X.day_delta("t1", "t2").alias("days"))


def delta_measures(deltas: DataFrame, **measures: Callable[[Column], Column]) -> DataFrame:
    """Deltas by version pair, under measures the caller names, each from column to aggregate."""
    return deltas.where("days is not null").groupBy("v1", "v2").agg(*[f(F.col("days")).alias(name) for name, f in measures.items()])


def assemble(versions: DataFrame, categories: DataFrame, authors: DataFrame) -> DataFrame:
    """One row a paper that has all three: each side is gathered before it is joined, so rows do not multiply."""
    v = version_times(versions).groupBy("arxiv_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("number", "version_time")))).alias("versions")
    )
    c = categories.groupBy("arxiv_id").agg(F.array_sort(F.collect_set("spec")).alias("categories"))
    name = F.struct(F.coalesce("first_name", F.lit("")).alias("first_name"), "last_name")
    a = authors.groupBy("arxiv_id").agg(F.array_sort(F.collect_set(name)).alias("authors"))
    return v.join(c, "arxiv_id").join(a, "arxiv_id")


def merge_streams(a: DataFrame, b: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """Two record streams joined by id, without ids seen before."""
    both = a.join(b, key)
    return both if seen is None else both.join(seen.select(key).distinct(), key, "left_anti")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``rows`` whose key is not in ``target``, each key once (its smallest row)."""
    new = rows.join(target.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.distinct()


def zip_names(first: Column, last: Column) -> Column:
    """Name arrays zipped to the shorter one's length."""
    n = F.least(F.size(first), F.size(last))
    return F.arrays_zip(F.slice(first, 1, n), F.slice(last, 1, n))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """A sample of n rows that stays the same: the first in order of the key's digest."""
    return df.orderBy(F.md5(key), key).limit(n)


def progress(all_keys: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """``(total, done, percent)`` of keys that have been done."""
    marked = all_keys.select(*keys).distinct().join(done.select(*keys).distinct().withColumn("d", F.lit(1)), keys, "left")
    return marked.agg(
        F.count("*").alias("total"), F.count("d").alias("done"), F.round(F.coalesce(100 * F.count("d") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("percent")
    )


def main_file(files: DataFrame, archive: list[str], path: str = "latex_path", body: str = "body", order: str = "file_id") -> DataFrame:
    """The main source of each archive.

    Empty files fall away; a file left alone is it. Else it must hold a document's begin; of
    those, styles and bibliographies fall away unless one is left alone; the longest is it.
    """
    begins = F.col(body).rlike(r"\\document(?:class|style)|\\begin\s*\{document\}")
    aux = F.lower(F.col(path)).rlike(r"\.(dtx|sty|bbl)$")
    df = files.where(F.length(body) > 0).withColumns({"_begins": begins, "_aux": aux})
    w = [F.col(c) for c in archive]
    counts = df.groupBy(*w).agg(F.count("*").alias("_n"), F.count_if("_begins").alias("_b"), F.count_if(F.col("_begins") & ~F.col("_aux")).alias("_p"))
    df = df.join(counts, archive)
    keep = (F.col("_n") == 1) | (F.col("_begins") & ((F.col("_b") == 1) | ~F.col("_aux")))
    best = df.where(keep).groupBy(*archive).agg(F.min_by(F.struct(order, path, F.length(body).alias("n_chars")), F.struct(-F.length(body), F.col(order))).alias("r"))
    return best.select(*archive, "r.*")


def first_author(authors: DataFrame) -> DataFrame:
    """The smallest author row of each paper."""
    return authors.groupBy("arxiv_id").agg(F.min_by(F.struct("first_name", "last_name"), "author_row").alias("a")).select("arxiv_id", "a.*")
