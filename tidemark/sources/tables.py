"""Readers of the engine's tables, files and annotation formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X

ALIGNMENT_SCHEMA = "pair_ID string, pair_UID string, sent_0_idx string, sent_0 string, sent_1_idx string, sent_1 string, aligning_method int"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table behind JDBC, as of the metadata database; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def alignment_files(spark: SparkSession, path: str) -> DataFrame:
    """Alignment files: separated by pipes, with a header; method 1 aligned, 2 partly, 3 not."""
    return spark.read.schema(ALIGNMENT_SCHEMA).option("sep", "|").option("header", True).csv(path)


def annotation_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Ragged annotation lines ``label*, explanation, id1, id2, sent1, sent2``, read from the right.

    Lines of fewer than five fields give no row. Quoted fields may hold commas and doubled quotes.
    """
    field = '"(?:[^"]|"")*"|[^,]*'
    raw = F.regexp_extract_all(F.concat(F.col(col), F.lit(",")), F.lit(f"({field}),"), F.lit(1))
    clean = F.transform(raw, lambda f: F.trim(F.when(f.startswith('"'), F.regexp_replace(F.substr(f, F.lit(2), F.length(f) - 2), '""', '"')).otherwise(f)))
    parts = lines.select(clean.alias("f")).where(F.size("f") >= 5)
    at = lambda k: F.element_at("f", -k)
    return parts.select(
        F.expr("slice(f, 1, size(f) - 5)").alias("labels"), at(5).alias("explanation"), at(4).alias("id1"), at(3).alias("id2"), at(2).alias("s1"), at(1).alias("s2")
    )


def file_listing(paths: DataFrame, col: str) -> DataFrame:
    """``(id, version)`` of paths ``.../{id}/v{version}/...``, each once."""
    part = lambda k: F.regexp_extract(F.col(col), r"/([^/]+)/v(\d+)/", k)
    return paths.where(part(2) != "").select(part(1).alias("id"), part(2).cast("int").alias("version")).distinct()


def lines_of(body: Column | str) -> Column:
    """The non-blank lines of a body, trimmed."""
    body = F.col(body) if isinstance(body, str) else body
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def paragraph_sentences(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Keys, p, s, text: paragraphs part at blank lines, sentences at line ends. Empty ones are
    dropped before they are counted."""
    bare = F.regexp_replace(F.regexp_replace(F.col(body), "\r", ""), "[ \t]+\n", "\n")
    ps = F.filter(F.transform(F.split(bare, "\n\n"), lambda p: lines_of(p)), lambda p: F.size(p) > 0)
    return (
        files.select(*keys, F.posexplode(ps).alias("p", "ss")).select(*keys, "p", F.posexplode("ss").alias("s", "text"))
    )


def sentence_arrays(body: Column | str) -> Column:
    """Paragraphs of a detexed text as arrays of sentences: paragraphs part at blank lines, their line ends are spaces."""
    body = F.col(body) if isinstance(body, str) else body
    bare = F.regexp_replace(F.regexp_replace(body, "\r", ""), "[ \t]+\n", "\n")
    ps = F.filter(F.transform(F.split(bare, "\n\n"), lambda p: F.btrim(F.replace(p, F.lit("\n"), F.lit(" ")), F.lit(" \t"))), lambda p: p != "")
    return F.filter(F.transform(ps, X.ssplit), lambda ss: F.size(ss) > 0)


def file_sentences(files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Keys, p, s, text: the sentences of detexed texts; null and blank ones give none."""
    return files.select(*keys, F.posexplode(sentence_arrays(body)).alias("p", "ss")).select(*keys, "p", F.posexplode("ss").alias("s", "text"))


def example_files(spark: SparkSession, path: str, group: str = "both") -> DataFrame:
    """``(grp, window, min_length, features, label)`` of written training rows; of both groups or one."""
    rows = spark.read.text(path)
    xs = F.transform(F.split("value", ","), lambda x: x.cast("double"))
    rows = rows.select("grp", "window", "min_length", F.slice(xs, 1, F.size(xs) - 1).alias("features"), F.element_at(xs, -1).alias("label"))
    return rows if group == "both" else rows.where(F.col("grp") == group)


def diff_rows(structs: DataFrame) -> DataFrame:
    """The rows of each version pair's diff, each once: of repeated rows the one with the smallest id.

    ``id1`` and ``id2`` are the sentence's ids in the two versions, null where it is not in them.
    A null sentence is read as an empty one.
    """
    keys = ["arxivid", "v1", "v2", "idx"]
    kept = F.struct(F.col("diff.code").alias("code"), F.coalesce("diff.sentence", F.lit("")).alias("text"), "identifiers", "status", "aligned", "struct_id")
    one = structs.groupBy(*keys).agg(F.min_by(kept, "struct_id").alias("r")).select(*keys, "r.*")
    first, last = F.get("identifiers", F.lit(0)), F.get("identifiers", F.size("identifiers") - 1)
    return one.withColumns({"id1": F.when(F.col("code") <= 0, first), "id2": F.when(F.col("code") >= 0, last)}).withColumn("words", X.words("text"))


#: Sentence pairs from which on a version pair is dealt to several tasks, and the most tasks it is dealt to: no row is sent more often.
LARGE, PARTS = 2_000_000, 4


def pair_rows(structs: DataFrame, *more: str) -> DataFrame:
    """``(pair, parts, part, idx, code, text, more)``: :func:`diff_rows`, a version pair in one place after a single shuffle.

    What is joined or grouped on the pair and ``part`` is not shuffled again. A large pair stands whole in each of its ``parts``
    places; :func:`own_part` tells whose turn a row of v1 is. ``more`` are columns of :func:`diff_rows`; pairs with a null in
    their key, which meet nothing, are left out.
    """
    keys = ["arxivid", "v1", "v2"]
    structs = structs.dropna(subset=keys)
    code, ids = F.col("diff.code"), F.col("identifiers")
    known = {"id1": F.when(code <= 0, F.get(ids, F.lit(0))), "id2": F.when(code >= 0, F.get(ids, F.size(ids) - 1))}
    kept = F.struct("idx", code.alias("code"), F.coalesce("diff.sentence", F.lit("")).alias("text"), *[known.get(c, F.col(c)).alias(c) for c in more])
    counts = structs.groupBy(*keys).agg((F.count_if(code <= 0) * F.count_if(code >= 0)).alias("n")).where(F.col("n") > LARGE)
    large = counts.select(*keys, F.least(F.lit(PARTS), F.ceil(F.col("n") / LARGE)).cast("int").alias("parts"))  # at most one pair in 1,400 rows
    rows = structs.select(*keys, "idx", "struct_id", kept.alias("r")).join(F.broadcast(large), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = by_pair(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    return rows.groupBy(*keys, "parts", "part", "idx").agg(F.min_by("r", "struct_id").alias("r")).select(*keys, "parts", "part", "r.*")  # r's idx: no filter on it reaches below the shuffle, which all readers share


def by_pair(rows: DataFrame) -> DataFrame:
    """Rows with a ``part`` in the places where :func:`pair_rows` has theirs."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "arxivid", "v1", "v2", "part")


def own_part(c: str) -> Column:
    """Whether a row of :func:`pair_rows` is the one of all its copies that counts, by the value of a column."""
    return F.pmod(F.xxhash64(c), "parts") == F.col("part")
