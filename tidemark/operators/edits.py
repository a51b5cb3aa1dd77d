"""Sentence edits, their annotations, and how those are merged and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import udfs
from tidemark.operators.align import PAIR
from tidemark.plans.runtime import cut


def _texts(rows: DataFrame, k: int) -> DataFrame:
    """Ids and texts of one version's sentences."""
    return rows.where(F.col("code") != (1 if k == 1 else -1)).select(*PAIR, F.col(f"id{k}"), F.col("text").alias(f"s{k}"))


def edit_pairs(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Aligned sentences that changed: all but a sole partner of the same text, and boring old sentences."""
    e = edges.select(*PAIR, "id1", "id2").distinct().join(_texts(rows, 1), [*PAIR, "id1"]).join(_texts(rows, 2), [*PAIR, "id2"])
    partners = F.count("*").over(W.partitionBy(*PAIR, "id1"))
    return e.withColumn("partners", partners).where(~((F.col("partners") == 1) & (F.col("s1") == F.col("s2"))) & ~X.is_boring("s1"))


def copy_edits(pairs: DataFrame) -> DataFrame:
    """Edits that merely copy-edit, with their label."""
    bare = [X.tokens(X.preprocess_sent(F.regexp_replace(c, "\\.+$", ""))) for c in ("s1", "s2")]
    return pairs.withColumn("label", udfs.copy_edit("s1", "s2", *bare)).where("label is not null")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last one in the order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def merge_by_priority(base: DataFrame, sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Labels of the first source that has the key, and the first explanation that is not empty."""
    out = base
    for k, s in enumerate(sources):
        out = out.join(s.select(*keys, F.col("labels").alias(f"_l{k}"), F.col("explanation").alias(f"_e{k}")), keys, "left")
    n = range(len(sources))
    merged = {"labels": F.coalesce(*[F.col(f"_l{k}") for k in n]), "explanation": F.coalesce(*[F.nullif(F.col(f"_e{k}"), F.lit("")) for k in n], F.lit(""))}
    return out.withColumns(merged).drop(*[f"_{c}{k}" for k in n for c in "le"])


def counted_labels(labels: Column) -> Column:
    """Labels without empty ones; where a bad label is among them, the bad ones only."""
    full = F.filter(labels, lambda x: x != "")
    bad = F.filter(full, lambda x: x.isin(*X.BAD_LABELS))
    return F.when(F.size(bad) > 0, bad).otherwise(full)


def label_distribution(annotated: DataFrame) -> DataFrame:
    """``(label, n, percent)`` over annotated pairs, which a label array tells, even an empty one."""
    total = annotated.where("labels is not null").agg(F.count("*").alias("total"))
    counts = annotated.select(F.explode(counted_labels(F.col("labels"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("label", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def reason_counts(annotated: DataFrame) -> DataFrame:
    labels = annotated.select(F.explode(F.filter("labels", lambda x: x != "")).alias("label"))
    return labels.groupBy(X.label_reason("label").alias("reason")).agg(F.count("*").alias("n"))


def unlabelled(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("labels").isNull()).alias("n_unlabelled"), F.count("*").alias("n_pairs"))


def examples_of(annotated: DataFrame, label: str = "other") -> DataFrame:
    return annotated.where(F.array_contains("labels", label))


def parse_ids(ids: Column | str) -> Column:
    """Ids of a merged field, parted by commas."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")


def edge_groups(edges: DataFrame) -> DataFrame:
    """With ``grp``: the connected group of each edge, named by its smallest v1 id.

    In each round every label goes to the smallest one that a sentence of its edges bears, and from
    there on to where the sentence of that name went, until no label moves: long chains need few rounds, and none is broken.
    """
    e = cut(edges.select(*PAIR, "id1", "id2").distinct().withColumn("grp", F.col("id1")))
    while True:
        right = e.groupBy(*PAIR, "id2").agg(F.min("grp").alias("to"))
        moves = cut(e.join(right, [*PAIR, "id2"]).groupBy(*PAIR, "grp").agg(F.min("to").alias("to")))
        if moves.where("to < grp").isEmpty():
            return e
        moved = cut(e.join(moves, [*PAIR, "grp"]).select(*PAIR, "id1", "id2", "to"))
        further = moved.groupBy(*PAIR, F.col("id1").alias("to")).agg(F.min("to").alias("end"))
        e = cut(moved.join(further, [*PAIR, "to"]).select(*PAIR, "id1", "id2", F.col("end").alias("grp")))


def merge_groups(pairs: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a group that has an annotated pair: ids and texts of all its sentences in order of the ids, labels
    joined and sorted, explanations in order; ``n_edges`` counts the annotated pairs."""
    notes = pairs.select(*PAIR, "id1", "id2", "labels", "explanation", F.lit(True).alias("noted"))
    df = groups.join(notes, [*PAIR, "id1", "id2"], "left").join(_texts(rows, 1), [*PAIR, "id1"]).join(_texts(rows, 2), [*PAIR, "id2"])

    def ordered(k: int) -> Column:
        sid = X.sentence_id(f"id{k}")
        return F.array_sort(F.collect_set(F.struct(sid["p"].alias("p"), sid["s"].alias("s"), F.col(f"id{k}").alias("id"), F.col(f"s{k}").alias("t"))))

    out = df.groupBy(*PAIR, "grp").agg(
        ordered(1).alias("a"), ordered(2).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(F.col("noted"), F.struct("id1", "id2", "explanation")))).alias("ex"), F.count("noted").alias("n_edges"),
    ).where("n_edges > 0")
    pick = lambda c, f: F.transform(c, lambda x: x[f])
    return out.select(
        *PAIR, F.array_join(pick("a", "id"), ",").alias("ids1"), F.array_join(pick("b", "id"), ",").alias("ids2"), F.array_join(pick("a", "t"), " ").alias("s1"),
        F.array_join(pick("b", "t"), " ").alias("s2"), "labels", F.array_join(F.filter(pick("ex", "explanation"), lambda x: x != ""), " ").alias("explanation"), "n_edges",
    )
