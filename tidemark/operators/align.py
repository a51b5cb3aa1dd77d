"""Alignment of the sentences of successive versions: identical, within a block, in the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import udfs
from tidemark.plans.runtime import cut
from tidemark.sources.tables import by_pair, own_part

PAIR = ["arxivid", "v1", "v2"]


def blocks(rows: DataFrame) -> DataFrame:
    """With ``block``: blocks of the old version close after a blank row that is in it."""
    w = W.partitionBy(*PAIR).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    closes = F.when((F.col("text") == "") & (F.col("code") <= 0), 1).otherwise(0)
    return rows.withColumn("block", F.coalesce(F.sum(closes).over(w), F.lit(0)).cast("int"))


def identical(rows: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """Edges of kept rows."""
    return rows.where("code = 0").select(*on, "id1", "id2", F.lit("identical").alias("method"))


def open_rows(rows: DataFrame) -> DataFrame:
    """Removed and added rows worth aligning."""
    return rows.where((F.col("code") != 0) & ~X.is_boring("text"))


def may_be_similar(n: Column, m: Column, a: Column, b: Column) -> Column:
    """What :func:`similar <tidemark.functions.kernels.similar>` cannot refuse by length alone: built-in
    expressions, so that most pairs never reach Python."""
    by_length = (n > 0) & (n - m <= 0.2 * n) & (m - n <= 0.4 * n)
    return by_length | a.contains(b) | b.contains(a)


def candidates(rows: DataFrame, on: list[str]) -> DataFrame:
    """Removed and added rows that meet on the keys and pass the length bound, with the words ``w`` and characters ``n`` of
    their preprocessed texts ``t``."""

    def side(code: int, k: int) -> DataFrame:
        own = rows.where(F.col("code") == code).select(*on, F.col(f"id{k}"), X.preprocess_sent("text").alias(f"t{k}")).withColumn(f"w{k}", X.words(f"t{k}"))
        return own.withColumn(f"n{k}", characters(F.col(f"w{k}")))

    met = side(-1, 1).join(side(1, 2), on)
    return met.where(may_be_similar(F.col("n1"), F.col("n2"), F.col("t1"), F.col("t2")))


def characters(ws: Column) -> Column:
    return F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))


def similar_edges(rows: DataFrame, on: list[str], method: str) -> DataFrame:
    """Edges of similar pairs. A word that the other side lacks is removed, or added, in any diff: pairs with
    too many characters of such words are refused before the diff is made."""
    near = (characters(F.array_except("w1", "w2")) <= 0.2 * F.col("n1")) & (characters(F.array_except("w2", "w1")) <= 0.4 * F.col("n1"))
    near = near | F.col("t1").contains(F.col("t2")) | F.col("t2").contains(F.col("t1"))
    return candidates(rows, on).where(near).where(udfs.similar("w1", "w2", "t1", "t2")).select(*PAIR, "id1", "id2", F.lit(method).alias("method"))


def align(rows: DataFrame) -> DataFrame:
    """All edges ``(pair, id1, id2, method)``: kept rows, then similar ones of a block, then of the document."""
    rows = blocks(rows)
    todo = cut(open_rows(rows))
    near = cut(similar_edges(todo, [*PAIR, "block"], "block"))
    left = todo.join(near.select(*PAIR, "id1"), [*PAIR, "id1"], "left_anti").join(near.select(*PAIR, "id2"), [*PAIR, "id2"], "left_anti")
    # Null ids never meet in an anti join: each row is tested on the side it has.
    return identical(rows).unionByName(near).unionByName(similar_edges(left, PAIR, "document"))


def statuses(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with ``state``: 'solved' for kept and for aligned removed ones, 'used' for aligned added ones, 'boring', else 'unknown'."""
    has = lambda k: edges.select(*PAIR, f"id{k}").distinct().withColumn(f"has{k}", F.lit(True))
    df = rows.join(has(1), [*PAIR, "id1"], "left").join(has(2), [*PAIR, "id2"], "left")
    state = F.when((F.col("code") == 0) | ((F.col("code") == -1) & F.col("has1")), "solved").when((F.col("code") == 1) & F.col("has2"), "used")
    return df.withColumn("state", F.coalesce(state, F.when(X.is_boring("text"), "boring").otherwise("unknown"))).drop("has1", "has2")


def solved_blocks(states: DataFrame) -> DataFrame:
    """``(pair, block, n_removed, solved)``: whether no removed row of the block is left unknown."""
    removed = F.col("code") == -1
    return states.groupBy(*PAIR, "block").agg(F.count_if(removed).alias("n_removed"), (F.count_if(removed & (F.col("state") == "unknown")) == 0).alias("solved"))


def unaligned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``(pair, side, id, text)`` of sentences worth aligning that no edge reaches."""
    out = None
    for side in (1, 2):
        has = rows.where(F.col("code") != (1 if side == 1 else -1)).where(~X.is_boring("text"))
        free = has.select(*PAIR, F.lit(side).alias("side"), F.col(f"id{side}").alias("id"), "text")
        free = free.join(edges.select(*PAIR, F.col(f"id{side}").alias("id")).distinct(), [*PAIR, "id"], "left_anti").select(*PAIR, "side", "id", "text")
        out = free if out is None else out.unionByName(free)
    return out


def cross_export(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """All sentences of v1 with all of v2 of each pair: method 1 where an edge joins them, else 3. ``head`` and ``tail``
    make up the id of an alignment file's row.

    Each sentence of v1 carries what it is joined to, so the cells are neither joined nor shuffled. Rows and edges that
    have a ``part`` (:func:`pair_rows <tidemark.sources.tables.pair_rows>`) meet within it.
    """
    on = [c for c in (*PAIR, "part") if c in rows.columns]
    place = lambda k: F.regexp_extract(f"id{k}", r"v?(\d+-\d+-\d+)$", 1)
    doc = F.concat(X.id_to_path("arxivid"), F.lit("-"), F.col("v1"), F.lit("-"), F.col("v2"))
    old = rows.where("code <= 0").where(own_part("id1") if "part" in on else F.lit(True))
    old = old.select(*on, "id1", F.col("text").alias("sent_0"), F.concat(F.lit("ID-"), doc, F.lit("-"), place(1), F.lit("-")).alias("head"))
    new = rows.where("code >= 0").select(*on, "id2", F.col("text").alias("sent_1"), place(2).alias("tail"))
    edges = edges.where("id1 is not null").select(*on, "id1", "id2")
    to = (by_pair(edges) if "part" in on else edges).groupBy(*on, "id1").agg(F.collect_set("id2").alias("to"))
    to = to.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("id1", "to"))).alias("all"))  # joined by the id too, rows would be shuffled anew
    old = old.join(to, on, "left").withColumn("to", F.try_element_at("all", F.col("id1"))).drop("all")
    cells = old.join(new, on)
    return cells.withColumn("aligning_method", F.when(F.array_contains("to", F.col("id2")), 1).otherwise(3)).drop("to", "part")


def renumber(free: DataFrame, literal: bool = False) -> DataFrame:
    """Unaligned sentences with dense places ``new_p, new_s`` within each version.

    The literal variant numbers the second side as the old pipeline did: its first sentence stands alone
    in paragraph 0, and what follows counts from paragraph 1.
    """
    sid = X.sentence_id("id")
    free = free.withColumns({"p": sid["p"], "s": sid["s"]})
    side = W.partitionBy(*PAIR, "side")
    free = free.withColumn("new_p", F.dense_rank().over(side.orderBy("p")) - 1)
    if literal:
        n = F.row_number().over(side.orderBy("p", "s"))
        free = free.withColumn("new_p", F.when((F.col("side") == 2) & (n > 1), F.col("new_p") + 1).otherwise(F.col("new_p")))
    return free.withColumn("new_s", F.row_number().over(W.partitionBy(*PAIR, "side", "new_p").orderBy("p", "s")) - 1)


def unaligned_export(places: DataFrame) -> DataFrame:
    """Cells of an annotation file: all free sentences of v1, under their new places, with all of v2; none aligned yet."""

    def side(k: int) -> DataFrame:
        place = F.concat(F.col(f"v{k}"), F.lit("-"), F.col("new_p"), F.lit("-"), F.col("new_s"))
        new = F.concat(F.col("arxivid"), F.lit("-v"), place)
        return places.where(F.col("side") == k).select(*PAIR, place.alias(f"place{k}"), new.alias(f"sent_{k - 1}_idx"), F.col("text").alias(f"sent_{k - 1}"))

    pair_id = F.concat(F.lit("ID-"), F.col("arxivid"), F.lit("-"), F.col("place1"), F.lit("-"), F.col("place2"))
    return side(1).join(side(2), PAIR).select(*PAIR, pair_id.alias("pair_ID"), F.lit("UID").alias("pair_UID"), "sent_0_idx", "sent_0", "sent_1_idx", "sent_1", F.lit(3).alias("aligning_method"))


def merge_manual(edges: DataFrame, manual: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with those that people marked on renumbered sentences, read back through their places.

    ``manual``: pair, p1, s1, p2, s2 (new places), aligning_method; only method 1 counts.
    """
    place = lambda k: places.where(F.col("side") == k).select(*PAIR, F.col("new_p").alias(f"p{k}"), F.col("new_s").alias(f"s{k}"), F.col("id").alias(f"id{k}"))
    back = manual.where("aligning_method = 1").join(place(1), [*PAIR, "p1", "s1"]).join(place(2), [*PAIR, "p2", "s2"])
    return edges.unionByName(back.select(*PAIR, "id1", "id2", F.lit("manual").alias("method"))).dropDuplicates([*PAIR, "id1", "id2"])


def inconsistent_ids(pairs: DataFrame) -> DataFrame:
    """Sentence ids that an alignment file gives more than one text."""
    both = pairs.select(F.col("sent_0_idx").alias("id"), F.col("sent_0").alias("text")).unionByName(pairs.select(F.col("sent_1_idx").alias("id"), F.col("sent_1").alias("text")))
    return both.groupBy("id").agg(F.countDistinct("text").alias("n_texts")).where("n_texts > 1")


def best_model(models: DataFrame, keys: list[str], model: str, n_unaligned: str) -> DataFrame:
    """The model with the fewest unaligned sentences of each document; the smallest name on ties."""
    return models.groupBy(*keys).agg(F.min_by(model, F.struct(n_unaligned, model)).alias(model), F.min(n_unaligned).alias(n_unaligned))


def same_alignment(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables hold the same edges."""
    a, b = (x.select(*PAIR, "id1", "id2").distinct() for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
