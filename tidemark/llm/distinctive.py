"""Distinctive terms of each record by a parsimonious language model.

A record is taken for a mixture of its own language and that of the collection. Expectation
maximisation gives each of its terms the share that the collection does not explain; common
terms lose their mass to the background, rare ones keep it. Background probabilities come
from all records. Terms that stand in a thousandth of the records or more are broadcast:
there are at most (terms a record) * 1000 of them, however large the collection. Only the others
are joined by shuffle, where by the same bound no key holds more than a thousandth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import cut, spread

MIN_LETTERS = 4
#: Weight of the record's own language in the mixture.
OWN = 0.1
MAX_ROUNDS = 60
TOLERANCE = 1e-7
COMMON = 0.001


_ASCII, _ANY = re.compile("[a-z]+"), regex.compile(r"\p{L}+")


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters in lower case, of at least ``MIN_LETTERS`` letters."""
    low = text.lower()
    return [t for t in (_ASCII if low.isascii() else _ANY).findall(low) if len(t) >= MIN_LETTERS]


def count_terms(texts: DataFrame) -> DataFrame:
    """``(term, df, cf)`` of texts ``(id, text)``: records with the term, and its uses. Counted up within the batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records, uses = Counter(), Counter()
            for text in b.column("text").to_pylist():
                terms = terms_of(text)
                uses.update(terms)
                records.update(set(terms))
            cols = list(uses), [records[t] for t in uses], list(uses.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["term", "df", "cf"])

    counted = texts.mapInArrow(run, "term string, df bigint, cf bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def maximise(tf: np.ndarray, background: np.ndarray, begins: np.ndarray, own: float = OWN) -> np.ndarray:
    """Converged term probabilities of many records laid end to end.

    ``begins`` holds the first position of each record, none of them empty. A record stands still once its own
    largest move is small, so that its scores do not depend on the records beside it.
    """
    if not len(tf):
        return tf
    lens = np.diff(np.append(begins, len(tf)))
    owner = np.repeat(np.arange(len(begins)), lens)
    p = tf / np.add.reduceat(tf, begins)[owner]
    other = (1 - own) * background
    moving = np.ones(len(begins), bool)
    for _ in range(MAX_ROUNDS):
        e = tf * (own * p) / (own * p + other)
        new = e / np.add.reduceat(e, begins)[owner]
        moved = np.maximum.reduceat(np.abs(new - p), begins)
        p = np.where(moving[owner], new, p)
        moving &= moved >= TOLERANCE
        if not moving.any():
            break
    return p


def score_terms(records: DataFrame, id_col: str, text: F.Column | str, least: int = 1, most: int | None = None) -> DataFrame:
    """``(id, term, tf, df, score)``: the distinct terms of each record, of those with ``least <= df <= most``.

    ``df`` counts the records with the term over the whole table, repeated records each;
    ``score`` is the term's converged probability in the record among all its terms, and a record's scores add
    up to one. Ids must be unique. Null, empty and term-free texts give no row and are not
    counted. An empty table gives an empty result. Very long texts are one record like any.
    """
    col = F.col(text) if isinstance(text, str) else text
    src = spread(records.select(F.col(id_col).alias("id"), col.alias("text")).where("id is not null and text is not null"))
    stats = cut(count_terms(src))
    total = stats.agg(F.sum("cf")).first()[0] or 1
    n = src.count()
    stats = stats.select("term", "df", (F.col("cf") / F.lit(total)).alias("background"))
    is_common = F.col("df") >= F.lit(max(1.0, n * COMMON))
    sent = src.sparkSession.sparkContext.broadcast({r.term: (r.df, r.background) for r in stats.where(is_common).collect()})
    kind = src.schema["id"].dataType.simpleString()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value.keys()
        for b in batches:
            rows, terms = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                got = set(terms_of(t)) - common
                rows += [k] * len(got)
                terms += got
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], names=["id", "term"])

    far = src.mapInArrow(rare, f"id {kind}, term string").join(stats.where(~is_common), "term")
    far = far.groupBy("id").agg(F.collect_list(F.struct("term", "df", "background")).alias("rare"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for b in batches:
            rows, terms, tf, df, background, begins = [], [], [], [], [], []
            for k, (t, far) in enumerate(zip(b.column("text").to_pylist(), b.column("rare").to_pylist())):
                counts = Counter(terms_of(t))
                if not counts:
                    continue
                begins.append(len(terms))
                own = {x["term"]: (x["df"], x["background"]) for x in far or ()}
                for w in sorted(counts):
                    known = common.get(w) or own[w]
                    terms.append(w)
                    df.append(known[0])
                    background.append(known[1])
                    tf.append(counts[w])
                rows += [k] * len(counts)
            uses, dfs = np.array(tf, np.int64), np.array(df, np.int64)
            p = maximise(uses.astype(np.float64), np.array(background, np.float64), np.array(begins, np.int64))
            keep = np.flatnonzero((dfs >= least) & (dfs <= (n if most is None else most)))
            at = pa.array(keep)
            cols = [b.column("id").take(pa.array(np.array(rows, np.int64)[keep])), pa.array(terms, pa.string()).take(at), pa.array(uses[keep]), pa.array(dfs[keep]), pa.array(p[keep])]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "term", "tf", "df", "score"])

    return src.join(far, "id", "left").mapInArrow(score, f"`{id_col}` {kind}, term string, tf bigint, df bigint, score double")


def shared_rare_terms(scored: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """The scored terms that stand in at least ``least`` and at most ``most`` records."""
    return scored.where(F.col("df").between(least, most))
