"""Near-duplicate texts by token-group matrices.

Texts are sets of words in a global order, rare words first. Two sets of Jaccard similarity ``t`` or more
share so many words that the first word they share stands among the first ``size - o + 1`` words of either,
``o`` being the least overlap with any partner the set may have. Each set is therefore sent to one cell for
each of these words, with its words from there on. A word too frequent for a cell of ``CELL`` sets
is joined with the next shared word to a pair, and a frequent pair with one more to a triple: how
many words name a cell follows from the words' shares of all texts and their number alone, so both
partners tell it alike, and cells stay small however large the collection.

Within a cell similar sets are partitioned into groups: sorted by their rarest further words and cut into
``GROUP_SIZE``. The token-group matrix holds a row of bits for each word, a bit for each group whose
union of words has it. For a query the rows of its words are added up, all groups at once, which
bounds its overlap with any member; only groups whose bound reaches the overlap that the sizes ask
are opened, and their members are compared word by word. Words before the cell's first one are
not counted, so a pair that also meets in an earlier cell may be told too low in later ones: the
highest similarity told is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import cut

THRESHOLD = 0.6
MIN_WORDS = 8
GROUP_SIZE = 6
#: Words in this share of all texts or more are ranked by frequency and sent to the workers;
#: there are at most (words a text) / COMMON of them. The others precede them, by hash.
COMMON = 0.001
#: Sets that a cell is meant to hold; a cell that holds more is dealt out in blocks of about so many.
CELL = 16_384
#: Sets in one row of a cell, and rows of input that are packed together.
CHUNK, PACKED = 512, 50_000
#: Hot cells up to this many are broadcast, beyond it they are joined by shuffle.
MAX_BROADCAST = 100_000
_EPS = 1e-9
_RARE = np.int64(-(2**63))
_MASK = np.int64(2**62 - 1)


def words_of(text: F.Column) -> F.Column:
    """Distinct maximal runs of letters or digits in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


@lru_cache(maxsize=4096)
def index_cut(b: int, t: float) -> int:
    """First words of a set of ``b`` that hold the first one shared with any partner of its size or larger."""
    return min(b, b - ceil(2 * t / (1 + t) * b - _EPS) + 1)


@lru_cache(maxsize=4096)
def probe_cut(a: int, t: float) -> int:
    """The like for partners of its size or smaller."""
    return min(a, a - max(1, ceil(t * a - _EPS)) + 1)


def need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of these sizes."""
    return np.ceil(t / (1 + t) * (a + b) - _EPS).astype(np.int64)


class Order(NamedTuple):
    """The global order: hashes of the common words, sorted, their ranks, and the share of each rank."""

    hashes: np.ndarray
    ranks: np.ndarray
    shares: np.ndarray
    n: int

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of common words, from 0 on; negative numbers of all others."""
        if not len(self.hashes):
            return _RARE | (hashes & _MASK)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], _RARE | (hashes & _MASK))

    def share(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.shares):
            return np.full(codes.shape, COMMON)
        return np.where(codes >= 0, self.shares[np.maximum(codes, 0)], COMMON)


def global_order(sets: DataFrame, n: int) -> Order:
    counts = sets.select(F.explode("hs").alias("h")).groupBy("h").count().where(F.col("count") >= max(2.0, n * COMMON)).orderBy("count", "h")
    rows = counts.collect()
    hashes = np.array([r.h for r in rows], np.int64)
    order = np.argsort(hashes)
    return Order(hashes[order], order.astype(np.int64), np.array([r["count"] / n for r in rows]), n)


def sets_of(texts: DataFrame, min_words: int) -> DataFrame:
    """``(id, hs)`` of texts ``(id, text)``: hashes of their distinct words."""
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    return cut(texts.select("id", F.array_distinct(hashed).alias("hs")).where(F.size("hs") >= min_words))


class Entries(NamedTuple):
    """Sets of a batch in their cells: cell, row, first position, and whether the set is looked up there or only looks up."""

    width: np.ndarray
    key: np.ndarray
    row: np.ndarray
    at: np.ndarray
    indexed: np.ndarray


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(*words: np.ndarray) -> np.ndarray:
    key = np.full(len(words[0]), np.uint64(len(words)))
    for k, w in enumerate(words):
        key = (key ^ w.view(np.uint64)) * _MIX[k]
        key ^= key >> np.uint64(29)
    return (key * _MIX[0]).view(np.int64)


def sorted_codes(b: pa.RecordBatch | pa.Table, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows end to end, each row in the global order, and where the rows begin."""
    hs = b.column("hs")
    if isinstance(hs, pa.ChunkedArray):
        hs = hs.combine_chunks()
    lens = np.asarray(pc.list_value_length(hs), np.int64)
    codes = order.codes(np.asarray(hs.flatten(), np.int64))
    codes = codes[np.lexsort((codes, np.repeat(np.arange(len(lens)), lens)))]
    return codes, np.concatenate([[0], np.cumsum(lens)])


def cells(codes: np.ndarray, begins: np.ndarray, order: Order, t: float, cell: float = CELL) -> Entries:
    """The cells of every set. A word names a cell where its share of all texts makes at most ``cell`` sets; else
    pairs with a later word do, or triples. Sets that may share fewer than three words with a partner go, besides, to
    cells (width 0) of each word alone."""
    sizes = np.diff(begins)
    out: list[tuple] = []

    def put(width: int, key: np.ndarray, rows: np.ndarray, i: int, indexed: bool) -> None:
        if len(rows):
            out.append((np.full(len(rows), width, np.int8), key, rows, np.full(len(rows), i, np.int64), np.full(len(rows), indexed)))

    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        probe, index = probe_cut(n, t), index_cut(n, t)
        m = codes[begins[rows][:, None] + np.arange(min(n, probe + 2))[None, :]]
        share = order.share(m)
        for i in range(probe):
            one = share[:, i] * order.n <= cell
            put(1, m[one, i], rows[one], i, i < index)
            if ceil(t * n - _EPS) < 3:
                put(0, m[:, i], rows, i, i < index)
            if one.all():
                continue
            r1 = np.flatnonzero(~one)
            for j in range(i + 1, min(n, probe + 1)):
                two = share[r1, i] * share[r1, j] * order.n <= cell
                r = r1[two]
                put(2, _mix(m[r, i], m[r, j]), rows[r], i, i < index and j < index + 1)
                r2 = r1[~two]
                for k in range(j + 1, min(n, probe + 2)) if len(r2) else ():
                    put(3, _mix(m[r2, i], m[r2, j], m[r2, k]), rows[r2], i, i < index and j < index + 1 and k < index + 2)
    if not out:
        e = np.zeros(0, np.int64)
        return Entries(e.astype(np.int8), e, e, e, e.astype(bool))
    return Entries(*(np.concatenate(x) for x in zip(*out)))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACKED:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def crowded_cells(sets: DataFrame, order: Order, t: float, cell: int) -> DataFrame:
    """``(width, key, blocks)`` of the cells that hold more sets than they are meant to. Cells of one word cannot."""
    sent = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            e = cells(*sorted_codes(table, sent.value), sent.value, t, cell)
            wide = e.width != 1
            for w in np.unique(e.width[wide]).tolist():
                keys, counts = np.unique(e.key[e.width == w], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), w, np.int8)), pa.array(keys), pa.array(counts)], names=["width", "key", "n"])

    found = sets.mapInArrow(run, "width tinyint, key bigint, n bigint").groupBy("width", "key").agg(F.sum("n").alias("n"))
    return cut(found.where(F.col("n") > cell).select("width", "key", F.ceil(F.col("n") / cell).cast("int").alias("blocks")))


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places ``starts[k] .. starts[k] + lens[k]`` of all k, end to end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as one binary value each; ``ends`` counts elements and begins with 0."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _small(most: int) -> type:
    return np.uint16 if most < 1 << 16 else np.uint32


_PACKED = "width tinyint, key bigint, ids binary, sizes binary, rare_n binary, indexed binary, rare binary, common binary"


def packed_cells(sets: DataFrame, order: Order, t: float, cell: int, longest: int) -> DataFrame:
    """The sets in their cells, up to ``CHUNK`` in a row, each as its words from the cell's first one on."""
    sent = sets.sparkSession.sparkContext.broadcast(order)
    small, code = _small(longest), _small(len(order.ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            ids = np.asarray(table.column("id").combine_chunks(), np.int64)
            codes, begins = sorted_codes(table, sent.value)
            e = cells(codes, begins, sent.value, t, cell)
            if not len(e.key):
                continue
            by = np.lexsort((e.row, e.key, e.width))
            width, key, row, at, indexed = (x[by] for x in e)
            new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(width) != 0)])
            first = np.flatnonzero(new)
            within = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            starts = np.flatnonzero(new | (within % CHUNK == 0))
            ends = np.append(starts, len(key))
            lens = begins[row + 1] - begins[row] - at
            flat = codes[_runs(begins[row] + at, lens)]
            rare = flat < 0
            rare_n = np.add.reduceat(rare, np.concatenate([[0], np.cumsum(lens)[:-1]]), dtype=np.int64)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(width[starts]), pa.array(key[starts]), _binary(ids[row], ends), _binary(np.stack([begins[row + 1] - begins[row], lens], 1).astype(small).reshape(-1), 2 * ends),
                    _binary(rare_n.astype(small), ends), _binary(indexed.astype(np.uint8), ends), _binary(flat[rare], upto(rare_n)), _binary(flat[~rare].astype(code), upto(lens - rare_n)),
                ],
                names=["width", "key", "ids", "sizes", "rare_n", "indexed", "rare", "common"],
            )

    return sets.mapInArrow(run, _PACKED)


class Members(NamedTuple):
    """Sets of a cell: ids, sizes, words from the cell's first one on (end to end), and where each begins."""

    ids: np.ndarray
    sizes: np.ndarray
    indexed: np.ndarray
    codes: np.ndarray
    begins: np.ndarray

    def take(self, at: np.ndarray) -> Members:
        lens = self.begins[at + 1] - self.begins[at]
        return Members(self.ids[at], self.sizes[at], self.indexed[at], self.codes[_runs(self.begins[at], lens)], np.concatenate([[0], np.cumsum(lens)]))

    def matrix(self, ids: np.ndarray, pad: int) -> np.ndarray:
        """The given numbers of its words, a row for each set, padded."""
        lens = np.diff(self.begins)
        out = np.full((len(lens), int(lens.max(initial=0))), pad, np.int32)
        out[np.repeat(np.arange(len(lens)), lens), np.arange(len(ids)) - np.repeat(self.begins[:-1], lens)] = ids
        return out


def unpack(rows: list[dict], small: type, code: type) -> Members:
    cat = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    sizes = cat("sizes", small).astype(np.int64).reshape(-1, 2)
    rare_n, lens = cat("rare_n", small).astype(np.int64), sizes[:, 1]
    begins = np.concatenate([[0], np.cumsum(lens)])
    codes = np.empty(begins[-1], np.int64)
    rare = np.arange(len(codes)) - np.repeat(begins[:-1], lens) < np.repeat(rare_n, lens)
    codes[rare], codes[~rare] = cat("rare", np.int64), cat("common", code)
    return Members(cat("ids", np.int64), sizes[:, 0], cat("indexed", np.uint8).astype(bool), codes, begins)


def grouped(index: Members, size: int = GROUP_SIZE) -> np.ndarray:
    """An order of the sets in which each ``size`` next ones are a group: those of the same rarest words, which follow the cell's first, together."""
    lens = np.diff(index.begins)
    keys = [index.codes[np.minimum(index.begins[:-1] + k, index.begins[1:] - 1)] for k in (4, 3, 2, 1) if len(lens)]
    return np.lexsort((lens, *keys)) if len(lens) else np.zeros(0, np.int64)


def search(index: Members, queries: Members, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """``(query, member, overlap)`` of the pairs found, places in the two; and how many groups there are and were opened for all queries."""
    index = index.take(order := grouped(index))
    words, own = np.unique(index.codes, return_inverse=True)
    v, n = len(words), len(index.ids)
    groups = -(-n // GROUP_SIZE)
    member_words = index.matrix(own, v)
    of = np.arange(n) // GROUP_SIZE
    union = np.zeros((v + 1, -(-groups // 64) * 64), np.uint8)
    union[own, np.repeat(of, np.diff(index.begins))] = 1
    matrix = np.packbits(union, axis=1).view(np.uint64)
    cut_at = np.arange(0, n, GROUP_SIZE)
    least, most = np.minimum.reduceat(index.sizes, cut_at), np.maximum.reduceat(index.sizes, cut_at)

    by_size = np.argsort(queries.sizes, kind="stable")
    queries = queries.take(by_size)
    at = np.minimum(np.searchsorted(words, queries.codes), v - 1)
    query_words = queries.matrix(np.where(words[at] == queries.codes, at, v), v)
    long = np.diff(queries.begins)
    block = max(1, min(2048, (32 << 20) // max(v + 1, matrix.shape[1] * 64)))
    got: list[tuple] = []
    opened = 0
    for lo in range(0, len(queries.ids), block):
        q = query_words[lo : lo + block, : int(long[lo : lo + block].max())]
        sizes = queries.sizes[lo : lo + block]
        planes: list[np.ndarray] = []
        for j in range(q.shape[1]):
            carry = matrix[q[:, j]]
            for k in range(len(planes)):
                planes[k], carry = planes[k] ^ carry, planes[k] & carry
            if (j + 1).bit_length() > len(planes):
                planes.append(carry)
        bound = np.zeros((len(q), matrix.shape[1] * 64), np.uint8 if len(planes) < 8 else np.uint32)
        top = np.iinfo(bound.dtype).max  # more than any bound
        for k, plane in enumerate(planes):
            bits = np.unpackbits(plane.view(np.uint8), axis=1).astype(bound.dtype, copy=False)
            bound |= np.left_shift(bits, bound.dtype.type(k), out=bits)
        for a in np.unique(sizes).tolist():
            i, j = np.searchsorted(sizes, [a, a + 1])
            fits = (least <= a) & (most >= t * a - _EPS)
            hit = np.flatnonzero(bound[i:j, :groups] >= np.where(fits, need(a, np.maximum(least, ceil(t * a - _EPS)), t), top).astype(bound.dtype))
            if not len(hit):
                continue
            qi, gi = hit // groups, hit % groups
            opened += len(qi)
            m = (gi[:, None] * GROUP_SIZE + np.arange(GROUP_SIZE)[None, :]).reshape(-1)
            qs = np.repeat(qi + i, GROUP_SIZE)
            qs, m = qs[m < n], m[m < n]
            b = index.sizes[m]
            ok = (b >= t * a - _EPS) & ((b < a) | ((b == a) & (index.ids[m] < queries.ids[lo + qs])))
            qs, m = qs[ok], m[ok]
            if not len(qs):
                continue
            present = np.zeros((j - i, v + 1), np.uint8)
            present[np.arange(j - i)[:, None], q[i:j]] = 1
            present[:, v] = 0
            flat = present.reshape(-1)
            for s in range(0, len(qs), 1 << 16):
                qq, mm = qs[s : s + (1 << 16)], m[s : s + (1 << 16)]
                shared = flat[((qq - i) * (v + 1))[:, None] + member_words[mm]].sum(1, dtype=np.int64)
                ok = shared >= need(a, index.sizes[mm], t)
                got.append((qq[ok] + lo, mm[ok], shared[ok]))
    if not got:
        e = np.zeros(0, np.int64)
        return e, e, e, groups, opened
    qs, m, shared = (np.concatenate(x) for x in zip(*got))
    return by_size[qs], order[m], shared, groups, opened


def similar_texts(
    records: DataFrame, id_col: str, text: F.Column | str, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, cell: int = CELL
) -> DataFrame:
    """``(id_a, id_b, similarity)``, smaller id first: pairs of different texts.

    Rows with exactly the same text are one text, under their smallest id. Similarity is
    the Jaccard similarity of the distinct words. Null texts and texts of fewer than
    ``min_words`` distinct words (empty ones too) give no pair; an empty table gives none.
    Ids are whole numbers; a null id gives none.
    """
    col = F.col(text) if isinstance(text, str) else text
    src = records.select(F.col(id_col).cast("bigint").alias("id"), col.alias("text")).where("id is not null and text is not null")
    sets = sets_of(src.groupBy("text").agg(F.min("id").alias("id")), max(1, min_words))
    n, longest = sets.agg(F.count("*"), F.coalesce(F.max(F.size("hs")), F.lit(0))).first()
    order = global_order(sets, max(n, 1))
    small, code = _small(longest), _small(len(order.ranks))
    packed = packed_cells(sets, order, threshold, cell, longest)
    crowded = crowded_cells(sets, order, threshold, cell)
    many = crowded.count()
    if many:
        packed = packed.join(F.broadcast(crowded) if many <= MAX_BROADCAST else crowded, ["width", "key"], "left")
        packed = packed.withColumn("own", F.pmod(F.xxhash64("ids"), F.coalesce("blocks", F.lit(1))).cast("int"))
        packed = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        packed = packed.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")
    else:
        packed = packed.withColumns({c: F.lit(0) for c in ("own", "lo", "hi")})
    names = ["ids", "sizes", "rare_n", "indexed", "rare", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def tell() -> pa.RecordBatch:
            a, b, s = (np.concatenate(x) if x else np.zeros(0) for x in zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], names=["id_a", "id_b", "similarity"])

        def compare(index: Members, queries: Members) -> None:
            index = index.take(np.flatnonzero(index.indexed))
            if not len(index.ids) or not len(queries.ids):
                return
            q, m, shared, _, _ = search(index, queries, threshold)
            if len(q):
                found.append((queries.ids[q], index.ids[m], shared / (queries.sizes[q] + index.sizes[m] - shared)))

        def close(cell: tuple, rows: list[dict]) -> None:
            if cell[2] == cell[3]:
                if sum(len(r["ids"]) for r in rows) > 8:
                    both = unpack(rows, small, code)
                    compare(both, both)
                return
            lo, hi = (unpack([r for r in rows if r["own"] == k], small, code) for k in cell[2:])
            compare(lo, hi)
            compare(hi, lo)

        current, rows = None, []
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("width", "key", "lo", "hi", "own", *names)}
            for k, cell in enumerate(zip(cols["width"], cols["key"], cols["lo"], cols["hi"])):
                if cell != current:
                    if rows:
                        close(current, rows)
                    current, rows = cell, []
                    if len(found) > 1000:
                        yield tell()
                rows.append({c: cols[c][k] for c in ("own", *names)})
        if rows:
            close(current, rows)
        if found:
            yield tell()

    met = packed.repartition("width", "key", "lo", "hi").sortWithinPartitions("width", "key", "lo", "hi")
    return met.mapInArrow(run, "id_a bigint, id_b bigint, similarity double").groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))
