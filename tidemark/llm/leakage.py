"""Evaluation passages in training text, by suffix arrays over shards of the training text.

Every shard of documents is laid end to end as one byte stream of its letters and digits,
and all its suffixes are sorted by their leading bytes. Every suffix of a test item that
starts at a word and spans at least ``min_words`` words is then binary-searched; runs that
share the leading bytes are narrowed by the next ones until the whole passage is compared.
Matches that continue one another at the same place are joined to the longest passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import spread

MIN_WORDS = 12
#: Bytes of test texts searched in one pass over the corpus, and thus sent to the workers; more mean more passes.
BYTES_PER_PASS = 16 << 20
SHARD_BYTES = 1 << 20
_NOISE = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_LEAD = 8  # bytes in a sort key


def _unify(text: str) -> str:
    """Compatibility forms unified, invisible and combining characters away, lower case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Cf", "Mn", "Mc", "Me", "Cc"))


def stream_of(text: str | None) -> bytes:
    """The letters and digits of a text, as compared; words joined without space."""
    if not text:
        return b""
    # Invisible and combining characters go with the rest that is neither letter nor digit.
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _NOISE.sub("", plain.lower()).encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in _WORD.findall(_unify(text))] if text else []


class Passages:
    """Test suffixes cut to their first ``min_words`` words, ready for binary search.

    The items' compared bytes lie end to end once; a passage is an offset and a length in them, so that
    neither a long word nor a long item makes the others larger.
    """

    def __init__(self, items: list[tuple[object, str | None]], min_words: int) -> None:
        self.item_ids = [i for i, _ in items]
        streams, item, word, at, length, total = [], [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            ends = np.cumsum([0] + [len(w) for w in words])
            n = len(words) - min_words + 1
            if n > 0:
                item.append(np.full(n, k, np.int64))
                word.append(np.arange(n))
                at.append(total + ends[:n])
                length.append(ends[min_words:] - ends[:n])
                streams += words
                total += int(ends[-1])
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.item, self.word, self.at, self.length = map(cat, (item, word, at, length))
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.item)) + 1]) if len(self.item) else np.zeros(0, np.int64)
        begins = np.zeros(len(items), np.int64)
        begins[self.item[first]] = self.at[first]
        self.offset = self.at - begins[self.item]  # of the passage within its item's bytes
        self.heads = _heads(b"".join(streams))

    def __len__(self) -> int:
        return len(self.at)

    def _part(self, which: np.ndarray | slice, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``d``-th eight bytes of the passages, and the mask of those within their length."""
        at = np.minimum(self.at[which] + _LEAD * d, len(self.heads) - 1)
        used = np.clip(self.length[which] - _LEAD * d, 0, _LEAD).astype(np.uint64)
        mask = np.where(used == 0, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (np.uint64(8) - np.maximum(used, np.uint64(1)))))
        return self.heads[at] & mask, mask

    def search(self, stream: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the stream and the passages that stand there."""
        none = np.zeros(0, np.int64)
        n = len(stream)
        if not n or not len(self):
            return none, none
        heads = _heads(stream)
        order = np.argsort(heads[:n], kind="stable")
        ranked = heads[:n][order]
        first, mask = self._part(slice(None), 0)
        lo = np.searchsorted(ranked, first, "left")
        hi = np.searchsorted(ranked, first | ~mask, "right")
        size = hi - lo
        which = np.repeat(np.arange(len(self)), size)
        within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        at = order[np.repeat(lo, size) + within]
        d = 1
        while len(which):
            open_ = self.length[which] > _LEAD * d
            if not open_.any():
                break
            part, mask = self._part(which[open_], d)
            ok = ~open_
            ok[open_] = (heads[np.minimum(at[open_] + _LEAD * d, n)] & mask) == part
            at, which = at[ok], which[ok]
            d += 1
        return at, which


def _heads(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end; one position more than bytes."""
    raw = np.frombuffer(data + b"\0" * _LEAD, np.uint8)
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(_LEAD):
        out = (out << np.uint64(8)) | raw[k : k + len(out)]
    return out


def _search_docs(ids: list, streams: list[bytes], passages: Passages, min_words: int) -> Iterator[tuple]:
    """``(id, item, first word, words, place)`` of the longest passage of each item in each text.

    Passages belong together where each next one starts a word later in the item and just that word's
    bytes later in the text; the first of the longest runs is told.
    """
    begins = np.cumsum([0] + [len(s) + 1 for s in streams])
    at, which = passages.search(b"\n".join(streams))
    if not len(at):
        return
    doc = np.searchsorted(begins, at, "right") - 1
    item, word = passages.item[which], passages.word[which]
    line = at - passages.offset[which]  # where the item would begin
    order = np.lexsort((word, line, item, doc))
    doc, item, word, line, at = doc[order], item[order], word[order], line[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(line) != 0) | (np.diff(word) != 1)
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(doc)))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for k, n in zip(starts.tolist(), size.tolist()):
        pair = int(doc[k]), int(item[k])
        if pair not in best or n > best[pair][0]:
            best[pair] = n, k
    for (d, i), (n, k) in best.items():
        place = len(streams[d][: int(at[k] - begins[d])].decode("utf-8", "replace"))
        yield ids[d], passages.item_ids[i], int(word[k]), n + min_words - 1, place


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, item_word, n_words, doc_at)``: the longest passage of the item in the document.

    The passage starts at word ``item_word`` of the item, after ``doc_at`` letters and digits of the
    document. Test texts are read in passes of about ``BYTES_PER_PASS``, which bounds what is sent to the
    workers; every pass searches all documents whole, and an item is never parted. Null and empty
    texts and items of fewer than ``min_words`` words give no row. A repeated document row gives its rows
    once. An item's id must be unique. Nothing but the result's rows is shuffled.
    """
    test = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    src = spread(docs.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t")).where("d is not null and t is not null"))
    kinds = src.schema["d"].dataType.simpleString(), test.schema["i"].dataType.simpleString()
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, item_word int, n_words int, doc_at bigint"
    held = test.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-held // BYTES_PER_PASS))
    sc = src.sparkSession.sparkContext
    out = None
    for k in range(passes):
        part = test.where(F.pmod(F.hash("i"), F.lit(passes)) == k) if passes > 1 else test
        sent = sc.broadcast(Passages([(r.i, r.t) for r in part.collect()], min_words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            passages, types = sent.value, None

            def emit(ids: list, streams: list[bytes]) -> pa.RecordBatch | None:
                rows = list(_search_docs(ids, streams, passages, min_words))
                if not rows:
                    return None
                cols = list(zip(*rows))
                return pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], types), pa.array(cols[1]), *(pa.array(cols[k], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.int64())))],
                    names=[doc_id, item_id, "item_word", "n_words", "doc_at"],
                )

            ids, streams, size = [], [], 0
            for b in batches:
                types = b.schema.field("d").type
                for i, t in zip(b.column("d").to_pylist(), b.column("t").to_pylist()):
                    s = stream_of(t)
                    ids.append(i)
                    streams.append(s)
                    size += len(s) + 1
                    if size >= SHARD_BYTES:
                        if (r := emit(ids, streams)) is not None:
                            yield r
                        ids, streams, size = [], [], 0
            if ids and (r := emit(ids, streams)) is not None:
                yield r

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    first = F.max_by(F.struct("item_word", "n_words", "doc_at"), F.struct("n_words", -F.col("item_word"), -F.col("doc_at")))
    return out.groupBy(doc_id, item_id).agg(first.alias("r")).select(doc_id, item_id, "r.*")


def drop_leaking(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that leak; rows with a null id stay."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
