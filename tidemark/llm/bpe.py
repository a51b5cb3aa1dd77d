"""Exact byte-pair encoding by a tokenization automaton.

The vocabulary's ranks are compiled once per Python worker. Merges are added one after
another as gadgets: the gadget of merge ``(l, r) -> t`` makes the arc pair ``l, r`` illegal
from rank ``t`` on and adds the arc ``t``. What is left is deterministic: a state is the
last token emitted, and from a state a token may follow only if merging could not have
joined or split the two differently. A word is encoded in one pass from left to right,
keeping for each byte position the only legal last token. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import spread

#: Fixed value: the public pre-tokenization pattern of this byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_WORDS = 200_000


def default_vocabulary() -> str:
    """Path of the vocabulary that the public_tokenizers package installs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenAutomaton:
    """Encoder and decoder over ranks (``base64 rank`` per line), given as a file's path or as its bytes."""

    def __init__(self, ranks: str | bytes) -> None:
        labels: dict[int, bytes] = {}
        if isinstance(ranks, str):
            with open(ranks, "rb") as f:
                ranks = f.read()
        for line in ranks.splitlines():
            if line.strip():
                b, rank = line.split()
                labels[int(rank)] = base64.b64decode(b)
        self.labels = labels
        self.ids = {b: i for i, b in labels.items()}
        self.tails = {b[k:] for b in self.ids for k in range(len(b))}  # arcs into a position, read backwards
        self.joins: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._legal: dict[tuple[int, int], bool] = {}
        for t in sorted(labels):
            b = labels[t]
            if len(b) > 1:
                self._add_gadget(t, b)
        self._legal.clear()
        self._memo: dict[str, list[int]] = {}
        self._split = regex.compile(SPLIT)

    def _add_gadget(self, t: int, b: bytes) -> None:
        """Find the two arcs that merge into ``t`` and bind them."""
        options = []
        for k in range(1, len(b)):
            left, right = self.ids.get(b[:k]), self.ids.get(b[k:])
            if left is not None and right is not None and left < t and right < t:
                options.append((left, right))
        if len(options) > 1:
            options = [p for p in options if self._may_follow(*p)] or options
        if options:
            self.parts[t] = options[0]
            self.joins.setdefault(options[0], t)

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` keeps exactly these two tokens.

        Undo the younger merge of the two on the inner edge, again and again. If the edge
        pieces have a merge older than what was undone, that merge would have come first.
        """
        joins, parts = self.joins, self.parts
        ceiling = 1 << 60
        while True:
            t = joins.get((a, b))
            if t is not None and t < ceiling:
                return False
            pa_, pb_ = parts.get(a), parts.get(b)
            if pa_ is None and pb_ is None:
                return True
            # Of equally placed merges the leftmost goes first: the right piece is undone on a tie.
            if pb_ is None or (pa_ is not None and a > b):
                ceiling, a = a, pa_[1]
            else:
                ceiling, b = b + 1, pb_[0]

    def may_follow(self, a: int, b: int) -> bool:
        got = self._legal.get((a, b))
        if got is None:
            if len(self._legal) > 4 * MEMO_WORDS:
                self._legal.clear()
            got = self._legal[(a, b)] = self._may_follow(a, b)
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        ids, tails, n = self.ids, self.tails, len(word)
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        state = [-1] * (n + 1)  # the last token of the only legal path that ends here
        for end in range(1, n + 1):
            arcs = []
            for start in range(end - 1, -1, -1):
                tail = word[start:end]
                if tail not in tails:
                    break
                if tail in ids:
                    arcs.append(start)
            for start in reversed(arcs):
                t = ids[word[start:end]]
                if start == 0 or (state[start] >= 0 and self.may_follow(state[start], t)):
                    state[end] = t
                    break
        out: list[int] = []
        at = n
        while at:
            out.append(state[at])
            at -= len(self.labels[state[at]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a null or empty one."""
        out: list[int] = []
        if not text:
            return out
        memo = self._memo
        for w in self._split.findall(text):
            ids = memo.get(w)
            if ids is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) < 64:
                    memo[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(ranks: str | bytes) -> TokenAutomaton:
    return TokenAutomaton(ranks)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, ids array<int>)``, one row per input row, without special tokens.

    Null and empty texts give an empty list. Repeated rows stay repeated. Texts of any
    length are encoded whole; a map-only step, so nothing is shuffled or collected. The
    vocabulary is read where the query is planned and its bytes are sent: workers need no such file.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = src.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(sent.value)
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for text in b.column("text").to_pylist():
                flat.extend(auto.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=[id_col, "ids"])

    return src.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids array<int>")
