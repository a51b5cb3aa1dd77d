"""Reading level by regularised ordinal regression.

English texts are told by their own words, whatever their language column says. Each gets
features of wording (length and rarity of words, diversity) and of sentence build (length,
connectives, a proxy of clause depth). Most are taken sentence by sentence and summed up by
medians, so that a passage of another kind in a text hardly moves them. A proportional-odds
model with a ridge penalty, fitted to the rated texts, gives each text its band.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import cut, spread

MIN_WORDS = 50
BANDS = 4
#: Ratings the model is fitted to at most: the first of a fixed order by hash, whatever the table's size.
MAX_RATINGS = 20_000
#: Words in this share of the English texts or more are sent to the workers with their frequency;
#: there are at most (words a text) / COMMON of them. Any other word counts as rare.
COMMON = 0.001
RIDGE = 0.003
FOREIGN = 0.12
#: Share of English function words among all words that English prose never falls short of; a language
#: in Latin script that is not listed below shares a few such words by chance.
ENGLISH = 0.15
#: The like for scripts without spaces, where a character or two are a word.
UNSPACED = 0.03

#: Frequent words of languages written in Latin script, each of one language only.
FUNCTION_WORDS = {
    "en": "the of and to is that for with each every our one this it from by which but not we their these if when while so between through under near was were are be has have as at or its than then there they you he she his her over behind".split(),
    "de": "der die das und ist von mit im den des ein eine einen dem zu auf für bei nicht sich auch als wird sind zum zur nach am aus jede einer wie oder nur noch".split(),
    "fr": "le les des du une et dans est que pour par sur avec sans selon vers près qui ne pas ce cette aux au plus sont notre chaque leur mais ou où".split(),
    "es": "el los las del una y en que con por sin para según se su al como más este esta sobre todo cada nuestro lo pero es son".split(),
    "it": "il lo gli della di che per con una è sono nel dei delle alla come più questo questa anche".split(),
    "pt": "o os uma em que com por para não do da dos das ao mais como este esta são cada nosso".split(),
    "nl": "de het een van en is dat met voor op zijn niet aan er ook als bij door naar uit".split(),
}
CONNECTIVES = frozenset(
    "because although though whereas while however therefore if when unless since hence thus moreover whether which whose that so but until before after despite nevertheless consequently furthermore".split()
)
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\[(?:EQUATION|MATH|CITATION|REF)\]|https?://\S+|<[^<>]{1,60}>|&#?\w{1,8};")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)\]]*\s+|\n\s*\n|\n#+ [^\n]*\n")
_INVISIBLE = re.compile("[\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_DIGIT = re.compile(r"\d")
_NOT_LATIN = re.compile(r"[^\W\d_A-Za-z\u00c0-\u024f]")
_OWNERS: dict[str, list[str]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        _OWNERS.setdefault(_w, []).append(_lang)


def _plain(text: str) -> str:
    """Compatibility forms unified, invisible characters away."""
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def _in_english(counts: Counter, plain: str) -> bool:
    if not plain.isascii() and (len(_NOT_LATIN.findall(plain)) > FOREIGN * len(plain) or len(_UNSPACED.findall(plain)) > UNSPACED * len(plain)):
        return False
    own, other = 0, dict.fromkeys(FUNCTION_WORDS, 0)
    for w in counts.keys() & _OWNERS.keys():
        langs = _OWNERS[w]
        if langs[0] == "en":
            own += counts[w]
        else:
            for x in langs:
                other[x] += counts[w]
    foreign = max(other.values())
    return own > ENGLISH * counts.total() and foreign <= FOREIGN * (own + foreign)


def is_english(text: str) -> bool:
    """Whether the text is written in English; an English passage in another language does not make it so."""
    plain = _MARK.sub(" ", _plain(text)).lower()
    return _in_english(Counter(_WORD.findall(plain)), plain)


FEATURES = (
    "sentence_words", "sentence_words_log", "word_letters", "long_share", "very_long_share", "connectives", "connective_share",
    "clause_depth", "marks", "diversity", "top_length", "rare_share", "rarity",
)


def text_features(text: str) -> tuple[list[float], list[str]] | None:
    """Features but the last two, and the distinct words; None for a text that gets no band."""
    plain = _MARK.sub(" ", _plain(text)).lower()
    sentences = [(x, _WORD.findall(x)) for x in _SENTENCE.split(plain)]
    counts: Counter = Counter()
    for _, ws in sentences:
        counts.update(ws)
    # Marks and unusual characters change the count of words a little: near the bound it is taken from the text as it stands.
    if (counts.total() < 2 * MIN_WORDS and len(_WORD.findall(text)) < MIN_WORDS) or not _in_english(counts, plain):
        return None
    rows, types = [], set()
    for s, ws in sentences:
        if _DIGIT.search(s):
            ws = [w for w in ws if not w.isdigit()]
        n = len(ws)
        if n < 3 or s.lstrip().startswith("#"):
            continue
        own = set(ws)
        types |= own
        links = own & CONNECTIVES
        joined = sum(map(ws.count, links)) if links else 0
        lengths = sorted(map(len, ws))
        commas = s.count(",")
        rows.append(
            (n, math.log(n), sum(lengths) / n, (n - bisect_left(lengths, 7)) / n, (n - bisect_left(lengths, 11)) / n, joined,
             joined > 0, joined + commas + 2 * s.count(";") + ws.count("and"), commas, len(own) / n, lengths[-1])
        )
    if not rows:
        ws = list(counts.elements())
        return [len(ws), math.log(len(ws)), 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0], sorted(set(ws))
    a = np.array(rows, np.float64)
    f = np.median(a, axis=0)
    f[6] = a[:, 6].mean()
    return f.tolist(), sorted(types)


def rarity(words: list[str], known: dict[str, float], floor: float) -> tuple[float, float]:
    """Share of words not known as common, and the mean log document frequency."""
    if not words:
        return 0.0, 0.0
    got = [known.get(w, floor) for w in words]
    return sum(w not in known for w in words) / len(words), sum(got) / len(got)


_WORDING, _BUILD = [2, 3, 4, 10], [0, 1, 5, 6]


def with_products(x: np.ndarray) -> np.ndarray:
    """Features, squares of the strongest, and products of wording with build, which count jointly."""
    products = (x[:, _WORDING, None] * x[:, None, _BUILD]).reshape(len(x), -1)
    return np.hstack([x, x[:, [0, 1, *_WORDING]] ** 2, products])


class OrdinalModel:
    """Proportional odds: P(band <= k) = sigmoid(cut_k - w.x), standardised x, ridge on w."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 1500) -> None:
        x = with_products(x)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = (x - self.mean) / self.scale
        w = np.zeros(z.shape[1])
        share = np.clip([(y <= k).mean() for k in range(1, BANDS)], 0.01, 0.99)
        cuts = np.log(share / (1 - share))
        theta = np.concatenate([w, cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            g = self._gradient(theta, z, y, ridge)
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            theta = theta - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        self.w, self.cuts = theta[: z.shape[1]], self._cuts(theta[z.shape[1] :])

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    def _gradient(self, theta: np.ndarray, z: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        d = z.shape[1]
        w, raw = theta[:d], theta[d:]
        edges = np.concatenate([[-np.inf], self._cuts(raw), [np.inf]])
        at = z @ w
        hi, lo = edges[y] - at, edges[y - 1] - at
        s_hi, s_lo = 1 / (1 + np.exp(-np.clip(hi, -40, 40))), 1 / (1 + np.exp(-np.clip(lo, -40, 40)))
        s_hi, s_lo = np.where(np.isposinf(hi), 1.0, s_hi), np.where(np.isneginf(lo), 0.0, s_lo)
        p = np.maximum(s_hi - s_lo, 1e-12)
        d_hi, d_lo = s_hi * (1 - s_hi) / p, s_lo * (1 - s_lo) / p
        n = len(y)
        g_w = z.T @ (d_hi - d_lo) / n + ridge * w
        g_c = np.array([(-(d_hi * (y == k)) + d_lo * (y == k + 1)).sum() / n for k in range(1, BANDS)])
        step = np.exp(raw[1:])
        g_raw = np.concatenate([[g_c.sum()], [g_c[k:].sum() * step[k - 1] for k in range(1, BANDS - 1)]])
        return np.concatenate([g_w, g_raw])

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((with_products(x) - self.mean) / self.scale) @ self.w

    def band(self, x: np.ndarray) -> np.ndarray:
        return 1 + (self.score(x)[:, None] > self.cuts[None, :]).sum(1)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, f array<double>, words array<string>)`` of the English texts long enough for a band."""
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, fs, words = [], [], []
            for k, text in enumerate(b.column("t").to_pylist()):
                if (got := text_features(text)) is not None:
                    rows.append(k)
                    fs.append(got[0])
                    words.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(fs, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string()))],
                names=["id", "f", "words"],
            )

    return src.mapInArrow(run, f"id {kind}, f array<double>, words array<string>")


def reading_bands(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", band_col: str = "band") -> DataFrame:
    """``(id, band int, level double)`` of each English text of at least ``MIN_WORDS`` words.

    Ratings with a null id or band and bands outside 1 to ``BANDS`` are passed over; of the others the first
    ``MAX_RATINGS`` in order of a hash are kept, and those of them that rate other texts are passed over
    too; raters that disagree count each. With ratings of fewer than two bands there is no scale and
    no row comes out. Null and empty texts get no band; repeated rows get it each.
    """
    measured = cut(measure(docs, id_col, text_col))
    n = measured.count()
    freq = measured.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= max(2.0, n * COMMON))
    known = {r.w: math.log(r["count"] / max(n, 1)) for r in freq.collect()}
    floor = math.log(min(COMMON, 1.0))
    usable = ratings.select(F.col(id_col).alias("id"), F.col(band_col).cast("int").alias("band")).where(f"id is not null and band between 1 and {BANDS}")
    usable = cut(usable.orderBy(F.xxhash64("id"), "id", "band").limit(MAX_RATINGS))
    # The rated texts are told by their ids, at most MAX_RATINGS, before anything else of the texts is moved.
    texts = measured.join(F.broadcast(usable.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"])
    rated = texts.join(F.broadcast(usable), "id").orderBy(F.xxhash64("id"), "id", "band").toPandas()
    kind = measured.schema["id"].dataType.simpleString()
    if rated["band"].nunique() < 2:
        return measured.where("false").select(F.col("id").alias(id_col), F.lit(0).alias("band"), F.lit(0.0).alias("level"))
    x = np.array([list(f) + list(rarity(list(w), known, floor)) for f, w in zip(rated["f"], rated["words"])])
    model = OrdinalModel(x, rated["band"].to_numpy(np.int64))
    sent = measured.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, common = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            at = np.array([f + list(rarity(w, common, floor)) for f, w in zip(b.column("f").to_pylist(), b.column("words").to_pylist())])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m.band(at), pa.int32()), pa.array(m.score(at))], names=[id_col, "band", "level"])

    return measured.mapInArrow(run, f"`{id_col}` {kind}, band int, level double")
