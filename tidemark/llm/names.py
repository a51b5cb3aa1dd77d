"""Variant spellings of names typed by people, by a pigeonhole segment join.

Each distinct spelling is parsed into given name, initials, particle and surname, whatever their
order, and folded (case, accents, nicknames, titles). Typing errors are then found between the
folded names: each is cut into four segments; one slip spoils at most two neighbouring ones, so
two must stand unharmed, shifted by a place at most. Pairs of segments are looked up in an
inverted index and verified by a banded edit distance. Rarer forms go to the most frequent
one; missing middle initials and particles, and initials for given names, are resolved where just
one person fits.

What decides between two forms is always a ratio of their uses; the few fixed counts beside the ratios say from
how many observations on a ratio is trusted. They hold per name or person, whose rows do not
multiply when the collection grows by other persons.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.runtime import cut

SEGMENTS = 4
#: A pair of segments in more names than this is looked up together with the rest less one letter.
HOT_KEY = 64
#: Common short forms of given names: the default of the parameter ``nicknames``.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "andy": "andrew", "ben": "benjamin", "benny": "benjamin", "bill": "william",
    "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "charlie": "charles",
    "chuck": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "dima": "dmitri",
    "mitya": "dmitri", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward", "beth": "elizabeth",
    "liz": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "fred": "frederick", "freddy": "frederick",
    "gianni": "giovanni", "greg": "gregory", "jim": "james", "jimmy": "james", "jack": "john", "joe": "joseph",
    "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "ken": "kenneth",
    "len": "leonard", "leo": "leonard", "lenny": "leonard", "liv": "olivia", "maggie": "margaret", "meg": "margaret",
    "peggy": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "mina": "wilhelmina", "minna": "wilhelmina",
    "nacho": "ignacio", "nick": "nicholas", "nico": "nicholas", "pat": "patricia", "trish": "patricia", "tricia": "patricia",
    "pete": "peter", "dick": "richard", "rick": "richard", "rich": "richard", "sam": "samuel", "sammy": "samuel",
    "steve": "steven", "sue": "susan", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "uschi": "ursula",
    "vicky": "victoria", "tori": "victoria", "vince": "vincent", "vinny": "vincent", "vin": "vincent", "hanna": "hannah",
    "izzy": "isabella", "bella": "isabella", "gus": "august", "hank": "henry", "harry": "henry", "larry": "lawrence",
    "oli": "olivia", "ollie": "olivia", "quin": "quentin", "fran": "francois", "tess": "therese",
}
PARTICLES = frozenset("van von der den de del della di da dos du la le el al bin ibn ter ten zu zur y".split())
_SUFFIX = re.compile(r"(?:\s*\((?:deceased|late|retired)\)|,?\s+(?:jr|sr|ii|iii|iv|ph\.?\s?d|m\.?d|esq)\.?)\s*$", re.I)
_TITLE = re.compile(r"^(?:dr|prof|professor|mr|mrs|ms|sir)\.?\s+", re.I)
_ORG = re.compile(r"\b(?:coll?abb?oration|coll?ab|coll|consortium|team|group|project|experiment)\b\.?", re.I)
_ORG_NOISE = re.compile(r"\b(?:for|on|behalf|of|and|the|in|by)\b")
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‐": "-", "–": "-"})


def fold(s: str) -> str:
    """Lower case without accents and with single spaces."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).lower().translate(_LETTERS))
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[-'][^\W_]+)*\.?(?:-[^\W_]\.)*", s)


def split_name(first: str | None, last: str | None, swapped: bool = False) -> tuple[str, str, str]:
    """Folded ``(given, particle, surname)``, whatever the parts' order."""
    given, family = fold(first or ""), fold(last or "")
    if swapped:
        given, family = family, given
    for _ in range(2):
        family, given = _SUFFIX.sub("", family), _TITLE.sub("", _SUFFIX.sub("", given))
    if "," in family:
        a, b = (x.strip() for x in family.split(",", 1))
        if given or (b and all(w in PARTICLES for w in b.split())):
            family = f"{b} {a}"
        else:
            family, given = a, b
    elif not given:
        words = family.split()
        k = len(words) - 1
        while k > 0 and words[k - 1] in PARTICLES:
            k -= 1
        given, family = " ".join(words[:k]), " ".join(words[k:])
    words = family.split()
    k = 0
    while k < len(words) - 1 and words[k] in PARTICLES:
        k += 1
    return given, " ".join(words[:k]), " ".join(words[k:])


def org_key(first: str | None, last: str | None) -> str | None:
    """The bare name of a collaboration; None for a person."""
    s = fold(f"{first or ''} {last or ''}").replace("-", " ")
    if not _ORG.search(s):
        return None
    return " ".join(re.findall(r"\w+", _ORG_NOISE.sub(" ", _ORG.sub(" ", s)))) or None


def parse(first: str | None, last: str | None, swapped: bool = False, nicknames: dict[str, str] = NICKNAMES) -> dict:
    """One spelling's folded parts: kind ('org', 'full', 'initial' or 'none') and the rest."""
    out = {"kind": "none", "particle": "", "surname": "", "first": "", "parts": "", "mid": ""}
    if (org := org_key(first, last)) is not None:
        return out | {"kind": "org", "surname": org}
    given, particle, surname = split_name(first, last, swapped)
    words = [w for w in re.split(r"[\s.]+(?!-)|\.(?=-)", given) if w]
    if not surname or not words:
        return out | {"surname": surname, "particle": particle}
    merged: list[str] = []
    for w in words:  # "j", "-p" is one compound initial
        if w.startswith("-") and merged:
            merged[-1] += w
        else:
            merged.append(w.lstrip("-"))
    lead = merged[0].split("-")
    out |= {"particle": particle, "surname": surname}
    if all(len(x) == 1 for x in lead if x):
        return out | {"kind": "initial", "parts": "".join(lead), "mid": "".join(w[0] for w in merged[1:] if w)}
    k = 1
    while k < len(merged) and len(merged[k].replace("-", "")) > 1:
        lead += merged[k].split("-")
        k += 1
    name = "".join(lead)
    return out | {"kind": "full", "first": nicknames.get(name, name), "parts": "".join(x[0] for x in lead if x), "mid": "".join(w[0] for w in merged[k:] if w)}


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours parts the two.

    The band of an edit distance of one is one diagonal to either side: what precedes the
    first difference and what follows it are compared as they stand.
    """
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _cuts(n: int) -> list[tuple[int, int]]:
    at = [round(n * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return list(zip(at, at[1:]))


def index_keys(s: str) -> list[str]:
    """Keys under which a name is stored: its length and two of its segments."""
    cuts = _cuts(len(s))
    return [f"{len(s)}:{i}{j}:{s[slice(*cuts[i])]}\t{s[slice(*cuts[j])]}" for i, j in combinations(range(SEGMENTS), 2)]


def probe_keys(s: str) -> list[str]:
    """Keys that a name looks up: names as long as itself, or shorter by one letter."""
    keys = set(index_keys(s))
    n = len(s) - 1
    if n >= SEGMENTS:
        cuts = _cuts(n)
        for i, j in combinations(range(SEGMENTS), 2):
            for di, dj in ((0, 0), (0, 1), (1, 1)):
                (a, b), (c, d) = cuts[i], cuts[j]
                keys.add(f"{n}:{i}{j}:{s[a + di : b + di]}\t{s[c + dj : d + dj]}")
    return sorted(keys)


def shortened(s: str) -> list[str]:
    """The name and all it becomes by leaving out one letter: names one slip apart share one."""
    return sorted({s} | {s[:k] + s[k + 1 :] for k in range(len(s))})


def _strings(f):
    return F.pandas_udf(lambda col: col.map(f), T.ArrayType(T.StringType()))


def segment_join(names: DataFrame) -> DataFrame:
    """``(a, b)``, each pair of distinct names ``k`` one slip apart, once.

    Where many names share a key, as under one very frequent surname, key and a shortened
    form are looked up together, which only names at most two slips apart share.
    """
    names = names.select("k").where(F.length("k") >= SEGMENTS)
    index = names.select("k", F.explode(_strings(index_keys)("k")).alias("key"))
    probe = names.select("k", F.explode(_strings(probe_keys)("k")).alias("key"))
    hot = index.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.lit(True).alias("hot"))
    short = _strings(shortened)

    def refine(df: DataFrame) -> DataFrame:
        seen = df.join(hot, "key", "left")
        cold = seen.where("hot is null").select("k", "key", F.lit("").alias("rest"))
        return cold.unionByName(seen.where("hot").select("k", "key", F.explode(short("k")).alias("rest")))

    pairs = (
        refine(probe).withColumnRenamed("k", "b").join(refine(index).withColumnRenamed("k", "a"), ["key", "rest"])
        .where((F.col("a") != F.col("b")) & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))))
        .select("a", "b").distinct()
    )
    check = F.pandas_udf(lambda a, b: pd.Series([one_slip(x, y) for x, y in zip(a, b)], dtype=bool), T.BooleanType())
    return pairs.where(check("a", "b"))


_PARSED = "first_name string, last_name string, n bigint, kind string, particle string, surname string, first string, parts string, mid string"


def parse_spellings(spelled: DataFrame, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """Spellings ``(first_name, last_name, n)`` with their folded parts.

    A row with given name and surname exchanged is told by the collection: its last name
    is a frequent given name there, its first name is not.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n = b.column("first_name").to_pylist(), b.column("last_name").to_pylist()
            firsts, lasts = [_words(fold(x or "")) for x in f], [_words(fold(x or "")) for x in n]
            both = [bool(x) and bool(y) and "," not in (z or "") for x, y, z in zip(firsts, lasts, n)]
            cols = [
                pa.array([x[0] if ok else None for x, ok in zip(firsts, both)], pa.string()),
                pa.array([x[-1] if ok else None for x, ok in zip(firsts, both)], pa.string()),
                pa.array([x[0] if ok else None for x, ok in zip(lasts, both)], pa.string()),
                pa.array([x[-1] if ok else None for x, ok in zip(lasts, both)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("first_name"), b.column("last_name"), b.column("n"), *cols],
                names=["first_name", "last_name", "n", "lead_first", "tail_first", "lead_last", "tail_last"],
            )

    led = cut(spelled.mapInArrow(lead, "first_name string, last_name string, n bigint, lead_first string, tail_first string, lead_last string, tail_last string"))
    uses = led.select(F.col("lead_first").alias("w"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("s")).unionByName(
        led.select(F.col("tail_last").alias("w"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("s"))
    )
    given = (
        uses.where((F.length("w") > 2) & ~F.col("w").isin(sorted(PARTICLES))).groupBy("w").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
        .where((F.col("g") >= 3) & (F.col("g") > 4 * F.col("s"))).select("w")
    )
    # Rows without two readable parts have no word to look up: they get keys of their own, many, that match nothing.
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64("first_name", "last_name"), F.lit(1024)).cast("string"))
    marked = led
    for c in ("lead_last", "lead_first", "tail_first"):
        marked = marked.withColumn("w", F.coalesce(c, none)).join(given.select("w", F.lit(True).alias(f"{c}_given")), "w", "left").drop("w")
    is_given = {c: F.coalesce(f"{c}_given", F.lit(False)) for c in ("lead_last", "lead_first", "tail_first")}
    swapped = is_given["lead_last"] & ~is_given["lead_first"] & ~is_given["tail_first"] & (F.length("tail_first") > 2) & ~F.col("tail_first").contains(".")
    marked = marked.select("first_name", "last_name", "n", F.coalesce(swapped, F.lit(False)).alias("swapped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(f, n, w, nicknames) for f, n, w in zip(*(b.column(c).to_pylist() for c in ("first_name", "last_name", "swapped")))]
            names = ["kind", "particle", "surname", "first", "parts", "mid"]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("first_name", "last_name", "n")] + [pa.array([g[c] for g in got], pa.string()) for c in names],
                names=["first_name", "last_name", "n", *names],
            )

    return cut(marked.mapInArrow(run, _PARSED))


def _only(col: str) -> F.Column:
    """The one non-empty value of a group, or null where there are none or several."""
    v = F.when(F.col(col) != "", F.col(col))
    return F.when(F.min(v) == F.max(v), F.min(v))


def _canonical(full: DataFrame) -> DataFrame:
    """``(first, surname, c_first, c_surname)``: each folded name and the form it goes to."""
    key = F.concat_ws("|", "first", "surname")
    names = cut(full.groupBy("first", "surname").agg(F.sum("n").alias("n")).withColumn("k", key))
    firsts = names.groupBy("first").agg(F.sum("n").alias("uses"), F.count("*").alias("spread"))
    known = firsts.where("uses >= 8 and spread >= 4").select("first", "uses")
    slips = cut(segment_join(names))
    both = slips.unionByName(slips.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda p: names.select(F.col("k").alias(p), F.col("first").alias(f"first_{p}"), F.col("n").alias(f"n_{p}"), F.col("score").alias(f"score_{p}"))
    # How often a form is written, and how many forms are a slip away: a name stands amid its slips.
    degree = both.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("degree"))
    names = cut(names.join(degree, "k", "left").withColumn("score", 2 * F.col("n") + F.coalesce("degree", F.lit(0))))
    both = both.join(side("a"), "a").join(side("b"), "b")
    for p in "ab":
        both = both.join(known.select(F.col("first").alias(f"first_{p}"), F.col("uses").alias(f"uses_{p}"), F.lit(True).alias(f"known_{p}")), f"first_{p}", "left")
    # Two given names of their own, not one and a slip that a large collection has seen often.
    level = 10 * F.least("uses_a", "uses_b") >= F.greatest("uses_a", "uses_b")
    two_names = F.col("known_a") & F.col("known_b") & (F.col("first_a") != F.col("first_b")) & level
    stands = lambda p: F.struct(F.col(f"score_{p}"), F.coalesce(f"known_{p}", F.lit(False)), F.col(p))
    frequent = stands("b") > stands("a")
    few = (F.col("n_a") <= 2) | (3 * F.col("n_a") <= F.col("n_b"))
    to = both.where(~F.coalesce(two_names, F.lit(False)) & frequent & few).groupBy("a").agg(
        F.max_by("b", F.struct(F.col("score_b"), F.col("b"))).alias("to")
    )
    goes = _settled(names.select("k").join(to.withColumnRenamed("a", "k"), "k", "left").select("k", F.coalesce("to", "k").alias("to"))).withColumnRenamed("to", "c")
    ends = names.select(F.col("k").alias("c"), F.col("first").alias("c_first"), F.col("surname").alias("c_surname"))
    return names.select("k", "first", "surname").join(goes, "k").join(ends, "c").select("first", "surname", "c_first", "c_surname")


def _settled(step: DataFrame) -> DataFrame:
    """``(k, to)`` with each pointer followed to its end; pointers only rise, so there is one."""
    step = cut(step)
    while True:
        nxt = cut(step.join(step.select(F.col("k").alias("to"), F.col("to").alias("end")), "to").select("k", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        step = nxt.drop("moved")


def _both_ways(slips: DataFrame) -> DataFrame:
    return slips.unionByName(slips.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_frequent(names: DataFrame, near: DataFrame) -> DataFrame:
    """``(k, to)`` of names ``(k, n)``: a rare one, or one much rarer, goes to its only more frequent neighbour in ``near``."""
    side = lambda p: names.select(F.col("k").alias(p), F.col("n").alias(f"n_{p}"))
    met = near.join(side("a"), "a").join(side("b"), "b").where((F.struct("n_b", "b") > F.struct("n_a", "a")) & ((F.col("n_a") <= 2) | (3 * F.col("n_a") <= F.col("n_b"))))
    to = met.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("to"), F.max("b").alias("b2")).where("to = b2").select("k", "to")
    return _settled(names.select("k").join(to, "k", "left").select("k", F.coalesce("to", "k").alias("to")))


def _orgs(parsed: DataFrame) -> DataFrame:
    """Spellings of collaborations with their entity; names that differ in a number are two."""
    org = cut(parsed.where("kind = 'org'"))
    names = cut(org.groupBy(F.col("surname").alias("k")).agg(F.sum("n").alias("n")))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\b(?:[ivx]+|\w*\d\w*)\b"), F.lit(0))
    near = _both_ways(segment_join(names)).where(numbers(F.col("a")) == numbers(F.col("b")))
    to = _to_frequent(names, near).withColumnRenamed("k", "surname")
    return org.join(to, "surname").select("first_name", "last_name", F.concat(F.lit("o|"), "to").alias("entity"))


def _unglued(full: DataFrame) -> DataFrame:
    """Particles written in one with the surname are parted where the collection has the two apart."""
    apart = full.where("particle != ''").groupBy("first", F.concat(F.regexp_replace("particle", " ", ""), "surname").alias("surname"))
    apart = apart.agg(F.max(F.struct(F.col("surname").alias("s"), F.col("particle").alias("p"))).alias("was"))
    full = full.join(apart, ["first", "surname"], "left")
    parted = (F.col("particle") == "") & F.col("was").isNotNull()
    return full.withColumns(
        {"surname": F.when(parted, F.col("was.s")).otherwise(F.col("surname")), "particle": F.when(parted, F.col("was.p")).otherwise(F.col("particle"))}
    ).drop("was")


def resolve(parsed: DataFrame) -> DataFrame:
    """``(first_name, last_name, entity)`` of every spelling that names a person or collaboration."""
    spelling = ["first_name", "last_name"]
    org = _orgs(parsed)
    full = cut(_unglued(parsed.where("kind = 'full'")))
    full = full.join(_canonical(full), ["first", "surname"])
    who = ["c_first", "c_surname"]
    # A dropped particle, then a dropped middle initial, where just one fits.
    particles = full.groupBy(*who).agg(_only("particle").alias("p"))
    full = full.join(particles, who).withColumn("p", F.when(F.col("particle") == "", F.coalesce("p", F.lit(""))).otherwise(F.col("particle")))
    mids = full.groupBy(*who, "p").agg(_only("mid").alias("m"))
    full = full.join(mids, [*who, "p"]).withColumn("m", F.when(F.col("mid") == "", F.coalesce("m", F.lit(""))).otherwise(F.col("mid")))
    full = cut(full.select(*spelling, *who, "p", "m", "parts", F.concat_ws("|", F.lit("f"), *who, "p", "m").alias("entity")))
    persons = full.groupBy("entity", "c_first", "c_surname", "p", "m").agg(F.max("parts").alias("parts"))
    persons = persons.select("entity", F.col("c_surname").alias("surname"), F.col("p").alias("particle"), "m", F.col("parts").alias("full_parts"), F.substring("c_first", 1, 1).alias("letter"))
    key = F.concat_ws(" ", F.when(F.col("particle") != "", F.col("particle")), "surname")
    persons = cut(persons.withColumn("key", key))
    short = cut(parsed.where("kind = 'initial'").withColumn("letter", F.substring("parts", 1, 1)).withColumn("key", key))
    forms = cut(short.groupBy("surname", "particle", "letter", "parts", "mid", "key").agg(F.sum("n").alias("n")))
    near = cut(_both_ways(segment_join(forms.select("key").union(persons.select("key")).distinct().withColumnRenamed("key", "k"))))
    fits = (F.length("parts") == 1) | (F.col("parts") == F.col("full_parts"))
    both_initials = F.concat("parts", "mid") == F.col("full_parts")  # "J. P." for a compound name
    rank = F.when(((F.col("mid") != "") & (F.col("mid") == F.col("m"))) | ((F.col("mid") != "") & both_initials), 2).when((F.col("mid") == "") | (F.col("m") == ""), 1)
    form = ["surname", "particle", "parts", "mid"]

    def one_of(met: DataFrame) -> DataFrame:
        met = met.where(fits).withColumn("rank", rank).where("rank is not null")
        met = met.groupBy(*form, "rank").agg(F.min("entity").alias("e"), F.max("entity").alias("e2"))
        return met.groupBy(*form).agg(F.max_by(F.when(F.col("e") == F.col("e2"), F.col("e")), "rank").alias("entity"), F.lit(True).alias("met"))

    exact = one_of(forms.drop("key").join(persons.drop("key"), ["surname", "particle", "letter"]))
    # A surname that no person has in full may be a slip of one: where just one person fits.
    lost = forms.join(persons.select("key").distinct(), "key", "left_anti")
    others = persons.select(F.col("key").alias("b"), "letter", "m", "full_parts", "entity")
    slipped = one_of(lost.join(near.withColumnRenamed("a", "key"), "key").join(others, ["b", "letter"])).where("entity is not null")
    met = cut(exact.unionByName(slipped))
    # Forms without a person: a slip of the surname goes to the more frequent one of the same initials.
    free = cut(forms.join(met, form, "left_anti").groupBy("parts", "key", "surname", "particle").agg(F.sum("n").alias("n"), F.array_remove(F.collect_set("mid"), "").alias("mids")).withColumn("k", F.concat_ws("|", "parts", "surname", "particle")))
    end = lambda p: free.select(F.col("key").alias(p), "parts", F.col("k").alias(f"k_{p}"), F.col("mids").alias(f"mids_{p}"))
    alike = near.join(end("a"), "a").join(end("b"), ["b", "parts"]).where(F.size(F.array_union("mids_a", "mids_b")) <= 1)
    to = _to_frequent(free, alike.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")))
    whole = F.concat_ws("|", "parts", "surname", "particle")
    short = short.join(met, form, "left").withColumn("k", whole).join(to, "k", "left").withColumn("k", F.coalesce("to", "k"))
    lone = short.groupBy("k").agg(_only("mid").alias("m"))
    short = short.join(lone, "k")
    alone = F.concat_ws("|", F.lit("i"), "k", F.when(F.col("mid") == "", F.coalesce("m", F.lit(""))).otherwise(F.col("mid")))
    # An initial that fits several persons is told from none of them and stays by itself.
    apart = F.concat_ws("|", F.lit("?"), "parts", "surname", "particle", "mid")
    short = short.select(*spelling, F.coalesce("entity", F.when(F.col("met"), apart), alone).alias("entity"))
    return org.unionByName(full.select(*spelling, "entity")).unionByName(short)


def variant_rows(
    authors: DataFrame, id_col: str = "author_row", first_col: str = "first_name", last_col: str = "last_name", nicknames: dict[str, str] = NICKNAMES
) -> DataFrame:
    """``(id, entity, spelling)`` of the rows whose name could be read."""
    rows = authors.select(F.col(id_col).alias("id"), F.col(first_col).alias("first_name"), F.col(last_col).alias("last_name")).where("id is not null")
    spelled = rows.groupBy("first_name", "last_name").agg(F.count("*").alias("n"))
    entities = cut(resolve(parse_spellings(spelled, nicknames)))
    same = F.col("r.first_name").eqNullSafe(F.col("e.first_name")) & F.col("r.last_name").eqNullSafe(F.col("e.last_name"))
    joined = rows.alias("r").join(entities.alias("e"), same)
    return joined.select("r.id", "e.entity", F.xxhash64(F.struct("r.first_name", "r.last_name"), F.col("r.first_name").isNull()).alias("spelling"))


def same_name_pairs(
    authors: DataFrame, id_col: str = "author_row", first_col: str = "first_name", last_col: str = "last_name", nicknames: dict[str, str] = NICKNAMES
) -> DataFrame:
    """``(id_a, id_b)``, smaller first: rows of one person or collaboration spelled differently.

    Rows spelled the same (nulls compared as values) give no pair among themselves but each is
    paired with the differing ones. Rows with a null id, or without a readable surname and
    given name, give none; neither does an empty table.
    """
    rows = cut(variant_rows(authors, id_col, first_col, last_col, nicknames))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.spelling") != F.col("b.spelling")))
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
