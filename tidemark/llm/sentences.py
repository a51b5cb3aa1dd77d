"""Sentence boundaries across languages and scripts by a pushdown automaton.

A text is read once. Lines move the stack of list levels: headings and numbered lines are units, a
numbered line opens its level or returns to it by its indent, and a blank line closes them all. Within
running text a stack tracks open quotations and brackets, a trie read backwards from a full stop tells
abbreviations, and each script brings its own terminators (full stops, ideographic stops, dandas,
the space of Thai). What comes out are offsets in code points, counted from the start of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import spread

#: Abbreviations that never end a sentence.
NEVER = (
    "e.g", "i.e", "cf", "vs", "viz", "approx", "resp", "ca", "incl", "esp", "w.r.t", "prof", "profs", "dr", "drs", "mr",
    "mrs", "ms", "st", "messrs", "hon", "rev", "gen", "capt", "lt", "col", "sgt", "mt", "z. b", "z.b", "d. h", "d.h", "u. u",
    "vgl", "bzw", "sog", "evtl", "ggf", "hr", "fr", "i. a", "i. d. r", "c.-à-d", "c-à-d", "p. ex", "p.ex", "mme", "mlle", "env",
    "sr", "sra", "srta", "dra", "p. ej", "p.ej", "aprox", "т. е", "т.е", "напр", "см", "ср", "проф", "г-н", "им", "ул", "द्र",
    "डॉ", "श्री", "प्रो", "ดร", "รศ", "ผศ", "พ.ศ", "ค.ศ",
)
#: Abbreviations before a number, a label or a reference.
NUMBERED = (
    "fig", "figs", "eq", "eqs", "eqn", "eqns", "sec", "secs", "sect", "ref", "refs", "no", "nos", "nr", "pp", "p", "vol", "vols",
    "app", "ch", "chap", "tab", "tabs", "thm", "lem", "prop", "def", "cor", "art", "abb", "kap", "bd", "s", "abschn", "gl",
    "pág", "págs", "núm", "cap", "sección", "n", "рис", "стр", "табл", "гл", "с", "пп", "п", "पृ", "सं",
)
#: Abbreviations that may also end a sentence; a capital after them tells.
MAY_END = (
    "etc", "et al", "al", "a.m", "p.m", "jr", "inc", "ltd", "co", "u.s", "u.k", "usw", "u. a", "u.a", "u. ä", "h", "ee. uu",
    "т. д", "т.д", "т. п", "т.п", "др", "г", "гг", "в", "вв", "и др", "ibid", "est",
)
#: Words after a German ordinal number.
_ORDINAL_NEXT = re.compile(
    r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Auflage|Ordnung|Grades|Klasse)\b"
)
_ORDINAL = re.compile(r"(?<![\w.,])\d{1,2}$")
_KIND_NEVER, _KIND_NUMBERED, _KIND_MAY_END = 1, 2, 3

TERMINATORS = ".!?…。！？｡．।॥؟۔"
_WIDE = frozenset("。！？｡．।॥۔؟")
_PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "«": "»", "„": "“”", "‹": "›", "〈": "〉", "〔": "〕"}
_OPENERS = {c: tuple(o for o, cs in _PAIRS.items() if c in cs) for c in "".join(_PAIRS.values())}
_CLOSERS = (frozenset("".join(_PAIRS.values())) | frozenset("\"'’")) - {"“"}  # that one opens, unless a low mark precedes
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_NUMBER = re.compile(r"[ \t]*(?:\d{1,3}[.)]|[-*•])[ \t]+\S")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARK = re.compile(r"\[(?:EQUATION|MATH|CITATION|REF)\]")
_SKIP = re.compile(r"(?:<[^<>\n]{1,60}>|&#?\w{1,8};|\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{?|\\\\|[\s*_`~$\"'“”„«»‹›‘’(\[{（「『¿¡|=<>&%])+")
_LABEL = re.compile(r"[\"“«„‘(\[*_]*\((?:[a-z]|[ivx]{1,4}|\d{1,2})\)\s+")
_THAI = re.compile("[\u0e00-\u0e7f]")
_WORD = re.compile(r"[^\W\d_]")
_EVENT = re.compile(
    r"(?P<mark>\[(?:EQUATION|MATH|CITATION|REF)\])|(?P<stop>(?:\.(?=[.!?…])|[!?…。！？｡．।॥؟۔])*[.!?…。！？｡．।॥؟۔])"
    r"|(?P<open>``)|(?P<close>'')|(?P<pair>[()\[\]（）【】「」『』《》“”«»„‹›〈〉〔〕\"])|(?P<gap>\s+)"
)


def _trie() -> dict:
    root: dict = {}
    for kind, words in ((_KIND_NEVER, NEVER), (_KIND_NUMBERED, NUMBERED), (_KIND_MAY_END, MAY_END)):
        for w in words:
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


_ABBREVIATIONS = _trie()


def _abbreviation(text: str, start: int, stop: int) -> int:
    """The kind of the longest abbreviation that ends right before ``stop``; 0 for none."""
    node, found, k = _ABBREVIATIONS, 0, stop - 1
    while k >= start:
        c = text[k].lower()
        c = " " if c.isspace() else c
        node = node.get(c)
        if node is None:
            break
        if "" in node and (k == start or not (text[k - 1].isalnum() or text[k - 1] == "-")):
            found = node[""]
        k -= 1
    return found


def _match(text: str, s: int, e: int, events: list[re.Match]) -> dict[int, int]:
    """Opening place -> end of its closing mark, for those that are closed.

    ``open_at`` holds, for each kind of opening mark, its places on the stack, so that a closing mark finds
    its partner without a search; what was opened after the partner is popped unclosed, each mark once.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = {}

    def push(key: str, at: int) -> None:
        open_at.setdefault(key, []).append(len(stack))
        stack.append((key, at))

    def close(held: int, end: int) -> None:
        out[stack[held][1]] = end
        while len(stack) > held:
            open_at[stack.pop()[0]].pop()

    for m in events:
        kind, c, at = m.lastgroup, m.group(), m.start()
        if kind in ("open", "close") or c == '"':
            key = '"' if c == '"' else "``"
            held = open_at[key][-1] if open_at.get(key) else -1
            before = text[at - 1] if at > s else " "
            after = text[m.end()] if m.end() < e else " "
            opens = kind == "open" or (kind != "close" and held < 0 and not after.isspace() and (before.isspace() or before in "([{—-" or not before.isalnum()))
            if held >= 0 and kind != "open":
                close(held, m.end())
            elif opens:
                push(key, at)
        elif kind == "pair":
            held = max((open_at[k][-1] for k in _OPENERS.get(c, ()) if open_at.get(k)), default=-1)
            if held >= 0:
                close(held, m.end())
            elif c in _PAIRS:
                push(c, at)
    return out


def _next_start(text: str, at: int, e: int) -> str:
    """What the text after ``at`` begins with: upper, lower, digit, mark, other or end."""
    while True:
        while at < e and text[at].isspace():
            at += 1
        if at >= e:
            return "end"
        if _MARK.match(text, at, e):
            return "mark"
        if (m := _LABEL.match(text, at, e)) is None:
            break
        at = m.end()
    if m := _SKIP.match(text, at, e):
        at = m.end()
        if at >= e:
            return "other"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c.islower():
        return "upper" if at + 1 < e and text[at + 1].isupper() else "lower"
    if c.isupper() or c.istitle():
        return "upper"
    return "caseless" if c.isalpha() else "other"


def _stops(text: str, s: int, e: int, m: re.Match) -> bool:
    """Whether the terminator ``m`` outside quotations and brackets ends a sentence."""
    stop, at, end = m.group(), m.start(), m.end()
    if any(c in _WIDE for c in stop):
        return True
    after = end
    while after < e and text[after] in _CLOSERS:
        after += 1
    spaced = after >= e or text[after].isspace()
    follows = _next_start(text, after, e)
    if follows == "end":
        return True
    if stop[-1] == "…" and follows == "caseless":
        return spaced
    if stop != ".":
        return follows != "lower" and (spaced or follows in ("upper", "caseless"))
    before = text[at - 1] if at > s else " "
    if not spaced:
        # A missing space: a lower-case word, or a closing mark after one, meets a capital.
        if follows != "upper" or not (before.islower() or before in "])”»" or before.isdigit()) or text[after] in "/\\_-<&":
            return False
        k = at - 1
        while k > s and text[k - 1].isalpha():
            k -= 1
        return (at - k >= 2 or not before.isalpha()) and not (text[k - 1 : k] in (".", "/", "@") and k > s) and _abbreviation(text, s, at) in (0, _KIND_MAY_END)
    if "\u0900" <= before <= "\u097f" or "\u0e00" <= before <= "\u0e7f":
        return False
    if before.isspace() or not (before.isalnum() or before in _CLOSERS or before in "%°*_`$}>…") and not _word_mark(before):
        return follows in ("upper", "caseless", "mark") and not before.isspace()
    if follows == "lower":
        return False
    if before.isdigit() and _ORDINAL_NEXT.match(text, after, e) and _ORDINAL.search(text, max(s, at - 4), at):
        return False
    kind = _abbreviation(text, s, at)
    nxt = after
    while nxt < e and text[nxt].isspace():
        nxt += 1
    label = nxt + 1 < e and text[nxt].isupper() and not text[nxt + 1].isalpha()
    single = before.isalpha() and (at - 1 == s or not (text[at - 2].isalnum() or text[at - 2] in "'’"))
    if single and nxt + 1 < e and text[nxt].isalpha() and text[nxt + 1] == ".":
        return False  # a chain of initials or a spaced abbreviation
    if kind == _KIND_NEVER:
        return False
    if kind == _KIND_MAY_END:
        return follows in ("upper", "caseless", "digit")
    if kind == _KIND_NUMBERED:
        return not (follows in ("digit", "mark", "other") or label or text[nxt] in "([{#")
    if single and before.isupper() and follows in ("upper", "other", "caseless"):
        k = at - 2
        while k > s and text[k - 1].isspace():
            k -= 1
        labelled = k > s and text[k - 1] == "." and _abbreviation(text, s, k - 1) == _KIND_NUMBERED
        return labelled
    return True


def _word_mark(c: str) -> bool:
    return c.isalpha() or "\u0300" <= c <= "\u036f"


def _running(text: str, s: int, e: int, ends: list[int]) -> None:
    """Units of running text ``[s, e)``."""
    events = list(_EVENT.finditer(text, s, e))
    pairs = _match(text, s, e, events)
    thai = 2 * len(_THAI.findall(text, s, e)) > len(_WORD.findall(text, s, e)) > 0
    unit = s
    while unit < e and text[unit].isspace():
        unit += 1
    outer, opened, inner_stop = -1, -1, False

    def finish(at: int) -> None:
        nonlocal unit
        ends.append(at)
        unit = at
        while unit < e and text[unit].isspace():
            unit += 1

    for m in events:
        at, end, kind = m.start(), m.end(), m.lastgroup
        if at < unit:
            continue
        if outer >= 0:
            if end < outer:
                if kind == "stop":
                    k = end
                    while k < outer and (text[k] in _CLOSERS or text[k].isspace()):
                        k += 1
                    inner_stop = inner_stop or k >= outer - 1  # only closing marks and spaces are left
                continue
            if end == outer:
                whole = opened == unit or not text[unit:opened].strip("*_`~$'‘¿¡ \t\n")
                outer = -1
                if inner_stop:
                    after = end
                    while after < e and text[after] in _CLOSERS and text[after] not in ("'", "’"):
                        after += 1
                    follows = _next_start(text, after, e)
                    joined = after < e and text[after] in ",;:—–-。！？．.!?"
                    if not joined and (follows in ("upper", "end") or (whole and follows not in ("lower",))):
                        finish(after)
                continue
            outer = -1
        if kind in ("pair", "open") and at in pairs:
            outer, opened, inner_stop = pairs[at], at, False
        elif kind == "stop":
            if _stops(text, s, e, m):
                while end < e and text[end] in _CLOSERS and end not in pairs:
                    end += 1
                finish(end)
        elif kind == "mark" and m.group() == "[EQUATION]":
            if end >= e or (text[end].isspace() and _next_start(text, end, e) == "upper" and _capital(text, end, e)):
                finish(end)
        elif kind == "gap" and thai and end < e:
            left, right = text[at - 1], text[end]
            if _THAI.match(left) and _THAI.match(right):
                finish(at)
            elif (left in _CLOSERS or left in "]!?") and _THAI.match(right) and not _MARK.search(text, max(s, at - 11), at):
                finish(at)
            elif _THAI.match(left) and right in "“\"«(" and end in pairs and _THAI.search(text, end, pairs[end]):
                finish(at)
    last = e
    while last > unit and text[last - 1].isspace():
        last -= 1
    if last > unit:
        ends.append(last)


def _capital(text: str, at: int, e: int) -> bool:
    """Whether a capitalised word follows, after white space and an opening mark at most."""
    while at < e and (text[at].isspace() or text[at] in "\"“«„(*_¿¡'‘"):
        at += 1
    return at < e and text[at].isupper()


def unit_ends(body: str | None) -> list[int]:
    """Ends of the sentence units of a text, in code points; none for a null or blank one."""
    ends: list[int] = []
    if not body or body.isspace():
        return ends
    start, at = -1, 0
    levels: list[int] | None = []  # indents of the open list levels; None within running text

    def flush(to: int) -> None:
        nonlocal start
        if start >= 0:
            _running(body, start, to, ends)
        start = -1

    breaks = [(m.start(), m.end()) for m in _LINE.finditer(body)] + [(len(body), len(body))]
    for line_end, nxt in breaks:
        line = body[at:line_end]
        stripped = len(line.rstrip())
        if not stripped:
            flush(at)
            levels = []
        elif _HEADING.match(line):
            flush(at)
            ends.append(at + stripped)
            levels = []
        elif levels is not None and _NUMBER.match(line):
            indent = len(line) - len(line.lstrip())
            while levels and levels[-1] >= indent:
                levels.pop()
            levels.append(indent)
            ends.append(at + stripped)
        else:
            if start < 0:
                start = at
            levels = None  # running text closes every level
        at = nxt
    flush(len(body))
    return ends


def sentence_units(files: DataFrame, id_col: str = "file_id", text_col: str = "body") -> DataFrame:
    """``(id, unit, sent_start, sent_end)``: the sentence units of every text, in order.

    Offsets count code points. Null, empty and blank texts give no row, and so do rows with a
    null id. Repeated rows give their units each time. Texts of any length are read whole in
    one pass; the step only maps, so nothing is shuffled.
    """
    src = spread(files.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, units, starts, stops = [], [], [], []
            for k, text in enumerate(b.column("t").to_pylist()):
                begin = 0
                for n, end in enumerate(unit_ends(text)):
                    while text[begin].isspace():
                        begin += 1
                    rows.append(k)
                    units.append(n)
                    starts.append(begin)
                    stops.append(end)
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(units, pa.int32()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
                names=[id_col, "unit", "sent_start", "sent_end"],
            )

    return src.mapInArrow(run, f"`{id_col}` {kind}, unit int, sent_start bigint, sent_end bigint")
