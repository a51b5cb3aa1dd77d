"""LaTeX to plain text: one pass per step over a string, without outside programs.

Unmatched braces leave the text as it is. Macros are expanded in order of their definition,
once each; a macro that calls itself is expanded once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What becomes of an environment (a mark, or nothing).
ENVIRONMENTS = {
    "equation": "[EQUATION]", "subequation": "[EQUATION]", "eqnarray": "[EQUATION]", "prop": "", "array": "", "figure": "",
    "align": "[EQUATION]", "table": "", "tabular": "", "math": "[MATH]", "matrix": "", "displaymath": "[EQUATION]", "thebibliography": "",
    "keywords": "", "alignat": "", "multline": "", "itemize": "", "tikzpicture": "", "keyword": "", "flushright": "", "lstlisting": "",
}
#: Commands that go with their argument, and those a mark stands for.
DROPPED = (
    "input", "author", "authors", "correspondingauthor", "authorrunning", "email", "offprints", "footnote", "foot", "pacs", "PACS", "address",
    "setcounter", "affiliation", "institute", "date", "label", "keywords", "newcounter", "urladdr", "thispagestyle", "footnotetext", "begin",
    "end", "tikzset", "bibliographystyle", "bibliography", "textcolor", "lstdefinelanguage", "citep", "citealt", "nocite", "setlength",
    "addtolength", "newtheorem",
)
MARKED = {"cite": "[CITATION]", "citet": "[CITATION]", "eqref": "[REF]", "ref": "[REF]", "autoref": "[REF]", "fref": "[REF]", "lref": "[REF]", "refs": "[REF]"}
_NAME = re.compile(r"\\([A-Za-z]+)\*?")
_DEFINE = re.compile(r"\\(?:newcommand|DeclareRobustCommand)\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*(?:\[(\d)\])?\s*(?:\[([^\]]*)\])?\s*(?=\{)|(?:\\(?:global|long)\s*)*\\g?def\s*\\([A-Za-z]+)((?:\s*#\d)*)\s*(?=\{)")
#: The last section of thanks, where the text that matters ends.
_ACKNOWLEDGED = re.compile(r"(?:#{1,6}[ \t]*)?\bAcknowledg(?:e?ment)s?\b\.?")
_HEADING = re.compile(r"\\((?:sub)*)section\*?\s*(?:\[[^\]]*\])?\s*(?=\{)")
_SENTENCE_AFTER = re.compile(r"\s+[A-Z]|\s*\Z")


def remove_comments(s: str) -> str:
    return re.sub(r"(?<!\\)%[^\n]*", "", s)


def braced(s: str, at: int, pair: str = "{}") -> int:
    """End of the group that opens at ``at``; -1 where none does or it stays open."""
    if s[at : at + 1] != pair[0]:
        return -1
    depth = 0
    for m in re.compile(r"\\.|[" + re.escape(pair) + "]", re.S).finditer(s, at):
        c = m.group()
        depth += (c == pair[0]) - (c == pair[1])
        if depth == 0:
            return m.end()
    return -1


def expand_macros(s: str) -> str:
    found: list[tuple[str, int, str | None, str]] = []
    out, at = [], 0
    while (m := _DEFINE.search(s, at)) is not None:
        end = braced(s, m.end())
        out.append(s[at : m.start()])
        if end < 0:
            out.append(m.group())
            at = m.end()
            continue
        count = int(m[2] or 0) if m[1] else m[5].count("#")
        found.append((m[1] or m[4], count, m[3], s[m.end() + 1 : end - 1].strip()))
        at = end
    s = "".join(out) + s[at:]
    for name, count, default, body in found:
        call = re.compile(r"\\" + name + r"(?![A-Za-z])[ \t]*")
        out, at = [], 0
        while (m := call.search(s, at)) is not None:
            args, k = [], m.end()
            if default is not None:
                end = braced(s, k, "[]")
                args, k = ([s[k + 1 : end - 1]], end) if end > 0 else ([default], k)
            while len(args) < count and (end := braced(s, k)) > 0:
                args.append(s[k + 1 : end - 1])
                k = end
            if not count and s[k : k + 2] == "{}":
                k += 2
            out.append(s[at : m.start()])
            value = re.sub(r"#(\d)", lambda d, a=args: a[int(d[1]) - 1] if 0 < int(d[1]) <= len(a) else "", body)
            tight = not count and m.end() > m.start() + len(name) + 1 and k == m.end()
            out.append(value + (" " if tight else ""))
            at = k
        s = "".join(out) + s[at:]
    return s


def replace_environments(s: str) -> str:
    out, at = [], 0
    for m in re.compile(r"\\begin\{([A-Za-z]+)\*?\}").finditer(s):
        if m.start() < at or m[1] not in ENVIRONMENTS:
            continue
        end = s.find("\\end{" + m[0][7:], m.end())
        if end < 0:
            continue
        out += [s[at : m.start()], ENVIRONMENTS[m[1]]]
        at = end + len(m[0]) - 2
    return "".join(out) + s[at:]


#: How many groups a dropped command takes where it is not one; a name without braces counts as one.
_GROUPS = {"newtheorem": 2, "setlength": 2, "addtolength": 2, "setcounter": 2, "lstdefinelanguage": 2}
_BARE_NAME = re.compile(r"\s*\\[A-Za-z]+")
_GAP = re.compile(r"\s*(?=\{)")


def replace_commands(s: str) -> str:
    """Commands that are dropped with their arguments, and citations and references as marks. An argument may stand on
    the next line where a command takes several; options may stand before, between and after the arguments."""
    out, at = [], 0
    for m in _NAME.finditer(s):
        if m.start() < at or (m[1] not in DROPPED and m[1] not in MARKED):
            continue
        k, count, want = m.end(), 0, _GROUPS.get(m[1], 1)
        while count < want:
            while (end := braced(s, k, "[]")) > 0:
                k = end
            if want > 1 and (bare := _BARE_NAME.match(s, k)) is not None:
                end = bare.end()
            else:
                end = braced(s, _GAP.match(s, k).end() if want > 1 and _GAP.match(s, k) else k)
            if end < 0:
                break
            k, count = end, count + 1
        if want > 1 and count and (end := braced(s, k, "[]")) > 0:
            k = end
        if not count and s[k : k + 1] == "{":
            continue  # stays open: the text is left as it is
        out += [s[at : m.start()], MARKED.get(m[1], "")]
        at = k
    return "".join(out) + s[at:]


def replace_math(s: str) -> str:
    """Displayed and inline math as marks; a full stop at their end stays where a sentence ends."""

    def mark(tag: str):
        return lambda m: tag + ("." if m[1].rstrip().endswith(".") and _SENTENCE_AFTER.match(m.string, m.end()) else "")

    for tag, pattern in (("[EQUATION]", r"\$\$(.*?)\$\$|\\\[(.*?)\\\]"), ("[MATH]", r"(?<!\\)\$([^$]*?)(?<!\\)\$|\\\((.*?)\\\)")):
        s = re.sub(pattern, lambda m, f=mark(tag): f(m) if m[1] is not None else tag, s, flags=re.S)
    return s


def collapse(s: str) -> str:
    for tag in ("MATH", "EQUATION"):
        s = re.sub(rf"\[{tag}\](?:\s+\[{tag}\])+", f"[{tag}]", s)
    return re.sub(r"\n\s*\n\s*(\[EQUATION\])", r"\n\1", re.sub(r"(\[EQUATION\])\s*\n\s*\n", r"\1\n", s))


def mark_headings(s: str) -> str:
    """Section commands as lines of as many ``#`` as they are deep, whatever braces stand in them."""
    out, at = [], 0
    while (m := _HEADING.search(s, at)) is not None:
        end, depth = braced(s, m.end()), len(m[1]) // 3 + 1
        if end < 0 or depth > 6:
            out.append(s[at : m.end()])
            at = m.end()
            continue
        out += [s[at : m.start()], "#" * depth + " " + " ".join(s[m.end() + 1 : end - 1].split())]
        at = end
    return "".join(out) + s[at:]


def clean(s: str) -> str:
    """Steps up to plain marks: comments, macros, environments, body, commands, math, headings."""
    s = replace_environments(expand_macros(remove_comments(s)))
    for start in ("\\begin{document}",):
        s = s.split(start, 1)[-1]
    s = s.split("\\end{document}", 1)[0].split("\\thebibliography", 1)[0]
    s = s.replace("\\begin{abstract}", "# Abstract\n").replace("\\end{abstract}", "")
    s = collapse(replace_math(replace_commands(s)))
    return re.sub(r"[ \t]+", " ", mark_headings(s))


def detex(s: str | None) -> str | None:
    """Plain text of a source; null for null."""
    if s is None:
        return None
    s = clean(s.replace("\r\n", "\n"))
    s = re.sub(r"\\([%&#_{}$])", "\\1", re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", "", s).replace("\\\\", " "))
    s = re.sub(r"(?<!\\)[{}]", "", s).replace("~", " ")
    if "Abstract" in s:
        s = "# Abstract" + s.split("Abstract", 1)[1]
    if hits := list(_ACKNOWLEDGED.finditer(s)):
        s = s[: hits[-1].start()]
    s = re.sub(r"[ \t]+", " ", re.sub(r" *\n *", "\n", s))
    return re.sub(r"\n{3,}", "\n\n", s).strip()


detex_udf = F.pandas_udf(lambda col: pd.Series([detex(x) for x in col], dtype=object), T.StringType())


#: Environments the plain scanner passes over.
SCAN_IGNORED = frozenset(
    ("figure", "table", "equation", "eqnarray", "align", "array", "tabular", "displaymath", "math", "thebibliography", "verbatim", "lstlisting", "tikzpicture", "matrix", "multline", "gather")
)
_SCAN = re.compile(r"\\begin\{([A-Za-z]+)\*?\}|\\end\{[A-Za-z]+\*?\}|\\(?:re)?newcommand\b|\\g?def\b|\\([A-Za-z]+)\*?|\\(.)|(\$\$?)|([{}])|(%)", re.S)


def scan_text(s: str | None) -> str | None:
    """A second way to plain text: one scan that drops definitions, math and commands, and keeps what else stands
    there. It ends at a line ``References`` in the last fifth of the lines. Null for null."""
    if s is None:
        return None
    start = s.find("\\begin{document}")
    at = start + 16 if start >= 0 else 0
    out: list[str] = []
    while (m := _SCAN.search(s, at)) is not None:
        out.append(s[at : m.start()])
        at = m.end()
        if m[1] is not None:
            if m[1] in SCAN_IGNORED and (end := s.find("\\end{" + m[0][7:], at)) >= 0:
                at = end + len(m[0]) - 2
        elif m[0] == "\\end{document}":
            s = s[:at]
        elif m[0].startswith(("\\newcommand", "\\renewcommand", "\\def", "\\gdef")):
            brace = s.find("{", at)
            while brace >= 0 and (end := braced(s, brace)) > 0:
                at = end
                while s[at : at + 1] == "[" and (opt := braced(s, at, "[]")) > 0:
                    at = opt
                brace = at if s[at : at + 1] == "{" else -1
        elif m[2] is not None:
            while s[at : at + 1] == "[" and (opt := braced(s, at, "[]")) > 0:
                at = opt
            if m[2] in DROPPED or m[2] in MARKED:
                at = max(at, braced(s, at))
        elif m[3] is not None:
            out.append(m[3] if m[3] in "%&#_{}$" else " ")
        elif m[4] is not None:
            end = s.find(m[4], at)
            at = end + len(m[4]) if end >= 0 else at
        elif m[6] is not None:
            end = s.find("\n", at)
            at = end if end >= 0 else len(s)
    out.append(s[at:])
    lines = [re.sub(r"[ \t~]+", " ", x).strip() for x in "".join(out).split("\n")]
    for k in range(len(lines) - 1, int(len(lines) * 0.8) - 1, -1):
        if lines[k].lower().strip("# ") == "references":
            lines = lines[:k]
            break
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


scan_udf = F.pandas_udf(lambda col: pd.Series([scan_text(x) for x in col], dtype=object), T.StringType())
