"""Clean text and structure from files of mixed markup.

A file's markup (LaTeX, HTML, Markdown or wiki) is told from what its body holds, not from its
name. One reader per markup walks the body once and yields its elements in order: headings, list
items, code blocks, displayed formulas and paragraphs, each as clean text. What a reader of the
finished file would not see (comments, disabled parts, scripts, styles, heads) is passed over.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.runtime import spread

Emit = Callable[[str, str], None]
KINDS = ("heading", "list_item", "code_block", "formula")
_SPACE = re.compile(r"[\s\u00a0\u2009\u202f\u200b]+")


def squeeze(s: str) -> str:
    return _SPACE.sub(" ", s.replace("\xa0", " ")).strip()


# --- LaTeX -----------------------------------------------------------------------------------

_CODE_ENVS = ("verbatim", "verbatim*", "lstlisting", "Verbatim", "Verbatim*", "minted", "alltt")
_MATH_ENVS = ("equation", "displaymath", "align", "eqnarray", "gather", "multline", "flalign", "alignat")
_LIST_ENVS = ("itemize", "enumerate", "description", "list", "compactitem", "compactenum")
_SECTIONS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
_TEX_EVENT = re.compile(
    r"(?P<escape>\\[\\%$&#_{}~^])|(?P<comment>%[^\n]*\n?[ \t]*)|(?P<display>\\\[|\$\$)|(?P<inline>\$|\\\()"
    r"|\\(?P<verb>verb)\*?(?P<delimiter>[^\sA-Za-z*])|\\(?P<name>[A-Za-z]+)(?P<star>\*?)|(?P<break>\n[ \t]*\n)"
)
_ACCENTS = {
    '"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306",
    "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331",
}
_LETTERS = {
    "ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å",
    "i": "ı", "j": "ȷ", "dots": "…", "ldots": "…", "textendash": "–", "textemdash": "—", "S": "§", "copyright": "©",
    "textbackslash": "\\", "textasciitilde": "~", "quad": " ", "qquad": " ", "newline": " ",
}
_ACCENT = re.compile(r"\\(?:([\"'`^~=.])\s*|([uvHckrdb])(?![A-Za-z])\s*)(?:\{\s*(\\?[A-Za-z])\s*\}|(\\[ij](?![A-Za-z])|[A-Za-z]))")
_DROPPED = frozenset(("label", "cite", "citep", "citet", "ref", "eqref", "pageref", "footnote", "index", "vspace", "hspace", "thanks", "bibliography", "bibliographystyle", "input", "include", "pagestyle", "setcounter"))
_LATER = frozenset(("href", "textcolor", "colorbox"))  # the second argument is seen


def _group(s: str, at: int, opening: str = "{", closing: str = "}") -> tuple[str, int] | None:
    """The bracketed argument at ``at`` (white space before it allowed) and its end."""
    n = len(s)
    while at < n and s[at].isspace():
        at += 1
    if at >= n or s[at] != opening:
        return None
    depth, k = 0, at
    while k < n:
        c = s[k]
        if c == "\\":
            k += 2
            continue
        if c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if depth == 0:
                return s[at + 1 : k], k + 1
        k += 1
    return None


def tex_text(s: str) -> str:
    """Text of a LaTeX fragment without inline markup."""

    def accent(m: re.Match) -> str:
        letter = (m.group(3) or m.group(4)).lstrip("\\")
        return unicodedata.normalize("NFC", letter + _ACCENTS[m.group(1) or m.group(2)])

    s = _ACCENT.sub(accent, s)
    out: list[str] = []
    k, n = 0, len(s)
    while k < n:
        c = s[k]
        if c == "\\":
            m = re.compile(r"[A-Za-z]+\*?").match(s, k + 1)
            if not m:
                nxt = s[k + 1 : k + 2]
                out.append(" " if nxt in ("\\", ",", ";", ":", "!", " ", "\n", "/") else "" if nxt in ("(", ")", "-") else nxt)
                k += 2
                continue
            name, k = m.group().rstrip("*"), m.end()
            if name in _DROPPED or name in _LATER:
                while (g := _group(s, k, "[", "]")) is not None:
                    k = g[1]
                if (g := _group(s, k)) is not None:
                    k = g[1]
                continue
            if name in _LETTERS:
                out.append(_LETTERS[name])
            while k < n and s[k] in " \t" and not (k + 1 < n and s[k + 1] == "{"):
                k += 1
            if k < n and s[k] == "[" and (g := _group(s, k, "[", "]")) is not None and s[g[1] : g[1] + 1] == "{":
                k = g[1]
            continue
        out.append(" " if c == "~" else "" if c in "{}" else c)
        k += 1
    return squeeze("".join(out).replace("$", ""))


_MACRO_HEAD = re.compile(
    r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand)\*?\s*(?:\{\s*\\([A-Za-z]+)\s*\}|\\([A-Za-z]+))\s*(?:\[(\d)\])?\s*(\[)?|\\g?def\s*\\([A-Za-z]+)((?:#\d)*)"
)


def _macros(s: str) -> tuple[dict[str, tuple[int, str | None, str]], str]:
    """User-defined commands (count of arguments, default of the first, body) and the source without their definitions."""
    defined: dict[str, tuple[int, str | None, str]] = {}
    out, at = [], 0
    while (m := _MACRO_HEAD.search(s, at)) is not None:
        line = s.rfind("\n", 0, m.start()) + 1
        default, after = None, m.end()
        if m.group(4) and (o := _group(s, m.end() - 1, "[", "]")) is not None:
            default, after = o
        body = None if re.search(r"(?<!\\)%", s[line : m.start()]) else _group(s, after)
        if body is None:
            out.append(s[at : m.end()])
            at = m.end()
            continue
        name = m.group(1) or m.group(2) or m.group(5)
        count = int(m.group(3) or 0) if not m.group(5) else len(m.group(6) or "") // 2
        defined[name] = (count, default, body[0].replace("\\xspace", ""))
        out.append(s[at : m.start()])
        at = body[1]
    return defined, "".join(out) + s[at:]


#: A source whose commands make more than this many times its length of it, and more than ``LEAST_GROWN``, is reported as an error.
GROWTH, LEAST_GROWN = 100, 10_000_000
_KNOWN = frozenset(("begin", "end", "item", "iffalse", "bibitem", "title", "author", "date", "usepackage", "documentclass", "documentstyle", "newtheorem", *_SECTIONS))
_AS_IT_STANDS = "|".join(re.escape(e) for e in (*_CODE_ENVS, *(x + star for x in _MATH_ENVS for star in ("", "*"))))
_EXPAND_EVENT = re.compile(
    r"\\begin\s*\{(?P<env>" + _AS_IT_STANDS + r")\}|(?P<comment>(?<!\\)%[^\n]*)|(?P<escape>\\[\\%$&#_{}~^])|\\verb\*?(?P<bar>[^\sA-Za-z*])"
    r"|(?P<math>\$\$|\$|\\\[|\\\()|\\(?P<name>[A-Za-z]+)"
)
_MATH_END = {"$$": "$$", "$": "$", "\\[": "\\]", "\\(": "\\)"}


def _expand(s: str, defined: dict[str, tuple[int, str | None, str]]) -> str:
    """The source with its own commands carried out; code, formulas and comments stay as written.

    The stack holds the texts being read, each the body of a command within the one below. A command that stands in
    its own body is left out there, so every expansion ends.
    """
    if not defined:
        return s
    out: list[str] = []
    frames: list[list] = [[s, 0, None]]
    active: set[str] = set()
    grown, most = 0, max(GROWTH * len(s), LEAST_GROWN)

    def leave() -> None:
        active.discard(frames.pop()[2])

    def argument(pair: str) -> str | None:
        while True:
            text, at, _ = frames[-1]
            if (g := _group(text, at, *pair)) is not None:
                frames[-1][1] = g[1]
                return g[0]
            if len(frames) == 1 or text[at:].strip():
                return None
            leave()  # the argument may stand after the command that ends here

    while frames:
        text, at, _ = frames[-1]
        m = _EXPAND_EVENT.search(text, at)
        if m is None:
            out.append(text[at:])
            leave()
            continue
        out.append(text[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name in defined and name not in _KNOWN:
            frames[-1][1] = at
            if name in active:
                continue
            count, default, body = defined[name]
            args: list[str] = []
            if default is not None and count:
                args.append(default if (o := argument("[]")) is None else o)
            while len(args) < count and (g := argument("{}")) is not None:
                args.append(g)
            put = re.sub(r"#(\d)", lambda d, a=args: a[int(d.group(1)) - 1] if 0 < int(d.group(1)) <= len(a) else "", body)
            grown += len(put)
            if grown > most:
                raise ValueError("commands expand without end")
            frames.append([put, 0, name])
            active.add(name)
            continue
        if m.group("env"):
            end = text.find("\\end{" + m.group("env") + "}", at)
            at = end if end >= 0 else at
        elif m.group("bar"):
            at = max(at, text.find(m.group("bar"), at) + 1)
        elif m.group("math"):
            end = text.find(_MATH_END[m.group("math")], at)
            at = end + len(m.group("math")) if end >= 0 else at
        out.append(text[m.start() : at])
        frames[-1][1] = at
    return "".join(out)


def read_latex(source: str, emit: Emit) -> None:
    defined, s = _macros(source)
    s = _expand(s, defined)
    begin = re.search(r"(?m)^(?:[^%\n]|\\%)*?\\begin\s*\{document\}", s)
    at = begin.end() if begin else 0
    levels: list[list[str] | None] = []  # the open item of each open list
    para: list[str] = []

    def text(t: str) -> None:
        (levels[-1] if levels and levels[-1] is not None else para).append(t)

    def end_item() -> None:
        if levels and levels[-1] is not None:
            if t := tex_text("".join(levels[-1])):
                emit("list_item", t)
            levels[-1] = None

    def end_para() -> None:
        if t := tex_text("".join(para)):
            emit("paragraph", t)
        para.clear()

    def until(pattern: str, start: int) -> tuple[str, int]:
        m = re.compile(pattern).search(s, start)
        return (s[start : m.start()], m.end()) if m else (s[start:], len(s))

    while at < len(s):
        m = _TEX_EVENT.search(s, at)
        if m is None:
            text(s[at:])
            break
        text(s[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if m.group("escape"):
            text(m.group())
        elif m.group("comment") is not None:
            text("\n" if "\n" in m.group() and s[at : at + 1] == "\n" else "")
        elif kind == "break":
            if not levels:
                end_para()
            else:
                text(" ")
        elif kind == "display":
            body, at = until(r"\\\]" if m.group() == "\\[" else r"\$\$", at)
            emit("formula", _formula(body))
        elif kind == "inline":
            body, end = until(r"(?<!\\)\$" if m.group() == "$" else r"\\\)", at)
            text("$" + body + "$")
            at = end
        elif m.group("verb"):
            body, at = until(re.escape(m.group("delimiter")), at)
            text(body.replace("\\", r"\textbackslash "))
        else:
            name, star = m.group("name"), m.group("star")
            if name == "begin" and (g := _group(s, at)) is not None:
                env, at = g[0].strip(), g[1]
                base = env.rstrip("*")
                if env in _CODE_ENVS:
                    if env != "verbatim" and (o := _group(s, at, "[", "]")) is not None and "\n" not in s[at : at + 1]:
                        at = o[1]
                    if env == "minted" and (o := _group(s, at)) is not None:
                        at = o[1]
                    body, at = until(r"\\end\{" + re.escape(env) + r"\}", at)
                    emit("code_block", squeeze(body))
                elif base in _MATH_ENVS:
                    body, at = until(r"\\end\s*\{" + re.escape(env) + r"\}", at)
                    emit("formula", _formula(body))
                elif env in ("comment", "thebibliography"):
                    _, at = until(r"\\end\s*\{" + env + r"\}", at)
                elif env in _LIST_ENVS:
                    if not levels:
                        end_para()
                    if (o := _group(s, at, "[", "]")) is not None:
                        at = o[1]
                    levels.append(None)
            elif name == "end" and (g := _group(s, at)) is not None:
                env, at = g[0].strip(), g[1]
                if env == "document":
                    break
                if env in _LIST_ENVS and levels:
                    end_item()
                    levels.pop()
            elif name == "item" and levels:
                end_item()
                levels[-1] = []
                if s[at : at + 1] == "[" and (o := _group(s, at, "[", "]")) is not None:
                    text(o[0] + " ")
                    at = o[1]
            elif name == "iffalse":
                _, at = until(r"\\fi(?![A-Za-z])", at)
            elif name == "bibitem":
                _, at = until(r"(?=\\bibitem|\\end\b)|\Z", at)
            elif name in _SECTIONS:
                if (o := _group(s, at, "[", "]")) is not None:
                    at = o[1]
                if (g := _group(s, at)) is not None:
                    if not levels:
                        end_para()
                    at = g[1]
                    emit("heading", tex_text(re.sub(r"(?<!\\)%[^\n]*", "", g[0])))
            elif name in ("title", "author", "date", "usepackage", "documentclass", "documentstyle", "newtheorem"):
                while (o := _group(s, at, "[", "]")) is not None:
                    at = o[1]
                if (g := _group(s, at)) is not None:
                    at = g[1]
            else:
                text("\\" + name + star)
    while levels:
        end_item()
        levels.pop()
    end_para()


def _formula(body: str) -> str:
    body = re.sub(r"(?<!\\)%[^\n]*", "", body)
    body = re.sub(r"\\label\s*\{[^{}]*\}", "", body)
    return squeeze(re.sub(r"\\(?:nonumber|notag)(?![A-Za-z])", "", body))


# --- HTML ------------------------------------------------------------------------------------

_BLOCKS = frozenset("p div section article main header footer table tr td th blockquote figure figcaption dl dt dd hr br form address".split())
_HIDDEN = frozenset("script style head title template noscript".split())
_SHOWN_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)


class _Html(HTMLParser):
    def __init__(self, emit: Emit) -> None:
        super().__init__(convert_charrefs=True)
        self.emit = emit
        self.hidden: list[str] = []
        self.lists: list[list[str] | None] = []
        self.heading: list[str] | None = None
        self.code: list[str] | None = None
        self.pre = 0
        self.math: list[str] | None = None
        self.para: list[str] = []

    def flush(self) -> None:
        raw = "".join(self.para)
        self.para.clear()
        for m in _SHOWN_MATH.finditer(raw):
            self.emit("formula", _formula(m.group(1) or m.group(2)))
        if t := squeeze(_SHOWN_MATH.sub(" ", raw)):
            self.emit("paragraph", t)

    def end_item(self) -> None:
        if self.lists and self.lists[-1] is not None:
            raw = "".join(self.lists[-1])
            self.lists[-1] = None
            for m in _SHOWN_MATH.finditer(raw):
                self.emit("formula", _formula(m.group(1) or m.group(2)))
            if t := squeeze(_SHOWN_MATH.sub(" ", raw)):
                self.emit("list_item", t)

    def end_heading(self) -> None:
        if self.heading is not None:
            if t := squeeze("".join(self.heading)):
                self.emit("heading", t)
            self.heading = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        got = {k: v or "" for k, v in attrs}
        if self.hidden:
            if tag == self.hidden[-1] and tag not in ("head",):
                self.hidden.append(tag)
            elif self.hidden == ["head"] and tag == "body":
                self.hidden.clear()
            return
        if tag in _HIDDEN or (("hidden" in got or "display:none" in got.get("style", "").replace(" ", "")) and tag not in ("br", "hr", "img", "input")):
            self.hidden.append(tag)
        elif re.fullmatch(r"h[1-6]", tag):
            self.end_heading()
            self.flush()
            self.heading = []
        elif tag in ("ul", "ol", "menu"):
            self.flush()
            self.lists.append(None)
        elif tag == "li":
            self.flush()
            if not self.lists:
                self.lists.append(None)
            self.end_item()
            self.lists[-1] = []
        elif tag in ("pre", "listing", "xmp"):
            self.flush()
            self.pre += 1
            self.code = self.code if self.code is not None else []
        elif tag == "math" and got.get("display") == "block":
            self.math = []
        elif tag in _BLOCKS:
            if tag in ("p", "div", "section", "table"):
                self.end_heading()
            if self.lists and self.lists[-1] is not None:
                self.lists[-1].append(" ")
            else:
                self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.end_heading()
        elif tag in ("ul", "ol", "menu") and self.lists:
            self.end_item()
            self.lists.pop()
        elif tag == "li":
            self.end_item()
        elif tag in ("pre", "listing", "xmp") and self.pre:
            self.pre -= 1
            if not self.pre:
                self.end_code()
        elif tag == "math" and self.math is not None:
            self.emit("formula", _formula("".join(self.math)))
            self.math = None
        elif tag in _BLOCKS:
            if self.lists and self.lists[-1] is not None:
                self.lists[-1].append(" ")
            else:
                self.flush()

    def end_code(self) -> None:
        if self.code is not None:
            if t := squeeze("".join(self.code)):
                self.emit("code_block", t)
            self.code = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.code is not None:
            self.code.append(data)
        elif self.math is not None:
            self.math.append(data)
        elif self.heading is not None:
            self.heading.append(data)
        elif self.lists and self.lists[-1] is not None:
            self.lists[-1].append(data)
        else:
            self.para.append(data)

    def finish(self) -> None:
        self.close()
        self.pre = 0
        self.end_code()
        self.end_heading()
        while self.lists:
            self.end_item()
            self.lists.pop()
        self.flush()


def read_html(source: str, emit: Emit) -> None:
    parser = _Html(emit)
    parser.feed(source)
    parser.finish()


# --- Markdown --------------------------------------------------------------------------------

_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_MD_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_MD_ITEM = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+(?=\S)|[ \t]*$)")
_MD_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")


def md_text(s: str) -> str:
    """Text of a Markdown fragment without inline markup."""
    kept: list[str] = []

    def keep(t: str) -> str:
        kept.append(t)
        return f"\0{len(kept) - 1}\1"

    s = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m.group(2).strip()), s, flags=re.S)
    s = _MD_ESCAPE.sub(lambda m: keep(m.group(1)), s)
    s = re.sub(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"!?\[([^\[\]]*)\]\[[^\[\]]*\]", r"\1", s)
    s = re.sub(r"<((?:https?|mailto):[^<>\s]+)>", r"\1", s)
    s = re.sub(r"</?[A-Za-z][^<>]*>", "", s)
    s = re.sub(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", s, flags=re.S)
    s = re.sub(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", s, flags=re.S)
    s = re.sub(r"~~(?=\S)(.+?)~~", r"\1", s)
    s = unescape(s)
    while "\0" in s:
        s = re.sub("\0(\\d+)\1", lambda m: kept[int(m.group(1))], s)
    return squeeze(s)


def read_markdown(source: str, emit: Emit) -> None:
    s = re.sub(r"<!--.*?(?:-->|\Z)", lambda m: "\n" * m.group().count("\n"), source, flags=re.S) if "```" not in source and "~~~" not in source else source
    lines = s.split("\n")
    para: list[str] = []
    item: list[str] | None = None
    item_at, blank, k, comment = 0, True, 0, False

    def end() -> None:
        nonlocal item
        if item is not None:
            if t := md_text(" ".join(item)):
                emit("list_item", t)
            item = None
        if t := md_text(" ".join(para)):
            emit("paragraph", t)
        para.clear()

    while k < len(lines):
        line = lines[k]
        k += 1
        bare = line.strip()
        if comment:
            comment = "-->" not in line
            continue
        indented = len(line) - len(line.lstrip(" ")) if not line.startswith("\t") else 4
        if (f := _MD_FENCE.match(line if item is None else line.lstrip())) is not None:
            end()
            body = []
            while k < len(lines) and not re.match(r"^\s*" + re.escape(f.group(2)[0]) + "{" + str(len(f.group(2))) + r",}\s*$", lines[k]):
                body.append(lines[k])
                k += 1
            k += 1
            if t := squeeze(" ".join(body)):
                emit("code_block", t)
            blank = False
        elif bare.startswith("<!--"):
            end()
            comment = "-->" not in line
        elif bare.startswith("$$"):
            end()
            body = bare[2:]
            while "$$" not in body and k < len(lines):
                body += "\n" + lines[k]
                k += 1
            emit("formula", _formula(body.split("$$")[0]))
        elif not bare:
            if item is None:
                end()
            blank = True
            continue
        elif indented >= 4 and blank and item is None and not para:
            body = [line]
            while k < len(lines) and (not lines[k].strip() or lines[k].startswith(("    ", "\t"))):
                body.append(lines[k])
                k += 1
            emit("code_block", squeeze(" ".join(body)))
        elif (h := re.match(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)) is not None:
            end()
            if t := md_text(h.group(2) or ""):
                emit("heading", t)
        elif re.match(r"^ {0,3}(=+|-+)[ \t]*$", line) and para and item is None:
            emit("heading", md_text(" ".join(para)))
            para.clear()
        elif _MD_RULE.match(line):
            end()
        elif (m := _MD_ITEM.match(line)) is not None and (not para or item is not None):
            end()
            item, item_at = [line[m.end() :]], m.end()
        elif item is not None and (not blank or indented >= min(2, item_at)):
            item.append(bare)
        else:
            if item is not None:
                end()
            para.append(bare)
        blank = False
    end()


# --- Wiki ------------------------------------------------------------------------------------


def wiki_text(s: str) -> str:
    """Text of a wiki fragment without inline markup."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group(1))
        return f"\0{len(kept) - 1}\1"

    s = re.sub(r"<nowiki>(.*?)</nowiki>", keep, s, flags=re.S)
    s = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", s, flags=re.S)
    while (t := re.sub(r"\{\{[^{}]*\}\}", "", s)) != s:
        s = t
    s = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]]*)\]", r"\1", s)
    s = re.sub(r"'{2,5}", "", s)
    s = re.sub(r"</?[A-Za-z][^<>]*>", "", s)
    s = unescape(s)
    return squeeze(re.sub("\0(\\d+)\1", lambda m: unescape(kept[int(m.group(1))]), s))


_WIKI_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<code>syntaxhighlight|source|pre)\b[^<>]*>(?P<body>.*?)(?:</(?P=code)>|\Z)"
    r"|(?P<math>^:+[ \t]*<math\b[^<>]*>|<math\b[^<>]*display=[\"']?block[^<>]*>)(?P<formula>.*?)(?:</math>|\Z)|(?P<nowiki><nowiki>.*?</nowiki>)",
    re.S | re.M | re.I,
)


def read_wiki(source: str, emit: Emit) -> None:
    parts: list[tuple[str, str]] = []

    def lift(m: re.Match) -> str:
        if m.group("nowiki"):
            return m.group()
        if m.group("code"):
            parts.append(("code_block", squeeze(unescape(m.group("body")) if m.group("code").lower() == "pre" else m.group("body"))))
        elif m.group("math"):
            parts.append(("formula", _formula(unescape(m.group("formula")))))
        else:
            return ""
        return f"\n\2{len(parts) - 1}\2\n"

    para: list[str] = []

    def end() -> None:
        if t := wiki_text(" ".join(para)):
            emit("paragraph", t)
        para.clear()

    for line in _WIKI_PART.sub(lift, source).split("\n"):
        bare = line.strip()
        if (m := re.fullmatch("\2(\\d+)\2", bare)) is not None:
            end()
            kind, t = parts[int(m.group(1))]
            if t:
                emit(kind, t)
        elif (m := re.fullmatch(r"(={1,6})[ \t]*(.+?)[ \t]*\1", bare)) is not None:
            end()
            emit("heading", wiki_text(m.group(2)))
        elif (m := re.match(r"[*#]+[:;]*|[:;]+[*#]+", line)) is not None:
            end()
            if t := wiki_text(line[m.end() :]):
                emit("list_item", t)
        elif not bare:
            end()
        else:
            para.append(bare)
    end()


# --- Choice ----------------------------------------------------------------------------------

_ASIDE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|source|syntaxhighlight)\b.*?(?:</\1>|\Z)|\\begin\{(verbatim\*?|lstlisting)\}.*?(?:\\end\{\2\}|\Z)", re.S | re.I)
_SIGNS = (
    ("latex", re.compile(r"\\(?:documentclass|documentstyle|usepackage|begin\s*\{|end\s*\{|(?:sub)*section|chapter|item(?![A-Za-z])|cite\{|ref\{|emph\{|text[a-z]{2}\{|\[)|\{\\bf ")),
    ("html", re.compile(r"</?(?:html|body|head|p|ul|ol|li|h[1-6]|div|span|em|b|a|br|table|td|tr)\b[^<>]*>", re.I)),
    ("wiki", re.compile(r"(?m)^={2,6}[^=\n].*={2,6}[ \t]*$|\[\[|'''|''|<nowiki>|<math\b|<(?:source|syntaxhighlight)\b|\{\{")),
    ("markdown", re.compile(r"(?m)\]\([^()\s]*\)|\*\*\w|```|~~~|^(?:=+|-{2,})[ \t]*$|`\w|\\[_*]|^\$\$")),
)
_READERS = {"latex": read_latex, "html": read_html, "wiki": read_wiki, "markdown": read_markdown}


def markup_of(body: str) -> str:
    """The markup whose signs are most frequent outside code; plain text counts as Markdown."""
    rest = _ASIDE.sub(lambda m: m.group()[:20], body)
    scores = [(len(p.findall(rest)), -k, name) for k, (name, p) in enumerate(_SIGNS)]
    best = max(scores)
    return best[2] if best[0] else "markdown"


def elements(body: str | None) -> list[tuple[str, str]]:
    """The elements of a file in order, paragraphs included; none for a null or blank one.

    A reader that fails leaves what it had read and an element ``error`` with the failure's name.
    """
    out: list[tuple[str, str]] = []
    if not body or body.isspace():
        return out
    body = body.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    try:
        _READERS[markup_of(body)](body, lambda kind, item: out.append((kind, item)) if item else None)
    except (RecursionError, ValueError, AssertionError) as e:
        out.append(("error", type(e).__name__))
    return out


_RESIDUE = re.compile(
    r"\\[A-Za-z]+|\\\\(?=\s|$)|\\[\[\]()%&#_$]|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});"
    r"|\[[^\[\]\n]*\]\([^()\s]+\)|\*\*[^\s*][^*\n]*\*\*|(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])|__[^\s_][^_\n]*__|```|(?<!`)`[^`\s][^`\n]*`(?!['`])"
    r"|\[\[[^\[\]\n]+\]\]|'''|(?<!')''(?!')\w[^'\n]*\w(?<!')''(?!')|\{\{[^{}\n]+\}\}|(?m:^={2,6} ?[^=\n]+={2,6}\s*$)|\{\\[a-z]+ "
)


#: A path of drive and folders, whose backslashes are no commands.
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:(?:\\[\w.-]+)+\\?(?![\w{\[])")


def has_residue(body: str | None) -> bool:
    """Whether a detexed text still holds markup; the project's own marks, plain signs and paths of files are none."""
    return bool(body) and _RESIDUE.search(_PATH.sub(" ", body) if ":\\" in body else body) is not None


_MARKS = {"cite": "[CITATION]", "citep": "[CITATION]", "citet": "[CITATION]", "ref": "[REF]", "eqref": "[REF]", "pageref": "[REF]"}
_KEPT = re.compile(r"```.*?(?:```|\Z)|\$\$.+?\$\$", re.S)
_GONE = "\0"
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?[ \t]*(?:\[[^\[\]\n]*\][ \t]*)?\{([^{}]*)\}(?:\{([^{}]*)\})?")
_INLINE = (
    (re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1>|\Z)", re.S | re.I), _GONE),
    (re.compile(r"\$(?!\$)(?=[^$\n]*\\[A-Za-z])[^$\n]+\$|\\\(.+?\\\)"), "[MATH]"),
    (re.compile(r"\{\{\s*cit[^{}\n]*\}\}", re.I), "[CITATION]"),
    (re.compile(r"\{\{[^{}\n]+\}\}|\[\[(?:File|Image|Category):[^\[\]\n]*\]\]"), _GONE),
    (re.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n]+)\]\]"), r"\1"),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+\)"), r"\1"),
    (re.compile(r"(?m)^(={2,6}) ?([^=\n]+?) ?=+[ \t]*$"), lambda m: "#" * len(m.group(1)) + f" {m.group(2).strip()}"),
    (re.compile(r"'{3}"), ""),
    (re.compile(r"(?<!')''(?!')(\w[^'\n]*\w)(?<!')''(?!')"), r"\1"),
    (re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"), ""),
    (re.compile(r"\*\*([^\s*][^*\n]*)\*\*"), r"\1"),
    (re.compile(r"(?<![\w*])\*([^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])"), r"\1"),
    (re.compile(r"__([^\s_][^_\n]*)__"), r"\1"),
    (re.compile(r"(?<!`)`([^`\s][^`\n]*)`(?!['`])"), r"\1"),
    (re.compile(r"\\\\(?=\s|$)"), _GONE),
)


def _command(m: re.Match) -> str:
    name, one, two = m.groups()
    if name in _SECTIONS:
        return f"# {one}"
    if name in _MARKS:
        return _MARKS[name]
    if name in _LATER and two is not None:
        return two
    return _GONE if name in _DROPPED or name in ("begin", "end") else one + ("" if two is None else f"{{{two}}}")


def clean_residue(body: str) -> str:
    """A detexed text without the inline markup left in it: only that is taken out, whatever kinds of it are
    mixed, and all else stays as it stands, the project's marks and headings too. Inline mathematics, citations
    and references become such marks; fenced code and formulas between double dollars stay."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group())
        return f"\1{len(kept) - 1}\2"

    s = _KEPT.sub(keep, re.sub("[\0\1\2]", "", body))
    for pattern, by in _INLINE:
        s = pattern.sub(by, s)
    s = _ACCENT.sub(lambda m: tex_text(m.group()), s)
    while (t := _COMMAND.sub(_command, s)) != s:
        s = t
    while (t := re.sub(r"\{\\[a-z]+ ([^{}]*)\}", r"\1", s)) != s:
        s = t
    s = re.sub(r"\\([%&#_$])", r"\1", s)
    s = re.sub(r"\\([A-Za-z]+)\*?", lambda m: _LETTERS.get(m.group(1), _GONE), s)
    s = re.sub(r"(?m)^(?:[ \t]*\0)+[ \t]*", "", s)
    s = re.sub(r"(?:[ \t]*\0)+(?=[ \t]*(?:[.,;:!?)\n]|\Z))", "", s)
    s = re.sub(r"[ \t]*(?:\0[ \t]*)+", " ", s)
    s = re.sub(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});", lambda m: unescape(m.group()).replace("\xa0", " "), s)
    return re.sub("\1(\\d+)\2", lambda m: kept[int(m.group(1))], s)


def _files(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(files.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null"))


def read_elements(files: DataFrame, id_col: str = "file_id", text_col: str = "body") -> DataFrame:
    """``(id, place, kind, item)``: the elements of every file in order, paragraphs included.

    Null, empty and blank bodies and null ids give no row; a file that is cut off gives what
    was begun. Repeated rows give their elements each time. Where a reader fails, what it had read
    stays, and a row of kind ``error`` names the failure. Files are read whole; nothing is shuffled.
    """
    src = _files(files, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, kinds, items = [], [], [], []
            for k, body in enumerate(b.column("t").to_pylist()):
                for n, (name, item) in enumerate(elements(body)):
                    rows.append(k)
                    places.append(n)
                    kinds.append(name)
                    items.append(item)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(kinds, pa.string()), pa.array(items, pa.string())],
                names=[id_col, "place", "kind", "item"],
            )

    return src.mapInArrow(run, f"`{id_col}` {kind}, place int, kind string, item string")


def residue_files(files: DataFrame, id_col: str = "file_id", text_col: str = "body") -> DataFrame:
    """Ids of the texts that still hold markup, each once; null ids and bodies give no row."""
    src = _files(files, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array([has_residue(t) for t in b.column("t").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(hit)], names=[id_col])

    return src.mapInArrow(run, f"`{id_col}` {kind}").distinct()


def cleaned_files(files: DataFrame, id_col: str = "file_id", text_col: str = "body") -> DataFrame:
    """``(id, text)``: detexed texts without the markup left in them; those that hold none stand as they are.

    Null, empty and blank bodies and null ids give no row.
    """
    src = _files(files, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            full = pa.array([bool(t) and not t.isspace() for t in texts], pa.bool_())
            clean = pa.array([clean_residue(t) if has_residue(t) else t for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(full), clean.filter(full)], names=[id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")


def clean_text(read: DataFrame, id_col: str = "file_id") -> DataFrame:
    """``(id, text)``: each file's clean text from its elements, blank lines between them; errors are no text."""
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("# "), "item"))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), "item"))
        .when(F.col("kind") == "code_block", F.concat(F.lit("```\n"), "item", F.lit("\n```")))
        .when(F.col("kind") == "formula", F.concat(F.lit("$$"), "item", F.lit("$$")))
        .otherwise(F.col("item"))
    )
    return (
        read.where("kind != 'error'").groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("s")))).alias("es"))
        .select(id_col, F.array_join(F.transform("es", lambda e: e["s"]), "\n\n").alias("text"))
    )
