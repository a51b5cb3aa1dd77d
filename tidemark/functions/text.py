"""Scalar text operators as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of detexed text and the ASCII punctuation string.
TAGS = ("[MATH]", "[EQUATION]", "[CITATION]", "[REF]")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Abbreviations after which a split is undone, and marks that may follow them.
FALSE_SUFFIXES = (
    "Fig.", "Figs.", "fig.", "figs.", "Sec.", "Secs.", "sec.", "secs.", "Sect.", "Sects.", "sect.", "sects.", "Ref.", "Refs.", "ref.",
    "refs.", "Eq.", "Eqs.", "eq.", "eqs.", "Eqn.", "Eqns.", "eqn.", "eqns.", "et al.", "resp.", "Table.",
)
FALSE_MARKS = (".", "(", "[")
_BLANK = "[ \\t\\n\\r]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flatten_once(x: Column | str) -> Column:
    """One level of nesting less."""
    return F.flatten(_c(x))


def paragraphs_to_lines(paragraphs: Column | str) -> Column:
    """Lines of all paragraphs, a blank line after each."""
    return F.flatten(F.transform(_c(paragraphs), lambda p: F.concat(p, F.array(F.lit("")))))


def tokens(x: Column | str) -> Column:
    """Tokens between white space; none for a blank text, null for a null one."""
    return F.filter(F.split(_c(x), _BLANK), lambda w: w != "")


def words(x: Column | str) -> Column:
    """Tokens but those that are a substring of the punctuation string (``()``, ``<=>``; not ``--``)."""
    return F.filter(tokens(x), lambda w: F.instr(F.lit(PUNCTUATION), w) == 0)


def n_grams(ws: Column | str, n: int) -> Column:
    """All n-grams of a word array, joined by a space; none for fewer than n words."""
    ws = _c(ws)
    grams = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, grams).otherwise(F.array().cast("array<string>"))


def n_grams_up_to(ws: Column | str, n: int) -> Column:
    """All n-grams of length 1 to n."""
    return F.concat(*[n_grams(ws, k) for k in range(1, n + 1)])


def is_title(x: Column | str) -> Column:
    return _c(x).rlike("^#+ .")


def is_title_or_newline(x: Column | str) -> Column:
    return (_c(x) == "") | is_title(x)


def tag_count(x: Column | str) -> Column:
    """How often one of the four marks stands in the text."""
    x = _c(x)
    return sum((((F.length(x) - F.length(F.replace(x, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in TAGS), F.lit(0))


def without_tags(x: Column | str) -> Column:
    x = _c(x)
    for t in TAGS:
        x = F.replace(x, F.lit(t), F.lit(" "))
    return x


def real_words(x: Column | str) -> Column:
    """Words that are neither a mark nor a number."""
    return F.filter(words(x), lambda w: ~w.isin(*TAGS) & ~w.rlike("^\\p{N}+$"))


def word_counts(x: Column | str) -> Column:
    """``struct<n, r>``: how many words and how many real words, in one pass over the tokens."""

    def step(acc: Column, w: Column) -> Column:
        word = (w != "") & (F.instr(F.lit(PUNCTUATION), w) == 0)
        real = word & ~w.isin(*TAGS) & ~w.rlike("^\\p{N}+$")
        return F.struct((acc["n"] + word.cast("int")).alias("n"), (acc["r"] + real.cast("int")).alias("r"))

    return F.aggregate(F.split(_c(x), _BLANK), F.struct(F.lit(0).alias("n"), F.lit(0).alias("r")), step)


def sent_filter(x: Column | str) -> Column:
    """Whether a sentence is worth aligning: a title, or more than three real words, fewer marks than
    half its words, and more than 0.7 of its characters letters or marks."""
    x = _c(x)
    tags = tag_count(x)
    bare = without_tags(x)
    nonspace = F.length(F.replace(bare, F.lit(" "), F.lit("")))
    alpha = F.length(F.regexp_replace(bare, "[^\\p{L}]+", ""))
    worded = F.transform(F.array(word_counts(x)), lambda c: (c["r"] > 3) & (tags < 0.5 * c["n"]))
    letters = (nonspace > 0) & ((alpha + tags) > 0.7 * (nonspace + tags))
    return F.when(is_title(x), True).otherwise(letters & F.element_at(worded, 1))


def is_boring(x: Column | str) -> Column:
    """Empty, or a title, or not worth aligning."""
    return (_c(x) == "") | is_title(x) | ~sent_filter(x)


def split_on_tag(x: Column | str, tag: str = "[EQUATION]") -> Column:
    """Parts of a text, split after the tag where a capital follows."""
    quoted = "\\Q" + tag + "\\E"
    return F.split(F.regexp_replace(_c(x), f"({quoted})\\s*(?=[A-Z])", "$1\u0001"), "\u0001")


def join_false_splits(sentences: Column | str) -> Column:
    """Sentences with false splits undone, folded in order: one that ends with an abbreviation takes
    the next one to it, once without a mark that stands on both sides; a lone full stop is dropped;
    spaces are collapsed."""
    suffixes = "(?:" + "|".join("\\Q" + x + "\\E" for x in FALSE_SUFFIXES) + ")"

    def fold(acc: Column, s: Column) -> Column:
        s = F.trim(F.regexp_replace(s, _BLANK, " "))
        last = F.element_at(acc, -1)
        doubled = F.lit(False)
        for mark in FALSE_MARKS:
            doubled = doubled | (last.endswith(mark) & s.startswith(mark))
        doubled = doubled & last.rlike(suffixes + "[.(\\[]$")
        merged = F.when(doubled, F.concat(last, F.substr(s, F.lit(2)))).otherwise(F.concat_ws(" ", last, s))
        joins = doubled | last.rlike(suffixes + "$")
        return F.when((s == ".") | (s == ""), acc).when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(s)))

    # An empty array has no last element: the fold starts from a padded one, dropped again.
    folded = F.aggregate(_c(sentences), F.array(F.lit("\u0002")), fold)
    return F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0)))


_SPLIT_AT = "([.!?][)\\]\"'”’]*)[ \\t\\n\\r]+([(\\[\"'“‘]*\\p{Lu})"
_SPLIT_TAG = "(\\[EQUATION\\])[ \\t\\n\\r]*([A-Z])"


def ssplit(paragraph: Column | str) -> Column:
    """Sentences of a paragraph: split after a terminator or a displayed formula where a capital follows, false splits undone."""
    marked = F.regexp_replace(F.regexp_replace(_c(paragraph), _SPLIT_AT, "$1\u0001$2"), _SPLIT_TAG, "$1\u0001$2")
    return join_false_splits(F.split(marked, "\u0001"))


def preprocess_sent(x: Column | str) -> Column:
    """Tokens joined by single spaces, marks kept whole, punctuation parted from words."""
    x = F.regexp_replace(_c(x), "([^\\p{L}\\p{N}\\s])", " $1 ")
    for t in TAGS:
        x = F.regexp_replace(x, "\\[\\s+" + t[1:-1] + "\\s+\\]", "[" + t[1:-1] + "]")
    return F.trim(F.regexp_replace(x, _BLANK, " "))


def remove_nullbytes(x: Column | str) -> Column:
    return F.translate(_c(x), "\u0000", "")


def reduce_inline_math(x: Column | str) -> Column:
    """Newlines to spaces, ``$$...$$`` away (to the last pair), ``$x$`` of one character or a number to its inside."""
    x = F.regexp_replace(F.regexp_replace(_c(x), "\\n", " "), "(?s)\\$\\$.*\\$\\$", "")
    return F.regexp_replace(x, "\\$ *([^$ ]|[0-9]+(?:\\.[0-9]+)?) *\\$", "$1")


def remove_comments(x: Column | str) -> Column:
    """Unescaped ``%`` to the end of the line away."""
    return F.regexp_replace(_c(x), "(?m)(?<!\\\\)%[^\\n]*", "")


def collapse_tags(x: Column | str) -> Column:
    """Runs of one mark parted by white space become one mark."""
    x = _c(x)
    for t in ("MATH", "EQUATION"):
        x = F.regexp_replace(x, f"\\[{t}\\](?:[ \\t\\n\\r]+\\[{t}\\])+", f"[{t}]")
    return x


def section_marks(x: Column | str) -> Column:
    """``\\section{x}`` and its five deeper kinds as lines of as many ``#``."""
    x = _c(x)
    for depth in range(6, 0, -1):
        x = F.regexp_replace(x, "\\\\" + "sub" * (depth - 1) + "section\\*?\\{([^{}]*)\\}", "#" * depth + " $1")
    return x


def id_to_path(arxiv_id: Column | str) -> Column:
    return F.replace(_c(arxiv_id), F.lit("/"), F.lit("-"))


#: Where the files of a version, and of a version pair, are kept below the data folder.
VERSION_FILES = {
    "source": "extra/{id}-v{v}.gz", "text": "extra/{id}-v{v}.txt", "latex": "extra/{id}-v{v}-original.tex", "sentences": "{id}-v{v}-sentences.txt", "pdf": "{id}-v{v}.pdf",
}
PAIR_FILES = {"alignment": "{id}-v{v1}-v{v2}.csv", "machine": "{id}-v{v1}-v{v2}.csv", "annotation": "{id}-v{v1}-v{v2}-({n}-unaligned-sents).csv"}


def version_file(arxiv_id: Column | str, version: Column | str, kind: str, root: str = "") -> Column:
    """Path of one of a version's files."""
    own = id_to_path(arxiv_id)
    path = F.replace(F.replace(F.lit(f"{{id}}/v{{v}}/{VERSION_FILES[kind]}"), F.lit("{id}"), own), F.lit("{v}"), _c(version).cast("string"))
    return F.concat(F.lit(root), path)


def pair_file(arxiv_id: Column | str, v1: Column | str, v2: Column | str, kind: str, n: Column | str | None = None) -> Column:
    """File name of a version pair; null where the versions are not in order."""
    name = F.replace(F.lit(PAIR_FILES[kind]), F.lit("{id}"), id_to_path(arxiv_id))
    for mark, value in (("{v1}", v1), ("{v2}", v2), *((("{n}", n),) if n is not None else ())):
        name = F.replace(name, F.lit(mark), _c(value).cast("string"))
    return F.when(_c(v1) < _c(v2), name)


def compare_command(arxiv_id: Column | str, v1: Column | str, v2: Column | str, tool: str = "code --diff") -> Column:
    """The command that shows the sentence files of two versions side by side."""
    return F.concat_ws(" ", F.lit(tool), version_file(arxiv_id, v1, "sentences"), version_file(arxiv_id, v2, "sentences"))


def merge_maps(first: Column | str, *more: Column | str) -> Column:
    """Maps merged; a key's value is that of the last map that has the key."""

    def both(out: Column, m: Column) -> Column:
        return F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(m, k)), m)

    out = _c(first)
    for m in more:
        out = both(out, _c(m))
    return out


def transpose(rows: Column | str) -> Column:
    """Rows and columns of an array of arrays exchanged, cut to the shortest row."""
    rows = _c(rows)
    width = F.array_min(F.transform(rows, F.size))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.transform(rows, lambda r: F.get(r, k)))).otherwise(F.slice(rows, 1, 0))


def sentence_id(text: Column | str) -> Column:
    """``{id}-v{version}-{p}-{s}`` as a struct; nulls where the text is not one."""
    pattern = "^(.*)-v?(\\d+)-(\\d+)-(\\d+)$"
    part = lambda k: F.regexp_extract(_c(text), pattern, k)
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    return F.struct(
        F.when(part(2) != "", part(1)).alias("arxivid"), number(2).alias("version"), number(3).alias("p"), number(4).alias("s")
    )


def format_sentence_id(arxivid: Column | str, version: Column | str, p: Column | str, s: Column | str) -> Column:
    return F.concat(_c(arxivid), F.lit("-v"), _c(version), F.lit("-"), _c(p), F.lit("-"), _c(s))


def f_mean(a: Column | str, b: Column | str, beta: float = 1.0) -> Column:
    """Weighted harmonic mean; 0 where both are 0."""
    a, b = _c(a), _c(b)
    return F.when(a + b == 0, 0.0).otherwise((1 + beta * beta) * a * b / (beta * beta * a + b))


def color_code(v: Column | str) -> Column:
    """White for -1, red for 1, else a shade of red."""
    v = _c(v)
    shade = F.concat(F.lit("rgb("), F.floor(v * 255).cast("string"), F.lit(",0,0)"))
    return F.when(v == -1, "#ffffff").when(v == 1, "#ff0000").otherwise(shade)


def day_delta(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from one time to another, rounded down (12 hours back is -1)."""
    return F.floor((F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / 86_400_000_000).cast("int")


def unescape_brackets(token: Column | str) -> Column:
    """Treebank bracket tokens as brackets."""
    t = _c(token)
    for name, mark in (("LRB", "("), ("RRB", ")"), ("LSB", "["), ("RSB", "]"), ("LCB", "{"), ("RCB", "}")):
        t = F.when(t == f"-{name}-", mark).otherwise(t)
    return t


#: Exact MIME types of file kinds.
MIME_KINDS = {
    "application/gzip": "gzip", "text/x-tex": "tex", "text/plain": "text", "application/x-tar": "tar", "application/pdf": "pdf",
    "application/postscript": "postscript",
}


def file_type(mime: Column | str, raw: Column | str) -> Column:
    """Kind of a downloaded file: by its exact MIME type, then by hints in the sniffed description."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in MIME_KINDS.items() for x in kv]), _c(mime))
    raw = _c(raw)
    hint = F.when(_c(mime).contains("image"), "image").when(raw.contains("EPS"), "eps").when(raw.contains("gzip") & raw.contains("gz"), "gzip")
    return F.coalesce(kind, hint, F.lit("unknown"))


def content_type(body: Column | str) -> Column:
    """Kind of a text body by its own signs."""
    b = F.lower(_c(body))
    return (
        F.when(_c(body).isNull(), "missing").when(F.trim(b) == "", "empty").when(b.startswith("%pdf"), "pdf").when(b.startswith("%!ps"), "postscript")
        .when(b.contains("<html") | b.contains("<!doctype html"), "html")
        .when(b.contains("\\documentclass") | b.contains("\\documentstyle") | b.contains("\\begin{document}"), "tex").otherwise("text")
    )


#: Annotation labels and the reasons they stand for.
REASONS = {
    "info missing": "elaboration", "elaboration": "elaboration", "too much info": "simplification", "simplification": "simplification",
    "inappropriate style": "style", "style": "style", "detex": "detex", "error": "error", "mistake": "error", "word usage": "style",
    "formatting": "formatting", "more info required": "more info required", "more info needed": "more info required",
    "pdf required": "more info required", "odf required": "more info required", "domain knowledge": "more info required",
    "other": "other", "not true": "truth", "truth": "truth",
}
BAD_LABELS = ("domain knowledge", "pdf required")


def label_reason(label: Column | str) -> Column:
    """The reason a label stands for; an unknown label in lower case."""
    low = F.lower(_c(label))
    pairs = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.element_at(pairs, low), low)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all distinct elements of two arrays; 0 where either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
