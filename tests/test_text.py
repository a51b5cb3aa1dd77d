import pytest
from pyspark.sql import functions as F

from tidemark.functions import detex as D
from tidemark.functions import text as X
from tidemark.sources import tables as T


def one(spark, value, *exprs, schema="x string"):
    return tuple(spark.createDataFrame([(value,)], schema).select(*[e.alias(f"c{k}") for k, e in enumerate(exprs)]).first())


@pytest.mark.parametrize(
    "text, good",
    [
        ("[MATH], [MATH] and more [MATH].", False),
        ("[MATH], [EQUATION] and more [MATH] consistently demonstrate that we have enough words to pass this test.", True),
        ("## Section Title", True),
        ("three real words", False),
        ("four real words here", True),
        ("   ", False),
        ("1 2 3 4 5 6", False),
        ("((( ))) ;;; === +++ *** a b c d", False),
    ],
)
def test_sent_filter(spark, text, good):
    got, boring = one(spark, text, X.sent_filter("x"), X.is_boring("x"))
    assert got is good
    assert boring is (not good or text.startswith("#"))


def test_words_drop_substrings_of_punctuation(spark):
    assert one(spark, "a () <=> -- ... b,", X.words("x"))[0] == ["a", "--", "...", "b,"]
    assert one(spark, "", X.words("x"))[0] == []
    assert one(spark, None, X.words("x"))[0] is None


def test_n_grams(spark):
    assert one(spark, ["a", "b", "c"], X.n_grams("x", 2), X.n_grams("x", 4), X.n_grams_up_to("x", 2), schema="x array<string>") == (
        ["a b", "b c"], [], ["a", "b", "c", "a b", "b c"],
    )


@pytest.mark.parametrize(
    "text, parts",
    [
        ("We see [EQUATION] The next", ["We see [EQUATION]", "The next"]),
        ("We see [EQUATION] the next", ["We see [EQUATION] the next"]),
        ("[EQUATION]", ["[EQUATION]"]),
        ("A [EQUATION] b [EQUATION] C", ["A [EQUATION] b [EQUATION]", "C"]),
    ],
)
def test_split_on_tag(spark, text, parts):
    assert one(spark, text, X.split_on_tag("x"))[0] == parts


def test_join_false_splits(spark):
    f = lambda xs: one(spark, xs, X.join_false_splits("x"), schema="x array<string>")[0]
    assert f(["In Fig.", "1, you can see this."]) == ["In Fig. 1, you can see this."]
    assert f(["A  b.", ".", "C."]) == ["A b.", "C."]
    assert f(["See Eq.(", "(3) here."]) == ["See Eq.(3) here."]
    assert f([]) == []
    assert f(["as in et al.", "[CITATION] by", "Sec.", "2."]) == ["as in et al. [CITATION] by", "Sec. 2."]


def test_ids(spark):
    got = one(spark, "hep-th-0607021-v1-0-12", X.sentence_id("x"))[0]
    assert (got.arxivid, got.version, got.p, got.s) == ("hep-th-0607021", 1, 0, 12)
    assert one(spark, "nothing", X.sentence_id("x"))[0].version is None
    assert one(spark, "hep-th/0607021", X.id_to_path("x"))[0] == "hep-th-0607021"


def test_day_delta_rounds_down(spark):
    df = spark.sql("select timestamp'2020-01-01 00:00:00' a, timestamp'2020-01-01 12:00:00' b")
    assert tuple(df.select(X.day_delta("a", "b").alias("x"), X.day_delta("b", "a").alias("y")).first()) == (-1, 0)


def test_small_functions(spark):
    assert one(spark, "-LRB-", X.unescape_brackets("x"))[0] == "("
    assert one(spark, "Word Usage", X.label_reason("x"))[0] == "style"
    assert one(spark, "Unheard", X.label_reason("x"))[0] == "unheard"
    assert one(spark, "a \\% b % c\nd", X.remove_comments("x"))[0] == "a \\% b \nd"
    assert one(spark, "[MATH] [MATH]\n[MATH] x", X.collapse_tags("x"))[0] == "[MATH] x"
    assert one(spark, "\\subsection{One}", X.section_marks("x"))[0] == "## One"
    assert one(spark, "a $x$ b\nc", X.reduce_inline_math("x"))[0] == "a x b c"
    assert one(spark, 0.5, X.color_code("x"), X.f_mean("x", "x"), schema="x double") == ("rgb(127,0,0)", 0.5)
    assert one(spark, -1.0, X.color_code("x"), schema="x double")[0] == "#ffffff"
    assert one(spark, [["a"], ["b", "c"]], X.paragraphs_to_lines("x"), schema="x array<array<string>>")[0] == ["a", "", "b", "c", ""]


@pytest.mark.parametrize(
    "mime, raw, kind",
    [("application/postscript", "", "postscript"), ("application/x-tar", "", "tar"), ("application/gzip", "", "gzip"), ("x", "gzip data, was a.gz", "gzip"), ("text/x-tex", "", "tex"), ("image/png", "", "image"), ("x", "y", "unknown")],
)
def test_file_type(spark, mime, raw, kind):
    df = spark.createDataFrame([(mime, raw)], "m string, r string")
    assert df.select(X.file_type("m", "r").alias("k")).first().k == kind


def test_annotation_lines(spark):
    rows = [("style,clarity,why,1,2,old,new",), ("why,1,2,old,new",), ('a,"x, ""y""",1,2,"s, 1",s2',), ("too,few",)]
    got = T.annotation_lines(spark.createDataFrame(rows, "value string")).collect()
    assert [r.labels for r in got] == [["style", "clarity"], [], ["a"]]
    assert (got[2].explanation, got[2].s1, got[2].s2) == ('x, "y"', "s, 1", "s2")


@pytest.mark.parametrize(
    "source, text",
    [
        ("a % comment\nb", "a\nb"),
        (r"\newcommand{\x}[1]{<#1>}\x{y} z", "<y> z"),
        (r"\newcommand{\x}[2][d]{#1#2}\x{y} \x[e]{z}", "dy ez"),
        (r"\def\ab{long}\ab is \abc", "long is"),
        (r"see \cite{k} and \ref{r}", "see [CITATION] and [REF]"),
        (r"\begin{equation}x\end{equation}\begin{figure}y\end{figure}z", "[EQUATION]z"),
        (r"\begin{document}in\end{document}out", "in"),
        (r"\section{One} two", "# One two"),
        (r"where $x=1.$ Then", "where [MATH]. Then"),
        (r"$$a$$ $$b$$", "[EQUATION]"),
        (r"a \footnote{b \emph{c}} d", "a d"),
        (r"open \footnote{b", r"open b"),
        ("", ""),
    ],
)
def test_detex(source, text):
    assert D.detex(source) == text


def test_detex_null_and_idempotent_marks():
    assert D.detex(None) is None
    assert D.collapse(D.collapse("[MATH] [MATH]")) == "[MATH]"
    assert D.replace_math(D.replace_math("a $x$ b")) == "a [MATH] b"


@pytest.mark.parametrize(
    "source, text",
    [
        (r"\begin{document}a \emph{b} $c$ d\end{document} e", "a b d"),
        (r"\newcommand{\x}[1]{y} z", "z"),
        (r"a \begin{figure}no\end{figure}b 5\% c", "a b 5% c"),
        ("w\nx\ny\nz\nReferences\n[1] no", "w\nx\ny\nz"),
        ("a % gone\nb $$open", "a\nb open"),
        ("", ""),
        (None, None),
    ],
)
def test_scan(source, text):
    assert D.scan_text(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        (r"\section{A {\em big} title}", "# A {\\em big} title"), (r"\subsection*[short]{Deep} x", "## Deep x"), (r"\subsubsection {A\nb}", "### A b"),
        (r"\section{open", r"\section{open"), (r"a \sectional{x}", r"a \sectional{x}"), (r"\section{$a_{1}$ and {b {c}}}", "# $a_{1}$ and {b {c}}"),
    ],
)
def test_headings_whatever_braces(source, text):
    assert D.mark_headings(source.replace("\\n", "\n")) == text


def test_long_sources_take_one_pass():
    assert D.replace_math("$a.$ Next " * 30_000).count("[MATH].") == 30_000
    assert len(D.scan_text("a $x$ % c\n" * 30_000)) > 30_000


def test_ssplit(spark):
    cases = [
        ("It is so in Fig. 3 here. The rest follows! Is it? Yes.", ["It is so in Fig. 3 here.", "The rest follows!", "Is it?", "Yes."]),
        ("As in [EQUATION] The next.", ["As in [EQUATION]", "The next."]), ("See [EQUATION] and more. (So it is.) End", ["See [EQUATION] and more.", "(So it is.)", "End"]), ("", []), ("  ", []),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.s for r in df.select("k", X.ssplit("t").alias("s")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_maps_and_paths(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": None, "c": 4}, [[1, 2], [3, 4, 5]], "hep/01", 1, 2)], "m map<string,int>, n map<string,int>, r array<array<int>>, i string, v1 int, v2 int")
    r = df.select(
        X.merge_maps("m", "n").alias("m"), X.transpose("r").alias("t"), X.version_file("i", "v1", "latex", "/d/").alias("p"), X.pair_file("i", "v1", "v2", "annotation", "v2").alias("a"),
        X.pair_file("i", "v2", "v1", "machine").alias("none"),
    ).first()
    assert r.m == {"a": 1, "b": None, "c": 4} and r.t == [[1, 3], [2, 4]]
    assert r.p == "/d/hep-01/v1/extra/hep-01-v1-original.tex" and r.a == "hep-01-v1-v2-(2-unaligned-sents).csv" and r.none is None


@pytest.mark.parametrize(
    "source, text",
    [
        (r"{\setlength\arraycolsep{1pt} [EQUATION]}", "{ [EQUATION]}"), (r"{setlength\arraycolsep{1pt} x}", r"{setlength\arraycolsep{1pt} x}"), (r"\addtolength{\mylength}{length}z", "z"),
        (r"\newtheorem{theorem}{Theorem}z", "z"), (r"\newtheorem{tw}[theorem]{Theorem}z", "z"), (r"\newtheorem{tw}{Theorem}[theorem]z", "z"),
        ("\\lstdefinelanguage[bzr]{c++}\n {basicstyle=x,\n  words={a, b},\n}\n\nmore", "\n\nmore"), ("\\lstdefinelanguage{idl}\n {\n words={in}\n }\n\nmore", "\n\nmore"),
        (r"see \cite[p. 3]{a,b} and \ref{x}", "see [CITATION] and [REF]"), (r"a\footnote{b {c}} d", "a d"), (r"\label{open", r"\label{open"), (r"\cite", "[CITATION]"),
    ],
)
def test_commands(source, text):
    assert D.replace_commands(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("when $r<R.$      We try.", "when [MATH].      We try."), ("Given $math$ in: $$equation.$$ We aim.", "Given [MATH] in: [EQUATION]. We aim."),
        ("costs \\$5 and \\$6", "costs \\$5 and \\$6"), ("so \\(x\\) and \\[y\\] go", "so [MATH] and [EQUATION] go"),
    ],
)
def test_math(source, text):
    assert D.replace_math(source) == text and D.replace_math(text) == text


@pytest.mark.parametrize("source", ["[MATH] [MATH] [MATH]", "[MATH]    [MATH]  [MATH]", "[MATH] [MATH]\n[MATH]"])
def test_consecutive_marks(source):
    assert D.collapse(source) == "[MATH]" == D.collapse("[MATH]")


@pytest.mark.parametrize(
    "source, text",
    [
        ("a \\w b", "a \\w b"), ("\\newcommand{\\w}{The book of \\LaTeX}\\item \\w\n\\wx{y}", "\\item The book of \\LaTeX\n\\wx{y}"), ("\\newcommand{\\w}{x}y", "y"),
        ("\\newcommand{\\w}[1] {\nBy #1 alone}\\w{two {of} us}", "By two {of} us alone"), ("\\newcommand{\\w}[2][old]{#1 #2}\\w{a} \\w[new]{a}", "old a new a"),
        ("\\newcommand\\w{x}\\w{}y", "xy"), ("\\global\\long\\def\\w#1#2{#2^#1}\\w{a}{b}", "b^a"), ("\\gdef \\w{\\emph{s}}\\w.", "\\emph{s}."), ("\\def\\w{open", "\\def\\w{open"),
        ("\\newcommand{\\a}{one}\\newcommand{\\ab}{two}\\a \\ab{}", "one two"),
    ],
)
def test_macros(source, text):
    assert D.expand_macros(source) == text
