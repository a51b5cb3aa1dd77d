import pytest

from tidemark.llm import markup as M
from tidemark.llm import reading as R
from tidemark.llm import sentences as S


def units(text):
    out, at = [], 0
    for end in S.unit_ends(text):
        out.append(text[at:end].strip())
        at = end
    return out


CASES = [
    ["The cat sat.", "It ran."],
    ["We agree with Dr. Kelvaro on Fig. 3 here.", "See pp. 12-14."],
    ["It held for e.g. Foo and Bar.", "And vs. the older one."],
    ["It is by K. T. Marovo.", "The rest follows."],
    ["At 9 a.m. it rained, at p < .05 and 1.2e-3.", "So it was."],
    ["We met at 9 a.m.", "Then we left."],
    ['Stone was called: "One holds. It is so." and nothing more.', "The end."],
    ['"A whole sentence is quoted."', "Next one."],
    ["(The whole is bracketed, cf. App. B. for the proof.)", "Next (see Sec. 3.) one."],
    ["We see this, [EQUATION]", "The next one."],
    ["One fast mode of [EQUATION] every bus."],
    ["This is it.", "(a) First, that follows."],
    ["This is it.", "pH of 7.2 means little."],
    ["Is it so?", "Yes!", "No. 5 shows that."],
    ["Das gilt z. B. bei hoher Last, d. h. am 3. Mai.", "„Der zweite Versuch gilt usw.“", "Ende."],
    ["La señal en la pág. 31, según el Sr. Talmiro.", "¿Qué es?"],
    ["Selon M. Tavorel vers 9 h. du matin.", "« Notre relevé précise. »"],
    ["Сигнал см. рис. 3 и т. д. по списку.", "«Простая модель и т. д.»", "В 2061 г. на севере."],
    ["第一次测量限制了信号的形状，即“不再变化。”的情形。", "“上界估计否定了热量。”", "“外层区域。”", "简化模型……但仍需检验。"],
    ["試料は（第5節を参照。）補った。", "「変化はない。」"],
    ["दूसरा प्रयोग डॉ. तवोरेल के पृ. 12 समान है।", "हर नमूना 3.5 है।"],
]


@pytest.mark.parametrize("parts", CASES)
def test_units(parts):
    wide = any("\u3040" <= c <= "\u9fff" for c in parts[0])
    assert units(("" if wide else " ").join(parts)) == parts


def test_lines_and_blanks():
    assert units("# Head\nOne line\nwraps here. Two.\n\n1. First. Second.\n2. Third\n\nlast") == ["# Head", "One line\nwraps here.", "Two.", "1. First. Second.", "2. Third", "last"]
    assert units("the car.Each one") == ["the car.", "Each one"]
    assert units("สัญญาณอ่อนจำกัด 3.14 หน่วย การวัดโดยดร. ทาโวเรล") == ["สัญญาณอ่อนจำกัด 3.14 หน่วย", "การวัดโดยดร. ทาโวเรล"]
    for blank in (None, "", " \n\t"):
        assert S.unit_ends(blank) == []
    assert units('open ( never closed. And "so on. End.') == ["open ( never closed.", 'And "so on.', "End."]
    long = "A sentence is here. " * 20000
    assert len(S.unit_ends(long)) == 20000


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 0), (2, None, 0), (3, "", 0), (None, "A.", 0), (4, "😀 é. B", 0)], "file_id bigint, body string, unit int")
    got = sorted((r.file_id, r.unit, r.sent_start, r.sent_end) for r in S.sentence_units(df).collect())
    assert got == [(1, 0, 0, 4), (1, 1, 5, 9), (4, 0, 0, 4), (4, 1, 5, 6)]
    assert S.sentence_units(df.where("false")).count() == 0


LATEX = r"""\documentclass{article}
\title{No heading}
\newcommand{\hd}[1]{\section{#1}}
\begin{document}
\section*{Caf\'e {\bf bold} \& R\#3~x}\label{s:1}
% \section{Hidden}
\iffalse
\section{Disabled}
\fi
\begin{comment}
\[ x \]
\end{comment}
\hd{From \emph{macro}}
\begin{itemize}
\item one \textbf{item} 5\%
\begin{enumerate}
\item
  nested K\"uvano
\end{enumerate}
\item last
\end{itemize}
\begin{verbatim}
% code \item
x   = 1
\end{verbatim}
\begin{equation}\label{e:1}
a = b
\end{equation}
\[ c \] and $inline$ $$d$$
\begin{thebibliography}{9}
\bibitem{k} Book.
\end{thebibliography}
\end{document}
\section{After}
"""


def kinds(body):
    return [x for x in M.elements(body) if x[0] != "paragraph"]


def test_latex():
    assert kinds(LATEX) == [
        ("heading", "Café bold & R#3 x"), ("heading", "From macro"), ("list_item", "nested Küvano"), ("list_item", "one item 5%"), ("list_item", "last"),
        ("code_block", "% code \\item x = 1"), ("formula", "a = b"), ("formula", "c"), ("formula", "d"),
    ] or sorted(kinds(LATEX)) == sorted([
        ("heading", "Café bold & R#3 x"), ("heading", "From macro"), ("list_item", "one item 5%"), ("list_item", "nested Küvano"), ("list_item", "last"),
        ("code_block", "% code \\item x = 1"), ("formula", "a = b"), ("formula", "c"), ("formula", "d"),
    ])


def test_html():
    body = "<html><head><title>T</title><style>h1{}</style></head><body><H1 class=x>A <b>b</b>&nbsp;c</H1><!-- <h2>no</h2> --><script>'<h2>x</h2>'</script>" \
        "<ul><li>one<ul><li>two</ul><li>three &amp; four</li></ul><pre><code>a &lt; b\n  c</code></pre><p>x \\[ f \\] y</p><div class='math'>$$g$$</div>"  # fmt: skip
    assert sorted(kinds(body)) == sorted([("heading", "A b c"), ("list_item", "one"), ("list_item", "two"), ("list_item", "three & four"), ("code_block", "a < b c"), ("formula", "f"), ("formula", "g")])


def test_markdown():
    body = "Title *one*\n======\n\n## Two `x` ##\n\n- a [b](c.md) \\*d\n  more\n  - nested\n1. num R&amp;D\n\n```py\n# no\n```\n\n$$f$$\n\n---\n\n<!-- # hidden -->\ntext snake\\_case\n"
    assert kinds(body) == [("heading", "Title one"), ("heading", "Two x"), ("list_item", "a b *d more"), ("list_item", "nested"), ("list_item", "num R&D"), ("code_block", "# no"), ("formula", "f")]


def test_wiki():
    body = "== A '''b''' [[c|d]] ==\n* one <nowiki>[x]</nowiki>\n** two\n# three\n:<math>f</math>\n<math display=\"block\">g</math>\n<source lang=x>\n== no ==\n</source>\n<!-- * hidden -->\ntext <math>in</math> [[Category:X]]\n"
    assert kinds(body) == [("heading", "A b d"), ("list_item", "one [x]"), ("list_item", "two"), ("list_item", "three"), ("formula", "f"), ("formula", "g"), ("code_block", "== no ==")]


@pytest.mark.parametrize("body", [None, "", " \n ", "\\begin{itemize}\\item cut", "\\begin{verbatim}\nx", "<ul><li>cut", "```\ncut", "== cut", "\\section{cut", "$$x", "\\def\\a{\\a\\a}\\begin{document}\\a"])
def test_cut_off_files_do_not_fail(body):
    M.elements(body)


@pytest.mark.parametrize("text, left", [("if a < b and x_1, {1, 2}, 5 % of R&D * in ~40", False), ("# Head\n[MATH] [REF]", False), ("a \\cite{k}", True), ("<i>x</i>", True), ("&nbsp;", True), ("[a](b.md)", True), ("**b**", True), ("[[a|b]]", True), ("'''c'''", True), ("{{cite|x}}", True), ("a \\\\ b", True), (None, False), ("", False)])
def test_residue(text, left):
    assert M.has_residue(text) is left


@pytest.mark.parametrize(
    "text, clean",
    [
        ("## Head\n\nThe \\emph{dense} **small** [MATH] is 5 % of R&D_1\\cite{k}.", "## Head\n\nThe dense small [MATH] is 5 % of R&D_1[CITATION]."),
        ("\\noindent One {\\bf x} '''y''' [[a|b]]s &lt; H<sub>2</sub>O \\\\\nnext", "One x y bs < H2O\nnext"),
        ("our $\\alpha$ {{cite|the}} [it](a.md)&nbsp;z", "our [MATH] [CITATION] it z"),
    ],
)
def test_clean_residue_of_mixed_kinds(text, clean):
    assert M.has_residue(text) and M.clean_residue(text) == clean


def test_text_files_are_cleaned(spark, tmp_path):
    from tidemark.llm import queries

    kind = "file_id bigint, body string"
    spark.createDataFrame([(1, "# a\n\n- b")], kind).write.parquet(str(tmp_path / "latex_files.parquet"))
    spark.createDataFrame([(2, "## x\n\na <i>b</i> c"), (3, "plain  5 % [REF]\n"), (4, None), (5, " ")], kind).write.parquet(str(tmp_path / "text_files.parquet"))
    got = {r.file_id: r.text for r in queries.p5_text(spark, str(tmp_path)).collect()}
    assert got == {1: "# a\n\n- b", 2: "## x\n\na b c", 3: "plain  5 % [REF]\n"}


def test_markup_tables(spark):
    df = spark.createDataFrame([(1, "# a\n\n- b", 5), (1, "# a\n\n- b", 5), (2, None, 5), (None, "# c", 5)], "file_id bigint, body string, kind int")
    read = M.read_elements(df)
    assert read.select("file_id", "kind", "item").distinct().count() == 2
    assert M.clean_text(read.dropDuplicates(["file_id", "place"])).first().text == "# a\n\n- b"
    assert M.residue_files(spark.createDataFrame([(1, "<b>x</b>"), (1, "<b>x</b>"), (2, "x")], "file_id bigint, body string")).count() == 1
    assert M.read_elements(df.where("false")).count() == 0


def test_language():
    en = "The cat sits on the mat and it is happy with the day. " * 3
    assert R.is_english(en)
    assert not R.is_english("Die Katze sitzt auf der Matte und ist mit dem Tag nicht zufrieden. " * 2 + en)
    assert not R.is_english("外层区域证实了源的位置" * 10 + en)
    assert not R.is_english("12345 !!!")


def test_reading_bands(spark):
    easy = "The cat sees the dog. The dog likes the red ball. A boy runs. " * 6
    hard = "The morphological characterisation establishes considerable heterogeneity although subsequent investigations demonstrate that the methodological assumptions remain questionable. " * 6
    docs = [(k, easy if k % 2 else hard, 0, "x") for k in range(40)] + [(90, None, 0, "x"), (91, "", 0, "x"), (92, "Too short.", 0, "x"), (93, easy, 0, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, band int, f string")
    lab = spark.createDataFrame([(k, 1, 1 if k % 2 else 4) for k in range(20)] + [(3, 2, None), (None, 1, 2), (999, 1, 3), (5, 3, 9)], "doc_id bigint, rater int, band int")
    got = {r.doc_id: r.band for r in R.reading_bands(d, lab).collect()}
    assert set(got) == {*range(40), 93}
    assert all((b <= 2) == bool(k % 2) for k, b in got.items() if k < 40) and got[93] <= 2
    assert R.reading_bands(d, lab.where("false")).count() == 0
    assert R.reading_bands(d.where("false"), lab).count() == 0


def test_many_labels_and_unclosed_marks():
    assert S.unit_ends("So it is. " + "(a) " * 3000 + "End.")
    assert S.unit_ends("So it is. " + '( " ' * 20000 + ") " * 20000)


def test_list_levels():
    assert units("1. One.\n  1. Inner.\n2. Two.\n\nText here.\n3. not a list. More.") == ["1. One.", "1. Inner.", "2. Two.", "Text here.", "3. not a list.", "More."]


def test_macros_without_bound():
    source = "\\documentclass{a}\\newcommand{\\a}{Spin\\xspace}\\newcommand{\\w}[2][old]{#1 #2}\\def\\x{\\x y}\\begin{document}"
    got = M.elements(source + "\\a{} " * 5000 + "\\section{The \\a{} Model}\\x{} \\w{way}, \\w[new]{way}\n\\[ \\a + 1 \\]\\end{document}")
    assert got[0] == ("paragraph", " ".join(["Spin"] * 5000))
    assert ("heading", "The Spin Model") in got and ("formula", "\\a + 1") in got
    assert ("paragraph", "y old way, new way") in got


def test_expansion_without_end_is_an_error():
    laughs = "\\documentclass{a}\\def\\z{aaaaaaaaaaaaaaaaaaaa}" + "".join(f"\\def\\{chr(97 + k)}{{{chr(92) + (chr(96 + k) if k else 'z')}" * 1 + "{}" + f"{chr(92) + (chr(96 + k) if k else 'z')}}}" for k in range(22))
    assert M.elements(laughs + "\\begin{document}\\v\\end{document}")[-1] == ("error", "ValueError")


def test_paths_are_no_residue():
    assert not M.has_residue("It lies at C:\\Users\\bob and D:\\x.")
    assert M.has_residue("It is \\emph{so} here.") and M.has_residue("C:\\emph{so}")


def test_unlisted_languages_are_not_english():
    polish = "Model ten opisuje zachowanie układu w zależności od temperatury i pokazuje, że to jest prawda. Wyniki są zgodne z teorią, a pomiary to potwierdzają. "
    turkish = "Bu model sistemin davranışını sıcaklığa bağlı olarak açıklar ve bunun doğru olduğunu gösterir. Sonuçlar teoriyle uyumludur, at ve on kişi de öyle. "
    assert not R.is_english(polish * 3) and not R.is_english(turkish * 3)
    assert R.is_english("The model tells how the system behaves when it is heated, and it shows that this holds. " * 3)
