import gzip
import io
import tarfile

import pytest

from pyspark.sql import functions as F

from tidemark.functions import tokenizer as K
from tidemark.operators.align import cross_export
from tidemark.sources import archives as A
from tidemark.sources import harvest as H
from tidemark.sources import sinks as S
from tidemark.sources import tables as T


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_unwrap_kinds():
    doc = "\\documentclass{a}\nbody"
    assert A.unwrap(gzip.compress(doc.encode())) == ("tex", doc, None)
    assert A.unwrap(gzip.compress(gzip.compress(b"plain"))) == ("text", "plain", None)
    assert A.unwrap(b"%PDF-1.4")[:2] == ("pdf", None)
    assert A.unwrap(b"%!PS-Adobe")[0] == "postscript"
    assert A.unwrap(None) == ("missing", None, None)
    assert A.unwrap(b"\x1f\x8bbroken")[2] is not None
    assert A.unwrap(b"a\0b")[2] == "cannot read unknown"


def test_tar_picks_and_inlines():
    files = {"main.tex": "\\documentclass{a}\n\\input{Part}\n% \\input{no}\n\\includegraphics{x.pdf}", "part.tex": "inlined words that are long", "x.sty": "\\documentclass{z}" * 9}
    kind, text, error = A.unwrap(gzip.compress(tar(files)))
    assert (kind, error) == ("tar", None) and "inlined words" in text and "\\input" not in text
    assert A.main_source({"a.tex": "x", "b.tex": "y"}) is None
    assert A.main_source({"a.tex": "only"}) == "only"
    assert A.main_source({"a.tex": "\\documentclass{a}\n\\input{a}\nend"}) == "\\documentclass{a}\nend"


def test_read_archives(spark, tmp_path):
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"\\documentclass{a}"))
    (tmp_path / "two.bin").write_bytes(b"%PDF")
    assert sorted(r.kind for r in A.read_archives(spark, str(tmp_path)).collect()) == ["pdf", "tex"]


def test_harvest(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        "<records><record><id>a/1</id><setSpec>cs</setSpec><setSpec>math</setSpec><version version='v1'><date>Mon, 2 Apr 2007 19:18:42 GMT</date></version>"
        "<version version='v2'><date>?</date></version><keyname>X</keyname><keyname>Y</keyname><forenames>A.</forenames></record></records>"
    )
    r = H.read_records(spark, str(tmp_path))
    assert sorted((v.number, v.version_time is None) for v in H.versions_of(r).collect()) == [(1, False), (2, True)]
    assert sorted(c.spec for c in H.categories_of(r).collect()) == ["cs", "math"]
    assert [(a.first_name, a.last_name) for a in H.authors_of(r).collect()] == [("A.", "X")]


def test_annotation_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(["style", "a,b"], 'say "so"', "1", "2", "old, one", "new"), ([], "", "3", "4", "s", "t")], "labels array<string>, explanation string, id1 string, id2 string, s1 string, s2 string")
    S.write_annotations(df, str(tmp_path / "a"))
    back = T.annotation_lines(spark.read.text(str(tmp_path / "a")))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_alignment_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 2, 0, 0, "same", "x-v1-0-0", "x-v2-0-0"), ("x", 1, 2, 1, 1, "new", None, "x-v2-0-1")], "arxivid string, v1 int, v2 int, idx int, code int, text string, id1 string, id2 string")
    edges = spark.createDataFrame([("x", 1, 2, "x-v1-0-0", "x-v2-0-0")], "arxivid string, v1 int, v2 int, id1 string, id2 string")
    S.write_alignment(cross_export(rows, edges), str(tmp_path / "p"))
    back = T.alignment_files(spark, str(tmp_path / "p"))
    assert sorted((r.sent_1, r.aligning_method) for r in back.collect()) == [("new", 3), ("same", 1)]


def test_html(spark):
    cells = spark.createDataFrame([("x", 1, 2, "a", "b", 1.0), ("x", 1, 2, "a", "c", -1.0)], "arxivid string, v1 int, v2 int, id1 string, id2 string, value double")
    html = S.heatmap_rows(cells).first().html
    assert html.count("<td") == 2 and html.count("title=") == 1 and "#ff0000" in html


def test_tokens(spark):
    df = spark.createDataFrame([(" We see [MATH], it's  so.",)], "t string")
    ts = df.select(K.tokens("t").alias("x")).first().x
    assert [t.text for t in ts] == ["We", "see", "[MATH]", ",", "it's", "so", "."]
    assert [" We see [MATH], it's  so."[t.start : t.stop] for t in ts] == [t.text for t in ts]
    assert df.select(K.untokenize(K.tokens("t")).alias("x")).first().x == "We see [MATH], it's  so."
    assert df.select(F.size(K.span(K.tokens("t"), 1, 2)).alias("n")).first().n == 2


def test_any_number_of_layers():
    data = b"\\documentclass{a} x"
    for _ in range(9):
        data = gzip.compress(data)
    assert A.unwrap(data) == ("tex", "\\documentclass{a} x", None)


def test_models_are_kept_where_they_are_better(spark, tmp_path):
    path = str(tmp_path / "models")
    edges = lambda m: spark.createDataFrame([("x", 1, 2, "a", "b", m)], "arxivid string, v1 int, v2 int, id1 string, id2 string, method string")
    left = lambda n: spark.createDataFrame([("x", 1, 2, n)], "arxivid string, v1 int, v2 int, n_unaligned int")
    for name, n in (("first", 5), ("worse", 7), ("better", 3), ("same", 3)):
        S.save_model(edges(name), left(n), path)
    assert [(r.method, r.n_unaligned) for r in S.load_model(spark, path).collect()] == [("better", 3)]


def test_examples_are_read_as_written(spark, tmp_path):
    path = str(tmp_path / "examples")
    rows = spark.createDataFrame([([1.0, 2.5], 1.0, "added", 1, 5), ([3.0, 4.0], 0.0, "removed", 2, 6)], "features array<double>, label double, grp string, window int, min_length int")
    S.write_examples(rows, path)
    got = {(r.grp, r.window, r.min_length, tuple(r.features), r.label) for r in T.example_files(spark, path).collect()}
    assert got == {("added", 1, 5, (1.0, 2.5), 1.0), ("removed", 2, 6, (3.0, 4.0), 0.0)}
    assert T.example_files(spark, path, "added").count() == 1


def test_results_and_annotated_copies(spark, tmp_path):
    results, copies = str(tmp_path / "results"), str(tmp_path / "copies")
    S.write_results(spark.createDataFrame([(6, 1, 2, 5.0), (5, 1, 3, 7.5)], "min_length int, window int, missed long, missed_percent double"), results)
    assert [tuple(r) for r in spark.read.csv(results, header=True).collect()] == [("5", "1", "3", "7.5"), ("6", "1", "2", "5.0")]
    pairs = [("h/1", 1, 2, ["style", "a,b"], "why", "i", "j", "One.", 'Two "q".'), ("h/1", 1, 2, [], "", "k", "l", "x", "y")]
    S.copy_annotated(spark.createDataFrame(pairs, "arxivid string, v1 int, v2 int, labels array<string>, explanation string, id1 string, id2 string, s1 string, s2 string"), copies)
    got = T.annotation_lines(spark.read.text(copies)).collect()
    assert [(r.labels, r.explanation, r.s2) for r in got] == [(["style", "a,b"], "why", 'Two "q".')]


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from tidemark.plans import runtime as R

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda *a: None)})})
    with pytest.raises(ValueError):
        R.ensure_checkpoint_dir(session)
