import os
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import align as A
from tidemark.operators import blocks as B
from tidemark.operators import edits as E
from tidemark.operators import metadata as M
from tidemark.operators import sequences as Q
from tidemark.operators import similarity as S
from tidemark.operators import versions as V
from tidemark.sources import tables as T

STRUCT = "struct_id bigint, arxivid string, v1 int, v2 int, idx int, identifiers array<string>, diff struct<code:int,sentence:string>, status string, aligned array<int>, extra int"
LONG = "the quick brown fox jumps over the lazy dog near the old river bank"


def rows_of(spark, rows):
    full = []
    p1 = s1 = p2 = s2 = 0
    for k, (code, text) in enumerate(rows):
        ids = ([f"x-v1-0-{k}"] if code <= 0 else []) + ([f"x-v2-0-{k}"] if code >= 0 else [])
        full.append((k, "x", 1, 2, k, ids, (code, text), None, [], 7))
    return T.diff_rows(spark.createDataFrame(full, STRUCT))


def test_islands(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0, 0, 1, 2, 3, 4, 4, 2, 6])], "d string, k int, v int")
    got = Q.islands(df, ["d"], ["k"], F.col("v") % 2 == 0).orderBy("k").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.island, []).append(r.v)
    assert list(groups.values()) == [[0, 0], [2], [4, 4, 2, 6]]
    assert Q.islands(df, ["d"], ["k"], F.col("v") % 2 == 0, 3).count() == 4


@pytest.mark.parametrize("size, expect", [(1, [[9, 1, 2], [1, 2, 3], [2, 3, 9]]), (2, [[9, 9, 1, 2, 3], [9, 1, 2, 3, 9], [1, 2, 3, 9, 9]])])
def test_neighbours(spark, size, expect):
    df = spark.createDataFrame([(0, k) for k in (1, 2, 3)], "d int, v int")
    assert [r.window for r in Q.neighbours(df, ["d"], ["v"], "v", size, F.lit(9)).orderBy("v").collect()] == expect
    assert Q.neighbours(df.where("v > 5"), ["d"], ["v"], "v", size, F.lit(9)).count() == 0


def test_running_ids_blank_takes_a_place(spark):
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(["a", "b", "", "c", ""])], "d int, k int, t string")
    got = Q.running_ids(df, ["d"], ["k"], F.col("t") == "").orderBy("k").collect()
    assert [(r.p, r.s) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_change_runs_tell_a_leading_run(spark):
    df = spark.createDataFrame([(0, k, c) for k, c in enumerate([1, 0, -1, 1, -1, 0, 1])], "d int, k int, code int")
    got = sorted((r.run, r.n_removed) for r in Q.change_runs(df, ["d"], ["k"]).collect())
    assert got == [(0, 0), (1, 2)]


def test_align_steps(spark):
    changed = LONG.replace("lazy", "sleepy")
    other = "completely different words stand in this sentence about nothing of note"
    rows = rows_of(spark, [(0, LONG + " first"), (-1, LONG), (1, changed), (0, ""), (-1, other), (0, ""), (1, other + " indeed"), (-1, "## Title"), (1, None)])
    edges = {(r.id1, r.id2, r.method) for r in A.align(rows).collect()}
    assert ("x-v1-0-0", "x-v2-0-0", "identical") in edges
    assert ("x-v1-0-1", "x-v2-0-2", "block") in edges
    assert ("x-v1-0-4", "x-v2-0-6", "document") in edges
    assert len([e for e in edges if e[2] != "identical"]) == 2
    free = A.unaligned(rows, A.align(rows)).collect()
    assert free == []


def test_align_empty(spark):
    assert A.align(rows_of(spark, [(0, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("cells", [S.CELLS, 2])
def test_similarity_meets_kept_sentences_and_other_blocks(spark, cells, monkeypatch):
    monkeypatch.setattr(S, "CELLS", cells)
    other = "completely different words stand in this sentence about nothing of note"
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))
    rows = rows_of(spark, [(0, LONG), (-1, LONG + " again"), (0, ""), (1, other + " indeed"), (0, ""), (-1, other), (-1, long), (1, long + " more"), (1, "## Title")])
    pairs = S.whole_pairs(rows)
    assert pairs.count() == 4 * 3 == pairs.select("text1", "text2").distinct().count()
    measured = {(r.text1, r.text2): r for r in S.whole_measures(rows).collect()}
    for r in pairs.collect():
        got, w1, w2 = measured[r.text1, r.text2], r.w1, r.w2
        n, (g1, g2) = K.lcs_length(w1, w2), (list(zip(w, w[1:])) for w in (w1, w2))
        k = K.lcs_length(g1, g2)
        assert got.lcs_length == n
        assert got["diff"] == pytest.approx(1 - ((len(w1) - n) / len(w1) + (len(w2) - n) / len(w2)) / 2)
        assert got.diff_2_gram == pytest.approx(1 - ((len(g1) - k) / len(g1) + (len(g2) - k) / len(g2)) / 2)
        assert got.jaccard == pytest.approx(len(set(w1) & set(w2)) / len(set(w1) | set(w2)))
        assert got.jaccard_2_gram == pytest.approx(len(set(g1) & set(g2)) / len(set(g1) | set(g2)))
    got = {r.text: r for r in S.whole_vectors(rows).collect()}
    for t, r in got.items():
        both = [x for (a, b), x in measured.items() for y in (a, b) if y == t]
        assert r.n_similar == len(both)
        for m in S.MEASURES:
            assert r[f"max_{m}"] == pytest.approx(max(x[m] for x in both)) and r[f"avg_{m}"] == pytest.approx(sum(x[m] for x in both) / len(both))
    assert got[LONG].n_similar == 7
    similar = {(r.text1, r.text2) for r in S.whole_similar(pairs).where("similar").collect()}
    assert similar == {(LONG, LONG), (LONG + " again", LONG), (other, other + " indeed"), (long, long + " more")}


def words_of(k, n):
    """``n`` words that no other ``k`` has."""
    return [f"{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}word" for j in range(n)]


@pytest.mark.parametrize("cells", [S.CELLS, 2])
def test_averages_are_of_exact_sums(spark, cells, monkeypatch):
    monkeypatch.setattr(S, "CELLS", cells)
    texts = [" ".join(words_of(k % 3, 5 + k)[k % 4 :]) for k in range(24)]
    rows = rows_of(spark, [((0, -1, 1)[k % 3 if k > 5 else 0], t) for k, t in enumerate(texts)])
    values = {}
    for r in S.whole_measures(rows).collect():
        for t in (r.text1, r.text2):
            values.setdefault(t, []).append(r)
    got = {r.text: r for r in S.whole_vectors(rows).collect()}
    assert set(got) == set(values)
    for m in S.MEASURES:
        assert {t: got[t][f"avg_{m}"] for t in got} == {t: float(sum(Fraction(x[m]) for x in v)) / len(v) for t, v in values.items()}


def test_feature_vectors_round_ties_as_sql_does(spark, tmp_path):
    """Two kept texts share one of 40 word pairs, among 16: their average is 0.0640625, and a double just below that."""
    duckdb = pytest.importorskip("duckdb")
    from tidemark import catalogue as C

    one, two = words_of(0, 21), words_of(1, 22)
    two[4:6] = one[7:9]
    texts = [" ".join(ws) for ws in [one, two, *(words_of(k, 9) for k in range(2, 16))]]
    rows = [(k, "x", 1, 2, k, [f"x-v1-0-{k}", f"x-v2-0-{k}"], (0, t), None, [], 7) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, STRUCT).write.parquet(str(tmp_path / "sentence_structs.parquet"))
    con = duckdb.connect()
    con.execute(f"create view sentence_structs as select * from '{tmp_path}/sentence_structs.parquet/*.parquet'")
    mine, theirs = C.feature_vectors(spark, str(tmp_path)), con.execute(C.oracle_sql()["feature_vectors"])
    assert mine.columns == [d[0] for d in theirs.description]
    got = sorted(tuple(r) for r in mine.collect())
    assert got == sorted(theirs.fetchall())
    assert {r[3]: r[mine.columns.index("avg_jaccard_2_gram")] for r in got}[texts[0]] == 0.064062


def test_edge_groups_are_components(spark):
    pairs = [("a1", "b1"), ("a2", "b1"), ("a2", "b2"), ("a3", "b2"), ("a9", "b9")]
    df = spark.createDataFrame([("x", 1, 2, a, b) for a, b in pairs], "arxivid string, v1 int, v2 int, id1 string, id2 string")
    got = {(r.id1, r.id2): r.grp for r in E.edge_groups(df).collect()}
    assert set(got.values()) == {"a1", "a9"}
    assert got["a3", "b2"] == "a1"


def test_merge_keeps_every_annotated_pair(spark):
    from tidemark import catalogue as C

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables here")
    an, merged = C.edit_pairs(spark, small).count(), C.merge_n_to_m(spark, small).collect()
    assert sum(r.n_edges for r in merged) == an > 0


def test_merge_has_unannotated_sentences_of_the_group(spark):
    rows = rows_of(spark, [(0, "a b"), (-1, "c d"), (0, "same")])
    ids = "arxivid string, v1 int, v2 int, id1 string, id2 string"
    edges = spark.createDataFrame([("x", 1, 2, "x-v1-0-0", "x-v2-0-0"), ("x", 1, 2, "x-v1-0-1", "x-v2-0-0"), ("x", 1, 2, "x-v1-0-2", "x-v2-0-2")], ids)
    pairs = spark.createDataFrame([("x", 1, 2, "x-v1-0-1", "x-v2-0-0", ["l"], "why")], ids + ", labels array<string>, explanation string")
    got = [(r.ids1, r.s1, r.s2, r.labels, r.explanation, r.n_edges) for r in E.merge_groups(pairs, E.edge_groups(edges), rows).collect()]
    assert got == [("x-v1-0-0,x-v1-0-1", "a b c d", "a b", ["l"], "why", 1)]


def test_edge_groups_settle_on_a_long_chain(spark):
    chain = [(f"a{k + d:03}", f"b{k:03}") for k in range(70) for d in (0, 1)]
    df = spark.createDataFrame([("x", 1, 2, a, b) for a, b in chain], "arxivid string, v1 int, v2 int, id1 string, id2 string")
    got = E.edge_groups(df)
    assert got.count() == 140 and [r.grp for r in got.select("grp").distinct().collect()] == ["a000"]


def test_priority_merge(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    s1 = spark.createDataFrame([(1, ["a"], ""), (2, [], "why")], "k int, labels array<string>, explanation string")
    s2 = spark.createDataFrame([(1, ["b"], "because"), (2, ["c"], "no")], "k int, labels array<string>, explanation string")
    got = {r.k: (r.labels, r.explanation) for r in E.merge_by_priority(base, [s1, s2], ["k"]).collect()}
    assert got == {1: (["a"], "because"), 2: ([], "why"), 3: (None, "")}


def test_label_distribution_bad_labels_alone(spark):
    df = spark.createDataFrame([(["style", "pdf required"],), (["style", ""],), ([],), (None,)], "labels array<string>")
    got = {r.label: (r.n, r.percent) for r in E.label_distribution(df).collect()}
    assert got == {"pdf required": (1, 33.333333), "style": (1, 33.333333)}


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, line int, v string")
    assert [r.v for r in E.last_wins(df, ["k"], "line").collect()] == ["b"]


def test_metadata(spark):
    v = spark.createDataFrame([("p", 1, None), ("p", 1, None), ("p", 3, None), ("q", 1, None), (None, 1, None)], "arxiv_id string, number int, version_time timestamp_ntz")
    assert [(r.arxiv_id, r.version_count) for r in M.multi_version(v).collect()] == [("p", 3)]
    assert M.version_pairs(M.version_times(v)).count() == 0  # a gap
    assert sorted((r.v1, r.v2) for r in M.announced_pairs(M.multi_version(v)).collect()) == [(1, 2), (2, 3)]
    c = spark.createDataFrame([("p", "cs"), ("q", "cs")], "arxiv_id string, spec string")
    a = spark.createDataFrame([("p", None, "X"), ("p", None, "X")], "arxiv_id string, first_name string, last_name string")
    got = M.assemble(v, c, a).collect()
    assert [r.arxiv_id for r in got] == ["p"] and len(got[0].authors) == 1
    assert M.insert_ignore(c.where("arxiv_id = 'p'"), c, ["arxiv_id"]).collect()[0].arxiv_id == "q"


def test_main_file_cascade(spark):
    doc = "\\documentclass{a} "
    rows = [("one", 1, "a.tex", "x"), ("two", 2, "a.sty", doc + "long long"), ("two", 3, "b.tex", doc), ("two", 4, "c.tex", ""), ("tie", 5, "a.tex", doc), ("tie", 6, "b.tex", doc), ("none", 7, "a.tex", "x"), ("none", 8, "b.tex", "y")]
    got = {r.arxivid: r.file_id for r in M.main_file(spark.createDataFrame(rows, "arxivid string, file_id bigint, latex_path string, body string"), ["arxivid"]).collect()}
    assert got == {"one": 1, "two": 3, "tie": 5}


def test_precision_recall_of_empty_sets(spark):
    e = spark.createDataFrame([], "k int")
    r = B.precision_recall(e, e, ["k"]).first()
    assert (r.tp, r.precision, r.recall) == (0, 0.0, 0.0)


def test_unknown_group_is_refused(spark):
    with pytest.raises(ValueError):
        B.examples(None, None, 5, 1, "neither")


def test_registered_evaluation_uses_the_folds_of_train():
    import inspect

    from tidemark import catalogue as C

    assert "B.train(ex)" in inspect.getsource(C.block_classifier_eval)
    assert inspect.signature(B.train).parameters["folds"].default == 10


def test_heatmap_modes(spark):
    other = "completely different words stand in this sentence about nothing of note"
    rows = rows_of(spark, [(0, LONG), (-1, LONG + " again"), (1, other), (0, ""), (-1, other + " indeed")])
    cells = lambda e: {(r.id1, r.id2): round(r.value, 3) for r in S.heatmap(rows, e).collect()}
    every = cells(None)
    assert len(every) == 4 * 3 and every["x-v1-0-0", "x-v2-0-0"] == 1 and every["x-v1-0-3", "x-v2-0-3"] == 0
    diff = cells(A.identical(rows))
    assert diff["x-v1-0-3", "x-v2-0-3"] == 1 and diff["x-v1-0-1", "x-v2-0-0"] == -1 and diff["x-v1-0-4", "x-v2-0-2"] == every["x-v1-0-4", "x-v2-0-2"] > 0.9
    easy = cells(A.align(rows))
    assert easy["x-v1-0-4", "x-v2-0-2"] == 1 and easy["x-v1-0-1", "x-v2-0-2"] == -1
    assert S.heatmap(rows.where("false")).count() == 0


def test_line_diff_rows(spark):
    text = lambda *ps: "\n\n".join(ps)
    a, b = "It is so in Fig. 3 here. The rest\nfollows.", "A last one stands here."
    files = [("x", 1, text(a, b)), ("x", 2, text(a.replace("so", "thus"), "New one.", b)), ("x", 3, None), ("y", 1, " \n\n "), ("y", 2, "One."), ("y", 2, "One. Two."), (None, 1, "z")]
    lines = V.version_lines(spark.createDataFrame([(*f, 5) for f in files], "arxivid string, version_no int, body string, idx int"))
    assert {(r.arxivid, r.version): r.lines for r in lines.collect()} == {
        ("x", 1): ["It is so in Fig. 3 here.", "The rest follows.", "", b, ""],
        ("x", 2): ["It is thus in Fig. 3 here.", "The rest follows.", "", "New one.", "", b, ""],
        ("y", 1): [], ("y", 2): ["One.", "Two.", ""],
    }
    got = {}
    for r in V.line_diff_rows(lines).orderBy("arxivid", "idx").collect():
        got.setdefault(r.arxivid, []).append((r.code, r.text, r.id1, r.id2))
    assert got["x"][:3] == [(-1, "It is so in Fig. 3 here.", "x-v1-0-0", None), (1, "It is thus in Fig. 3 here.", None, "x-v2-0-0"), (0, "The rest follows.", "x-v1-0-1", "x-v2-0-1")]
    assert (0, b, "x-v1-1-0", "x-v2-2-0") in got["x"] and [t for c, t, *_ in got["x"] if c == 1][1:] == ["New one.", ""]
    assert [c for c, *_ in got["y"]] == [1, 1, 1]
    whole = [(r.code, r.sentences) for r in V.paragraph_diff_rows(lines).where("arxivid = 'x'").orderBy("idx").collect()]
    assert (0, [b]) in whole and (1, ["New one."]) in whole and len(whole) == 4
    assert V.line_diff_rows(lines.where("false")).count() == 0


def test_machine_alignment_is_the_steps_in_order(spark):
    """Against a plain computation: filters, diff, then similar sentences of a block, then of the document."""
    one = "The quick brown fox jumps over the lazy dog near the river."
    two = "Completely different words stand in this sentence about nothing of note."
    three = "Another statement is made here about the shape of the signal."
    texts = [("a", 1, f"{one} {two}\n\n{three}"), ("a", 2, f"{one} {two.replace('nothing', 'something')}\n\nShort one.\n\n{three.replace('made', 'given')}"), ("h", 1, one), ("h", 2, one)]
    sources = [("a", 1, "\\input other"), ("h", 2, "x\n\\input harvmac\n"), ("a", 2, "% \\input harvmac"), ("a", 2, None)]
    files = lambda rows: spark.createDataFrame(rows, "arxivid string, version_no int, body string")
    rows, edges = V.machine_alignment(files(texts), files(sources))
    diff = rows.orderBy("arxivid", "idx").collect()
    assert {r.arxivid for r in diff} == {"a"}
    words = lambda t: [w for w in t.replace(".", " ").split()]
    alike = lambda x, y: K.similar(words(x), words(y), x.replace(".", " ."), y.replace(".", " ."))
    want, block = {(r.id1, r.id2) for r in diff if r.code == 0}, 0
    blocks = []
    for r in diff:
        blocks.append((block, r))
        block += r.text == "" and r.code <= 0
    old, new = ([x for x in blocks if x[1].code == c and len(words(x[1].text)) > 3] for c in (-1, 1))
    near = {(a.id1, b.id2) for p, a in old for q, b in new if p == q and alike(a.text, b.text)}
    left = [a for _, a in old if a.id1 not in {x for x, _ in near}], [b for _, b in new if b.id2 not in {y for _, y in near}]
    want |= near | {(a.id1, b.id2) for a in left[0] for b in left[1] if alike(a.text, b.text)}
    assert {(r.id1, r.id2) for r in edges.collect()} == want and len(near) >= 1


def test_states_and_solved_blocks(spark):
    rows = A.blocks(rows_of(spark, [(0, LONG), (-1, LONG + " again"), (1, LONG + " anew"), (0, ""), (-1, "tiny"), (-1, LONG + " lost")]))
    edges = A.identical(rows).unionByName(rows.limit(1).select(*A.PAIR, F.lit("x-v1-0-1").alias("id1"), F.lit("x-v2-0-2").alias("id2"), F.lit("s").alias("method")))
    st = A.statuses(rows, edges)
    assert [r.state for r in st.orderBy("idx").collect()] == ["solved", "solved", "used", "solved", "boring", "unknown"]
    assert {r.block: r.solved for r in A.solved_blocks(st).collect()} == {0: True, 1: False}


def test_copy_edits(spark):
    cases = [
        ("It is so.", "It is s0.", None), ("It is so.", "It is sox.", "correction"), ("It is so", "It is, so!?", "correction"), ("It is so.", "It is the so.", "word usage"),
        ("It is so.", "The it is so.", None), ("It is so.", "the It is the so.", None), ("It is so bright.", "It so is bright.", "word usage"), ("a\tb", "a b", "correction"),
    ]
    df = spark.createDataFrame([(a, b, k) for k, (a, b, _) in enumerate(cases)], "s1 string, s2 string, k int")
    got = {r.k: r.label for r in E.copy_edits(df).collect()}
    assert [got.get(k) for k in range(len(cases))] == [x for *_, x in cases]


def test_curated_pairs(spark):
    ids = spark.createDataFrame([("p", 4), ("q", 1)], "arxiv_id string, version_count int")
    present = spark.createDataFrame([("p", 1), ("p", 2), ("p", 4), ("p", 2)], "arxiv_id string, number int")
    assert [tuple(r) for r in M.curated_pairs(ids, present).collect()] == [("p", 1, 2)]
