"""Queries over all sentence pairs: what they give, and that they shuffle no pair."""

import pytest

import __spark_entry__ as entry_module
from tidemark.functions.kernels import Postings
from tidemark.sources import tables as T

STRUCT = "struct_id bigint, arxivid string, v1 int, v2 int, idx int, identifiers array<string>, diff struct<code:int,sentence:string>, status string, aligned array<int>"


def text(k):
    return " ".join(f"word{chr(97 + (k * j) % 26)}{chr(97 + j)}" for j in range(1, 8 + k % 5))


@pytest.fixture
def folder(spark, tmp_path):
    """Two version pairs, of 90 rows and of 6; rows repeated under new ids, equal texts, a null sentence and a null key."""
    rows = []
    for paper, n in (("a/1", 90), ("b", 6)):
        for k in range(n):
            code = (-1, 1, 0)[k % 3]
            ids = ([f"{paper}-v1-{k}-0"] if code <= 0 else []) + ([f"{paper}-v2-{k}-0"] if code >= 0 else [])
            rows.append((len(rows), paper, 1, 2, k, ids, (code, text(k % 40) + (" more" if k % 7 == 0 else "")), None, [k + 1, k + 2] if code == -1 and k % 2 else []))
    rows += [(1000 + k, *rows[k][1:6], (1, "repeated rows do not count here"), None, []) for k in (3, 4, 92)]
    rows += [(2000, "b", 1, 2, 6, ["b-v2-6-0"], (1, None), None, []), (2001, None, 1, 2, 0, ["x"], (0, text(1)), None, [])]
    spark.createDataFrame(rows, STRUCT).write.parquet(str(tmp_path / "sentence_structs.parquet"))
    return str(tmp_path)


def exchanged(plan):
    """Rows that the exchanges of a plan that ran have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(exchanged(plan.children().apply(k)) for k in range(plan.children().size()))


def against_sql(spark, folder, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view sentence_structs as select * from '{folder}/sentence_structs.parquet/*.parquet'")
    theirs = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    df = entry_module.queries()[name](spark, folder).select(*names)
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == sorted(map(repr, theirs.fetchall())) and got
    return df, len(got)


@pytest.fixture(params=[T.LARGE, 200])
def parted(request, spark, monkeypatch):
    monkeypatch.setattr(T, "LARGE", request.param)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_alignment_export_shuffles_no_cells(spark, folder, parted):
    df, n = against_sql(spark, folder, "alignment_export")
    assert df.where("aligning_method = 1").count() > 30
    assert n > 3600 > exchanged(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["jaccard_pairs", "jaccard_bigram_pairs", "similar_pairs"])
def test_values_of_text_pairs_shuffle_only_rows(spark, folder, parted, monkeypatch, name):
    monkeypatch.setattr("tidemark.operators.similarity.BLOCK", 7)
    monkeypatch.setattr("tidemark.operators.similarity.cut", None)  # nothing is written aside
    df, n = against_sql(spark, folder, name)
    assert n > 1500 > exchanged(df._jdf.queryExecution().executedPlan())


def test_words_in_common():
    many = [["a", "bb", "a"], [], ["bb", "ccc", "d"]]
    count, weight = Postings(many).shared([["bb", "x", "ccc"], [], ["a", "a"]], len)
    assert count.tolist() == [[1, 0, 2], [0, 0, 0], [1, 0, 0]] and weight.tolist() == [[2, 0, 5], [0, 0, 0], [1, 0, 0]]
    assert Postings([]).shared([["a"]])[0].shape == (1, 0)
