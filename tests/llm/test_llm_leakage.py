import random

from tidemark.llm import leakage as L

DOC, ITEM = "doc_id bigint, text string, item_id int", "item_id bigint, text string, doc_id int"


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        if not t:
            continue
        s = L.stream_of(t)
        for i, x in items:
            w = L.words_of(x)
            if any(b"".join(w[k : k + n]) in s for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEM)
    return L.find_leaks(d, b, **kw)


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "be", "ta", "x1", "über", "straße", "ﬁn"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randrange(3, 12))) for k in range(25)]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(80)]
    docs += [(100 + k, text(5) + " " + items[k][1].upper().replace(" ", "-\u200b ") + text(5)) for k in range(25)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "alpha " * 5000), (203, "alpha " * 5000)]
    for n in (2, 4, 7):
        got = {(r.doc_id, r.item_id) for r in run(spark, docs, items, min_words=n).collect()}
        assert got == brute(docs, items, n)


def test_longest_passage_and_passes(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "zero " + item.replace("one ", "")), (2, item), (3, item.replace("seven", "7"))]
    items = [(9, item), (10, None), (11, "short"), (12, item + " more")]
    want = {(1, 9, 1, 12, 4), (2, 9, 0, 13, 0), (1, 12, 1, 12, 4), (2, 12, 0, 13, 0)}
    assert {tuple(r) for r in run(spark, docs, items).collect()} == want
    monkeypatch.setattr(L, "BYTES_PER_PASS", 30)
    assert {tuple(r) for r in run(spark, docs, items).collect()} == want


def test_empty_tables_and_removal(spark):
    assert run(spark, [], [(1, "a b c")]).count() == 0
    assert run(spark, [(1, "a b c")], []).count() == 0
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    leaks = spark.createDataFrame([(1, 5), (1, 6)], "doc_id bigint, item_id bigint")
    assert sorted(str(r.doc_id) for r in L.drop_leaking(d, leaks).collect()) == ["2", "None"]


def test_runs_stand_together(spark):
    """Passages of different places of a document make no longer one."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    docs = [(1, " ".join(words[:12]) + " between " + " ".join(words[1:])), (2, " ".join(words[:12]) + " ")]
    got = {tuple(r) for r in run(spark, docs, [(7, " ".join(words))]).collect()}
    assert got == {(1, 7, 0, 12, 0), (2, 7, 0, 12, 0)}


def test_vowel_signs_are_within_words():
    assert len(L.words_of("हर नमूना समान है")) == 4


def test_a_long_word_makes_no_other_passage_larger():
    items = [(1, "x" * 20_000 + " a b c d e f g h i j k"), (2, " ".join(f"word{k}" for k in range(14)))]
    p = L.Passages(items, 12)
    assert len(p) == 4 and p.heads.nbytes < 200_000
    at, which = p.search(L.stream_of(items[1][1]) + b"zz")
    assert sorted(zip(at.tolist(), p.word[which].tolist())) == [(0, 0), (5, 1), (10, 2)]
