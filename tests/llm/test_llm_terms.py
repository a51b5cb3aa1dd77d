from collections import Counter

import numpy as np
import pytest

from tidemark.llm import distinctive as D


def em(tf, bg, own=D.OWN):
    p = [x / sum(tf) for x in tf]
    for _ in range(500):
        e = [t * own * a / (own * a + (1 - own) * b) for t, a, b in zip(tf, p, bg)]
        p = [x / sum(e) for x in e]
    return p


def test_maximise_matches_plain_loops():
    tf = [np.array([3.0, 1, 1]), np.array([1.0]), np.array([2.0, 2])]
    bg = [np.array([0.5, 0.01, 0.2]), np.array([0.3]), np.array([0.1, 0.1])]
    got = D.maximise(np.concatenate(tf), np.concatenate(bg), np.array([0, 3, 4]))
    want = np.concatenate([em(t, b) for t, b in zip(tf, bg)])
    assert np.allclose(got, want, atol=1e-3)


def test_scores(spark):
    texts = [(k, "Every common word stands here") for k in range(30)] + [(40, "every common rarity"), (41, "rarity Rarity"), (42, None), (43, ""), (44, "a b 123")]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts], "struct_id bigint, text string, term string, df double")
    got = {(r.struct_id, r.term): r for r in D.score_terms(df, "struct_id", "text").collect()}
    counts = Counter(w for _, t in texts if t for w in set(t.lower().split()) if len(w) >= 4 and w.isalpha())
    assert {k[1]: v.df for k, v in got.items()} == dict(counts)
    assert set(i for i, _ in got) == {*range(30), 40, 41}
    assert got[41, "rarity"].tf == 2 and got[41, "rarity"].score == pytest.approx(1.0)
    assert got[40, "rarity"].score > got[40, "every"].score
    total = Counter()
    for (i, _), r in got.items():
        total[i] += r.score
    assert all(abs(v - 1) < 1e-9 for v in total.values())


def test_shared_terms_and_empty(spark):
    df = spark.createDataFrame([(k, "aaaa " + ("bbbb" if k < 2 else "cccc")) for k in range(5)], "struct_id bigint, text string")
    found = D.shared_rare_terms(D.score_terms(df, "struct_id", "text"), 3, 4)
    assert {(r.struct_id, r.term) for r in found.collect()} == {(k, "cccc") for k in (2, 3, 4)}
    assert D.score_terms(df.where("false"), "struct_id", "text").count() == 0
