import random
import re
from math import ceil

import numpy as np
import pytest

from tidemark.llm import neardup as N


def brute(rows, t, least):
    first = {}
    for i, s in rows:
        if i is not None and s is not None:
            first[s] = min(i, first.get(s, i))
    sets = {i: set(re.findall(r"[^\W_]+", s.lower())) for s, i in first.items()}
    sets = sorted((i, x) for i, x in sets.items() if len(x) >= least)
    return {(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if len(x & y) >= t * len(x | y) - 1e-9}


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8])
def test_same_as_brute_force(spark, t):
    rng = random.Random(int(t * 10))
    vocab = [f"w{k}" for k in range(60)] + ["the", "of", "each"] * 8
    rows = []
    for k in range(150):
        s = [rng.choice(vocab) for _ in range(rng.choice([9, 12, 20, 30, 45, 80, 120]))]
        rows.append((k, " ".join(s)))
        for c in range(rng.randrange(3)):
            e = [w if rng.random() > 0.15 else rng.choice(vocab) for w in s]
            rng.shuffle(e)
            rows.append((1000 + 10 * k + c, " ".join(e)))
    rows += [(5000, rows[0][1]), (5001, rows[0][1] + "!"), (5002, None), (5003, ""), (5004, "few words"), (None, rows[1][1])]
    df = spark.createDataFrame([(i, s, 1, "x") for i, s in rows], "struct_id bigint, text string, size int, key string")
    got = [(r.id_a, r.id_b) for r in N.similar_texts(df, "struct_id", "text", t).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, t, N.MIN_WORDS)


def test_hot_group(spark):
    base = [f"v{k}" for k in range(12)]
    rows = [(k, " ".join(base + [f"x{k}"])) for k in range(60)] + [(100 + k, f"other words number {k} stand in this place {k * 7} and {k * 13} here") for k in range(30)]
    df = spark.createDataFrame(rows, "struct_id bigint, text string")
    got = {(r.id_a, r.id_b) for r in N.similar_texts(df, "struct_id", "text").collect()}
    assert got == brute(rows, 0.6, 8) and len(got) >= 60 * 59 // 2


def test_empty(spark):
    df = spark.createDataFrame([], "struct_id bigint, text string")
    assert N.similar_texts(df, "struct_id", "text").count() == 0


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_cuts_suffice(t):
    for b in range(1, 150):
        for a in range(b, int(b / t) + 1):
            o = ceil(t / (1 + t) * (a + b) - 1e-9)
            assert N.index_cut(b, t) >= b - o + 1
            assert N.probe_cut(a, t) >= min(a, a - o + 1)


@pytest.mark.parametrize("cell", [1, 4, 30])
def test_small_cells(spark, cell):
    """Cells of pairs and triples, and cells dealt out in blocks, give the same pairs."""
    rng = random.Random(cell)
    vocab = [f"w{k}" for k in range(25)] + ["the", "of", "each"] * 4
    rows = []
    for k in range(70):
        s = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 4, 9, 12, 20]))]
        rows += [(10 * k, " ".join(s)), (10 * k + 1, " ".join([*s[1:], "new"])), (10 * k + 2, " ".join([*s, f"x{k % 5}"]))]
    df = spark.createDataFrame(rows, "struct_id bigint, text string")
    got = [(r.id_a, r.id_b) for r in N.similar_texts(df, "struct_id", "text", 0.6, 1, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 1)


def test_groups_hold_similar_sets_and_bounds_skip_most():
    rng = np.random.default_rng(1)
    base = [np.sort(rng.choice(4000, 20, replace=False)) for _ in range(60)]
    sets = [np.sort(np.unique(np.concatenate([b[:-2], rng.choice(4000, 2)]))) for b in base for _ in range(N.GROUP_SIZE)]
    rng.shuffle(sets := [np.concatenate([[0], s[s > 0]]) for s in sets])
    lens = np.array([len(s) for s in sets])
    m = N.Members(np.arange(len(sets)), lens, np.ones(len(sets), bool), np.concatenate(sets), np.concatenate([[0], np.cumsum(lens)]))
    q, i, shared, groups, opened = N.search(m, m, 0.6)
    assert groups == 60 and opened < 0.1 * groups * len(sets)
    want = {(x, y) for x in range(len(sets)) for y in range(len(sets)) if (lens[y], y) < (lens[x], x) and len(np.intersect1d(sets[x], sets[y])) >= 0.6 * len(np.union1d(sets[x], sets[y])) - 1e-9}
    assert set(zip(q.tolist(), i.tolist())) == want and len(want) > 500
