import random

import pytest

from tidemark.llm import names as N


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def some_names():
    rng = random.Random(8)
    out = set()
    for _ in range(60):
        s = "".join(rng.choice("abc|de") for _ in range(rng.randrange(4, 14)))
        out.add(s)
        for _ in range(3):
            k = rng.randrange(len(s))
            out.add(rng.choice([s[:k] + s[k + 1 :], s[:k] + "x" + s[k:], s[:k] + "y" + s[k + 1 :], s[:k] + s[k : k + 2][::-1] + s[k + 2 :]]))
    return sorted(x for x in out if len(x) >= 4)


def test_one_slip():
    xs = some_names()[:90]
    for a in xs:
        for b in xs:
            assert N.one_slip(a, b) == (osa(a, b) == 1)


@pytest.mark.parametrize("hot", [64, 0])
def test_segment_join_same_as_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(N, "HOT_KEY", hot)
    xs = some_names()
    got = {frozenset((r.a, r.b)) for r in N.segment_join(spark.createDataFrame([(x,) for x in xs], "k string")).collect()}
    assert got == {frozenset((a, b)) for a in xs for b in xs if a < b and osa(a, b) == 1}


@pytest.mark.parametrize(
    "first, last, parts",
    [
        (None, "al Jalasiki, Núria", ("nuria", "al", "jalasiki", "")),
        (None, "Edward J. von der Motosipa", ("edward", "von der", "motosipa", "j")),
        ("Quentin P.", "Rifusogoff, von der", ("quentin", "von der", "rifusogoff", "p")),
        ("ZOË", "AL HORUJIMAK", ("zoe", "al", "horujimak", "")),
        ("Peggy", "de Zerejihe Jr.", ("margaret", "de", "zerejihe", "")),
        ("Karl Heinz", "X (deceased)", ("karlheinz", "", "x", "")),
    ],
)
def test_parse(first, last, parts):
    p = N.parse(first, last)
    assert (p["first"], p["particle"], p["surname"], p["mid"]) == parts


def test_parse_initials_and_others():
    assert (N.parse("J.-P. B.", "Vep")["parts"], N.parse("J.-P. B.", "Vep")["mid"]) == ("jp", "b")
    assert (N.parse("A.L.", "Lot")["parts"], N.parse("A.L.", "Lot")["mid"]) == ("a", "l")
    assert N.parse("for the", "GIBAHIS Collaboration") == N.parse(None, "gibahis colaboration")
    assert N.parse(None, None)["kind"] == N.parse("", " ")["kind"] == N.parse("Anna", None)["kind"] == "none"


def test_pairs(spark):
    rows = [("Jonathan T.", "McPawasele"), ("Jonathan T.", "McPPawasele"), ("McPawasele", "Jonathan T."), ("J.", "McPawasele"), (None, "McPawasele, Jonathan T."), ("Edward", "McPawasele")]
    rows += [("Edward", "Bado")] * 2 + [("Ed", "Bado"), ("E.", "Bado"), ("Emma", "Bado"), ("Jonathan", f"Rest{'abcdefgh'[len(rows) % 8]}o")]
    rows += [("Jonathan", f"Na{c}{c}o") for c in "klmnp"] + [(None, None), (None, "VORA Collaboration"), ("the", "Vora Collab."), ("Robert", "Vora")]
    df = spark.createDataFrame([(k, f, n, "x", "y") for k, (f, n) in enumerate(rows)], "author_row bigint, first_name string, last_name string, entity string, n string")
    got = {(r.id_a, r.id_b) for r in N.same_name_pairs(df).collect()}
    one = range(5)
    want = {(a, b) for a in one for b in one if a < b}
    want |= {(6, 8), (7, 8)}  # E. Bado fits two persons and stays by itself
    orgs = [k for k, (f, n) in enumerate(rows) if n and "Colla" in n]
    want |= {tuple(orgs)}
    assert got == want
    assert N.same_name_pairs(df.where("false")).count() == 0


def test_slips_in_surnames_of_initials_and_in_collaborations(spark):
    rows = [("W.C.", "Fabolusuk"), ("William C.", "Fablousuk"), ("E.", "Webadoru"), ("E.", "Webadoruu"), ("E.", "Webadoru"), (None, "Vorapim Collaboration"), (None, "Voarpim Collaboration"), (None, "Vorapim 2 Collaboration"), (None, "Vorapim 3 Collaboration")]
    df = spark.createDataFrame([(k, f, n) for k, (f, n) in enumerate(rows)], "author_row bigint, first_name string, last_name string")
    assert {(r.id_a, r.id_b) for r in N.same_name_pairs(df).collect()} == {(0, 1), (2, 3), (3, 4), (5, 6)}


def test_pointers_are_followed_to_their_end(spark):
    step = spark.createDataFrame([(f"k{k}", f"k{min(k + 1, 6)}") for k in range(7)], "k string, to string")
    assert {(r.k, r.to) for r in N._settled(step).collect()} == {(f"k{k}", "k6") for k in range(7)}
