import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import kernels as K

LISTS = st.lists(st.sampled_from("abcd"), max_size=12)


def slow_lcs(a, b):
    if not a or not b:
        return 0
    return slow_lcs(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(slow_lcs(a[:-1], b), slow_lcs(a, b[:-1]))


def test_hand_cases():
    assert K.lcs_length("abcd", "bxd") == 2
    assert K.lcs_length("q", "z") == 0
    assert K.lcs_length("xyx", "xxy") == 2
    assert K.lcs([], list("ab")) == []


@given(LISTS, LISTS)
def test_lcs_is_common_and_longest(a, b):
    c = K.lcs(a, b)
    for x in (a, b):
        it = iter(x)
        assert all(v in it for v in c)
    assert len(c) == K.lcs_length(a, b) <= min(len(a), len(b))
    if len(a) + len(b) <= 12:
        assert len(c) == slow_lcs(a, b)


@given(LISTS, LISTS)
def test_diff_rebuilds_both(a, b):
    d = K.fast_diff(a, b)
    assert [x for c, x in d if c <= 0] == a
    assert [x for c, x in d if c >= 0] == b
    assert len(d) >= max(len(a), len(b))


@settings(max_examples=30)
@given(st.lists(st.integers(1, 9), max_size=30))
def test_repeated_lists(a):
    assert K.lcs_length(a * 4, a * 4) == 4 * len(a)


def test_removed_precedes_added():
    assert K.fast_diff(["a", "x", "c"], ["a", "y", "c"]) == [(0, "a"), (-1, "x"), (1, "y"), (0, "c")]


def test_similar():
    a = "one two three four five six seven eight nine ten".split()
    assert K.similar(a, a)
    assert K.similar(a, a[:-1] + ["tens"])
    assert not K.similar(a, "quite another sentence with nothing shared at all here".split())
    assert K.similar(["two", "three"], a)  # contained, whatever the lengths
    assert not K.similar(["aaaa", "bbbb"], ["aaaa", "cccc", "dddd", "eeee"])


def edit(a, b):
    """Sentences of words and full stops only, whose tokens are told without the engine."""
    ts = [re.sub(r"([^\w\s])", r" \1 ", x.rstrip(".")).split() for x in (a, b)]
    return K.copy_edit(a, b, *ts)


def test_copy_edit_rules():
    assert edit("The result hold.", "The result holds.") == "correction"
    assert edit("We see, that it is.", "We see that, it is!.") == "correction"
    assert edit("We use 3 cups.", "We use 4 cups.") is None
    assert edit("We often see this effect.", "We see this effect often.") == "word usage"
    assert edit("Result of the test is old.", "The result of test is old.") is None
    assert edit("In limit we find it.", "In the limit we find it.") == "word usage"
    assert edit("Two words changed here.", "Both terms altered there.") is None


def test_mark_changes():
    assert K.mark_changes("a b c".split(), "a x c".split()) == ("a **b** c.", "a **x** c.")
    assert K.mark_changes("a".split(), "a b c".split()) == ("a.", "a **b c**.")


@given(LISTS, LISTS)
def test_halves_give_a_longest_one_too(a, b):
    before, K.MOST_CELLS = K.MOST_CELLS, 6
    try:
        c = K.lcs(a, b)
    finally:
        K.MOST_CELLS = before
    for x in (a, b):
        it = iter(x)
        assert all(v in it for v in c)
    assert len(c) == K.lcs_length(a, b)


def best(a, b):
    """``(words, characters)`` of the best common subsequence, by trying all."""
    if not a or not b:
        return (0, 0)
    out = max(best(a[:-1], b), best(a, b[:-1]))
    if a[-1] == b[-1]:
        n, c = best(a[:-1], b[:-1])
        out = max(out, (n + 1, c + len(a[-1])))
    return out


WORDS = st.lists(st.sampled_from(["a", "bb", "ccc", "dddd"]), max_size=6)


@given(WORDS, WORDS)
def test_common_characters(a, b):
    assert K.common_characters(a, b) == best(tuple(a), tuple(b))[1]


def test_similar_looks_at_punctuation_only_for_containment():
    a, b = "one two".split(), "one two three".split()
    assert K.similar(a, b, "one two", "one two three .")
    assert not K.similar(a, b, "one two .", "one two three .")


@pytest.mark.parametrize("old, new", [([], []), (["a", ""], []), (["a", "", "b", "c", ""], ["a", "", "c", "d", "", "e", ""])])
def test_diff_rows_places(old, new):
    rows = K.diff_rows(old, new)
    for side, lines in ((1, old), (2, new)):
        own = [r for r in rows if r[2 * side] >= 0]
        assert [r[1] for r in own] == lines
        p = s = 0
        for r in own:
            assert r[2 * side : 2 * side + 2] == (p, s)
            p, s = (p + 1, 0) if r[1] == "" else (p, s + 1)
