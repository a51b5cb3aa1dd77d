"""Fragments of ANSI SQL that say what the column expressions of ``functions.text`` say."""

from __future__ import annotations

from tidemark.functions.text import FALSE_MARKS, FALSE_SUFFIXES, PUNCTUATION, TAGS

_P = PUNCTUATION.replace("'", "''")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r]+'), lambda w: w <> '' AND strpos('{_P}', w) = 0)"


def real_words(x: str) -> str:
    tags = ", ".join(f"'{t}'" for t in TAGS)
    return f"list_filter({words(x)}, lambda w: w NOT IN ({tags}) AND NOT regexp_matches(w, '^\\p{{N}}+$'))"


def tag_count(x: str) -> str:
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, '{t}', ''))) // {len(t)}" for t in TAGS) + ")"


def without_tags(x: str) -> str:
    for t in TAGS:
        x = f"replace({x}, '{t}', ' ')"
    return x


def is_title(x: str) -> str:
    return f"regexp_matches({x}, '^#+ .')"


def sent_filter(x: str) -> str:
    bare = without_tags(x)
    nonspace, alpha = f"length(replace({bare}, ' ', ''))", f"length(regexp_replace({bare}, '[^\\p{{L}}]', '', 'g'))"
    return (
        f"(CASE WHEN {is_title(x)} THEN TRUE ELSE len({real_words(x)}) > 3 AND {tag_count(x)} < 0.5 * len({words(x)}) AND {nonspace} > 0 "
        f"AND ({alpha} + {tag_count(x)}) > 0.7 * ({nonspace} + {tag_count(x)}) END)"
    )


def is_boring(x: str) -> str:
    return f"({x} = '' OR {is_title(x)} OR NOT {sent_filter(x)})"


def preprocess(x: str) -> str:
    x = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}\\s])', ' \\1 ', 'g')"
    for t in TAGS:
        x = f"regexp_replace({x}, '\\[\\s+{t[1:-1]}\\s+\\]', '{t}', 'g')"
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g'))"


def bigrams(ws: str) -> str:
    return f"list_transform(range(1, len({ws})), lambda i: {ws}[i] || ' ' || {ws}[i + 1])"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


#: Rows of each pair's diff, each once, with the ids of either version.
DIFF = """d AS (SELECT arxivid, v1, v2, idx, code, coalesce(text, '') AS text, status, aligned, struct_id,
  CASE WHEN code <= 0 THEN identifiers[1] END AS id1, CASE WHEN code >= 0 THEN identifiers[len(identifiers)] END AS id2
  FROM (SELECT *, diff.code AS code, diff.sentence AS text, row_number() OVER (PARTITION BY arxivid, v1, v2, idx ORDER BY struct_id) AS rn
        FROM sentence_structs) WHERE rn = 1)"""
#: With the boring flag, and the block of the old version.
OPEN = (
    DIFF
    + f""", b AS (SELECT *, {is_boring('text')} AS boring, CAST(coalesce(sum(CASE WHEN text = '' AND code <= 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY arxivid, v1, v2 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS block FROM d)"""
)


def sentence_part(x: str, k: int) -> str:
    return f"regexp_extract({x}, '^(.*)-v?(\\d+)-(\\d+)-(\\d+)$', {k})"


def lcs_length(a: str, b: str) -> str:
    """Row by row over the first list; a row is built cell by cell over the second."""
    row = f"list_reduce(range(1, len({b}) + 1), lambda r, j: list_append(r, CASE WHEN {a}[i] = {b}[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], r[j]) END), [CAST(0 AS BIGINT)])"
    return f"list_reduce(range(1, len({a}) + 1), lambda prev, i: {row}, list_transform(range(0, len({b}) + 1), lambda k: CAST(0 AS BIGINT)))[len({b}) + 1]"


def diff_sim(a: str, b: str, same: str) -> str:
    n = lcs_length(a, b)
    return f"(CASE WHEN {same} THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 1 - ((len({a}) - {n}) / len({a}) + (len({b}) - {n}) / len({b})) / 2 END)"


def characters(ws: str) -> str:
    return f"length(array_to_string({ws}, ''))"


def kept_characters(a: str, b: str) -> str:
    """Characters of the common words in a longest common subsequence, of several the most: a million a word and one a character."""
    row = f"list_reduce(range(1, len({b}) + 1), lambda r, j: list_append(r, CASE WHEN {a}[i] = {b}[j] THEN greatest(prev[j] + 1000000 + length({a}[i]), prev[j + 1], r[j]) ELSE greatest(prev[j + 1], r[j]) END), [CAST(0 AS BIGINT)])"
    return f"(list_reduce(range(1, len({a}) + 1), lambda prev, i: {row}, list_transform(range(0, len({b}) + 1), lambda k: CAST(0 AS BIGINT)))[len({b}) + 1] % 1000000)"


def similar(a: str, b: str, one: str, two: str) -> str:
    """``a``, ``b``: words of the preprocessed texts ``one``, ``two``."""
    n, m = characters(a), characters(b)
    k = kept_characters(a, b)
    return (
        f"(CASE WHEN contains({one}, {two}) OR contains({two}, {one}) THEN TRUE WHEN {n} = 0 OR {m} = 0 OR {n} - {m} > 0.2 * {n} OR {m} - {n} > 0.4 * {n} THEN FALSE "
        f"ELSE {n} - {k} <= 0.2 * {n} AND {m} - {k} <= 0.4 * {n} END)"
    )


def join_false_splits(parts: str) -> str:
    suffixes = "(?:" + "|".join(x.replace(".", "\\.") for x in FALSE_SUFFIXES) + ")"
    doubled = " OR ".join(f"(ends_with(acc[-1], '{x}') AND starts_with(z, '{x}'))" for x in FALSE_MARKS)
    step = (
        f"CASE WHEN z = '.' OR z = '' THEN acc WHEN ({doubled}) AND regexp_matches(acc[-1], '{suffixes}[.(\\[]$') THEN list_append(list_slice(acc, 1, len(acc) - 1), acc[-1] || substr(z, 2)) "
        f"WHEN regexp_matches(acc[-1], '{suffixes}$') THEN list_append(list_slice(acc, 1, len(acc) - 1), acc[-1] || ' ' || z) ELSE list_append(acc, z) END"
    )
    bare = f"list_transform({parts}, lambda y: trim(regexp_replace(y, '[ \\t\\n\\r]+', ' ', 'g')))"
    return f"list_slice(list_reduce({bare}, lambda acc, z: {step}, [chr(2)]), 2, 1000000)"


def ssplit(x: str) -> str:
    marked = f"""regexp_replace({x}, '([.!?][)\\]"''”’]*)[ \\t\\n\\r]+([(\\["''“‘]*\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')"""
    marked = f"regexp_replace({marked}, '(\\[EQUATION\\])[ \\t\\n\\r]*([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return join_false_splits(f"string_split({marked}, chr(1))")


#: Sentences of each version with a text, in paragraphs; and in lines, a blank one after each paragraph.
VERSION_LINES = f"""vt AS (SELECT arxivid, version_no AS version, arg_max(body, (length(body), body)) AS b FROM text_files WHERE arxivid IS NOT NULL AND version_no IS NOT NULL AND body IS NOT NULL GROUP BY ALL),
  vp AS (SELECT arxivid, version, list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(replace(b, chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), chr(10) || chr(10)),
    lambda q: trim(replace(q, chr(10), ' '), ' ' || chr(9))), lambda q: q <> ''), lambda q: {ssplit('q')}), lambda ss: len(ss) > 0) AS paragraphs FROM vt),
  vl AS (SELECT *, flatten(list_transform(paragraphs, lambda ss: list_append(ss, ''))) AS lines FROM vp),
  vm AS (SELECT o.arxivid, o.version AS v1, n.version AS v2, o.lines AS l1, n.lines AS l2, o.paragraphs AS ps1, n.paragraphs AS ps2 FROM vl o JOIN vl n ON n.arxivid = o.arxivid AND n.version = o.version + 1)"""
