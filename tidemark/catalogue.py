"""All queries of the core, by key, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import detex as D
from tidemark.functions import text as X
from tidemark.functions import tokenizer as K
from tidemark.functions import udfs
from tidemark.operators import align as A
from tidemark.operators import blocks as B
from tidemark.operators import edits as E
from tidemark.operators import metadata as M
from tidemark.operators import sequences as Q
from tidemark.operators import similarity as S
from tidemark.operators import versions as V
from tidemark.plans import sqltext as L
from tidemark.plans.runtime import cut
from tidemark.sources import archives, harvest, sinks
from tidemark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PAIR = A.PAIR


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def big(*cols: str) -> list[F.Column]:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return T.diff_rows(T.table(spark, sf, "sentence_structs"))


def _stored_edges(rows: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """Edges that the table itself holds: kept rows, and the places in ``aligned``."""
    old = rows.where("code = -1").select(*on, "id1", F.explode("aligned").alias("idx"))
    new = rows.where("code = 1").select(*on, "idx", "id2")
    return A.identical(rows, on).unionByName(old.join(new, [*on, "idx"]).select(*on, "id1", "id2", F.lit("stored").alias("method")))


_EDGES = """e AS (SELECT arxivid, v1, v2, id1, id2, 'identical' AS method FROM d WHERE code = 0
  UNION ALL SELECT o.arxivid, o.v1, o.v2, o.id1, n.id2, 'stored' FROM (SELECT arxivid, v1, v2, id1, unnest(aligned) AS at FROM d WHERE code = -1) o
  JOIN d n ON n.arxivid = o.arxivid AND n.v1 = o.v1 AND n.v2 = o.v2 AND n.idx = o.at AND n.code = 1)"""

# --- sentences and filters -------------------------------------------------------------------

_LINES = """l AS (SELECT file_id, arxivid, trim(t, ' ' || chr(9) || chr(13)) AS line FROM
  (SELECT file_id, arxivid, unnest(string_split(body, chr(10))) AS t FROM text_files WHERE body IS NOT NULL))"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    files = T.table(spark, sf, "text_files").where("body is not null")
    return files.select("file_id", "arxivid", F.explode(T.lines_of("body")).alias("line"))


@query(
    f"""WITH {_LINES} SELECT file_id, count(*) AS n_lines, count(*) FILTER ({L.sent_filter('line')}) AS n_kept,
  count(*) FILTER ({L.is_title('line')}) AS n_titles, count(*) FILTER ({L.is_boring('line')}) AS n_boring,
  CAST(sum(len({L.words('line')})) AS BIGINT) AS n_words, CAST(sum({L.tag_count('line')}) AS BIGINT) AS n_tags,
  round(count(*) FILTER ({L.sent_filter('line')}) / count(*), 6) AS keep_rate FROM l WHERE line <> '' GROUP BY file_id"""
)
def sent_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = _lines(spark, sf).withColumns({"kept": X.sent_filter("line"), "title": X.is_title("line")})
    return df.groupBy("file_id").agg(
        F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), F.count_if("title").alias("n_titles"),
        F.count_if(F.col("title") | ~F.col("kept")).alias("n_boring"), F.sum(F.size(X.words("line"))).alias("n_words"),
        F.sum(X.tag_count("line")).alias("n_tags"), F.round(F.count_if("kept") / F.count("*"), 6).alias("keep_rate"),
    )


@query(f"WITH {L.DIFF} SELECT struct_id, {L.is_boring('text')} AS boring, {L.sent_filter('text')} AS kept FROM d")
def boring_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("struct_id", X.is_boring("text").alias("boring"), X.sent_filter("text").alias("kept"))


@query(f"WITH {_LINES} SELECT file_id, line, count(*) AS n FROM l WHERE {L.is_title('line')} GROUP BY ALL")
def title_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where(X.is_title("line")).groupBy("file_id", "line").agg(F.count("*").alias("n"))


_PARAGRAPHS = """ps AS (SELECT file_id, unnest(list_filter(list_transform(string_split(regexp_replace(replace(body, chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), chr(10) || chr(10)),
    lambda q: list_filter(list_transform(string_split(q, chr(10)), lambda z: trim(z, ' ' || chr(9) || chr(13))), lambda z: z <> '')), lambda q: len(q) > 0)) AS ss,
    unnest(range(0, 100000)) AS p FROM text_files WHERE body IS NOT NULL),
  u AS (SELECT file_id, CAST(p AS INTEGER) AS p, unnest(ss) AS text, unnest(range(0, len(ss))) AS s FROM ps WHERE ss IS NOT NULL)"""


@query(f"WITH {_PARAGRAPHS} SELECT file_id, p, CAST(s AS INTEGER) AS s, text FROM u")
def paragraph_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = T.table(spark, sf, "text_files").where("body is not null")
    return T.paragraph_sentences(files, ["file_id"])


@query(
    f"""WITH {_PARAGRAPHS} SELECT file_id, count(DISTINCT p) AS n_paragraphs, count(*) AS n_sentences FROM u WHERE {L.sent_filter('text')} GROUP BY file_id"""
)
def doc_filter_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    kept = paragraph_lines(spark, sf).where(X.sent_filter("text"))
    return kept.groupBy("file_id").agg(F.countDistinct("p").alias("n_paragraphs"), F.count("*").alias("n_sentences"))


@query("SELECT file_id, NOT regexp_matches(body, '(?m)^[^%\\n]*\\\\input harvmac') AS kept FROM latex_files WHERE body IS NOT NULL")
def harvmac_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = T.table(spark, sf, "latex_files").where("body is not null")
    return files.select("file_id", (~V.uses_harvmac("body")).alias("kept"))


@query(
    f"""WITH {L.DIFF}, c AS (SELECT *, len(list_filter({L.words(L.preprocess('text'))}, lambda w: w = '[MATH]')) >= 3 AS heavy FROM d)
  SELECT arxivid, v1, v2, count(*) FILTER (heavy AND code <= 0) * count(*) FILTER (heavy AND code >= 0) AS product,
  count(*) FILTER (heavy AND code <= 0) * count(*) FILTER (heavy AND code >= 0) <= 5000 AS kept FROM c GROUP BY arxivid, v1, v2"""
)
def doc_pair_filter(spark: SparkSession, sf: str) -> DataFrame:
    return V.rich_in_math(_diff(spark, sf))


@query(f"WITH {L.DIFF} SELECT struct_id, len({L.words('text')}) AS n_words, array_to_string({L.words('text')}, ' ') AS words FROM d")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("struct_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(
    f"""WITH {L.DIFF} SELECT struct_id, array_to_string(regexp_extract_all(text, '{K.TOKEN.replace("'", "''")}'), ' ') AS tokens,
  len(regexp_extract_all(text, '{K.TOKEN.replace("'", "''")}')) AS n_tokens FROM d"""
)
def token_texts(spark: SparkSession, sf: str) -> DataFrame:
    ts = _diff(spark, sf).select("struct_id", K.token_texts("text").alias("ts"))
    return ts.select("struct_id", F.array_join("ts", " ").alias("tokens"), F.size("ts").cast("bigint").alias("n_tokens"))


@query(
    f"""WITH {L.DIFF}, r AS (SELECT struct_id, length(text) - length(regexp_replace(text, '^\\s+', '')) AS lead, regexp_extract_all(text, '(?:{K.TOKEN.replace("'", "''")})\\s*') AS raw FROM d),
  x AS (SELECT struct_id, lead, raw, unnest(raw) AS t, unnest(range(1, len(raw) + 1)) AS i FROM r),
  y AS (SELECT *, lead + coalesce(list_sum(list_transform(list_slice(raw, 1, i - 1), lambda z: length(z))), 0) AS place, regexp_replace(t, '\\s+$', '') AS bare FROM x)
  SELECT struct_id, CAST(i - 1 AS INTEGER) AS pos, bare AS text, substr(t, length(bare) + 1) AS ws, CAST(place AS INTEGER) AS start, CAST(place + length(bare) AS INTEGER) AS stop FROM y"""
)
def token_spans(spark: SparkSession, sf: str) -> DataFrame:
    ts = _diff(spark, sf).select("struct_id", F.posexplode(K.tokens("text")).alias("pos", "t"))
    return ts.select("struct_id", "pos", "t.text", "t.ws", "t.start", "t.stop")


@query(f"WITH {L.DIFF}, w AS (SELECT {L.words('text')} AS ws FROM d), g AS (SELECT unnest({L.bigrams('ws')}) AS bigram FROM w) SELECT bigram, count(*) AS n FROM g GROUP BY bigram")
def word_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select(F.explode(X.n_grams("words", 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query(
    f"""WITH {L.DIFF}, w AS (SELECT list_transform({L.words('text')}, lambda z: lower(z)) AS ws FROM d),
  g AS (SELECT 1 AS k, unnest(ws) AS gram FROM w UNION ALL SELECT 2, unnest({L.bigrams('ws')}) FROM w
    UNION ALL SELECT 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w)
  SELECT gram, k, count(*) AS n FROM g GROUP BY gram, k HAVING count(*) > 1"""
)
def ngrams_1_to_n(spark: SparkSession, sf: str) -> DataFrame:
    low = _diff(spark, sf).select(F.transform("words", F.lower).alias("ws"))
    grams = None
    for k in (1, 2, 3):
        g = low.select(F.explode(X.n_grams("ws", k)).alias("gram"), F.lit(k).alias("k"))
        grams = g if grams is None else grams.unionByName(g)
    return grams.groupBy("gram", "k").agg(F.count("*").alias("n")).where("n > 1")


@query(
    """SELECT file_id, CAST(len(parts) AS BIGINT) AS n_parts, array_to_string(parts, chr(1)) AS parts FROM (SELECT file_id,
  string_split(regexp_replace(body, '(\\[EQUATION\\])\\s*([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM text_files WHERE body IS NOT NULL)"""
)
def split_on_tag(spark: SparkSession, sf: str) -> DataFrame:
    parts = T.table(spark, sf, "text_files").where("body is not null").select("file_id", X.split_on_tag("body").alias("parts"))
    return parts.select("file_id", F.size("parts").cast("bigint").alias("n_parts"), F.array_join("parts", "\u0001").alias("parts"))


@query(
    f"""WITH {_PARAGRAPHS}, n AS (SELECT file_id, CAST(p AS INTEGER) AS p, CAST(s AS INTEGER) AS s, string_split(regexp_replace(text, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS naive FROM u),
  j AS (SELECT *, {L.join_false_splits('naive')} AS joined FROM n)
  SELECT file_id, p, s, CAST(len(naive) AS INTEGER) AS n_split, CAST(len(joined) AS INTEGER) AS n_joined, array_to_string(joined, chr(10)) AS sentences FROM j"""
)
def join_false_splits(spark: SparkSession, sf: str) -> DataFrame:
    ps = paragraph_lines(spark, sf)
    naive = F.split(F.regexp_replace("text", "([.!?]) +", "$1\u0001"), "\u0001")
    return ps.select("file_id", "p", "s", F.size(naive).alias("n_split"), X.join_false_splits(naive).alias("j")).select(
        "file_id", "p", "s", "n_split", F.size("j").alias("n_joined"), F.array_join("j", "\n").alias("sentences")
    )


@query(
    f"""WITH {L.VERSION_LINES}, q AS (SELECT arxivid, version, unnest(paragraphs) AS ss, unnest(range(0, len(paragraphs))) AS p FROM vp)
  SELECT arxivid, version, CAST(p AS INTEGER) AS p, CAST(unnest(range(0, len(ss))) AS INTEGER) AS s, unnest(ss) AS text FROM q"""
)
def file_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of detexed texts by the core's splitter."""
    lines = V.version_lines(T.table(spark, sf, "text_files"))
    return lines.select("arxivid", "version", F.posexplode("paragraphs").alias("p", "ss")).select("arxivid", "version", "p", F.posexplode("ss").alias("s", "text"))


@query(
    f"""WITH {L.VERSION_LINES} SELECT arxivid, v1, v2, array_to_string(l1, chr(10)) AS old, array_to_string(l2, chr(10)) AS new, CAST({L.lcs_length('l1', 'l2')} AS BIGINT) AS n_kept,
  len(l1) + len(l2) - CAST({L.lcs_length('l1', 'l2')} AS BIGINT) AS n_rows, TRUE AS in_place FROM vm WHERE len(l1) + len(l2) > 0"""
)
def line_diff_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """What the line diff must give back: either version, line by line, with as many kept lines as can be, and rows whose
    ids count paragraphs and sentences as the files do."""
    rows = cut(line_diff_rows(spark, sf))
    ids = lambda k: F.count_if(F.col(f"id{k}").isNotNull())
    part = lambda test: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("idx", "code", "text"))), test), lambda r: r["text"]), "\n")
    old, new = F.count_if(F.col("code") <= 0), F.count_if(F.col("code") >= 0)
    distinct = (F.countDistinct("id1") == old) & (F.countDistinct("id2") == new) & (ids(1) == old) & (ids(2) == new)
    return rows.groupBy(*PAIR).agg(
        part(lambda r: r["code"] <= 0).alias("old"), part(lambda r: r["code"] >= 0).alias("new"), F.count_if(F.col("code") == 0).alias("n_kept"), F.count("*").alias("n_rows"),
        distinct.alias("in_place"),
    )


@query()
def line_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.line_diff_rows(V.version_lines(T.table(spark, sf, "text_files")))


@query(
    f"""WITH {L.VERSION_LINES}, q AS (SELECT *, list_transform(ps1, lambda x: array_to_string(x, '<SENT>')) AS q1, list_transform(ps2, lambda x: array_to_string(x, '<SENT>')) AS q2 FROM vm)
  SELECT arxivid, v1, v2, array_to_string(q1, chr(10)) AS old, array_to_string(q2, chr(10)) AS new, CAST({L.lcs_length('q1', 'q2')} AS BIGINT) AS n_kept FROM q WHERE len(q1) + len(q2) > 0"""
)
def paragraph_diff_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    rows = paragraph_diff_rows(spark, sf).withColumn("t", F.array_join("sentences", V.SENTENCE))
    part = lambda test: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("idx", "code", "t"))), test), lambda r: r["t"]), "\n")
    return rows.groupBy(*PAIR).agg(part(lambda r: r["code"] <= 0).alias("old"), part(lambda r: r["code"] >= 0).alias("new"), F.count_if(F.col("code") == 0).alias("n_kept"))


@query()
def paragraph_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.paragraph_diff_rows(V.version_lines(T.table(spark, sf, "text_files")))


@query()
def machine_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """From texts to aligned sentences: filters, diff, identical, block and document steps."""
    return V.machine_alignment(T.table(spark, sf, "text_files"), T.table(spark, sf, "latex_files"))[1]


@query(f"WITH {_LINES} SELECT file_id, count(*) FILTER (line = '' OR {L.is_title('line')}) AS n FROM l GROUP BY file_id")
def titles_or_newlines(spark: SparkSession, sf: str) -> DataFrame:
    files = T.table(spark, sf, "text_files").where("body is not null")
    lines = files.select("file_id", F.explode(F.transform(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))).alias("line"))
    return lines.groupBy("file_id").agg(F.count_if(X.is_title_or_newline("line")).alias("n"))


@query("SELECT file_id, length(replace(body, chr(0), '')) AS n, replace(body, chr(0), '') AS body FROM latex_files WHERE body IS NOT NULL")
def null_bytes(spark: SparkSession, sf: str) -> DataFrame:
    clean = X.remove_nullbytes("body")
    return T.table(spark, sf, "latex_files").where("body is not null").select("file_id", F.length(clean).cast("bigint").alias("n"), clean.alias("body"))


@query(
    f"""WITH {L.DIFF} SELECT struct_id, array_to_string(list_transform({L.tokens("replace(replace(text, '(', ' -LRB- '), ')', ' -RRB- ')")},
  lambda t: CASE t WHEN '-LRB-' THEN '(' WHEN '-RRB-' THEN ')' ELSE t END), ' ') AS tokens FROM d"""
)
def bracket_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Treebank bracket tokens as brackets again."""
    treebank = F.replace(F.replace("text", F.lit("("), F.lit(" -LRB- ")), F.lit(")"), F.lit(" -RRB- "))
    return _diff(spark, sf).select("struct_id", F.array_join(F.transform(X.tokens(treebank), X.unescape_brackets), " ").alias("tokens"))


@query("SELECT struct_id, array_to_string(list_transform(identifiers, lambda i: trim(i)), ' | ') AS ids, len(identifiers) AS n FROM sentence_structs WHERE identifiers IS NOT NULL")
def parsed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids written as one field, as of merged sentences, and read again."""
    field = T.table(spark, sf, "sentence_structs").where("identifiers is not null").select("struct_id", F.array_join("identifiers", ",").alias("f"))
    return field.select("struct_id", F.array_join(E.parse_ids("f"), " | ").alias("ids"), F.size(E.parse_ids("f")).cast("bigint").alias("n"))


@query(f"WITH {L.VERSION_LINES} SELECT arxivid, version, len(flatten(paragraphs)) AS n_sentences, array_to_string(flatten(paragraphs), chr(10)) AS text, array_to_string(lines, chr(10)) AS lines FROM vl")
def flattened_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    v = V.version_lines(T.table(spark, sf, "text_files"))
    flat = X.flatten_once("paragraphs")
    return v.select("arxivid", "version", F.size(flat).cast("bigint").alias("n_sentences"), F.array_join(flat, "\n").alias("text"), F.array_join(X.paragraphs_to_lines("paragraphs"), "\n").alias("lines"))


@query(f"WITH {L.VERSION_LINES} SELECT arxivid, version, array_to_string(list_transform(paragraphs, lambda ss: array_to_string(ss, chr(10))), chr(10) || chr(10)) AS body FROM vl WHERE len(paragraphs) > 0")
def sentence_file_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """What is written to the sentence file of each version."""
    return sinks.sentence_bodies(file_sentences(spark, sf), ["arxivid", "version"])


@query(f"WITH {L.DIFF} SELECT struct_id, {L.preprocess('text')} AS sentence FROM d")
def preprocess_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("struct_id", X.preprocess_sent("text").alias("sentence"))


@query(
    f"""WITH i AS (SELECT struct_id, unnest(identifiers) AS id FROM sentence_structs)
  SELECT struct_id, id, {L.sentence_part('id', 1)} AS arxivid, TRY_CAST({L.sentence_part('id', 2)} AS INTEGER) AS version,
  TRY_CAST({L.sentence_part('id', 3)} AS INTEGER) AS p, TRY_CAST({L.sentence_part('id', 4)} AS INTEGER) AS s FROM i"""
)
def sentence_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = T.table(spark, sf, "sentence_structs").select("struct_id", F.explode("identifiers").alias("id"))
    return ids.select("struct_id", "id", X.sentence_id("id").alias("x")).select("struct_id", "id", "x.*")


@query("SELECT file_id, regexp_replace(body, '(^|[^\\\\])%[^\\n]*', '\\1', 'g') AS body FROM latex_files WHERE body IS NOT NULL")
def remove_comments(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "latex_files").where("body is not null").select("file_id", X.remove_comments("body").alias("body"))


@query(
    f"""WITH {L.DIFF} SELECT struct_id, regexp_replace(regexp_replace(text, '\\[MATH\\](?:[ \\t\\n\\r]+\\[MATH\\])+', '[MATH]', 'g'),
  '\\[EQUATION\\](?:[ \\t\\n\\r]+\\[EQUATION\\])+', '[EQUATION]', 'g') AS text FROM d"""
)
def collapse_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("struct_id", X.collapse_tags("text").alias("text"))


@query()
def detex_clean(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "latex_files").where("body is not null").select("file_id", D.detex_udf("body").alias("text"))


@query()
def detex_scan(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "latex_files").where("body is not null").select("file_id", D.scan_udf("body").alias("text"))


@query(
    """SELECT file_id, regexp_replace(regexp_replace(replace(body, chr(10), ' '), '(?s)\\$\\$.*\\$\\$', '', 'g'), '\\$ *([^$ ]|[0-9]+(?:\\.[0-9]+)?) *\\$', '\\1', 'g') AS body
  FROM latex_files WHERE body IS NOT NULL"""
)
def inline_math(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "latex_files").where("body is not null").select("file_id", X.reduce_inline_math("body").alias("body"))


@query(
    """SELECT file_id, CASE WHEN body IS NULL THEN 'missing' WHEN trim(lower(body)) = '' THEN 'empty' WHEN starts_with(lower(body), '%pdf') THEN 'pdf'
  WHEN starts_with(lower(body), '%!ps') THEN 'postscript' WHEN contains(lower(body), '<html') OR contains(lower(body), '<!doctype html') THEN 'html'
  WHEN contains(lower(body), '\\documentclass') OR contains(lower(body), '\\documentstyle') OR contains(lower(body), '\\begin{document}') THEN 'tex'
  ELSE 'text' END AS kind FROM latex_files"""
)
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "latex_files").select("file_id", X.content_type("body").alias("kind"))


@query(
    """WITH f AS (SELECT *, regexp_matches(body, '\\\\document(?:class|style)|\\\\begin\\s*\\{document\\}') AS begins,
    regexp_matches(lower(latex_path), '\\.(dtx|sty|bbl)$') AS aux FROM latex_files WHERE length(body) > 0),
  c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (begins) OVER w AS b FROM f WINDOW w AS (PARTITION BY arxivid)),
  k AS (SELECT *, row_number() OVER (PARTITION BY arxivid ORDER BY length(body) DESC, file_id) AS rn FROM c WHERE n = 1 OR (begins AND (b = 1 OR NOT aux)))
  SELECT arxivid, file_id, latex_path, CAST(length(body) AS INTEGER) AS n_chars FROM k WHERE rn = 1"""
)
def file_selection_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return M.main_file(T.table(spark, sf, "latex_files"), ["arxivid"])


# --- metadata --------------------------------------------------------------------------------


@query("SELECT arxiv_id, max(number) AS version_count FROM versions GROUP BY arxiv_id HAVING max(number) > 1")
def multi_version_papers(spark: SparkSession, sf: str) -> DataFrame:
    return M.multi_version(T.table(spark, sf, "versions"))


@query(
    """WITH m AS (SELECT arxiv_id, max(number) AS n FROM versions GROUP BY arxiv_id HAVING max(number) > 1)
  SELECT arxiv_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS version FROM m"""
)
def version_expand(spark: SparkSession, sf: str) -> DataFrame:
    return M.expand_versions(multi_version_papers(spark, sf))


@query(
    """WITH m AS (SELECT arxiv_id, max(number) AS n FROM versions GROUP BY arxiv_id HAVING max(number) > 1),
  x AS (SELECT arxiv_id, CAST(unnest(range(1, n)) AS INTEGER) AS v1 FROM m) SELECT arxiv_id, v1, v1 + 1 AS v2 FROM x"""
)
def announced_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return M.announced_pairs(multi_version_papers(spark, sf))


_TIMES = "t AS (SELECT arxiv_id, number, min(version_time) AS version_time FROM versions WHERE arxiv_id IS NOT NULL AND number IS NOT NULL GROUP BY arxiv_id, number)"
_DELTAS = f"""{_TIMES}, dd AS (SELECT a.arxiv_id, a.number AS v1, b.number AS v2,
  CAST(floor((epoch_us(a.version_time) - epoch_us(b.version_time)) / 86400000000.0) AS INTEGER) AS days FROM t a JOIN t b ON a.arxiv_id = b.arxiv_id AND b.number = a.number + 1)"""


@query(f"WITH {_TIMES} SELECT a.arxiv_id, a.number AS v1, b.number AS v2 FROM t a JOIN t b ON a.arxiv_id = b.arxiv_id AND b.number = a.number + 1")
def version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return M.version_pairs(M.version_times(T.table(spark, sf, "versions"))).select("arxiv_id", "v1", "v2")


@query(
    """WITH m AS (SELECT arxiv_id, max(number) AS n FROM versions GROUP BY arxiv_id HAVING max(number) > 1), x AS (SELECT arxiv_id, CAST(unnest(range(1, n)) AS INTEGER) AS v1 FROM m),
  f AS (SELECT DISTINCT arxivid, version_no FROM text_files WHERE body IS NOT NULL)
  SELECT arxiv_id, v1, v1 + 1 AS v2 FROM x WHERE (arxiv_id, v1) IN (SELECT (arxivid, version_no) FROM f) AND (arxiv_id, v1 + 1) IN (SELECT (arxivid, version_no) FROM f)"""
)
def curated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    present = T.table(spark, sf, "text_files").where("body is not null").select(F.col("arxivid").alias("arxiv_id"), F.col("version_no").alias("number"))
    return M.curated_pairs(multi_version_papers(spark, sf), present)


@query(
    f"""WITH {_TIMES}, i AS (SELECT DISTINCT arxiv_id, replace(arxiv_id, '/', '-') AS id, number AS v FROM t)
  SELECT arxiv_id, v AS version, id || '/v' || v || '/extra/' || id || '-v' || v || '.gz' AS source, id || '/v' || v || '/extra/' || id || '-v' || v || '.txt' AS text,
  id || '/v' || v || '/' || id || '-v' || v || '-sentences.txt' AS sentences, id || '-v' || v || '-v' || (v + 1) || '.csv' AS machine, CAST(NULL AS VARCHAR) AS backwards,
  'code --diff ' || id || '/v' || v || '/' || id || '-v' || v || '-sentences.txt ' || id || '/v' || (v + 1) || '/' || id || '-v' || (v + 1) || '-sentences.txt' AS command FROM i"""
)
def file_paths(spark: SparkSession, sf: str) -> DataFrame:
    v = M.version_times(T.table(spark, sf, "versions")).select("arxiv_id", F.col("number").alias("version"), (F.col("number") + 1).alias("v2"))
    return v.select(
        "arxiv_id", "version", *[X.version_file("arxiv_id", "version", k).alias(k) for k in ("source", "text", "sentences")], X.pair_file("arxiv_id", "version", "v2", "machine").alias("machine"),
        X.pair_file("arxiv_id", "v2", "version", "machine").alias("backwards"), X.compare_command("arxiv_id", "version", "v2").alias("command"),
    )


@query(
    f"""WITH {_TIMES}, a AS (SELECT arxivid AS arxiv_id, version_no AS number, max(file_id) AS x FROM latex_files GROUP BY ALL), b AS (SELECT arxivid AS arxiv_id, version_no AS number, max(file_id) AS x FROM text_files GROUP BY ALL),
  k AS (SELECT arxiv_id, number, x FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (arxiv_id, number))
  SELECT arxiv_id, string_agg(number || '=' || x, ' ' ORDER BY number) AS merged FROM k WHERE arxiv_id IN (SELECT arxiv_id FROM a) AND arxiv_id IN (SELECT arxiv_id FROM b) GROUP BY arxiv_id"""
)
def merged_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maps from version to file of sources and texts, texts' entries over sources' ones."""

    def files(name: str) -> DataFrame:
        last = T.table(spark, sf, name).groupBy(F.col("arxivid").alias("arxiv_id"), "version_no").agg(F.max("file_id").alias("x"))
        return last.groupBy("arxiv_id").agg(F.map_from_entries(F.collect_list(F.struct("version_no", "x"))).alias(name))

    both = files("latex_files").join(files("text_files"), "arxiv_id").withColumn("m", X.merge_maps("latex_files", "text_files"))
    entries = F.array_sort(F.map_entries("m"))
    return both.select("arxiv_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), " ").alias("merged"))


@query(f"WITH {_DELTAS} SELECT arxiv_id, v1, v2, days FROM dd")
def version_day_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return M.day_deltas(M.version_pairs(M.version_times(T.table(spark, sf, "versions"))))


@query(
    f"""WITH {_DELTAS} SELECT v1, v2, round(avg(days), 6) AS mean_days, round(quantile_cont(days, 0.5), 6) AS median_days, count(*) AS n
  FROM dd WHERE days IS NOT NULL GROUP BY v1, v2"""
)
def avg_time_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return M.delta_measures(
        version_day_deltas(spark, sf), mean_days=lambda d: F.round(F.avg(d), 6), median_days=lambda d: F.round(F.percentile(d, 0.5), 6), n=F.count
    )


@query(
    f"""WITH {_TIMES}, v AS (SELECT arxiv_id, count(*) AS n_versions, max(number) AS last_version FROM t GROUP BY arxiv_id),
  c AS (SELECT arxiv_id, string_agg(DISTINCT spec, ' ' ORDER BY spec) AS categories FROM categories GROUP BY arxiv_id),
  a AS (SELECT arxiv_id, count(DISTINCT (coalesce(first_name, ''), last_name)) AS n_authors FROM authors GROUP BY arxiv_id)
  SELECT arxiv_id, n_versions, last_version, categories, n_authors FROM v JOIN c USING (arxiv_id) JOIN a USING (arxiv_id)"""
)
def paper_metadata(spark: SparkSession, sf: str) -> DataFrame:
    df = M.assemble(T.table(spark, sf, "versions"), T.table(spark, sf, "categories"), T.table(spark, sf, "authors"))
    return df.select(
        "arxiv_id", F.size("versions").cast("bigint").alias("n_versions"), F.array_max(F.map_keys("versions")).alias("last_version"),
        F.array_join("categories", " ").alias("categories"), F.size("authors").cast("bigint").alias("n_authors"),
    )


@query(
    """SELECT arxiv_id, min(spec) AS spec FROM categories WHERE arxiv_id NOT IN (SELECT arxivid FROM latex_files WHERE arxivid IS NOT NULL) GROUP BY arxiv_id"""
)
def insert_ignore_new_papers(spark: SparkSession, sf: str) -> DataFrame:
    known = T.table(spark, sf, "latex_files").select(F.col("arxivid").alias("arxiv_id"))
    return M.insert_ignore(known, T.table(spark, sf, "categories").select("arxiv_id", "spec"), ["arxiv_id"])


@query(
    """SELECT v.arxiv_id, v.number, c.spec FROM (SELECT DISTINCT arxiv_id, number FROM versions) v JOIN categories c USING (arxiv_id)
  WHERE v.arxiv_id NOT IN (SELECT arxivid FROM text_files WHERE arxivid IS NOT NULL)"""
)
def harvest_merge(spark: SparkSession, sf: str) -> DataFrame:
    seen = T.table(spark, sf, "text_files").select(F.col("arxivid").alias("arxiv_id"))
    v = T.table(spark, sf, "versions").select("arxiv_id", "number").distinct()
    return M.merge_streams(v, T.table(spark, sf, "categories").select("arxiv_id", "spec"), "arxiv_id", seen)


@query(
    """WITH l AS (SELECT DISTINCT regexp_extract(latex_path, '/([^/]+)/v(\\d+)/', 1) AS id, CAST(regexp_extract(latex_path, '/([^/]+)/v(\\d+)/', 2) AS INTEGER) AS version
  FROM latex_files WHERE regexp_matches(latex_path, '/([^/]+)/v(\\d+)/')) SELECT id, max(version) AS version, count(*) AS n_versions FROM l GROUP BY id"""
)
def directory_listing(spark: SparkSession, sf: str) -> DataFrame:
    listed = T.file_listing(T.table(spark, sf, "latex_files"), "latex_path")
    return listed.groupBy("id").agg(F.max("version").alias("version"), F.count("*").alias("n_versions"))


@query("SELECT arxiv_id, replace(arxiv_id, '/', '-') AS path FROM papers")
def id_paths(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "papers").select("arxiv_id", X.id_to_path("arxiv_id").alias("path"))


@query("SELECT arxiv_id FROM papers ORDER BY md5(arxiv_id), arxiv_id LIMIT 100")
def paper_sample(spark: SparkSession, sf: str) -> DataFrame:
    return M.hash_sample(T.table(spark, sf, "papers"), "arxiv_id", 100).select("arxiv_id")


@query(
    f"""WITH {_TIMES}, f AS (SELECT DISTINCT arxivid AS arxiv_id, version_no AS number FROM text_files WHERE body IS NOT NULL)
  SELECT count(*) AS total, count(f.number) AS done, round(100 * count(f.number) / count(*), 6) AS percent FROM t LEFT JOIN f ON t.arxiv_id = f.arxiv_id AND t.number = f.number"""
)
def progress_percent(spark: SparkSession, sf: str) -> DataFrame:
    all_keys = M.version_times(T.table(spark, sf, "versions"))
    done = T.table(spark, sf, "text_files").where("body is not null").select(F.col("arxivid").alias("arxiv_id"), F.col("version_no").alias("number"))
    return M.progress(all_keys, done, ["arxiv_id", "number"])


@query(
    f"""WITH {_TIMES}, f AS (SELECT DISTINCT arxivid AS arxiv_id, version_no AS number FROM text_files)
  SELECT t.arxiv_id, count(*) = count(f.number) AS complete FROM t LEFT JOIN f ON t.arxiv_id = f.arxiv_id AND t.number = f.number GROUP BY t.arxiv_id"""
)
def all_versions_present(spark: SparkSession, sf: str) -> DataFrame:
    f = T.table(spark, sf, "text_files").select(F.col("arxivid").alias("arxiv_id"), F.col("version_no").alias("number"), F.lit(1).alias("x")).distinct()
    t = M.version_times(T.table(spark, sf, "versions")).join(f, ["arxiv_id", "number"], "left")
    return t.groupBy("arxiv_id").agg((F.count("*") == F.count("x")).alias("complete"))


@query(
    f"""WITH {L.DIFF}, p AS (SELECT arxivid, v1, v2, count(*) FILTER (code <= 0 AND text <> '') AS n1, count(*) FILTER (code >= 0 AND text <> '') AS n2,
    CAST(sum(len({L.words('text')})) FILTER (code >= 0) AS BIGINT) AS w2 FROM d GROUP BY arxivid, v1, v2)
  SELECT count(DISTINCT arxivid) AS n_papers, count(*) AS n_pairs, CAST(sum(n1) AS BIGINT) AS n_old_sentences, CAST(sum(n2) AS BIGINT) AS n_new_sentences,
  CAST(sum(w2) AS BIGINT) AS n_new_words FROM p"""
)
def corpus_overview(spark: SparkSession, sf: str) -> DataFrame:
    full = F.col("text") != ""
    per = _diff(spark, sf).groupBy(*PAIR).agg(
        F.count_if(full & (F.col("code") <= 0)).alias("n1"), F.count_if(full & (F.col("code") >= 0)).alias("n2"),
        F.sum(F.when(F.col("code") >= 0, F.size("words"))).alias("w2"),
    )
    return per.agg(
        F.countDistinct("arxivid").alias("n_papers"), F.count("*").alias("n_pairs"), F.sum("n1").alias("n_old_sentences"),
        F.sum("n2").alias("n_new_sentences"), F.sum("w2").alias("n_new_words"),
    )


_XML = """x AS (SELECT arxiv_id, number, date_trunc('second', min(version_time)) AS version_time FROM versions WHERE arxiv_id IS NOT NULL AND number IS NOT NULL GROUP BY ALL)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Harvested records made of the tables, an XML text each, and read again."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tagged = lambda name, c: F.concat(F.lit(f"<{name}>"), esc(c), F.lit(f"</{name}>"))
    date = F.coalesce(tagged("date", F.date_format("version_time", "EEE, d MMM yyyy HH:mm:ss 'GMT'")), F.lit(""))
    v = M.version_times(T.table(spark, sf, "versions")).withColumn("x", F.concat(F.lit('<version version="v'), F.col("number").cast("string"), F.lit('">'), date, F.lit("</version>")))
    a = T.table(spark, sf, "authors").where("first_name is not null and trim(first_name) <> '' and trim(last_name) <> ''")
    a = a.withColumn("x", F.concat(tagged("keyname", F.trim("last_name")), tagged("forenames", F.trim("first_name"))))
    c = T.table(spark, sf, "categories").withColumn("x", tagged("setSpec", F.col("spec")))
    parts = [df.select("arxiv_id", "x") for df in (v, a, c)]
    text = F.concat(F.lit("<record>"), tagged("id", F.col("arxiv_id")), F.array_join(F.array_sort(F.collect_list("x")), ""), F.lit("</record>"))
    return harvest.parse_records(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("arxiv_id").agg(text.alias("value")))


@query(f"WITH {_XML} SELECT arxiv_id, number, version_time FROM x")
def harvested_versions(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.versions_of(_records(spark, sf)).withColumn("version_time", F.col("version_time").cast("timestamp_ntz"))


@query("SELECT DISTINCT arxiv_id, spec FROM categories")
def harvested_categories(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.categories_of(_records(spark, sf))


@query("SELECT DISTINCT arxiv_id, trim(first_name) AS first_name, trim(last_name) AS last_name FROM authors WHERE first_name IS NOT NULL AND trim(first_name) <> '' AND trim(last_name) <> ''")
def harvested_authors(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.authors_of(_records(spark, sf))


@query("SELECT file_id, body AS text, CAST(NULL AS VARCHAR) AS error FROM latex_files WHERE length(body) > 0")
def archives_unwrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Sources packed into gzip layers, as many as the id tells, and opened again."""
    files = T.table(spark, sf, "latex_files").where("length(body) > 0").select("file_id", "body")
    return archives.unwrap_rows(archives.packed_rows(files, "file_id", "body"), "file_id").drop("kind")


# --- alignment -------------------------------------------------------------------------------


@query(f"WITH {L.DIFF} SELECT arxivid, v1, v2, id1, id2 FROM d WHERE code = 0")
def identical_align(spark: SparkSession, sf: str) -> DataFrame:
    return A.identical(_diff(spark, sf)).drop("method")


@query(f"WITH {L.OPEN} SELECT arxivid, v1, v2, block, count(*) AS n_rows, count(*) FILTER (code = -1 AND NOT boring) AS n_removed, count(*) FILTER (code = 1 AND NOT boring) AS n_added FROM b GROUP BY ALL")
def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    b = A.blocks(_diff(spark, sf)).withColumn("good", ~X.is_boring("text"))
    return b.groupBy(*PAIR, "block").agg(
        F.count("*").alias("n_rows"), F.count_if(F.expr("code = -1 and good")).alias("n_removed"), F.count_if(F.expr("code = 1 and good")).alias("n_added")
    )


@query(f"WITH {L.DIFF}, {_EDGES}, s AS (SELECT arxivid, v1, v2, 1 AS side, id1 AS id, text FROM d WHERE code <= 0 UNION ALL SELECT arxivid, v1, v2, 2, id2, text FROM d WHERE code >= 0) "
       f"SELECT arxivid, v1, v2, side, id, text FROM s WHERE NOT {L.is_boring('text')} AND NOT EXISTS (SELECT 1 FROM e WHERE e.arxivid = s.arxivid AND e.v1 = s.v1 AND e.v2 = s.v2 "
       "AND ((s.side = 1 AND e.id1 = s.id) OR (s.side = 2 AND e.id2 = s.id)))")  # fmt: skip
def unaligned_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = _diff(spark, sf)
    return A.unaligned(rows, _stored_edges(rows))


_WORDS_OPEN = f"o AS (SELECT *, {L.preprocess('text')} AS t FROM b WHERE NOT boring AND code <> 0), n AS (SELECT *, {L.words('t')} AS ws, {L.characters(L.words('t'))} AS n FROM o)"
_SIMILAR = L.similar("x.ws", "y.ws", "x.t", "y.t")
_NEAR = f"""nr AS (SELECT x.arxivid, x.v1, x.v2, x.id1, y.id2 FROM n x JOIN n y ON x.arxivid = y.arxivid AND x.v1 = y.v1 AND x.v2 = y.v2 AND x.block = y.block WHERE x.code = -1 AND y.code = 1 AND {_SIMILAR}),
  fo AS (SELECT * FROM n WHERE code = -1 AND (arxivid, v1, v2, id1) NOT IN (SELECT (arxivid, v1, v2, id1) FROM nr)), fn AS (SELECT * FROM n WHERE code = 1 AND (arxivid, v1, v2, id2) NOT IN (SELECT (arxivid, v1, v2, id2) FROM nr)),
  al AS (SELECT arxivid, v1, v2, id1, id2, 'identical' AS method FROM d WHERE code = 0 UNION ALL SELECT *, 'block' FROM nr
    UNION ALL SELECT x.arxivid, x.v1, x.v2, x.id1, y.id2, 'document' FROM fo x JOIN fn y ON x.arxivid = y.arxivid AND x.v1 = y.v1 AND x.v2 = y.v2 WHERE {_SIMILAR})"""


@query(
    f"""WITH {L.OPEN}, {_WORDS_OPEN} SELECT x.arxivid, x.v1, x.v2, x.block, x.id1, y.id2 FROM n x JOIN n y ON x.arxivid = y.arxivid AND x.v1 = y.v1 AND x.v2 = y.v2 AND x.block = y.block
  WHERE x.code = -1 AND y.code = 1 AND ((x.n > 0 AND x.n - y.n <= 0.2 * x.n AND y.n - x.n <= 0.4 * x.n) OR contains(x.t, y.t) OR contains(y.t, x.t))"""
)
def block_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.open_rows(A.blocks(_diff(spark, sf)))
    return A.candidates(rows, [*PAIR, "block"]).select(*PAIR, "block", "id1", "id2")


@query(f"WITH {L.OPEN}, {_WORDS_OPEN}, {_NEAR} SELECT *, 'block' AS method FROM nr")
def block_align(spark: SparkSession, sf: str) -> DataFrame:
    return A.similar_edges(A.open_rows(A.blocks(_diff(spark, sf))), [*PAIR, "block"], "block")


@query(f"WITH {L.OPEN}, {_WORDS_OPEN}, {_NEAR} SELECT * FROM al")
def document_align(spark: SparkSession, sf: str) -> DataFrame:
    return A.align(cut(_diff(spark, sf)))


@query(
    f"""WITH {L.DIFF}, {_EDGES}, m AS (SELECT o.arxivid, o.v1, o.v2, o.id1, n.id2, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.arxivid = o.arxivid AND e.v1 = o.v1
    AND e.v2 = o.v2 AND e.id1 = o.id1 AND e.id2 = n.id2) THEN 1 ELSE 3 END AS method FROM d o JOIN d n ON o.arxivid = n.arxivid AND o.v1 = n.v1 AND o.v2 = n.v2
    WHERE o.code <= 0 AND n.code >= 0) SELECT arxivid, v1, v2, method AS aligning_method, count(*) AS n FROM m GROUP BY ALL"""
)
def pair_cross_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = _diff(spark, sf)
    return A.cross_export(rows, _stored_edges(rows)).groupBy(*PAIR, "aligning_method").agg(F.count("*").alias("n"))


_STATES = f"""{L.OPEN}, {_EDGES}, st AS (SELECT b.arxivid, b.v1, b.v2, b.idx, b.block, b.code, CASE WHEN code = 0 OR (code = -1 AND (arxivid, v1, v2, id1) IN (SELECT (arxivid, v1, v2, id1) FROM e)) THEN 'solved'
    WHEN code = 1 AND (arxivid, v1, v2, id2) IN (SELECT (arxivid, v1, v2, id2) FROM e) THEN 'used' WHEN boring THEN 'boring' ELSE 'unknown' END AS state FROM b)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.blocks(_diff(spark, sf))
    return A.statuses(rows, _stored_edges(rows))


@query(f"WITH {_STATES} SELECT arxivid, v1, v2, idx, state FROM st")
def sentence_states(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select(*PAIR, "idx", "state")


@query(f"WITH {_STATES} SELECT arxivid, v1, v2, block, count(*) FILTER (code = -1) AS n_removed, count(*) FILTER (code = -1 AND state = 'unknown') = 0 AS solved FROM st GROUP BY ALL")
def solved_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return A.solved_blocks(_states(spark, sf))


@query(
    f"""WITH {L.DIFF}, {_EDGES} SELECT 'ID-' || replace(o.arxivid, '/', '-') || '-' || o.v1 || '-' || o.v2 || '-' || regexp_extract(o.id1, 'v?(\\d+-\\d+-\\d+)$', 1) || '-' || regexp_extract(n.id2, 'v?(\\d+-\\d+-\\d+)$', 1) AS pair_ID,
  'UID' AS pair_UID, o.id1 AS sent_0_idx, o.text AS sent_0, n.id2 AS sent_1_idx, n.text AS sent_1, CASE WHEN (o.arxivid, o.v1, o.v2, o.id1, n.id2) IN (SELECT (arxivid, v1, v2, id1, id2) FROM e) THEN 1 ELSE 3 END AS aligning_method
  FROM d o JOIN d n ON o.arxivid = n.arxivid AND o.v1 = n.v1 AND o.v2 = n.v2 WHERE o.code <= 0 AND n.code >= 0"""
)
def alignment_export(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the alignment files."""
    rows = T.pair_rows(T.table(spark, sf, "sentence_structs"), "id1", "id2", "aligned")
    return sinks.alignment_rows(A.cross_export(rows, _stored_edges(rows, [*PAIR, "part"])))


_FREE = f"""{L.DIFF}, {_EDGES}, s AS (SELECT arxivid, v1, v2, 1 AS side, id1 AS id, text FROM d WHERE code <= 0 UNION ALL SELECT arxivid, v1, v2, 2, id2, text FROM d WHERE code >= 0),
  fr AS (SELECT *, CAST({L.sentence_part('id', 3)} AS INTEGER) AS p, CAST({L.sentence_part('id', 4)} AS INTEGER) AS q FROM s WHERE NOT {L.is_boring('text')}
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.arxivid = s.arxivid AND e.v1 = s.v1 AND e.v2 = s.v2 AND ((s.side = 1 AND e.id1 = s.id) OR (s.side = 2 AND e.id2 = s.id)))),
  np AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY arxivid, v1, v2, side ORDER BY p) - 1 AS INTEGER) AS new_p FROM fr)"""


@query(f"WITH {_FREE} SELECT arxivid, v1, v2, side, id, new_p, CAST(row_number() OVER (PARTITION BY arxivid, v1, v2, side, new_p ORDER BY p, q) - 1 AS INTEGER) AS new_s FROM np")
def unaligned_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return A.renumber(unaligned_sentences(spark, sf)).select(*PAIR, "side", "id", "new_p", "new_s")


@query(
    f"""WITH {_FREE}, nn AS (SELECT *, row_number() OVER (PARTITION BY arxivid, v1, v2, side, new_p ORDER BY p, q) - 1 AS new_s FROM np)
  SELECT x.arxivid, x.v1, x.v2, 'ID-' || x.arxivid || '-' || x.v1 || '-' || x.new_p || '-' || x.new_s || '-' || x.v2 || '-' || y.new_p || '-' || y.new_s AS pair_ID, 'UID' AS pair_UID,
  x.arxivid || '-v' || x.v1 || '-' || x.new_p || '-' || x.new_s AS sent_0_idx, x.text AS sent_0, y.arxivid || '-v' || y.v2 || '-' || y.new_p || '-' || y.new_s AS sent_1_idx, y.text AS sent_1, 3 AS aligning_method
  FROM nn x JOIN nn y ON x.arxivid = y.arxivid AND x.v1 = y.v1 AND x.v2 = y.v2 AND x.side = 1 AND y.side = 2"""
)
def unaligned_export(spark: SparkSession, sf: str) -> DataFrame:
    return A.unaligned_export(A.renumber(unaligned_sentences(spark, sf)))


@query(
    """WITH i AS (SELECT unnest(identifiers) AS id, diff.sentence AS text FROM sentence_structs)
  SELECT id, count(DISTINCT text) AS n_texts FROM i GROUP BY id HAVING count(DISTINCT text) > 1"""
)
def inconsistent_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = T.table(spark, sf, "sentence_structs").select(F.explode("identifiers").alias("sent_0_idx"), F.col("diff.sentence").alias("sent_0"))
    return A.inconsistent_ids(ids.withColumns({"sent_1_idx": F.col("sent_0_idx"), "sent_1": F.col("sent_0")}))


@query(
    f"""WITH {L.DIFF}, m AS (SELECT arxivid, v1, v2, coalesce(status, 'NONE') AS model, count(*) AS n FROM d GROUP BY ALL)
  SELECT arxivid, v1, v2, arg_min(model, (n, model)) AS model, min(n) AS n_unaligned FROM m GROUP BY arxivid, v1, v2"""
)
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    m = _diff(spark, sf).groupBy(*PAIR, F.coalesce("status", F.lit("NONE")).alias("model")).agg(F.count("*").alias("n_unaligned"))
    return A.best_model(m, PAIR, "model", "n_unaligned")


@query(
    f"""WITH {_FREE}, nm AS (SELECT *, row_number() OVER (PARTITION BY arxivid, v1, v2, side, new_p ORDER BY p, q) - 1 AS new_s FROM np),
  mk AS (SELECT x.arxivid, x.v1, x.v2, x.id AS id1, y.id AS id2, 'manual' AS method FROM nm x JOIN nm y ON x.arxivid = y.arxivid AND x.v1 = y.v1 AND x.v2 = y.v2
    AND x.side = 1 AND y.side = 2 AND x.new_p = y.new_p AND x.new_s = y.new_s) SELECT arxivid, v1, v2, id1, id2, method FROM e UNION ALL SELECT * FROM mk"""
)
def manual_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _diff(spark, sf)
    places = cut(unaligned_renumber(spark, sf))
    marks = places.where("side = 1").select(*PAIR, "new_p", "new_s").join(places.where("side = 2").select(*PAIR, "new_p", "new_s"), [*PAIR, "new_p", "new_s"])
    manual = marks.select(*PAIR, *[F.col(c).alias(f"{c[-1]}{k}") for k in (1, 2) for c in ("new_p", "new_s")], F.lit(1).alias("aligning_method"))
    return A.merge_manual(_stored_edges(rows), manual, places).select(*PAIR, "id1", "id2", "method")


# --- similarity ------------------------------------------------------------------------------

_PAIRS = f"""{L.DIFF}, gd AS (SELECT * FROM d WHERE NOT {L.is_boring('text')}), so AS (SELECT DISTINCT arxivid, v1, v2, text FROM gd WHERE code <= 0), sn AS (SELECT DISTINCT arxivid, v1, v2, text FROM gd WHERE code >= 0),
  po AS (SELECT *, {L.preprocess('text')} AS t, {L.words(L.preprocess('text'))} AS ws FROM so), pn AS (SELECT *, {L.preprocess('text')} AS t, {L.words(L.preprocess('text'))} AS ws FROM sn),
  pw AS (SELECT po.arxivid, po.v1, po.v2, po.text AS text1, pn.text AS text2, po.t AS t1, pn.t AS t2, po.ws AS w1, pn.ws AS w2 FROM po JOIN pn ON po.arxivid = pn.arxivid AND po.v1 = pn.v1 AND po.v2 = pn.v2),
  pg AS (SELECT *, {L.bigrams('w1')} AS g1, {L.bigrams('w2')} AS g2 FROM pw)"""


def _measures(spark: SparkSession, sf: str, *measures: str) -> DataFrame:
    """Every text of v1 worth comparing with every one of v2, kept ones too."""
    return S.whole_measures(_diff(spark, sf), measures)


@query(f"WITH {_PAIRS} SELECT arxivid, v1, v2, text1, text2, round(CASE WHEN text1 = text2 THEN 1.0 ELSE {L.jaccard('w1', 'w2')} END, 6) AS jaccard FROM pg")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.every_jaccard(T.table(spark, sf, "sentence_structs"))


@query(f"WITH {_PAIRS} SELECT arxivid, v1, v2, text1, text2, round(CASE WHEN text1 = text2 THEN 1.0 ELSE {L.jaccard('g1', 'g2')} END, 6) AS jaccard_2_gram FROM pg")
def jaccard_bigram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.every_jaccard(T.table(spark, sf, "sentence_structs"), "jaccard_2_gram")


@query(
    f"""WITH {_PAIRS}, j AS (SELECT arxivid, v1, v2, text1, text2, CASE WHEN text1 = text2 THEN 1.0 ELSE {L.jaccard('w1', 'w2')} END AS jaccard FROM pg),
  r AS (SELECT arxivid, v1, v2, text1 AS text, jaccard FROM j UNION ALL SELECT arxivid, v1, v2, text2, jaccard FROM j)
  SELECT arxivid, v1, v2, text, count(*) AS n_similar, round(max(jaccard), 6) AS max_jaccard, round(avg(jaccard), 6) AS avg_jaccard FROM r GROUP BY ALL"""
)
def similarity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = S.whole_vectors(_diff(spark, sf), ("jaccard",))
    return v.select(*PAIR, "text", "n_similar", F.round("max_jaccard", 6).alias("max_jaccard"), F.round("avg_jaccard", 6).alias("avg_jaccard"))


@query(f"WITH {_PAIRS} SELECT arxivid, v1, v2, text1, text2, CAST({L.lcs_length('w1', 'w2')} AS INTEGER) AS lcs_length FROM pg")
def lcs_length(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "diff").select(*PAIR, "text1", "text2", "lcs_length")


@query(
    f"""WITH {_PAIRS} SELECT arxivid, v1, v2, text1, text2, round({L.diff_sim('w1', 'w2', 'text1 = text2')}, 6) AS diff, round({L.diff_sim('g1', 'g2', 'text1 = text2')}, 6) AS diff_2_gram FROM pg"""
)
def diff_sim(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, "diff", "diff_2_gram").select(*PAIR, "text1", "text2", F.round("diff", 6).alias("diff"), F.round("diff_2_gram", 6).alias("diff_2_gram"))


@query(f"WITH {_PAIRS} SELECT arxivid, v1, v2, text1, text2, {L.similar('w1', 'w2', 't1', 't2')} AS similar FROM pw")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.every_similar(T.table(spark, sf, "sentence_structs"))


@query()
def fast_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    edits = edit_pairs(spark, sf).select(*PAIR, "id1", "id2", F.posexplode(udfs.fast_diff(X.tokens("s1"), X.tokens("s2"))).alias("pos", "d"))
    return edits.select(*PAIR, "id1", "id2", "pos", "d.code", "d.text")


@query()
def show_difference(spark: SparkSession, sf: str) -> DataFrame:
    bare = lambda c: X.tokens(X.preprocess_sent(F.regexp_replace(c, "\\.+$", "")))
    return edit_pairs(spark, sf).select(*PAIR, "id1", "id2", udfs.mark_changes(bare("s1"), bare("s2")).alias("m")).select(*PAIR, "id1", "id2", "m.old", "m.new")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Features over all texts of both versions."""
    rows = _diff(spark, sf)
    texts = rows.where(~X.is_boring("text")).select(*PAIR, "text").distinct()
    return S.feature_rows(texts, S.whole_vectors(rows), PAIR)


@query(
    f"""WITH {_PAIRS}, sm AS (SELECT arxivid, v1, v2, text1, text2, CASE WHEN text1 = text2 THEN 1.0 ELSE {L.jaccard('w1', 'w2')} END AS jaccard,
    CASE WHEN text1 = text2 THEN 1.0 ELSE {L.jaccard('g1', 'g2')} END AS jaccard_2_gram, {L.diff_sim('w1', 'w2', 'text1 = text2')} AS diff, {L.diff_sim('g1', 'g2', 'text1 = text2')} AS diff_2_gram FROM pg),
  rl AS (SELECT arxivid, v1, v2, text1 AS text, jaccard, jaccard_2_gram, diff, diff_2_gram FROM sm UNION ALL SELECT arxivid, v1, v2, text2, jaccard, jaccard_2_gram, diff, diff_2_gram FROM sm),
  vc AS (SELECT arxivid, v1, v2, text, {', '.join(f'max({m}) AS max_{m}, avg({m}) AS avg_{m}' for m in S.MEASURES)} FROM rl GROUP BY ALL),
  tt AS (SELECT DISTINCT arxivid, v1, v2, text FROM d WHERE NOT {L.is_boring('text')}), tk AS (SELECT *, {L.tokens(L.preprocess('text'))} AS ts FROM tt),
  tf AS (SELECT *, CAST(len(ts) AS INTEGER) AS n_tokens, CAST(len(list_filter(ts, lambda t: contains(t, '[MATH]') OR contains(t, '[EQUATION]') OR contains(t, '[CITATION]') OR contains(t, '[REF]'))) AS INTEGER) AS n_special_tokens FROM tk)
  SELECT tf.arxivid, tf.v1, tf.v2, tf.text, {', '.join(f'round(coalesce({c}, 0.0), 6) AS {c}' for c in S.FEATURES[:8])}, n_tokens, n_special_tokens,
  round(CASE WHEN n_tokens > 0 THEN n_special_tokens / n_tokens ELSE 0.0 END, 6) AS percent_special_tokens FROM tf LEFT JOIN vc ON tf.arxivid = vc.arxivid AND tf.v1 = vc.v1 AND tf.v2 = vc.v2 AND tf.text = vc.text"""
)
def feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded as SQL rounds a double, times a million to a whole number; ``F.round(c, 6)`` goes by its decimal digits, and takes 0.0640625 up."""
    df = _features(spark, sf)
    return df.select(*PAIR, "text", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if "n_" != c[:2] else F.col(c) for c in S.FEATURES])


@query(
    f"""WITH {L.DIFF}, tt AS (SELECT DISTINCT arxivid, v1, v2, text FROM d WHERE NOT {L.is_boring('text')}), tk AS (SELECT *, {L.tokens(L.preprocess('text'))} AS ts FROM tt)
  SELECT arxivid, v1, v2, text, CAST(len(ts) AS BIGINT) AS n_tokens,
  CAST(len(list_filter(ts, lambda t: contains(t, '[MATH]') OR contains(t, '[EQUATION]') OR contains(t, '[CITATION]') OR contains(t, '[REF]'))) AS BIGINT) AS n_special_tokens FROM tk"""
)
def token_features(spark: SparkSession, sf: str) -> DataFrame:
    texts = _diff(spark, sf).where(~X.is_boring("text")).select(*PAIR, "text").distinct()
    return S.token_features(texts).select(*PAIR, "text", *big("n_tokens", "n_special_tokens"))


_CELLS = f"""x AS (SELECT o1.arxivid, o1.v1, o1.v2, o1.id1, o2.id2, o1.t AS t1, o2.t AS t2, o1.ws AS w1, o2.ws AS w2 FROM hw o1 JOIN hw o2 ON o1.arxivid = o2.arxivid AND o1.v1 = o2.v1 AND o1.v2 = o2.v2 AND o1.code <= 0 AND o2.code >= 0)"""
_HW = f"hw AS (SELECT *, {L.preprocess('text')} AS t, {L.words(L.preprocess('text'))} AS ws FROM d)"
_VALUES = f"""SELECT arxivid, v1, v2, count(*) AS n_cells, count(*) FILTER (value = 1) AS n_aligned, count(*) FILTER (value = -1) AS n_taken,
  round(sum(value) FILTER (value >= 0), 4) AS heat FROM val GROUP BY arxivid, v1, v2"""
_BLANK_OR_DIFF = f"CASE WHEN t1 = '' OR t2 = '' THEN 0.0 ELSE {L.diff_sim('w1', 'w2', 't1 = t2')} END"


def _aligned_values(edges: str) -> str:
    return f"""de AS (SELECT DISTINCT arxivid, v1, v2, id1, id2 FROM {edges}), d1 AS (SELECT DISTINCT arxivid, v1, v2, id1 FROM de), d2 AS (SELECT DISTINCT arxivid, v1, v2, id2 FROM de),
  val AS (SELECT x.arxivid, x.v1, x.v2, CASE WHEN de.id1 IS NOT NULL THEN 1.0 WHEN d1.id1 IS NOT NULL OR d2.id2 IS NOT NULL THEN -1.0 ELSE {_BLANK_OR_DIFF} END AS value FROM x
    LEFT JOIN de ON x.arxivid = de.arxivid AND x.v1 = de.v1 AND x.v2 = de.v2 AND x.id1 = de.id1 AND x.id2 = de.id2
    LEFT JOIN d1 ON x.arxivid = d1.arxivid AND x.v1 = d1.v1 AND x.v2 = d1.v2 AND x.id1 = d1.id1
    LEFT JOIN d2 ON x.arxivid = d2.arxivid AND x.v1 = d2.v1 AND x.v2 = d2.v2 AND x.id2 = d2.id2)"""


def _heat(cells: DataFrame) -> DataFrame:
    v = F.col("value")
    return cells.groupBy(*PAIR).agg(
        F.count("*").alias("n_cells"), F.count_if(v == 1).alias("n_aligned"), F.count_if(v == -1).alias("n_taken"), F.round(F.sum(F.when(v >= 0, v)), 4).alias("heat")
    )


@query(f"WITH {L.DIFF}, {_EDGES}, {_HW}, {_CELLS}, {_aligned_values('e')} {_VALUES}")
def heatmap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """By the alignment that the table holds."""
    rows = cut(_diff(spark, sf))
    return _heat(S.heatmap(rows, _stored_edges(rows)))


@query(f"WITH {L.DIFF}, {_HW}, {_CELLS}, ie AS (SELECT arxivid, v1, v2, id1, id2 FROM d WHERE code = 0), {_aligned_values('ie')} {_VALUES}")
def heatmap_diff(spark: SparkSession, sf: str) -> DataFrame:
    """By identical sentences."""
    rows = cut(_diff(spark, sf))
    return _heat(S.heatmap(rows, A.identical(rows)))


@query(f"WITH {L.OPEN}, {_WORDS_OPEN}, {_NEAR}, {_HW}, {_CELLS}, {_aligned_values('al')} {_VALUES}")
def heatmap_easy(spark: SparkSession, sf: str) -> DataFrame:
    """By the machine alignment."""
    rows = cut(_diff(spark, sf))
    return _heat(S.heatmap(rows, A.align(rows)))


@query(f"WITH {L.DIFF}, {_HW}, {_CELLS}, val AS (SELECT arxivid, v1, v2, {_BLANK_OR_DIFF} AS value FROM x) {_VALUES}")
def heatmap_all(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities alone."""
    return _heat(S.heatmap(cut(_diff(spark, sf))))


# --- sequences -------------------------------------------------------------------------------

_SENTS = f"""{L.DIFF}, {_EDGES}, sd AS (SELECT arxivid, v1, v2, 1 AS side, id1 AS id, text FROM d WHERE code <= 0 UNION ALL SELECT arxivid, v1, v2, 2, id2, text FROM d WHERE code >= 0),
  eh AS (SELECT DISTINCT arxivid, v1, v2, 1 AS side, id1 AS id FROM e UNION SELECT DISTINCT arxivid, v1, v2, 2, id2 FROM e),
  ss AS (SELECT sd.*, CAST({L.sentence_part('sd.id', 3)} AS INTEGER) AS p, CAST({L.sentence_part('sd.id', 4)} AS INTEGER) AS s, {L.is_boring('sd.text')} AS boring, eh.id IS NOT NULL AS aligned
    FROM sd LEFT JOIN eh ON sd.arxivid = eh.arxivid AND sd.v1 = eh.v1 AND sd.v2 = eh.v2 AND sd.side = eh.side AND sd.id = eh.id)"""


def _sents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _diff(spark, sf)
    return B.side_sentences(rows, _stored_edges(rows))


_CHUNKS = """mk AS (SELECT *, (NOT aligned OR boring) AS ok FROM ss), isl AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END)
    OVER (PARTITION BY arxivid, v1, v2, side ORDER BY p, s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM mk),
  cn AS (SELECT *, count(*) OVER (PARTITION BY arxivid, v1, v2, side, island) AS island_size FROM isl WHERE ok)"""


@query(f"WITH {_SENTS}, {_CHUNKS} SELECT arxivid, v1, v2, side, id, island_size FROM cn WHERE island_size >= 5")
def islands_min_length(spark: SparkSession, sf: str) -> DataFrame:
    return B.chunks(_sents(spark, sf), 5).select(*PAIR, "side", "id", "island_size")


@query(
    f"""WITH {_SENTS} SELECT arxivid, v1, v2, side, id, coalesce(lag(length(text), 2) OVER w, -1) AS before2, coalesce(lag(length(text)) OVER w, -1) AS before1,
  length(text) AS own, coalesce(lead(length(text)) OVER w, -1) AS after1, coalesce(lead(length(text), 2) OVER w, -1) AS after2 FROM ss
  WINDOW w AS (PARTITION BY arxivid, v1, v2, side ORDER BY p, s)"""
)
def neighbour_window(spark: SparkSession, sf: str) -> DataFrame:
    sents = _sents(spark, sf).withColumn("n", F.length("text").cast("bigint"))
    w = Q.neighbours(sents, [*PAIR, "side"], ["p", "s"], "n", 2, F.lit(-1).cast("bigint"))
    return w.select(*PAIR, "side", "id", *[F.get("window", F.lit(k)).alias(n) for k, n in enumerate(("before2", "before1", "own", "after1", "after2"))])


@query(
    f"""WITH {_SENTS}, w AS (SELECT arxivid, v1, v2, side, id, lag(length(text)) OVER w AS a, length(text) AS b, lag(p) OVER w AS c, p AS e FROM ss WINDOW w AS (PARTITION BY arxivid, v1, v2, side ORDER BY p, s))
  SELECT arxivid, v1, v2, side, id, coalesce(a, -1) || ' ' || coalesce(c, -1) || ' | ' || b || ' ' || e AS pairs FROM w"""
)
def transposed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Two windows over the sentences, lengths and paragraphs, as rows of both values."""
    sents = _sents(spark, sf).withColumn("n", F.length("text"))
    w = Q.neighbours(sents, [*PAIR, "side"], ["p", "s"], "n", 1, F.lit(-1)).withColumnRenamed("window", "lengths")
    w = Q.neighbours(w, [*PAIR, "side"], ["p", "s"], "p", 1, F.lit(-1))
    both = X.transpose(F.array(F.slice("lengths", 1, 2), F.slice("window", 1, 2)))
    return w.select(*PAIR, "side", "id", F.array_join(F.transform(both, lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), " ")), " | ").alias("pairs"))


@query(
    f"""WITH {L.DIFF}, k AS (SELECT *, sum(CASE WHEN code = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY arxivid, v1, v2 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d),
  r AS (SELECT arxivid, v1, v2, CAST(run AS INTEGER) AS run, count(*) FILTER (code = -1) AS n_removed FROM k WHERE code <> 0 GROUP BY ALL) SELECT * FROM r WHERE n_removed > 0 OR run = 0"""
)
def unaligned_run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return Q.change_runs(_diff(spark, sf), PAIR, ["idx"])


@query(
    f"""WITH {L.DIFF}, o AS (SELECT *, CAST(coalesce(sum(CASE WHEN text = '' THEN 1 ELSE 0 END) OVER (PARTITION BY arxivid, v1, v2 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS p
    FROM d WHERE code <= 0) SELECT arxivid, v1, v2, idx, p, CAST(row_number() OVER (PARTITION BY arxivid, v1, v2, p ORDER BY idx) - 1 AS INTEGER) AS s FROM o"""
)
def running_sentence_ids(spark: SparkSession, sf: str) -> DataFrame:
    old = _diff(spark, sf).where("code <= 0")
    return Q.running_ids(old, PAIR, ["idx"], F.col("text") == "").select(*PAIR, "idx", "p", "s")


@query(
    f"""WITH {L.DIFF}, t AS (SELECT *, coalesce(status, 'O') AS tag FROM d), g AS (SELECT *, row_number() OVER (PARTITION BY arxivid, v1, v2 ORDER BY idx)
    - row_number() OVER (PARTITION BY arxivid, v1, v2, tag ORDER BY idx) AS grp FROM t)
  SELECT arxivid, v1, v2, tag, min(idx) AS start, string_agg(text, ' ' ORDER BY idx) AS text FROM g WHERE tag <> 'O' GROUP BY arxivid, v1, v2, tag, grp"""
)
def tag_groups(spark: SparkSession, sf: str) -> DataFrame:
    t = _diff(spark, sf).withColumn("tag", F.coalesce("status", F.lit("O")))
    return Q.tag_groups(t, PAIR, ["idx"], "tag", "text").select(*PAIR, "tag", F.col("start.idx").alias("start"), "text")


@query(f"WITH {L.DIFF} SELECT arxivid, v1, v2, count(*) FILTER (code = 0 AND text <> '') + 1 AS keeps, count(*) FILTER (code = 1) AS adds, count(*) FILTER (code = -1 AND trim(text) <> '') AS deletes FROM d GROUP BY arxivid, v1, v2")
def diff_counters(spark: SparkSession, sf: str) -> DataFrame:
    full = F.col("text") != ""
    return _diff(spark, sf).groupBy(*PAIR).agg(
        (F.count_if((F.col("code") == 0) & full) + 1).alias("keeps"), F.count_if(F.col("code") == 1).alias("adds"),
        F.count_if((F.col("code") == -1) & (F.trim("text") != "")).alias("deletes"),
    )


# --- edits and annotations -------------------------------------------------------------------

_EDITS = f"""{L.DIFF}, {_EDGES}, de AS (SELECT DISTINCT arxivid, v1, v2, id1, id2 FROM e),
  ep AS (SELECT de.*, a.text AS s1, z.text AS s2, count(*) OVER (PARTITION BY de.arxivid, de.v1, de.v2, de.id1) AS partners FROM de
    JOIN d a ON a.arxivid = de.arxivid AND a.v1 = de.v1 AND a.v2 = de.v2 AND a.id1 = de.id1 AND a.code <= 0
    JOIN d z ON z.arxivid = de.arxivid AND z.v1 = de.v1 AND z.v2 = de.v2 AND z.id2 = de.id2 AND z.code >= 0),
  ed AS (SELECT * FROM ep WHERE NOT (partners = 1 AND s1 = s2) AND NOT {L.is_boring('s1')})"""


@query(f"WITH {_EDITS} SELECT arxivid, v1, v2, id1, id2, s1, s2, partners FROM ed")
def edit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _diff(spark, sf)
    return E.edit_pairs(rows, _stored_edges(rows)).select(*PAIR, "id1", "id2", "s1", "s2", "partners")


@query(
    f"""WITH {_EDITS}, q AS (SELECT *, {L.tokens('s1')} AS q1, {L.tokens('s2')} AS q2 FROM ed)
  SELECT arxivid, v1, v2, id1, id2, array_to_string(q1, ' ') AS old, array_to_string(q2, ' ') AS new, CAST({L.lcs_length('q1', 'q2')} AS BIGINT) AS n_kept FROM q"""
)
def fast_diff_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """What the diff of two sentences must give back: either one, with as many kept tokens as can be."""
    edits = edit_pairs(spark, sf).select(*PAIR, "id1", "id2", udfs.fast_diff(X.tokens("s1"), X.tokens("s2")).alias("d"))
    part = lambda test: F.array_join(F.transform(F.filter("d", test), lambda r: r["text"]), " ")
    return edits.select(
        *PAIR, "id1", "id2", part(lambda r: r["code"] <= 0).alias("old"), part(lambda r: r["code"] >= 0).alias("new"), F.size(F.filter("d", lambda r: r["code"] == 0)).cast("bigint").alias("n_kept")
    )


@query()
def copy_edit_rules(spark: SparkSession, sf: str) -> DataFrame:
    return E.copy_edits(edit_pairs(spark, sf)).select(*PAIR, "id1", "id2", "label")


# Annotations are told from the texts themselves, by rules that either engine can state.
_ANNOTATED = f"""{_EDITS}, an AS (SELECT *, list_filter([CASE WHEN length(s2) < 0.9 * length(s1) THEN 'Too much info' END, CASE WHEN length(s2) > 1.1 * length(s1) THEN 'Info missing' END,
    CASE WHEN contains(s2, '[MATH]') AND NOT contains(s1, '[MATH]') THEN 'domain knowledge' END, CASE WHEN lower(s1) = lower(s2) THEN 'formatting' END,
    CASE WHEN contains(s2, '[REF]') THEN 'Other' END], lambda l: l IS NOT NULL) AS labels, 'from ' || length(s1) || ' to ' || length(s2) AS explanation FROM ed)"""


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    n1, n2 = F.length("s1"), F.length("s2")
    labels = F.array(
        F.when(n2 < 0.9 * n1, "Too much info"), F.when(n2 > 1.1 * n1, "Info missing"),
        F.when(F.col("s2").contains("[MATH]") & ~F.col("s1").contains("[MATH]"), "domain knowledge"),
        F.when(F.lower("s1") == F.lower("s2"), "formatting"), F.when(F.col("s2").contains("[REF]"), "Other"),
    )
    text = F.concat(F.lit("from "), n1.cast("string"), F.lit(" to "), n2.cast("string"))
    return edit_pairs(spark, sf).withColumns({"labels": F.array_compact(labels), "explanation": text})


@query(
    f"""WITH {_ANNOTATED}, k AS (SELECT unnest(CASE WHEN len(list_filter(labels, lambda l: l IN ('domain knowledge', 'pdf required'))) > 0
    THEN list_filter(labels, lambda l: l IN ('domain knowledge', 'pdf required')) ELSE labels END) AS label FROM an)
  SELECT label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM an), 6) AS percent FROM k GROUP BY label"""
)
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return E.label_distribution(cut(_annotated(spark, sf)))


_REASON = "CASE lower(label) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.REASONS.items()) + " ELSE lower(label) END"


@query(f"WITH {_ANNOTATED}, k AS (SELECT unnest(labels) AS label FROM an) SELECT {_REASON} AS reason, count(*) AS n FROM k GROUP BY ALL")
def label_to_reason(spark: SparkSession, sf: str) -> DataFrame:
    return E.reason_counts(_annotated(spark, sf))


@query(f"WITH {_ANNOTATED} SELECT arxivid, v1, v2, id1, id2, explanation FROM an WHERE list_contains(labels, 'Other')")
def other_examples(spark: SparkSession, sf: str) -> DataFrame:
    return E.examples_of(_annotated(spark, sf), "Other").select(*PAIR, "id1", "id2", "explanation")


@query(f"WITH {_ANNOTATED} SELECT id1, id2, array_to_string(labels, '|') AS labels, len(labels) AS n_labels, explanation, trim(s1) AS s1, trim(s2) AS s2 FROM an")
def annotation_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation lines as they are written, read from the right again."""
    got = T.annotation_lines(sinks.annotation_rows(_annotated(spark, sf)))
    return got.select("id1", "id2", F.array_join("labels", "|").alias("labels"), F.size("labels").cast("bigint").alias("n_labels"), "explanation", "s1", "s2")


@query(f"WITH {_ANNOTATED} SELECT count(*) FILTER (length(s1) % 3 <> 0) AS n_unlabelled, count(*) AS n_pairs FROM an")
def unlabelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    an = cut(_annotated(spark, sf))
    keys = [*PAIR, "id1", "id2"]
    return E.unlabelled(E.merge_by_priority(an.select(*keys), [an.where(F.length("s1") % 3 == 0)], keys))


@query(
    f"""WITH {_ANNOTATED}, p1 AS (SELECT * FROM an WHERE length(s1) % 3 = 0), p2 AS (SELECT * REPLACE (['style'] AS labels) FROM an WHERE length(s1) % 2 = 0)
  SELECT an.arxivid, an.v1, an.v2, an.id1, an.id2, array_to_string(coalesce(p1.labels, p2.labels), '|') AS labels,
  coalesce(nullif(CASE WHEN length(p1.s2) % 2 = 0 THEN p1.explanation ELSE '' END, ''), nullif(p2.explanation, ''), '') AS explanation FROM an
  LEFT JOIN p1 ON an.arxivid = p1.arxivid AND an.v1 = p1.v1 AND an.v2 = p1.v2 AND an.id1 = p1.id1 AND an.id2 = p1.id2
  LEFT JOIN p2 ON an.arxivid = p2.arxivid AND an.v1 = p2.v1 AND an.v2 = p2.v2 AND an.id1 = p2.id1 AND an.id2 = p2.id2"""
)
def priority_merge(spark: SparkSession, sf: str) -> DataFrame:
    an = cut(_annotated(spark, sf))
    keys = [*PAIR, "id1", "id2"]
    first = an.where(F.length("s1") % 3 == 0).withColumn("explanation", F.when(F.length("s2") % 2 == 0, F.col("explanation")).otherwise(""))
    second = an.where(F.length("s1") % 2 == 0).withColumn("labels", F.array(F.lit("style")))
    merged = E.merge_by_priority(an.select(*keys), [first, second], keys)
    return merged.select(*keys, F.array_join("labels", "|").alias("labels"), "explanation")


@query(
    f"""WITH RECURSIVE {_ANNOTATED}, ge AS (SELECT DISTINCT arxivid, v1, v2, id1, id2 FROM e), nb AS (SELECT DISTINCT x.arxivid, x.v1, x.v2, x.id1 AS a, y.id1 AS b FROM ge x JOIN ge y ON x.arxivid = y.arxivid AND x.v1 = y.v1 AND x.v2 = y.v2 AND x.id2 = y.id2),
  re AS (SELECT * FROM nb UNION SELECT re.arxivid, re.v1, re.v2, re.a, nb.b FROM re JOIN nb ON nb.arxivid = re.arxivid AND nb.v1 = re.v1 AND nb.v2 = re.v2 AND nb.a = re.b),
  gp AS (SELECT arxivid, v1, v2, a AS id1, min(b) AS grp FROM re GROUP BY ALL), gg AS (SELECT ge.*, grp FROM ge JOIN gp USING (arxivid, v1, v2, id1)),
  pt AS (SELECT arxivid, v1, v2, 1 AS side, id1 AS id, text FROM d WHERE code <= 0 UNION ALL SELECT arxivid, v1, v2, 2, id2, text FROM d WHERE code >= 0),
  gs AS (SELECT DISTINCT arxivid, v1, v2, grp, 1 AS side, id1 AS id FROM gg UNION ALL SELECT DISTINCT arxivid, v1, v2, grp, 2, id2 FROM gg),
  gt AS (SELECT gs.*, pt.text, CAST({L.sentence_part('gs.id', 3)} AS INTEGER) AS p, CAST({L.sentence_part('gs.id', 4)} AS INTEGER) AS s FROM gs JOIN pt USING (arxivid, v1, v2, side, id)),
  ga AS (SELECT arxivid, v1, v2, grp, string_agg(id, ',' ORDER BY p, s, id) FILTER (side = 1) AS ids1, string_agg(id, ',' ORDER BY p, s, id) FILTER (side = 2) AS ids2,
    string_agg(text, ' ' ORDER BY p, s, id) FILTER (side = 1) AS s1, string_agg(text, ' ' ORDER BY p, s, id) FILTER (side = 2) AS s2 FROM gt GROUP BY ALL),
  gl AS (SELECT gg.arxivid, gg.v1, gg.v2, gg.grp, array_to_string(list_sort(list_distinct(flatten(list(an.labels)))), '|') AS labels,
    coalesce(string_agg(an.explanation, ' ' ORDER BY an.id1, an.id2) FILTER (an.explanation <> ''), '') AS explanation, count(*) AS n_edges
    FROM gg JOIN an ON an.arxivid = gg.arxivid AND an.v1 = gg.v1 AND an.v2 = gg.v2 AND an.id1 = gg.id1 AND an.id2 = gg.id2 GROUP BY ALL)
  SELECT arxivid, v1, v2, ids1, ids2, s1, s2, labels, explanation, n_edges FROM ga JOIN gl USING (arxivid, v1, v2, grp)"""
)
def merge_n_to_m(spark: SparkSession, sf: str) -> DataFrame:
    an = cut(_annotated(spark, sf))
    rows = cut(_diff(spark, sf))
    # The edges that the annotated pairs come from: no pair is without a group.
    merged = E.merge_groups(an, E.edge_groups(_stored_edges(rows)), rows)
    return merged.select(*PAIR, "ids1", "ids2", "s1", "s2", F.array_join("labels", "|").alias("labels"), "explanation", "n_edges")


# --- block classifier ------------------------------------------------------------------------


@query(
    f"""WITH {_SENTS}, {_CHUNKS}, pr AS (SELECT arxivid, v1, v2, side, id FROM cn WHERE island_size >= 5 AND NOT boring), tr AS (SELECT arxivid, v1, v2, side, id FROM ss WHERE NOT aligned AND NOT boring),
  c AS (SELECT (SELECT count(*) FROM pr SEMI JOIN tr USING (arxivid, v1, v2, side, id)) AS tp, (SELECT count(*) FROM pr ANTI JOIN tr USING (arxivid, v1, v2, side, id)) AS fp,
    (SELECT count(*) FROM tr ANTI JOIN pr USING (arxivid, v1, v2, side, id)) AS fn)
  SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c"""
)
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    sents = cut(_sents(spark, sf))
    return B.precision_recall(B.chunks(sents, 5).where("not boring"), sents.where("not aligned and not boring"), [*PAIR, "side", "id"])


_METRICS = f"""{_SENTS}, {_CHUNKS}, sk AS (SELECT DISTINCT arxivid, v1, v2, side, id FROM cn WHERE island_size >= 5),
  fr AS (SELECT f.*, sk.id IS NOT NULL AS skip FROM (SELECT * FROM ss WHERE NOT boring AND NOT aligned) f LEFT JOIN sk USING (arxivid, v1, v2, side, id)),
  pm AS (SELECT arxivid, v1, v2, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2, count(*) FILTER (side = 1 AND NOT skip) AS k1, count(*) FILTER (side = 2 AND NOT skip) AS k2 FROM fr GROUP BY ALL),
  go AS (SELECT e.arxivid, e.v1, e.v2, a.id IS NOT NULL OR z.id IS NOT NULL AS lost FROM e LEFT JOIN sk a ON a.arxivid = e.arxivid AND a.v1 = e.v1 AND a.v2 = e.v2 AND a.side = 1 AND a.id = e.id1
    LEFT JOIN sk z ON z.arxivid = e.arxivid AND z.v1 = e.v1 AND z.v2 = e.v2 AND z.side = 2 AND z.id = e.id2),
  gm AS (SELECT arxivid, v1, v2, count(*) FILTER (lost) AS missed, count(*) AS n_gold FROM go GROUP BY ALL),
  bm AS (SELECT coalesce(pm.arxivid, gm.arxivid) AS arxivid, coalesce(pm.v1, gm.v1) AS v1, coalesce(pm.v2, gm.v2) AS v2, coalesce(n1 * n2, 0) AS comparisons, coalesce(n1 * n2 - k1 * k2, 0) AS saved,
    coalesce(missed, 0) AS missed, coalesce(n_gold, 0) AS n_gold FROM pm FULL JOIN gm ON pm.arxivid = gm.arxivid AND pm.v1 = gm.v1 AND pm.v2 = gm.v2)"""


@query(f"WITH {_METRICS} SELECT * FROM bm")
def block_metrics(spark: SparkSession, sf: str) -> DataFrame:
    sents, rows = cut(_sents(spark, sf)), _diff(spark, sf)
    return B.block_metrics(sents, B.chunks(sents, 5), _stored_edges(rows).select(*PAIR, "id1", "id2"))


@query(
    f"""WITH {_METRICS}, t AS (SELECT CAST(sum(comparisons) AS BIGINT) AS comparisons, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(n_gold) AS BIGINT) AS n_gold FROM bm)
  SELECT *, round(coalesce(100 * saved / nullif(comparisons, 0), 0), 6) AS saved_percent, round(coalesce(100 * missed / nullif(n_gold, 0), 0), 6) AS missed_percent FROM t"""
)
def corpus_block_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return B.roll_up(block_metrics(spark, sf))


@query(
    f"""WITH {_METRICS}, m AS (SELECT arxivid, v1, v2, comparisons, saved, n_gold, missed, coalesce((n_gold - missed) / nullif(n_gold, 0), 0) AS kept, coalesce(saved / nullif(comparisons, 0), 0) AS share FROM bm)
  SELECT arxivid, v1, v2, round(CASE WHEN kept + share = 0 THEN 0.0 ELSE 5 * kept * share / (4 * kept + share) END, 6) AS f2,
  CASE WHEN share = 1 THEN '#ff0000' WHEN share = -1 THEN '#ffffff' ELSE 'rgb(' || CAST(floor(share * 255) AS BIGINT) || ',0,0)' END AS color FROM m"""
)
def block_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted mean of the share of edges kept and of comparisons saved, and the latter's shade."""
    m = block_metrics(spark, sf)
    share = lambda a, b: F.coalesce(a / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    m = m.withColumns({"kept": share(F.col("n_gold") - F.col("missed"), "n_gold"), "share": share(F.col("saved"), "comparisons")})
    return m.select(*PAIR, F.round(X.f_mean("kept", "share", 2.0), 6).alias("f2"), X.color_code("share").alias("color"))


@query(
    f"""WITH {_SENTS}, {_CHUNKS}, lg AS (SELECT DISTINCT arxivid, v1, v2, side, id FROM cn WHERE island_size >= 5), cl AS (SELECT ss.*, CASE WHEN lg.id IS NOT NULL THEN 'green' ELSE 'grey' END AS color FROM ss LEFT JOIN lg USING (arxivid, v1, v2, side, id))
  SELECT arxivid, v1, v2, side, '<table><tr>' || string_agg('<td class="' || color || '"></td>', '' ORDER BY p, s, color) || '</tr></table>' AS html FROM cl GROUP BY ALL"""
)
def prediction_strips(spark: SparkSession, sf: str) -> DataFrame:
    """Strips of coloured cells, one a version, as they are written to pages."""
    sents = cut(_sents(spark, sf))
    df = sents.join(B.chunks(sents, 5).select(*PAIR, "side", "id", F.lit("green").alias("c")).distinct(), [*PAIR, "side", "id"], "left")
    return sinks.strip_rows(df.withColumn("color", F.coalesce("c", F.lit("grey"))))


@query(
    f"""WITH {_SENTS}, {_CHUNKS}, lg AS (SELECT DISTINCT arxivid, v1, v2, side, id FROM cn WHERE island_size >= 5), sh AS (SELECT DISTINCT arxivid, v1, v2, side, id FROM cn WHERE island_size >= 2)
  SELECT ss.arxivid, ss.v1, ss.v2, ss.side, ss.id, CASE WHEN NOT aligned AND lg.id IS NOT NULL THEN 'green' WHEN aligned AND lg.id IS NOT NULL THEN 'blue'
    WHEN NOT aligned THEN 'yellow' WHEN sh.id IS NOT NULL THEN 'faded' ELSE 'grey' END AS color
  FROM ss LEFT JOIN lg USING (arxivid, v1, v2, side, id) LEFT JOIN sh USING (arxivid, v1, v2, side, id)"""
)
def prediction_colors(spark: SparkSession, sf: str) -> DataFrame:
    sents = cut(_sents(spark, sf))
    flag = lambda n, name: B.chunks(sents, n).select(*PAIR, "side", "id", F.lit(True).alias(name))
    df = sents.join(flag(5, "long"), [*PAIR, "side", "id"], "left").join(flag(2, "short"), [*PAIR, "side", "id"], "left")
    df = df.withColumns({"free": ~F.col("aligned"), "long": F.coalesce("long", F.lit(False)), "short": F.coalesce("short", F.lit(False))})
    return df.select(*PAIR, "side", "id", B.prediction_color("free", "long", "short").alias("color"))


@query(
    f"""WITH {_SENTS}, {_CHUNKS}, pos AS (SELECT DISTINCT arxivid, v1, v2, side, id FROM cn WHERE island_size >= 5)
  SELECT ss.arxivid, ss.v1, ss.v2, ss.side, ss.id, 33 AS n_features, CAST(CASE WHEN pos.id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS label FROM ss LEFT JOIN pos USING (arxivid, v1, v2, side, id) WHERE NOT boring"""
)
def training_examples(spark: SparkSession, sf: str) -> DataFrame:
    ex = B.examples(_sents(spark, sf), _features(spark, sf), 5, 1)
    return ex.select(*PAIR, "side", "id", F.size("features").alias("n_features"), "label")


@query()
def block_classifier_eval(spark: SparkSession, sf: str) -> DataFrame:
    sents = cut(_sents(spark, sf))
    ex = cut(B.examples(sents, _features(spark, sf), 5, 1))
    model, accuracy = B.train(ex)
    found = B.predicted_blocks(B.predicted(sents, ex, model), 5)
    gold = _stored_edges(_diff(spark, sf)).select(*PAIR, "id1", "id2")
    return B.roll_up(B.block_metrics(sents, found, gold)).withColumn("accuracy", F.round(F.lit(accuracy), 4))
