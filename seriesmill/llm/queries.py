"""Queries that apply each operator to its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import filter_audit, ngram_filter, packing, prefix_trie, quality, secrets, url_filter
from seriesmill.llm.exact_dedup import exact_groups
from seriesmill.llm.jaccard_join import similar_components
from seriesmill.llm.language import identify
from seriesmill.llm.mixing import mix
from seriesmill.llm.pieces import round_trip
from seriesmill.llm.substring_dedup import measure_repeats
from seriesmill.session import read_table

#: Vocabulary file of the SentencePiece query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Vocabulary file of the packing query.
TOKENS = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.strip()
        return function

    return register


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS nth FROM n)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM w
""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read_table(spark, folder, "documents"))


@query()
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(read_table(spark, folder, "documents"))


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(read_table(spark, folder, "documents"))


@query()
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read_table(spark, folder, "documents"), PIECES, keep=["doc_id"])


@query()
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(read_table(spark, folder, "documents"))


@query(r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS every_line FROM documents),
l AS (SELECT *, list_filter(every_line, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(every_line) AS n_lines,
         length(t) - length(regexp_replace(t, '[0-9!-/:-@\[-`{-~]', '', 'g')) AS n_marks, coalesce(list_max(map_values(list_histogram(w))), 0) AS top_word, len(filled) AS n_filled,
         len(list_filter(filled, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_cut,
         len(list_filter(filled, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[-*•]'))) AS n_list
  FROM l LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR word_chars > 40 * n_words OR word_chars < 2 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_marks > word_chars OR 10 * top_word > 3 * n_words OR (n_filled > 2 AND (10 * n_cut > 3 * n_filled OR 10 * n_list > 9 * n_filled))) AS kept FROM f
""")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read_table(spark, folder, "documents"))


@query()
def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_filter.score(read_table(spark, folder, "documents"))


@query()
def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read_table(spark, folder, "pages"))


def _secrets_sql() -> str:
    """Positions as sums of the lengths of matches and of the text between them, kind by kind."""
    kinds = []
    for nth, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(f"SELECT doc_id, '{rule.kind}' AS kind, {nth} AS nth, {rule.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d")
    base = ", ".join(f"'{rule.kind}'" for rule in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
p AS (SELECT doc_id, kind, nth, i, least, m, g, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM k, unnest(range(1, len(m) + 1)) AS u(i)),
f AS (SELECT doc_id, kind, nth, CAST(s AS BIGINT) AS s, CAST(s + length(m[i]) AS BIGINT) AS e FROM p WHERE length(g[i]) >= least),
a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (kind IN ({base})) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


@query(_secrets_sql())
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    # the ledger of the base rules leaves the other rules to the second scan
    _, ledger = secrets.scan(docs, secrets.BASE_RULES)
    findings, _ = secrets.scan(docs, ledger=ledger)
    return secrets.digest_spans(findings)


@query()
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return measure_repeats(read_table(spark, folder, "documents"))


@query(r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_concat([k], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(k))),
heads AS (
  SELECT c, c - c % 20 AS b,
         xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                     lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) % 4 AS h
  FROM (SELECT DISTINCT c FROM o), crc_table),
spliced AS (
  SELECT h.c, 0 AS side, p, role, text FROM heads h JOIN o ON o.c = h.b AND o.p <= h.h
  UNION ALL SELECT h.c, 1, p, role, text FROM heads h JOIN o ON o.c = h.c AND o.p > h.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, p) AS d, sha256(length(role) || ':' || role || ':' || text) AS s,
             len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM spliced),
x AS (SELECT c, d, w, list(s) OVER (PARTITION BY c ORDER BY d) AS path FROM r
      UNION ALL SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM heads),
long AS (SELECT c, max(d) AS n FROM x GROUP BY c),
n AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = long.n), '')) AS ends_sha256 FROM x JOIN long USING (c) GROUP BY path, d),
up AS (SELECT path, depth, conv_id, n_convs, w, ends_sha256, CASE WHEN depth > 0 THEN path[1:depth - 1] END AS above FROM n),
kids AS (SELECT above, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY above),
v AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.above = up.path),
t AS (SELECT x.path, sum((v.n_convs - 1) * v.w) AS saved, count(*) FILTER (v.n_children = 0) AS leaves FROM v JOIN x ON x.c = v.conv_id AND x.d <= v.depth GROUP BY x.path)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN t ON t.path = v.path LEFT JOIN n a ON a.path = v.above
""")
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, members = prefix_trie.splice_heads(prefix_trie.ordered_turns(read_table(spark, folder, "conversations")))
    return prefix_trie.prefix_trie(turns, members)


@query()
def op12_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(read_table(spark, folder, "documents"), TOKENS)
    return packing.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS r(step)),
s AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS fit, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM m, steps),
g AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fit AND NOT gone), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
""")
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(read_table(spark, folder, "documents"), read_table(spark, folder, "labels")))


@query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
