"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe, embeddings, fim, jaccard, langid, linededup, lm, mixing, quality, secrets, sharding, spelling, substrings
from driftloom.llm.common import documents
from driftloom.session import ship


def over_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": over_documents(secrets.digest),
        "op2_bpe": over_documents(bpe.digest),
        "op3_ngram_jaccard": over_documents(jaccard.digest),
        "op4_lm_scoring": over_documents(lm.digest),
        "op5_line_dedup": over_documents(linededup.digest),
        "op6_language_id": over_documents(langid.digest),
        "op7_quality_rules": over_documents(quality.digest),
        "op8_substring_dedup": over_documents(substrings.digest),
        "op9_embedding_dedup": lambda spark, sf_dir: embeddings.digest(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op10_source_mixing": over_documents(mixing.digest),
        "op11_spelling_variants": over_documents(spelling.digest),
        "op12_sharding": over_documents(sharding.digest),
        "op13_fill_in_middle": over_documents(fim.digest),
    }


BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often ON k.key = often.key GROUP BY rid
"""

SPACED = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def without(pattern: str, text: str) -> str:
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


def words_in(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '{SPACED}+'), lambda x: x <> ''))"


QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACED}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (rid, g)) GROUP BY rid),
line AS (SELECT rid, unnest(lines) AS x FROM d),
feat AS (
  SELECT rid, x, {words_in("x")} AS n, length(x) - {without(SYMBOLS, "x")} AS sym, length(x) - {without("[|»›•·]", "x")} AS nav,
    length(x) - {without("!", "x")} AS bang, {without(SPACED + "+", "x")} AS chars FROM line
),
lost AS (
  SELECT rid, sum(chars) AS n FROM feat WHERE (sym > 0 AND sym * 4 >= n) OR (nav >= 2 AND nav * 5 >= n)
    OR (n >= 4 AND NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}') AND bang >= n)
    OR (n >= 12 AND NOT regexp_matches(x, '{quality.ENDS}'))
    OR (n <= {quality.BOILERPLATE_WORDS} AND regexp_matches(x, '{quality.BOILERPLATE}')) GROUP BY rid
),
r AS (
  SELECT doc_id, len(w) AS n_words, {without(SPACED + "+", "t")} AS word_chars, length(t) - {without(SYMBOLS, "t")} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS gone
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND gone <= word_chars * 0.5 AS kept FROM r
"""

#: 32 bits of the hash of a key, from its nth group of eight hexadecimal digits.
GROUP = "CAST('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {}, 8) AS BIGINT)"

FILL_IN_MIDDLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    {GROUP.format(1)} AS h1, {GROUP.format(9)} AS h2, {GROUP.format(17)} AS h3, {GROUP.format(25)} AS h4 FROM documents
),
c AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP, "op7_quality_rules": QUALITY, "op13_fill_in_middle": FILL_IN_MIDDLE}
