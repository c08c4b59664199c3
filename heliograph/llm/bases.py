"""The columns of operators 2, 3, 9 and 10 that SQL can express, as queries of their own with their SQL.

Each takes its rows from the operator's registered query; what a trained model, a battery of tests or
context words add stands beside them there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import langid, lm, pii, secrets


def base_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold of each document and whether its language can't be told."""
    found = langid.op2_language_id(spark, sf_dir)
    return found.select("doc_id", "held_out", (F.col("lang_pred") == langid.UNDETERMINED).alias("undetermined"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the fixed patterns."""
    return secrets.op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and smoothed unigram score; the score to six decimals, as sums of doubles differ beyond."""
    found = lm.fold_scores(spark, sf_dir, neural=False)  # as the operator's query, but for the training of its model
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the kinds whose pattern and checksum decide alone."""
    return pii.op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


#: crc32 of doc_id as text: the table of the bytes by its rule, then one step a byte.
FOLDS = """
bits(i, v, step) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM bits WHERE step < 8
), crc_table AS (SELECT list(v ORDER BY i) AS crc_t FROM bits WHERE step = 8),
folds AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
         lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), crc_table
)"""

LANGUAGE_SQL = f"""
WITH RECURSIVE {FOLDS}
SELECT d.doc_id, f.crc % 3 = 1 AS held_out, NOT regexp_matches(coalesce(d.text, ''), '\\p{{L}}') AS undetermined
FROM documents d LEFT JOIN folds f ON d.doc_id = f.doc_id
"""

SCORES_SQL = rf"""
WITH RECURSIVE {FOLDS},
d AS (
  SELECT row_number() OVER () AS r, d.doc_id, f.crc % 5 = 1 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w
  FROM documents d LEFT JOIN folds f ON d.doc_id = f.doc_id
), tokens AS (SELECT r, held_out, unnest(w) AS w FROM d),
counts AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
sums AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts),
scored AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))) AS base_score
  FROM tokens LEFT JOIN counts USING (w), sums GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score FROM d JOIN scored USING (r), sums
"""


def _spans(kinds: list[tuple[str, str, str, str]]) -> str:
    """Spans of (name, pattern, group, condition on m and g): matches and the texts between them give the places."""
    found = "\n  UNION ALL ".join(
        f"SELECT r, {k} AS kind, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {g})) AS g, unnest(string_split_regex(t, '{p}')) AS b FROM d"
        for k, (_, p, g, _) in enumerate(kinds)
    )
    kept = " OR ".join(f"(kind = {k} AND {condition})" for k, (_, _, _, condition) in enumerate(kinds))
    names = ", ".join(f"'{name}'" for name, *_ in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, (name, *_) in enumerate(kinds))
    shown = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, *_ in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {found}
), placed AS (
  SELECT r, kind, m, g, CAST(sum(length(b) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM found WHERE i IS NOT NULL
), kept AS (SELECT r, kind, stop - length(m) AS start, stop FROM placed WHERE {kept}),
summed AS (
  SELECT r, {counts}, string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS joined FROM kept GROUP BY r
)
SELECT doc_id, {shown}, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN summed USING (r)
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CAST(substr(reverse({_DIGITS}), i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END - CASE WHEN i % 2 = 0 AND substr(reverse({_DIGITS}), i, 1) > '4' THEN 9 ELSE 0 END FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"

SECRETS_SQL = _spans([
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "2", "length(g) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "0", "length(m) >= 18"),
    ("hex", "[0-9a-f]+", "0", "length(m) >= 16"),
])

PII_SQL = _spans([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "0", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "0", "len([x FOR x IN string_split(m, '.') IF length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255']) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "0", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "0", f"length({_DIGITS}) BETWEEN 10 AND 15"),
])


def queries() -> dict:
    return {"base_language": base_language, "base_secrets": base_secrets, "base_scores": base_scores, "base_pii": base_pii}


def oracle_sql() -> dict:
    return {"base_language": LANGUAGE_SQL, "base_secrets": SECRETS_SQL, "base_scores": SCORES_SQL, "base_pii": PII_SQL}
