"""The queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard_join, langid, media_columns, packing, quality_lines, secret_scan, substring_runs, suffix_dedup, toxicity
from .common import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.line_frequency(table(spark, sf_dir, "documents"))


def op2_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.store(table(spark, sf_dir, "documents"))


def op3_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op4_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op5_substring_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_runs.dedup(table(spark, sf_dir, "documents"))


def op6_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_langid_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_jaccard_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_frequency, op2_media_webp, op3_secret_markov, op4_bpe_pair_index, op5_substring_runs, op6_toxicity_pu, op7_suffix_dedup, op8_langid_bayes, op9_jaccard_bayes, op10_best_fit)
    return {f.__name__: f for f in own}


WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {WORDS.format("text")} AS ws FROM documents),
lines AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
real AS (SELECT doc_id, host, line, {WORDS.format("line")} AS lw FROM lines WHERE len({WORDS.format("line")}) > 0),
norm AS (SELECT doc_id, host, len(lw) AS n, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS l FROM real),
per AS (SELECT doc_id, host, l, sum(n) AS n FROM norm GROUP BY ALL),
sizes AS (SELECT source AS host, count(*) AS docs FROM documents GROUP BY source),
often AS (SELECT p.host, l FROM per p JOIN sizes s USING (host) GROUP BY p.host, l, s.docs HAVING count(*) > 50 AND count(*) > 0.01 * s.docs),
gone AS (SELECT doc_id, sum(n) AS n, count(*) AS k FROM per JOIN often USING (host, l) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real GROUP BY doc_id),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, w FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice USING (doc_id, w)) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words, coalesce(gone.k, 0)::BIGINT AS n_removed_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_removed_words > 0.5 * n_words OR n_words - n_removed_words < 25) AS kept, n_removed_words, n_removed_lines FROM failed
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM w JOIN twice USING (h)),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: ps IS NULL OR NOT list_contains(ps, k)), ' '), '')) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 5 * k >= 4 * (a.n + b.n - k)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
cls AS (SELECT u AS doc_id, min(v) AS class_id FROM r GROUP BY u),
shape AS (SELECT doc_id, list_sort(list(x)) AS xs FROM (SELECT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)) GROUP BY doc_id),
copies AS (SELECT doc_id, count(*) OVER (PARTITION BY xs) AS n_copies FROM shape),
deg AS (SELECT u AS doc_id, count(*) AS n_links FROM l GROUP BY u)
SELECT documents.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies FROM documents LEFT JOIN cls USING (doc_id) LEFT JOIN deg USING (doc_id) LEFT JOIN copies USING (doc_id)
"""


# bytes as pairs of hexadecimal digits; a string of 400 bytes is told apart by its digest
OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, b, substring(h, 2 * b + 1, 1822) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS b FROM d WHERE length(h) >= 800)),
w AS (SELECT doc_id, b + j AS i, md5_number(substring(g, 2 * j + 1, 800)) AS x FROM (SELECT doc_id, b, g, unnest(range(0, least(512, length(g) // 2 - 399))) AS j FROM g)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) USING (x)),
s AS (SELECT doc_id, i, lag(i) OVER o AS p, lead(i) OVER o AS q FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, sum(least(400, coalesce(q - i, 400))) AS n, list(i ORDER BY i) FILTER (p IS NULL OR i - p > 400) AS a, list(i + 400 ORDER BY i) FILTER (q IS NULL OR q - i > 400) AS b FROM s GROUP BY doc_id),
k AS (SELECT doc_id, h, coalesce(n, 0)::BIGINT AS n, coalesce(a, []) AS a, [0] || coalesce(b, []) AS b FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n AS n_removed, len(a)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(b) + 1), lambda j: substring(h, 2 * b[j] + 1, 2 * (coalesce(a[j], length(h) // 2) - b[j]))), ''))) AS kept_sha256 FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": OP1, "op5_substring_runs": OP5, "op7_suffix_dedup": OP7, "op9_jaccard_bayes": OP9}
