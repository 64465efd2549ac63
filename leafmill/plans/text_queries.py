"""Queries over text: widths, lines, predicates, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines, search
from .layouts import table

WORDS, LINES = 12, 40
# all words of the documents, laid out 12 a line, 90 points apart, and 40 lines a page
WORDS_SQL = f"""SELECT doc_id, i, word, (i - 1) // {WORDS} AS line, (i - 1) // {WORDS * LINES} AS page, (i - 1) % {WORDS} AS pos FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, word, line, page, pos) of every word."""
    found = F.filter(F.split("text", "[ \n\t\r]+", -1), lambda w: w != "")
    flat = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("k", "word"))
    return flat.select("doc_id", (F.col("k") + 1).alias("i"), "word", F.floor(F.col("k") / WORDS).cast("int").alias("line"), F.floor(F.col("k") / (WORDS * LINES)).cast("int").alias("page"), (F.col("k") % WORDS).alias("pos"))


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as spans in content order; heights within a line differ by up to 0.8 points."""
    jitter = (F.col("i") % 5) * 0.2
    w = words(spark, sf_dir)
    return w.select(F.col("doc_id").cast("string").alias("doc_id"), "page", F.col("i").cast("int").alias("span_seq"), (F.col("pos") * 90.0).alias("x"), (100000.0 - F.col("line") * 20 - jitter).alias("y"), (F.col("pos") * 90.0 + F.length("word") * 6).alias("end_x"), F.lit(12.0).alias("font_size"), F.lit("F").alias("font"), F.col("word").alias("text"))


def build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.build_lines(word_spans(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("doc_id"), "page", "line_no", F.round("y", 2).alias("y"), "text")


GAP = "90.0 - length(lag(word) OVER w) * 6"
LINE_SQL = f"""SELECT doc_id, page, line, max(y) AS y, string_agg(sp || word, '' ORDER BY pos) AS text FROM (
SELECT doc_id, page, line, pos, word, 100000.0 - line * 20 - (i % 5) * 0.2 AS y, CASE WHEN pos = 0 THEN '' WHEN {GAP} > 3 THEN repeat(' ', CAST(greatest(1, least(10, floor(({GAP}) / 3))) AS INTEGER)) WHEN {GAP} > 0.5 THEN ' ' ELSE '' END AS sp
FROM ({WORDS_SQL}) WINDOW w AS (PARTITION BY doc_id, line ORDER BY pos)) GROUP BY doc_id, page, line"""


def unended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose spans do not say where they end: half the size, here six points, a character."""
    spans = word_spans(spark, sf_dir).withColumn("end_x", F.col("x"))
    return lines.build_lines(spans).select(F.col("doc_id").cast("long").alias("doc_id"), "page", "line_no", F.round("y", 2).alias("y"), "text")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.page_text(lines.build_lines(word_spans(spark, sf_dir))).select(F.col("doc_id").cast("long").alias("doc_id"), "page", "text")


def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.7 - 2).alias("gap"), (F.col("p_size") * 0.5).alias("size"))
    return gaps.select("p_partkey", F.length(lines.spaces(F.col("gap"), F.col("size"))).alias("n_spaces"))


SPACING_SQL = "SELECT p_partkey, CASE WHEN g > u THEN CAST(greatest(1, least(10, trunc(g / u))) AS INTEGER) WHEN g > 0.5 THEN 1 ELSE 0 END AS n_spaces FROM (SELECT p_partkey, p_size::DOUBLE * 0.7::DOUBLE - 2 AS g, greatest(2.0::DOUBLE, p_size::DOUBLE * 0.5::DOUBLE * 0.25::DOUBLE) AS u FROM part)"


def _widths(font: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", F.round(T.text_width(F.col("p_name"), 12.0, font), 4).alias("width"))

    return query


def _widths_sql(font: str) -> str:
    from ..codec.fonts import standard_widths

    pairs = ", ".join(f"({k}, {v})" for k, v in sorted(standard_widths(font).items()) if k < 127)
    return f"SELECT p_partkey, round(sum(coalesce(w, 556.0)) / 1000 * 12, 4)::DOUBLE AS width FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) LEFT JOIN (VALUES {pairs}) AS t(code, w) ON code = ascii(c) GROUP BY p_partkey"


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """is_header_text, is_all_numeric and is_number of several columns' texts."""
    p = table(spark, sf_dir, "part")
    texts = F.array(F.col("p_name"), F.col("p_brand"), F.format_string("%.2f", "p_retailprice"), F.col("p_size").cast("string"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" "), F.col("p_brand")), F.lit(""))
    flat = p.select("p_partkey", F.posexplode(texts).alias("k", "t"))
    return flat.select("p_partkey", "k", T.is_header_text(F.col("t")).alias("header"), T.is_all_numeric(F.col("t")).alias("numeric"), T.is_number(F.col("t")).alias("number"))


PREDICATES_SQL = r"""SELECT p_partkey, k, strlen(t) BETWEEN 1 AND 30 AND NOT regexp_full_match(t, '[0-9., -]*') AS header, regexp_full_match(t, '[0-9., -]*') AS numeric, regexp_full_match(t, '[0-9.]+') AS number FROM (
SELECT p_partkey, unnest(range(0, 6))::INTEGER AS k, unnest([p_name, p_brand, printf('%.2f', p_retailprice), p_size::VARCHAR, p_name || ' ' || p_type || ' ' || p_brand, '']) AS t FROM part)"""


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("("), F.col("c_name"), F.lit(")\\"), F.col("c_mktsegment"))
    return c.select("c_custkey", T.escape_pdf(text).alias("escaped"), T.smart_append(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "-").when(F.col("c_custkey") % 3 == 1, "/").otherwise("")), F.col("c_name")).alias("joined"))


ESCAPES_SQL = r"""SELECT c_custkey, '\(' || c_name || '\)\\' || c_mktsegment AS escaped, c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '/' ELSE ' ' END || c_name AS joined FROM customer"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Company: "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "  Estimator: x").otherwise(""))
    return c.select("c_custkey", T.after_label(text, "Company:").alias("after"), T.between_labels(text, "Company:", "Estimator:").alias("between"), T.after_label(text, "Other:").alias("absent"))


LABELS_SQL = "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '  Estimator: x' ELSE '' END AS after, c_name AS between, '' AS absent FROM customer"


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("space", "uni0041", "Eacute", "hyphen", "X", "unknownglyph", "uni20AC", "quoteright")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(names).alias("glyph")).select("n_nationkey", "glyph", T.glyph_to_text(F.col("glyph")).alias("text"))


GLYPHS_SQL = "SELECT n_nationkey, glyph, text FROM nation, (VALUES ('space', ' '), ('uni0041', 'A'), ('Eacute', 'É'), ('hyphen', '-'), ('X', 'X'), ('unknownglyph', 'unknownglyph'), ('uni20AC', '€'), ('quoteright', '’')) AS g(glyph, text)"


def search_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.in_spans(word_spans(spark, sf_dir), "en")
    return hits.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "place", F.col("at").alias("start_at"), F.round("rect.x", 3).alias("x"), F.round("rect.width", 3).alias("width"), F.round("rect.height", 3).alias("height"))


# non-overlapping places come from the lengths of the pieces between them
SEARCH_SQL = f"""SELECT doc_id, page::INTEGER AS page, i::INTEGER AS place, k::INTEGER AS start_at, round(pos * 90.0 + k * 6, 3)::DOUBLE AS x, 12.0::DOUBLE AS width, round(12 * 1.2, 3)::DOUBLE AS height FROM (
SELECT doc_id, page, i, pos, unnest(list_transform(range(1, len(p)), lambda n: list_sum(list_transform(p[1:n], lambda t: length(t))) + (n - 1) * 2)) AS k FROM (SELECT doc_id, page, i, pos, string_split(word, 'en') AS p FROM ({WORDS_SQL})) WHERE len(p) > 1)"""


def two_spans(spark: SparkSession, sf_dir: str, gap: float) -> DataFrame:
    """Two pages a part, on each its name and behind it, after a gap, its brand; six points a character."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), "p_name", "p_brand")
    texts = F.array(F.struct(F.lit(0).alias("k"), F.lit(50.0).alias("x"), F.col("p_name").alias("t")), F.struct(F.lit(1).alias("k"), (50.0 + 6 * F.length("p_name") + gap).alias("x"), F.col("p_brand").alias("t")))
    flat = part.select("doc_id", "page", F.explode(texts).alias("s"))
    return flat.select("doc_id", "page", F.col("s.k").alias("span_seq"), "s.x", F.lit(500.0).alias("y"), (F.col("s.x") + 6 * F.length("s.t")).alias("end_x"), F.lit(12.0).alias("font_size"), F.lit("F").alias("font"), F.col("s.t").alias("text"))


def hit_rows(hits: DataFrame) -> DataFrame:
    box = [F.round(f"rect.{k}", 3).alias(k) for k in ("x", "y", "width", "height")]
    return hits.select(F.col("doc_id").cast("long").alias("p_partkey"), "page", "hit_no", *box)


def search_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that begins in the gap between two spans is in the line alone."""
    return hit_rows(search.search(two_spans(spark, sf_dir, 3.0), " Brand"))


def search_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a span and its line both have counts once, and is numbered through the document."""
    hits = search.document_order(search.search(two_spans(spark, sf_dir, 0.0), "Brand"))
    return hit_rows(hits).join(hits.select(F.col("doc_id").cast("long").alias("p_partkey"), "page", "hit_no", F.col("doc_hit_no").cast("int").alias("doc_hit_no")), ["p_partkey", "page", "hit_no"])


def across_sql(extra: str = "") -> str:
    gap = 0 if extra else 3
    return f"SELECT p_partkey, page, 0 AS hit_no, (50.0 + 6 * length(p_name) + {gap})::DOUBLE AS x, (500 - 12 * 0.2)::DOUBLE AS y, {30.0 if extra else 36.0}::DOUBLE AS width, 14.4::DOUBLE AS height{extra} FROM part, (VALUES (0), (1)) AS p(page)"



QUERIES = {
    "build_lines": (build_lines, f"SELECT doc_id, page::INTEGER AS page, (line % {LINES})::INTEGER AS line_no, round(y, 2)::DOUBLE AS y, text FROM ({LINE_SQL})"),
    "page_text": (page_text, f"SELECT doc_id, page::INTEGER AS page, string_agg(text, chr(10) ORDER BY line) AS text FROM ({LINE_SQL}) GROUP BY doc_id, page"),
    "line_spacing": (line_spacing, SPACING_SQL),
    "text_width_helvetica": (_widths("Helvetica"), _widths_sql("Helvetica")),
    "text_width_times_bold": (_widths("Times-Bold"), _widths_sql("Times-Bold")),
    "text_width_courier": (_widths("Courier"), "SELECT p_partkey, round(length(p_name) * 600.0 / 1000 * 12, 4)::DOUBLE AS width FROM part"),
    "text_predicates": (predicates, PREDICATES_SQL),
    "escape_and_append": (escapes, ESCAPES_SQL),
    "label_values": (labels, LABELS_SQL),
    "glyph_to_text": (glyphs, GLYPHS_SQL),
    "search_spans": (search_spans, SEARCH_SQL),
    "search_across_spans": (search_across, across_sql()),
    "search_document_order": (search_once, across_sql(", page AS doc_hit_no")),
    "span_end_estimate": (unended_lines, f"SELECT doc_id, page::INTEGER AS page, (line % {LINES})::INTEGER AS line_no, round(y, 2)::DOUBLE AS y, text FROM ({LINE_SQL})"),
}
