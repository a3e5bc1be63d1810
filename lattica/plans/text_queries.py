"""Queries of sources, characters, classes, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import decode
from lattica.operators import relational as R
from lattica.plans.registry import query
from lattica.plans.shapes import CHARS, CLASS_SQL, MASK_SQL, class_model, lines_of, lines_sql, words
from lattica.plans.shared import table
from lattica.sources import readers


def _definition(spark: SparkSession, text: str) -> DataFrame:
    return readers.split_lines(spark.createDataFrame([("def", text)], "file string, text string"), "file", "text")


def _classified(spark: SparkSession, lines: DataFrame, keys: list[str]) -> DataFrame:
    classes, ranges = readers.char_classes(_definition(spark, CHARS))
    return R.classify(R.chars(lines, keys), readers.char_map(classes, ranges), 0)


@query("sentences", lines_sql("documents", "doc_id", "text"))
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "documents", "doc_id")


_CHARS = f"""WITH l AS ({lines_sql("benchmark", "item_id", "text")}),
c AS (SELECT item_id, sent_id, CAST(unnest(range(length(sentence))) AS INTEGER) AS ci, sentence FROM l WHERE sentence <> ''),
k AS (SELECT item_id, sent_id, ci, substr(sentence, ci + 1, 1) AS ch FROM c)
SELECT item_id, sent_id, ci, ch, unicode(ch) AS cp, strlen(ch) AS byte_len,
  CAST(coalesce(sum(strlen(ch)) OVER (PARTITION BY item_id, sent_id ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS byte_pos FROM k"""


@query("chars", _CHARS)
def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chars(lines_of(spark, sf_dir, "benchmark", "item_id"), ["item_id", "sent_id"])


_CP = f"""WITH c AS (SELECT unnest(string_split(replace(text, chr(10), ''), '')) AS ch FROM documents),
k AS (SELECT ch, unicode(ch) AS u, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch),
m AS (SELECT *, {CLASS_SQL.format(u="(CASE WHEN u > 65535 THEN 0 ELSE u END)")} AS class_id FROM k)
SELECT class_id, {MASK_SQL.format(c="class_id")} AS type_mask, CAST(sum(n) AS BIGINT) AS n_chars, CAST(sum(n * strlen(ch)) AS BIGINT) AS n_bytes, count(*) AS n_code_points FROM m GROUP BY class_id"""


@query("char_classes", _CP)
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counts of characters first: classes are a function of the code point
    text = F.regexp_replace("text", "\n", "")
    counts = table(spark, sf_dir, "documents").select(F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    classes, ranges = readers.char_classes(_definition(spark, CHARS))
    c = R.classify(counts.withColumn("cp", F.ascii("ch")), readers.char_map(classes, ranges), 0)
    return c.groupBy("class_id", "type_mask").agg(F.sum("n").alias("n_chars"), F.sum(F.col("n") * F.octet_length("ch")).alias("n_bytes"), F.count("*").alias("n_code_points"))


def _runs_sql(name: str, key: str) -> str:
    return f"""l AS ({lines_sql(name, key, "text")}),
c AS (SELECT {key}, sent_id, CAST(unnest(range(length(sentence))) AS INTEGER) AS ci, sentence FROM l WHERE sentence <> ''),
k AS (SELECT {key}, sent_id, ci, unicode(substr(sentence, ci + 1, 1)) AS u FROM c),
m AS (SELECT {key}, sent_id, ci, {CLASS_SQL.format(u="u")} AS class_id FROM k),
b AS (SELECT *, {MASK_SQL.format(c="class_id")} AS mask FROM m),
f AS (SELECT *, CASE WHEN (mask & lag(mask) OVER (PARTITION BY {key}, sent_id ORDER BY ci)) <> 0 THEN 0 ELSE 1 END AS brk FROM b),
r AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY {key}, sent_id ORDER BY ci) AS BIGINT) AS run_id FROM f)"""


@query("class_runs", f"WITH {_runs_sql('benchmark', 'item_id')} SELECT item_id, sent_id, run_id, min(ci) AS first_ci, max(ci) + 1 AS run_end, arg_min(class_id, ci) AS class_id FROM r GROUP BY item_id, sent_id, run_id")
def class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["item_id", "sent_id"]
    runs = R.runs(_classified(spark, lines_of(spark, sf_dir, "benchmark", "item_id"), keys), keys)
    return runs.groupBy(*keys, "run_id").agg(F.min("ci").alias("first_ci"), F.max("run_end").alias("run_end"), F.min_by("class_id", "ci").alias("class_id"))


@query(
    "run_histogram",
    f"WITH {_runs_sql('conversations', 'conv_id, turn').replace('PARTITION BY conv_id, turn, sent_id', 'PARTITION BY conv_id, turn, sent_id')}, g AS (SELECT arg_min(class_id, ci) AS class_id, count(*) AS length FROM r GROUP BY conv_id, turn, sent_id, run_id) SELECT class_id, length, count(*) AS n FROM g GROUP BY ALL",
)
def run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("sentence"))
    runs = R.class_runs(decode.spread(lines), [], class_model()).withColumn("length", (F.col("run_end") - F.col("first_ci")).cast("long"))
    return runs.groupBy("class_id", "length").agg(F.count("*").alias("n"))


_SPACES = f"""WITH l AS ({lines_sql("benchmark", "item_id", "text")}), c AS (SELECT item_id, sent_id, CAST(unnest(range(length(sentence))) AS INTEGER) AS ci, sentence FROM l WHERE sentence <> '')
SELECT item_id, sent_id, ci, CASE WHEN trim(substr(sentence, ci + 1)) = '' THEN NULL ELSE CAST(ci + length(substr(sentence, ci + 1)) - length(ltrim(substr(sentence, ci + 1), ' ')) AS INTEGER) END AS head_ci FROM c"""


@query("leading_spaces", _SPACES)
def leading_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["item_id", "sent_id"]
    return R.heads(_classified(spark, lines_of(spark, sf_dir, "benchmark", "item_id"), keys), keys, 2).select(*keys, "ci", "head_ci")


@query(
    "scalar_functions",
    """SELECT p_partkey, translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
  '"' || p_name || ',""' || p_type || '""' || chr(34) AS quoted, CAST(trunc(least(greatest(-(p_retailprice / 100) * 800, -32767), 32767)) AS INTEGER) AS quantized,
  CAST(greatest(-32767, trunc(-400 * pow(strlen(p_name), 1.5))) AS INTEGER) AS keyword, CAST(trunc(-ln(p_size / 100.0) * 200) AS INTEGER) AS log_cost,
  printf('%.6f', p_retailprice) AS number, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS n_cells FROM part""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        C.ascii_lower(F.col("p_brand")).alias("lowered"),
        C.quote_field(F.concat("p_name", F.lit(',"'), "p_type", F.lit('"'))).alias("quoted"),
        C.quantized_cost(F.col("p_retailprice") / 100, 800).alias("quantized"),
        C.keyword_cost(F.col("p_name")).alias("keyword"),
        C.log_cost(F.col("p_size") / 100.0).alias("log_cost"),
        C.dtoa(F.col("p_retailprice")).alias("number"),
        F.size(C.split_runs(F.col("p_type"), " \t")).alias("n_cells"),
    )


_HANGUL = "('하늘'), ('가'), ('나무'), ('바람'), ('abc'), ('강a'), (''), ('값')"


@query(
    "jongsung_flag",
    f"""SELECT w AS word, CASE WHEN w = '' OR NOT unicode(right(w, 1)) BETWEEN 44032 AND 55203 THEN '*' WHEN (unicode(right(w, 1)) - 44032) % 28 > 0 THEN 'T' ELSE 'F' END AS flag,
  regexp_full_match(w, '[가-힣]+') AS hangul FROM (VALUES {_HANGUL}) t(w)""",
)
def jongsung_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x.strip("()' "),) for x in _HANGUL.split(", ")]
    w = spark.createDataFrame(rows, "word string")
    return w.select("word", C.final_consonant(F.col("word")).alias("flag"), C.is_hangul(F.col("word")).alias("hangul"))


@query(
    "compound_explode",
    "SELECT CAST(unnest(range(len(p))) AS INTEGER) AS i, string_split(unnest(p), '/')[1] AS surface, string_split(unnest(p), '/')[2] AS pos, string_split(unnest(p), '/')[3] AS semantic_class FROM (SELECT string_split('가/NNG/*+나/NNG/지명', '+') AS p)",
)
def compound_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("가/NNG/*+나/NNG/지명",)], "e string")
    return e.select(F.posexplode(C.compound_parts(F.col("e"))).alias("i", "t")).select("i", "t.*")


@query("prefix_compounds", "SELECT p_partkey, unnest(list_transform(range(1, len(m) + 1), lambda i: array_to_string(m[1:i], ''))) AS compound FROM (SELECT p_partkey, string_split(p_name, ' ') AS m FROM part)")
def prefix_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(C.prefix_compounds(F.split("p_name", " "))).alias("compound"))


@query("expression_check", "SELECT * FROM (VALUES ('가/NNG/*/0/1', true), ('가/NNG/지명/0/1+나/NNG/*/1/2', true), ('가/NNG/*/0', false), ('가/NNG/없음/0/1', false), ('가/NNG/*/a/1', false)) t(expression, good)")
def expression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["가/NNG/*/0/1", "가/NNG/지명/0/1+나/NNG/*/1/2", "가/NNG/*/0", "가/NNG/없음/0/1", "가/NNG/*/a/1"]
    return spark.createDataFrame([(x,) for x in rows], "expression string").select("expression", C.valid_expression(F.col("expression"), ["지명", "인명"]).alias("good"))


@query("page_phrases", "SELECT page_id, CAST(unnest(range(len(p))) AS INTEGER) AS i, unnest(p) AS phrase FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS p FROM pages)")
def page_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.phrases(table(spark, sf_dir, "pages"), "<h1>([^<]*)</h1>")


@query("word_stats", f"WITH l AS ({lines_sql('documents', 'doc_id', 'text')}), w AS (SELECT unnest(string_split(sentence, ' ')) AS w FROM l) SELECT w AS surface, count(*) AS n FROM w WHERE w <> '' GROUP BY w")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(lines_of(spark, sf_dir, "documents", "doc_id"), []).groupBy(F.col("w").alias("surface")).agg(F.count("*").alias("n"))


_PAIRS = f"""WITH l AS ({lines_sql("documents", "doc_id", "text")}), t AS (SELECT doc_id, sent_id, unnest(range(len(s))) AS i, unnest(s) AS w FROM (SELECT doc_id, sent_id, string_split(sentence, ' ') AS s FROM l)),
v AS (SELECT * FROM t WHERE w <> ''), p AS (SELECT w AS "left", lead(w) OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS "right" FROM v),
c AS (SELECT "left", "right", count(*) AS n FROM p WHERE "right" IS NOT NULL GROUP BY ALL), d AS (SELECT count(DISTINCT w) AS v FROM v)
SELECT "left", "right", n, CAST(trunc(-ln((n + 0.5) / (sum(n) OVER (PARTITION BY "left") + 0.5 * v)) * 200) AS INTEGER) AS cost FROM c, d"""


@query("bigram_lm_costs", _PAIRS)
def bigram_lm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.operators.etl import pair_costs

    return pair_costs(decode.spread(table(spark, sf_dir, "documents").select("text")), "text", line_break="\n")


@query(
    "unigram_lm_costs",
    f"WITH l AS ({lines_sql('documents', 'doc_id', 'text')}), v AS (SELECT w FROM (SELECT unnest(string_split(sentence, ' ')) AS w FROM l) WHERE w <> ''), c AS (SELECT w, count(*) AS n FROM v GROUP BY w) SELECT w, n, CAST(trunc(-ln((n + 0.5) / (sum(n) OVER () + 0.5 * count(*) OVER ())) * 200) AS INTEGER) AS cost FROM c",
)
def unigram_lm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.operators.etl import word_costs

    return word_costs(words(lines_of(spark, sf_dir, "documents", "doc_id"), []))
