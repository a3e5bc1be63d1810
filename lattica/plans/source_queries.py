"""Queries of definition files, model files, merges and edits, output lines: files are made of table rows, read back and compared."""

from __future__ import annotations

import lzma

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions import paths
from lattica.operators import decode, etl, lexicon
from lattica.operators import format as fmt
from lattica.operators import relational as R
from lattica.plans import build
from lattica.plans.dictionary_queries import _FEATURES, _L, _WEIGHTS, RULES, UNIGRAMS, _features, _left_ids, _part_names, _weights
from lattica.plans.lattice_queries import _PART_PATHS, _PROBS
from lattica.plans.model import EngineConf
from lattica.plans.registry import query
from lattica.plans.shapes import CHARS, UNKNOWN, part_model
from lattica.plans.shared import fresh_path, table
from lattica.plans.text_queries import _definition
from lattica.sources import readers


def _file(rows: DataFrame, key: str, order: str, line: Column, head: str = "") -> DataFrame:
    """One file per key, out of lines in order; (key, line_no, line) read back from it."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])  # a definition file
    text = F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n"))
    return readers.split_lines(rows.groupBy(key).agg(text.alias("text")), key, "text")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def _per_region(spark: SparkSession, sf_dir: str, read, line: Column, head: str = "") -> DataFrame:
    """read(lines) of each region's file, put together. There are five regions."""
    n = _nation(spark, sf_dir)
    out = None
    for k in sorted(r["r_regionkey"] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()):
        one = read(_file(n.filter(F.col("n_regionkey") == k), "n_regionkey", "n_nationkey", line, head)).withColumn("n_regionkey", F.lit(k).cast("int"))
        out = one if out is None else out.unionByName(one)
    return out


_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)"


# ---------------------------------------------------------------------------------------------------------------- sources


@query(
    "partial_block_scan",
    """WITH b AS (SELECT p_partkey, CAST(0 AS INTEGER) AS sent_id, string_split(p_name, ' ') AS w, 'N' AS pattern FROM part UNION ALL SELECT p_partkey, CAST(1 AS INTEGER), string_split(p_type, ' '), NULL FROM part)
SELECT p_partkey, sent_id, CAST(unnest(range(len(w))) AS INTEGER) AS frag_idx, unnest(w) AS surface, pattern FROM b""",
)
def partial_block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("\tN"))), "\n")
    text = F.concat(tokens, F.lit("\nEOS\n"), F.replace("p_type", F.lit(" "), F.lit("\n")))
    return readers.partial_blocks(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", "p_partkey")


@query("csv_file_names", "SELECT r_name || CASE r_regionkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' ELSE '.Csv' END AS name FROM region WHERE r_regionkey <> 3")
def csv_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names as files with extensions in different cases; one has another extension."""
    folder = fresh_path(spark, "csv-names")
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        name = r["r_name"] + (".txt" if r["r_regionkey"] == 3 else (".csv", ".CSV", ".Csv")[r["r_regionkey"] % 3])
        out = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        stream = out.getFileSystem(spark._jsc.hadoopConfiguration()).create(out)
        stream.writeBytes("a,0,0,1,N\n")
        stream.close()
    return spark.createDataFrame([(paths.file_name(p),) for p in readers.csv_files(spark, folder)], "name string")


@query("rewrite_rule_scan", f"WITH {_RANKED} SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey, CASE WHEN k <= 2 THEN 'unigram' ELSE 'left' END AS section, n_name || ',*' AS pattern, '$1,' || n_nationkey AS target FROM r")
def rewrite_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules under two headings, with comments and empty lines between them."""
    n = _nation(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rule = F.concat("n_name", F.lit(",* \t $1,"), F.col("n_nationkey").cast("string"))
    ruled = n.withColumn("k", k).withColumn("line", F.concat(F.when(F.col("k") == 1, "[unigram rewrite]\n").when(F.col("k") == 3, "# next\n\n[left rewrite]\n").otherwise(""), rule))
    out = None
    for region in range(5):
        one = readers.rewrite_rules(_file(ruled.filter(F.col("n_regionkey") == region), "n_regionkey", "n_nationkey", F.col("line"), "# rules\n")).select(F.lit(region).alias("n_regionkey"), "section", "pattern", "target")
        out = one if out is None else out.unionByName(one)
    return out


@query("pos_rule_scan", "SELECT n_regionkey::INTEGER AS n_regionkey, n_name || ',*' AS pattern, CAST(n_nationkey AS INTEGER) AS pos_id FROM nation")
def pos_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("n_name", F.lit(",*   "), F.col("n_nationkey").cast("string"))
    return _per_region(spark, sf_dir, readers.pos_rules, line, "# ids\n\n").select("n_regionkey", "pattern", "pos_id")


@query("id_list_scan", "SELECT n_regionkey::INTEGER AS n_regionkey, CAST(n_nationkey AS INTEGER) AS id, n_name || ',x y' AS feature FROM nation")
def id_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_region(spark, sf_dir, readers.id_list, F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(",x y")))).select("n_regionkey", "id", "feature")


@query("template_scan", "SELECT n_regionkey::INTEGER AS n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'UNIGRAM' ELSE 'BIGRAM' END AS kind, 'T' || n_nationkey || ':%F[' || n_regionkey || ']' AS template FROM nation")
def template_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "UNIGRAM\t").otherwise("BIGRAM  "), F.lit("T"), F.col("n_nationkey").cast("string"), F.lit(":%F["), F.col("n_regionkey").cast("string"), F.lit("]"))
    return _per_region(spark, sf_dir, readers.templates, line, "# features\n").select("n_regionkey", "kind", "template")


@query("config_scan", "SELECT 'name-' || n_nationkey AS key, n_name AS value FROM nation")
def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with comments, blanks and a repeated key, whose first value counts."""
    rows = _nation(spark, sf_dir).orderBy("n_nationkey").collect()  # a settings file
    text = "; settings\n# more\n\n" + "".join(f" name-{r['n_nationkey']}  = {r['n_name']} \n" for r in rows) + "".join(f"name-{r['n_nationkey']} = again\n" for r in rows)
    return spark.createDataFrame(list(readers.parse_config(text).items()), "key string, value string")


@query("settings_lines", "SELECT 'name-' || n_nationkey || ' = ' || n_name AS line FROM nation UNION ALL SELECT 'cost-factor = 350' UNION ALL SELECT 'bos-feature = B,*'")
def settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings out of a map, written as lines again: what differs from the defaults."""
    given = {f"name-{r['n_nationkey']}": r["n_name"] for r in _nation(spark, sf_dir).collect()} | {"cost-factor": "350", "bos-feature": "B,*"}  # a settings file
    return spark.createDataFrame([(x,) for x in EngineConf.from_map(given).lines()], "line string")


@query("crf_model_scan", f"WITH {_FEATURES}, {_WEIGHTS} SELECT CAST(alpha AS DOUBLE) AS alpha, f AS feature FROM g")
def crf_model_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written as lines, with its header, and read back."""
    body = lexicon.model_lines(_weights(spark, sf_dir, UNIGRAMS[:2])).withColumn("k", F.lit(1))
    whole = _file(body, "k", "line", F.col("line"), "cost-factor: 700\nbos-feature: BOS\n\n")
    return readers.crf_model(whole)[1]


@query("crf_model_header", "SELECT * FROM (VALUES ('cost-factor', '700'), ('bos-feature', 'BOS,*:*')) t(key, value)")
def crf_model_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.crf_model(_definition(spark, "cost-factor: 700\nbos-feature: BOS,*:*\n\n0.5\tU0:x\n"))[0]


@query("model_text", f"WITH {_FEATURES}, {_WEIGHTS} SELECT printf('%.16f', CAST(alpha AS DOUBLE)) || chr(9) || f AS line FROM g")
def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.model_lines(_weights(spark, sf_dir, UNIGRAMS[:2]))


@query("id_text", f"WITH {_FEATURES}, v AS (SELECT DISTINCT {_L} AS v FROM x) SELECT '0 BOS/EOS,*,*' AS line UNION ALL SELECT row_number() OVER (ORDER BY v) || ' ' || v FROM v")
def id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.id_lines(_left_ids(spark, sf_dir))


@query("xz_scan", "SELECT CAST(p_size AS VARCHAR) AS file, p_partkey || ',' || p_name AS line FROM part")
def xz_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by size as compressed files, read back."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat_ws(",", x["p_partkey"].cast("string"), x["p_name"]))
    files = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("path")).agg(F.array_join(lines, "\n").alias("text"))

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([lzma.compress(x.as_py().encode()) for x in b.column("text")], pa.binary())], names=["path", "content"])

    return readers.xz_csv(files.mapInArrow(packed, "path string, content binary")).select("file", "line")


@query("s_expression_scan", "SELECT p_partkey, p_size AS cost, p_name AS word, p_type || '(' AS note FROM part")
def s_expression_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries as nested lists with quoted and escaped atoms."""
    p = table(spark, sf_dir, "part")
    entry = F.concat(F.lit('(noun ((word "'), "p_name", F.lit('") (cost '), F.col("p_size").cast("string"), F.lit(')) (note "'), "p_type", F.lit('\\("))'))
    return readers.s_expression_entries(p.select("p_partkey", entry.alias("text")), "text", {"cost": "noun/cost", "word": "noun/word", "note": "noun/note"}).select("p_partkey", F.col("cost").cast("int").alias("cost"), "word", "note")


@query("transcoded_rows", "SELECT doc_id, text FROM documents WHERE strlen(text) = length(text)")
def transcoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose bytes are no text of the charset go."""
    return readers.transcoded(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text")), "text", "ascii")


@query("stored_model", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT w AS surface, CAST(0 AS INTEGER) AS left_id, CAST(-100 * length(w) AS INTEGER) AS word_cost, 'NOUN,' || length(w) AS feature FROM w")
def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written to the shared folder and read back, as entries."""
    path = fresh_path(spark, "model")
    build.save_model(spark, part_model(spark, sf_dir), path)
    m = build.load_model(spark, path)
    rows = [(s.decode(), int(m.left[k]), int(m.cost[k]), m.features[k]) for i, s in enumerate(m.surfaces) for k in range(m.first[i], m.first[i + 1])]
    return spark.createDataFrame(rows, "surface string, left_id int, word_cost int, feature string")


@query("matrix_round_trip", "SELECT CAST(n_nationkey AS INTEGER) AS right_ctx, CAST(r_regionkey AS INTEGER) AS left_ctx, CAST((n_nationkey * 37 - r_regionkey * 500) AS INTEGER) AS cost FROM nation, region")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection matrix as compiled bytes and back."""
    cells = _nation(spark, sf_dir).select("n_nationkey").crossJoin(table(spark, sf_dir, "region").select("r_regionkey"))
    rows = cells.select("n_nationkey", "r_regionkey", (F.col("n_nationkey") * 37 - F.col("r_regionkey") * 500).alias("cost")).collect()  # a matrix
    import numpy as np

    m = np.zeros((25, 5), np.int64)
    for a, b, c in rows:
        m[a, b] = c
    back = build.read_binary_matrix(build.binary_matrix(m))
    return spark.createDataFrame([(a, b, int(back[a, b])) for a in range(25) for b in range(5)], "right_ctx int, left_ctx int, cost int")


# ---------------------------------------------------------------------------------------------------------------- functions


@query(
    "string_functions",
    """SELECT p_partkey, string_split(replace(replace(p_name, ' ', '|'), 'e', '|'), '|') AS kept, CAST(('0x' || upper(printf('%04x', p_partkey % 65536))) AS BIGINT)::INTEGER AS number,
  replace(p_type, 'A', chr(8213)) AS dashed, p_name LIKE 'red %' OR p_size = 7 AS matched, p_type || '/' || p_brand AS joined, p_brand AS stripped, p_type || '/x' AS folder, 'a.b/' || p_brand || '.out' AS renamed FROM part""",
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    feature = F.concat_ws(",", first, F.col("p_size").cast("string"), F.lit("x"))
    return p.select(
        "p_partkey",
        C.split_keep(F.col("p_name"), " e").alias("kept"),
        C.hex_number(F.concat(F.lit("0x"), F.lpad(F.hex(F.col("p_partkey") % 65536), 4, "0"))).alias("number"),
        C.plain_dash(F.replace("p_type", F.lit("A"), F.lit("—"))).alias("dashed"),
        (C.column_match(F.lit("red,*,x,y"), feature) | C.column_match(F.lit("*,7"), feature)).alias("matched"),
        paths.join(F.col("p_type"), F.col("p_brand")).alias("joined"),
        paths.without_folder(F.concat("p_type", F.lit("/x/"), "p_brand")).alias("stripped"),
        paths.folder(F.concat("p_type", F.lit("/x/"), "p_brand")).alias("folder"),
        paths.with_extension(F.concat(F.lit("a.b/"), "p_brand", F.lit(".dic")), ".out").alias("renamed"),
    )


@query("escaped_format", "SELECT p_partkey, chr(9) || chr(10) || chr(13) || ' ' || chr(92) || p_name || chr(7) AS text FROM part WHERE NOT contains(p_name, ' ') UNION ALL SELECT p_partkey, string_agg(chr(9) || chr(10) || chr(13) || ' ' || chr(92) || w || chr(7), '' ORDER BY i) FROM (SELECT p_partkey, unnest(range(len(s))) AS i, unnest(s) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part WHERE contains(p_name, ' '))) GROUP BY p_partkey")
def escaped_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All escapes of a template around each token."""
    conf = EngineConf(node_format="\\t\\n\\r\\s\\\\%m\\a", eos_format="")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sentence"))
    t = decode.tokens_column(parts, part_model(spark, sf_dir, conf=conf))
    return t.select("p_partkey", fmt.user_format(conf)(F.col("tokens"), F.col("sentence")).alias("text"))


@query("previous_token_format", "SELECT p_partkey, string_agg('0:' || (-100 * length(w)) || ':' || c, ';' ORDER BY i) || ';' AS text FROM (SELECT p_partkey, i, w, sum(-100 * length(w)) OVER (PARTITION BY p_partkey ORDER BY i) AS c FROM (SELECT p_partkey, unnest(range(len(s))) AS i, unnest(s) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part))) GROUP BY p_partkey")
def previous_token_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection cost, cost of the step and running cost of each token, which need the token before."""
    conf = EngineConf(node_format="%pC:%pn:%pc;", eos_format="")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sentence"))
    t = decode.tokens_column(parts, part_model(spark, sf_dir, conf=conf))
    return t.select("p_partkey", fmt.user_format(conf)(F.col("tokens"), F.col("sentence")).alias("text"))


# ---------------------------------------------------------------------------------------------------------------- outputs


@query("expectation_lines", f"{_PROBS}, g AS (SELECT p_name, k.b AS b, k.e AS e, k.f AS feature, sum(p) AS p FROM k GROUP BY ALL) SELECT p_partkey, feature, count(*) AS n_lines, round(sum(p), 2) AS prob FROM part JOIN g USING (p_name) WHERE p >= 0.0001 GROUP BY p_partkey, feature")
def expectation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram lines of probabilities from 1e-4 on, read back from their text."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sentence"))
    m = part_model(spark, sf_dir, pieces=True)
    nodes = decode.all_nodes(parts, m, theta=0.002).filter("stat < 2")
    lines = fmt.expectation_lines(nodes, decode.lattice_paths(parts, m, theta=0.002), ["p_partkey"])
    cells = F.split("line", "\t")
    unigram = lines.filter(F.col("line").startswith("U")).select("p_partkey", F.get(cells, F.lit(2)).alias("feature"), F.get(cells, F.lit(3)).cast("double").alias("prob"))
    return unigram.groupBy("p_partkey", "feature").agg(F.count("*").alias("n_lines"), F.round(F.sum("prob"), 2).alias("prob"))


@query("nbest_text", f"{_PART_PATHS}, r AS (SELECT p_name, least(3, count(*)) AS n, list_sum(list_slice(list_sort(list(len(nodes) * 0 + cost)), 1, 3)) AS cost FROM full_paths GROUP BY p_name) SELECT p_partkey, CAST(n AS INTEGER) AS results, true AS ended FROM part JOIN r USING (p_name)")
def nbest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results stand in the text, and whether it ends as it should."""
    parts = decode.spread(table(spark, sf_dir, "part")).select("p_partkey", F.col("p_name").alias("sentence"))
    text = fmt.nbest_text(decode.nbest(parts, part_model(spark, sf_dir, pieces=True), 3), ["p_partkey"], "EON\n")
    return text.select("p_partkey", F.regexp_count("text", F.lit("(?m)^EOS$")).cast("int").alias("results"), F.col("text").endswith("EOS\nEON\n").alias("ended"))


@query("one_best_alternatives", "SELECT p_partkey, count(*) AS n, 'ALT' AS feature, min('NOUN,' || length(w)) AS best_feature FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE starts_with(w, 'b') GROUP BY p_partkey")
def one_best_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates beside the best path's nodes, over the same span."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sentence"))
    m = part_model(spark, sf_dir)
    m = m.with_user_entries([(x.decode(), 0, 0, 500, "ALT") for x in m.surfaces if x.startswith(b"b")])
    found = decode.alternatives(decode.all_nodes(parts, m), ["p_partkey"])
    return found.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("feature").alias("feature"), F.min("best_feature").alias("best_feature"))


@query("nodes_at_start", f"{_PART_PATHS} SELECT p_partkey, CAST(e AS INTEGER) AS \"end\", feature FROM part JOIN cand USING (p_name) WHERE b = 0")
def nodes_at_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that begin at the first byte."""
    from lattica.plans.tagger import nodes_at

    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sentence"))
    nodes = decode.all_nodes(parts, part_model(spark, sf_dir, pieces=True)).filter("stat < 2")
    return nodes_at(nodes, begin=0).select("p_partkey", "end", "feature")


@query("sentence_ends", "SELECT p_partkey, unnest(['BOS/EOS', 'BOS/EOS']) AS feature, unnest([2, 3]) AS stat, unnest([0, CAST(strlen(p_name) AS INTEGER)]) AS start FROM part")
def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a sentence's two ends."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sentence"))
    return decode.all_nodes(parts, part_model(spark, sf_dir)).filter("stat >= 2").select("p_partkey", "feature", "stat", "start")


@query("dictionary_info", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), e AS (SELECT 0 AS dict_id, w FROM w UNION ALL SELECT 1, left(w, 2) FROM w) SELECT dict_id, count(*) AS size, count(DISTINCT w) AS surfaces, CAST(max(strlen(w)) AS INTEGER) AS longest FROM e GROUP BY dict_id")
def dictionary_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    entries = w.select(F.lit(0).alias("dict_id"), F.col("w").alias("surface")).unionByName(w.select(F.lit(1).alias("dict_id"), F.left("w", F.lit(2)).alias("surface")))
    return lexicon.dictionary_info(entries)


@query("user_dictionary_tokens", "WITH t AS (SELECT p_partkey, unnest(range(len(s))) AS i, unnest(s) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)) SELECT CASE WHEN starts_with(w, 'b') THEN 'USER' ELSE 'NOUN,' || length(w) END AS feature, count(*) AS n FROM t GROUP BY 1")
def user_dictionary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a user dictionary, looked up after the system's, win by their cost."""
    p = table(spark, sf_dir, "part")
    m = part_model(spark, sf_dir)
    m = m.with_user_entries([(s.decode(), 0, 0, -100000, "USER") for s in m.surfaces if s.startswith(b"b")])
    tokens = decode.tokenize(p.select("p_partkey", F.col("p_name").alias("sentence")), m)
    return tokens.groupBy("feature").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------------------------- checks and edits


@query("entry_violations", "SELECT p_name AS surface, 'context id' AS problem FROM part WHERE p_size > 45 UNION ALL SELECT split_part(p_type, ' ', 1), 'too many entries' FROM part GROUP BY split_part(p_type, ' ', 1) HAVING count(*) > 255")
def entry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context ids outside of a 46 x 46 matrix, and surfaces of more than 255 entries."""
    p = table(spark, sf_dir, "part")
    ids = lexicon.violations(p.select(F.col("p_name").alias("surface"), F.col("p_size").alias("left_id"), F.lit(0).alias("right_id")), 46, 46).filter("problem = 'context id'")
    many = lexicon.violations(p.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("surface"), F.lit(0).alias("left_id"), F.lit(0).alias("right_id")), 1, 1)
    return ids.unionByName(many)


@query("uncovered_classes", "SELECT 'LATIN' AS class_name UNION ALL SELECT 'SYMBOL'")
def uncovered_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = readers.char_classes(_definition(spark, CHARS))
    lines = "\n".join(x for x in UNKNOWN.splitlines() if not x.startswith(("LATIN", "SYMBOL")))
    return readers.uncovered_classes(classes, readers.unknown_entries(_definition(spark, lines), classes))


@query("chosen_sources", "SELECT n_name AS surface, r_name AS source FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') OR r_regionkey = 0")
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed files that are switched on."""
    regions = table(spark, sf_dir, "region")
    rows = _nation(spark, sf_dir).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("surface"), F.col("r_name").alias("source"))
    first = [r["r_name"] for r in regions.filter("r_regionkey = 0").collect()]
    return etl.choose_sources(rows, ["ASIA", "EUROPE", *first])


def _authoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authoring table out of customers."""
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    return c.select(
        F.col("c_name").alias("surface"), F.col("c_mktsegment").alias("pos"), F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).alias("semantic_class"), F.lit("값").alias("read"),
        none.alias("type"), none.alias("start_pos"), none.alias("end_pos"), none.alias("expression"), (F.col("c_custkey") % 4 > 0).alias("is_available"), "c_custkey",
    )


@query("authoring_export", "SELECT c_mktsegment AS pos, c_name || ',0,0,0,' || c_mktsegment || ',' || CASE WHEN c_nationkey % 3 > 0 THEN 'C' || c_nationkey ELSE '*' END || ',T,값,*,*,*,*' AS line FROM customer WHERE c_custkey % 4 > 0")
def authoring_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.export_lines(_authoring(spark, sf_dir)).select("pos", "line")


@query("authoring_selection", "SELECT c_mktsegment AS pos, c_nationkey % 3 > 0 AS classed, count(*) AS n FROM customer WHERE c_custkey % 4 > 0 GROUP BY ALL")
def authoring_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available rows with and without a class."""
    return etl.available(_authoring(spark, sf_dir)).groupBy("pos", F.col("semantic_class").isNotNull().alias("classed")).agg(F.count("*").alias("n"))


@query("distinct_tags", "SELECT DISTINCT c_mktsegment AS pos, CASE WHEN c_nationkey % 3 > 0 THEN 'C' || c_nationkey END AS semantic_class FROM customer")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.tags(_authoring(spark, sf_dir))


@query("distinct_lines", "SELECT DISTINCT p_brand AS line FROM part ORDER BY 1")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.sorted_unique(table(spark, sf_dir, "part").select(F.col("p_brand").alias("line")))


@query("surface_rank", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS INTEGER) AS rank FROM customer")
def surface_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.ranked(_authoring(spark, sf_dir)).select("c_custkey", "rank")


@query("edited_lexicon", "SELECT c_custkey, c_mktsegment || CASE WHEN c_nationkey = 7 THEN '+' ELSE '' END AS pos FROM customer")
def edited_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen rows changed, all others as they were."""
    change = lambda d: d.withColumn("pos", F.concat("pos", F.lit("+")))
    return etl.edit(_authoring(spark, sf_dir), F.col("semantic_class") == "C7", change, True).select("c_custkey", "pos")


@query("retagged", "SELECT n_name AS surface, CASE WHEN n_nationkey = 3 THEN 8 ELSE n_nationkey END AS left_id, CASE WHEN n_nationkey = 3 THEN 'SF,x' ELSE 'SSC,x' END AS feature FROM nation")
def retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry takes a tag and another's context ids."""
    n = _nation(spark, sf_dir)
    names = {r["n_nationkey"]: r["n_name"] for r in n.filter("n_nationkey in (3, 8)").collect()}
    e = n.select(F.col("n_name").alias("surface"), F.col("n_nationkey").alias("left_id"), F.col("n_nationkey").alias("right_id"), F.lit("SSC,x").alias("feature"))
    return etl.retag_like(e, names[3], names[8], "SF").select("surface", "left_id", "feature")


@query("first_matching_override", "SELECT CAST(n_nationkey AS INTEGER) AS right_ctx, CAST(r_regionkey AS INTEGER) AS left_ctx, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE starts_with(n_name, 'I')) AND r_regionkey = (SELECT min(r_regionkey) FROM region WHERE contains(r_name, 'E')) THEN -7 ELSE 1 END AS cost FROM nation, region")
def first_matching_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection cost set for the first contexts whose features match."""
    left = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("feature"))
    right = _nation(spark, sf_dir).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("feature"))
    matrix = right.select(F.col("id").alias("right_ctx")).crossJoin(left.select(F.col("id").alias("left_ctx"))).withColumn("cost", F.lit(1))
    return etl.override_first(matrix, right, left, [(F.col("feature").startswith("I"), F.col("feature").contains("E"), -7)]).select("right_ctx", "left_ctx", "cost")


@query("patched_lines", "SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS line_no, line FROM (SELECT n_nationkey * 10 AS o, n_name AS line FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey * 10 + 5, lower(n_name) FROM nation WHERE n_regionkey = 3)")
def patched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken out and put in at their places; order stays."""
    n = _nation(spark, sf_dir)
    lines = n.select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("line"))
    hunks = n.filter("n_regionkey in (2, 3)").select(F.col("n_nationkey").alias("line_no"), (F.col("n_regionkey") == 2).alias("removed"), F.when(F.col("n_regionkey") == 3, F.array(F.lower("n_name"))).alias("added"))
    return etl.apply_hunks(lines, hunks)


# ---------------------------------------------------------------------------------------------------------------- statistics

_LETTERS = """t AS (SELECT p_partkey, i, substr(p_name, CAST(i AS INTEGER), 1) AS c FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
p AS (SELECT c AS "left", lead(c) OVER (PARTITION BY p_partkey ORDER BY i) AS "right" FROM t), n AS (SELECT "left", "right", count(*) AS n FROM p WHERE "right" IS NOT NULL GROUP BY ALL),
v AS (SELECT DISTINCT c FROM t)"""


@query("letter_pair_matrix", f"WITH {_LETTERS} SELECT a.c AS \"left\", b.c AS \"right\", CAST(trunc(-ln((coalesce(n, 0) + 0.5) / (coalesce(sum(n) OVER (PARTITION BY a.c), 0) + 0.5 * (SELECT count(*) FROM v))) * 200) AS INTEGER) AS cost FROM v a CROSS JOIN v b LEFT JOIN n ON n.\"left\" = a.c AND n.\"right\" = b.c")
def letter_pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of all pairs of letters, those that never occur included."""
    words = table(spark, sf_dir, "part").select(F.split("p_name", "").alias("w"))
    return etl.pair_matrix(etl.neighbours(words, "w"), words.select(F.explode("w").alias("w")))


@query("frequent_features", f"WITH {_FEATURES}, e AS (SELECT 'U0:' || a AS f FROM x UNION ALL SELECT 'U1:' || a || '/' || b FROM x WHERE b NOT IN ('*', '') UNION ALL SELECT 'U2:' || d || '-3' FROM x) SELECT f AS crf_feature, count(*) AS n FROM e GROUP BY f HAVING count(*) >= 3")
def frequent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that occur at least so often."""
    from lattica.operators import rewrite

    t = _features(spark, sf_dir).select("feature", F.col("feature").alias("ufeature"), F.lit(3).alias("char_type"), F.lit("").alias("surface"))
    return rewrite.frequent(rewrite.expand_templates(t, UNIGRAMS), 3)


@query("space_penalty_first", "SELECT 'x' AS feature, CAST(5 + 30 AS INTEGER) AS step_cost")
def space_penalty_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several penalties for one part of speech the first counts."""
    nodes = spark.createDataFrame([(1, 0, 0, 1, 0, 0, 1, 0, "a"), (1, 1, 2, 3, 0, 0, 2, 5, "x")], "k int, begin_ci int, start_ci int, end_ci int, left_id int, right_id int, pos_id int, word_cost int, feature string")
    matrix = spark.createDataFrame([(0, 0, 0)], "right_ctx int, left_ctx int, cost int")
    penalties = spark.createDataFrame([(0, 2, 30), (1, 2, 70), (2, 3, 9)], "ord int, pos_id int, penalty int")
    return R.edges(nodes, matrix, ["k"], penalties).select("feature", "step_cost")


@query("wakati_dictionary", "SELECT DISTINCT w AS surface, '' AS feature FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def wakati_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled dictionary without features."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("surface")).distinct().withColumn("feature", F.lit("NOUN,x"))
    return lexicon.compile_entries(w, wakati=True).select("surface", "feature")


@query("cost_from_rewritten", f"WITH {_FEATURES}, {_WEIGHTS} SELECT feature, CAST(trunc(least(greatest(-800 * sum(alpha), -32767), 32767)) AS INTEGER) AS word_cost FROM x JOIN g ON f IN ('U0:' || a, 'U1:' || a || '/' || b) WHERE length(feature) % 2 = 0 GROUP BY feature UNION ALL SELECT feature, 77 FROM x WHERE length(feature) % 2 = 1")
def cost_from_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only empty costs of user entries are computed."""
    entries = _features(spark, sf_dir).withColumn("word_cost", F.when(F.length("feature") % 2 == 1, 77))
    return lexicon.model_costs(entries, RULES, UNIGRAMS[:2], _weights(spark, sf_dir, UNIGRAMS[:2]), 800).select("feature", "word_cost")


@query("split_long_lines", "SELECT p_partkey, CAST(k AS INTEGER) AS part, length(t) > 10 AS was_split, substr(t, CAST(k * 10 + 1 AS BIGINT), 10) AS sentence FROM (SELECT p_partkey, t, unnest(range(greatest(1, CAST(ceil(length(t) / 10.0) AS BIGINT)))) AS k FROM (SELECT p_partkey, p_name || p_type AS t FROM part))")
def split_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines longer than the buffer come in parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_type").alias("sentence"))
    return readers.split_long(p, 10).select("p_partkey", "part", "was_split", "sentence")


_KEYS = "translate(lower({w}), 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999')"


@query("keypad_conversion", f"WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), d AS (SELECT w, {_KEYS.format(w='w')} AS k, row_number() OVER (ORDER BY w) AS r FROM w), b AS (SELECT k, arg_min(w, r) AS w FROM d GROUP BY k), t AS (SELECT p_partkey, unnest(range(len(s))) AS i, unnest(s) AS x FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)) SELECT p_partkey, string_agg(b.w || ' ', '' ORDER BY i) AS text FROM t JOIN b ON b.k = {_KEYS.format(w='x')} GROUP BY p_partkey")
def keypad_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text conversion by a dictionary: digits of a telephone keypad become words again."""
    from lattica.plans.model import Model
    from lattica.plans.shapes import SIMPLE_CHARS, SIMPLE_UNKNOWN

    digits = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999")
    p = table(spark, sf_dir, "part")
    w = p.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select("w", digits(F.col("w")).alias("k")).orderBy("w").collect()  # a dictionary
    conf = EngineConf(node_format="%H\\s", eos_format="")
    m = Model.build([(r["k"], 0, 0, rank - 1000 * len(r["k"]) ** 2, r["w"]) for rank, r in enumerate(w)], conf, SIMPLE_CHARS, SIMPLE_UNKNOWN)
    t = decode.tokens_column(p.select("p_partkey", digits(F.col("p_name")).alias("sentence")), m)
    return t.select("p_partkey", fmt.user_format(conf)(F.col("tokens"), F.col("sentence")).alias("text"))


@query("observed_counts", "SELECT 'NOUN,' || length(w) AS feature, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of gold features, as training observes them in its lattices."""
    from lattica.operators import train

    m = part_model(spark, sf_dir, pieces=True)
    found = train.observed(_part_names(spark, sf_dir), m, {}, ["%F[0],%F[1]"], [])
    return spark.createDataFrame([(k, int(v)) for k, v in found.items() if v and k.startswith("NOUN")], "feature string, n long")
