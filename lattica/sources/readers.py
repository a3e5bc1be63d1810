"""Text sources as DataFrames.

Readers work on a DataFrame of lines (file, line_no, line), so the same parsing serves files, tables and tests. Order
within a file is kept by line_no, which ``lines`` takes from whole files; large sentence inputs use ``sentences`` instead, which
splits freely.
"""

from __future__ import annotations

import lzma
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import columns as C


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, line_no, line of small definition files, whole files at a time."""
    text = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return split_lines(text, "file", "value")


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of a text column; a final newline ends the last line."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n$", "")
    return df.select(F.col(key), F.posexplode(F.split(clean, "\n", -1)).alias("line_no", "line"))


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """The folder's CSV files in name order, whatever the case of the extension."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,CSV,Csv}").load(folder).select("path")
    return [r["path"] for r in found.orderBy("path").collect()]  # file names of one dictionary


def sentences(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, sent_id, sentence: the lines of a text column."""
    return df.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("sent_id", "sentence"))


def split_long(df: DataFrame, limit: int, text: str = "sentence") -> DataFrame:
    """df with lines of more than limit bytes cut into rows of at most limit, between characters, in order; adds part (from 0) and was_split, the warning."""
    kept = [f for f in df.schema if f.name != text]

    def cut(raw: bytes) -> list[str]:
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + limit)
            while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:  # a character longer than the limit stays whole
                end += 1
            out.append(raw[at:end].decode())
            at = end
        return out or [""]

    def run(batches):
        for batch in batches:
            parts = [[x] if x is None or len(x) * 4 <= limit else cut(x.encode()) for x in batch.column(text).to_pylist()]
            take = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            columns = [batch.column(f.name).take(take) for f in kept] + [pa.array([x for p in parts for x in p], pa.string())]
            columns += [pa.array([k for p in parts for k in range(len(p))], pa.int32()), pa.array([len(p) > 1 for p in parts for _ in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), text, "part", "was_split"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{text}` string", "part int", "was_split boolean"])
    return df.mapInArrow(run, schema)


def partial_blocks(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, sent_id, frag_idx, surface, pattern: blocks that end at EOS or an empty line."""
    rows = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line"))
    ends = (F.col("line") == "EOS") | (F.col("line") == "")
    w = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("sent_id", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - ends.cast("int")).filter(~ends)
    cells = F.split("line", "\t", 2)
    return rows.select(
        key, F.col("sent_id").cast("int"), (F.row_number().over(Window.partitionBy(key, "sent_id").orderBy("i")) - 1).alias("frag_idx"), F.get(cells, F.lit(0)).alias("surface"), F.get(cells, F.lit(1)).alias("pattern")
    )


def lexicon(lines_df: DataFrame) -> DataFrame:
    """entry_ord, surface, left_id, right_id, word_cost, feature: five CSV columns, the fifth as it stands. Empty surfaces go."""
    head, rest = C.csv_head(F.col("line"), 4)
    out = lines_df.select("line_no", *[c.alias(n) for c, n in zip(head, ("surface", "l", "r", "c"), strict=True)], rest.alias("feature"))
    return out.filter("surface <> ''").select(
        F.col("line_no").alias("entry_ord"), "surface", C.number_prefix(F.col("l")).alias("left_id"), C.number_prefix(F.col("r")).alias("right_id"), C.number_prefix(F.col("c")).alias("word_cost"), "feature"
    )


def matrix(lines_df: DataFrame) -> DataFrame:
    """right_ctx, left_ctx, cost of every cell; missing cells are 0, of repeated ones the last counts."""
    cells = F.split(F.trim("line"), r"\s+")
    rows = lines_df.filter(F.trim("line") != "").select("line_no", *[F.get(cells, F.lit(i)).cast("int").alias(c) for i, c in enumerate(("a", "b", "c"))])
    size = rows.filter("line_no = 0").select(F.col("a").alias("rows"), F.col("b").alias("cols"))
    grid = size.select("cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("right_ctx")).select("right_ctx", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("left_ctx"))
    given = rows.filter("line_no > 0").groupBy(F.col("a").alias("right_ctx"), F.col("b").alias("left_ctx")).agg(F.max_by("c", "line_no").alias("cost"))
    return grid.join(given, ["right_ctx", "left_ctx"], "left").select("right_ctx", "left_ctx", F.coalesce("cost", F.lit(0)).alias("cost"))


def char_classes(lines_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, class_name, invoke, grp, length) and (ord, low, high, classes) of a character definition."""
    clean = lines_df.select("line_no", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).filter("line <> ''")
    cells = F.split("line", r"\s+")
    first = F.get(cells, F.lit(0))
    names = clean.filter(~F.col("line").startswith("0x"))
    w = Window.orderBy("line_no")  # a handful of classes
    classes = names.select(
        (F.row_number().over(w) - 1).alias("class_id"), first.alias("class_name"), (F.get(cells, F.lit(1)) == "1").alias("invoke"), (F.get(cells, F.lit(2)) == "1").alias("grp"), F.get(cells, F.lit(3)).cast("int").alias("length")
    )
    bounds = F.split(first, r"\.\.")
    ranges = clean.filter(F.col("line").startswith("0x")).select(
        F.col("line_no").alias("ord"), C.hex_number(F.get(bounds, F.lit(0))).alias("low"), C.hex_number(F.element_at(bounds, -1)).alias("high"), F.slice(cells, F.lit(2), F.size(cells)).alias("classes")
    )
    return classes, ranges


def char_map(classes: DataFrame, ranges: DataFrame) -> DataFrame:
    """code_point, class_id, type_mask of the mapped code points; later ranges win, the first class is the default type."""
    points = ranges.select("ord", "classes", F.explode(F.sequence("low", "high")).alias("code_point")).filter("code_point < 65535")
    last = points.groupBy("code_point").agg(F.max_by("classes", "ord").alias("classes"))
    each = last.select("code_point", F.posexplode("classes").alias("i", "class_name")).join(F.broadcast(classes), "class_name")  # under 18 classes
    return each.groupBy("code_point").agg(F.min_by("class_id", "i").alias("class_id"), F.bit_or(F.expr("shiftleft(1, class_id)")).alias("type_mask"))


def unknown_entries(lines_df: DataFrame, classes: DataFrame) -> DataFrame:
    """class_name, class_id, entry_ord and the lexicon columns."""
    rows = lexicon(lines_df).withColumnRenamed("surface", "class_name")
    return rows.join(F.broadcast(classes.select("class_name", "class_id")), "class_name")


def uncovered_classes(classes: DataFrame, unknown: DataFrame) -> DataFrame:
    """Classes without unknown-word entries; must be empty."""
    return classes.join(unknown, "class_name", "left_anti").select("class_name")


def rewrite_rules(lines_df: DataFrame) -> DataFrame:
    """section, ord, pattern, target of a rewrite definition."""
    clean = lines_df.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    head = F.when(F.col("line").startswith("["), F.regexp_extract("line", r"^\[(\w+) rewrite\]", 1))
    w = Window.orderBy("line_no")  # a definition file
    marked = clean.withColumn("section", F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("line").startswith("["))
    cells = C.split_runs(F.col("line"), " \t")
    return marked.select("section", F.col("line_no").alias("ord"), F.get(cells, F.lit(0)).alias("pattern"), F.get(cells, F.lit(1)).alias("target"))


def id_list(lines_df: DataFrame) -> DataFrame:
    """id, feature of a context id file."""
    cells = F.split(F.trim("line"), r"\s+", 2)
    return lines_df.filter(F.trim("line") != "").select(F.get(cells, F.lit(0)).cast("int").alias("id"), F.get(cells, F.lit(1)).alias("feature"))


def pos_rules(lines_df: DataFrame) -> DataFrame:
    """ord, pattern, pos_id; without any rule everything is 1."""
    clean = lines_df.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    cells = C.split_runs(F.col("line"), " \t")
    return clean.select(F.col("line_no").alias("ord"), F.get(cells, F.lit(0)).alias("pattern"), F.get(cells, F.lit(1)).cast("int").alias("pos_id"))


def templates(lines_df: DataFrame) -> DataFrame:
    """kind (UNIGRAM or BIGRAM), ord, template."""
    clean = lines_df.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    cells = C.split_runs(F.col("line"), " \t")
    return clean.select(F.get(cells, F.lit(0)).alias("kind"), F.col("line_no").alias("ord"), F.get(cells, F.lit(1)).alias("template"))


def crf_model(lines_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value) of the header and (alpha, feature) of a text model; an empty line parts them."""
    edge = lines_df.filter("line = ''").agg(F.min("line_no").alias("edge"))
    rows = lines_df.crossJoin(F.broadcast(edge))  # one row
    head = F.split("line", r":\s*", 2)
    body = F.split("line", "\t", 2)
    return (
        rows.filter("line_no < edge").select(F.get(head, F.lit(0)).alias("key"), F.get(head, F.lit(1)).alias("value")),
        rows.filter("line_no > edge and line <> ''").select(F.get(body, F.lit(0)).cast("double").alias("alpha"), F.get(body, F.lit(1)).alias("feature")),
    )


def corpus(df: DataFrame, key: str = "file") -> DataFrame:
    """sent_id, tok_idx, surface, feature of token lines parted by EOS; df has key, line_no, line."""
    w = Window.partitionBy(key).orderBy("line_no")
    ends = F.col("line") == "EOS"
    rows = df.withColumn("sent_id", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - ends.cast("int")).filter(~ends & (F.col("line") != ""))
    cells = F.split("line", "\t", 2)
    return rows.select(
        key, F.col("sent_id").cast("int"), (F.row_number().over(Window.partitionBy(key, "sent_id").orderBy("line_no")) - 1).alias("tok_idx"), F.get(cells, F.lit(0)).alias("surface"), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("feature")
    )


def result_offsets(tokens: DataFrame, key: Sequence[str] = ("file", "sent_id")) -> DataFrame:
    """A parse result as nodes: byte offset and length of every token of a concatenated sentence."""
    w = Window.partitionBy(*key).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("surface")
    return tokens.withColumn("length", size).withColumn("begin_pos", (F.sum(size).over(w) - size).cast("int"))


def parse_config(text: str) -> dict[str, str]:
    """key = value lines; ; and # begin comments; the first value of a key counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in ";#" and "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            out.setdefault(k, v)
    return out


def xz_lines(path: str) -> list[str]:
    """Lines of an xz-compressed source, which Spark has no codec for."""
    with lzma.open(path, "rt", encoding="utf-8") as f:
        return f.read().splitlines()


def xz_csv(df: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """file, line_no, line of xz files that binaryFile has read."""

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("file").to_pylist(), batch.column("body"), strict=True):
                rows = lzma.decompress(body.as_py()).decode("utf-8").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.string())], names=["file", "line_no", "line"])

    return df.select(F.col(key).alias("file"), F.col(content).alias("body")).mapInArrow(run, "file string, line_no int, line string")


def s_expressions(text: str) -> list:
    """Nested lists of a dictionary of S-expressions."""
    stack, token, quoted, escape = [[]], "", False, False

    def flush():
        nonlocal token
        if token:
            stack[-1].append(token)
            token = ""

    for ch in text:
        if escape:
            token, escape = token + ch, False
        elif ch == "\\":
            escape = True
        elif quoted:
            if ch == '"':
                quoted = False
                stack[-1].append(token)
                token = ""
            else:
                token += ch
        elif ch == '"':
            flush()
            quoted = True
        elif ch == "(":
            flush()
            stack.append([])
        elif ch == ")":
            flush()
            done = stack.pop()
            stack[-1].append(done)
        elif ch.isspace():
            flush()
        else:
            token += ch
    flush()
    return stack[0]


def s_expression_entries(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """df without its text column, a row for each top-level list of the text, with the fields' values: name -> a path of list heads,
    whose innermost list's second item (or that item's first) is the value; null where there is none."""
    kept = [f for f in df.schema if f.name != text]

    def at(item, path: list[str]):
        for head in path:
            lists = [x for x in item if isinstance(x, list) and x]
            inner = [y for x in lists for y in (x if isinstance(x[0], list) else [x]) if isinstance(y, list)]
            item = next((x for x in inner if x and x[0] == head), None)
            if item is None:
                return None
        value = item[1] if len(item) > 1 else None
        return value[0] if isinstance(value, list) and value else value

    def run(batches):
        for batch in batches:
            rows, values = [], []
            for i, body in enumerate(batch.column(text).to_pylist()):
                for entry in s_expressions(body or ""):
                    if isinstance(entry, list) and entry:
                        rows.append(i)
                        values.append([at([entry] if path[0] == entry[0] else [], path) for path in (p.split("/") for p in fields.values())])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(f.name).take(take) for f in kept] + [pa.array([v[k] for v in values], pa.string()) for k in range(len(fields))], names=[f.name for f in kept] + list(fields))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` string" for n in fields])
    return df.mapInArrow(run, schema)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A lexicon table of a database; partition options pass through."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def phrases(pages: DataFrame, pattern: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """Phrases of pages: every first group of the pattern."""
    return pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 1)).alias("i", "phrase"))


def transcoded(df: DataFrame, column: str, charset: str) -> DataFrame:
    """Binary text of an older charset as UTF-8; rows that don't decode go."""

    def run(batches):
        for batch in batches:
            out, keep = [], []
            for x in batch.column(column):
                try:
                    out.append(None if x.as_py() is None else x.as_py().decode(charset))
                    keep.append(True)
                except UnicodeDecodeError:
                    out.append(None)
                    keep.append(False)
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array(out, pa.string())).filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {'string' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first condition that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)
