"""Small models and character definitions that the registered queries share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.columns import keyword_cost
from lattica.plans.model import EngineConf, Model
from lattica.plans.shared import table
from lattica.sources.readers import sentences

CHARS = """DEFAULT 0 1 0
SPACE 0 1 0
ALPHA 1 1 0
NUMERIC 1 1 0
LATIN 1 1 2
SYMBOL 1 1 0
0x0020 SPACE
0x0009..0x000D SPACE
0x0030..0x0039 NUMERIC
0x0041..0x005A ALPHA
0x0061..0x007A ALPHA
0x00C0..0x017F LATIN ALPHA
0x0021..0x002F SYMBOL
0x003A..0x0040 SYMBOL
0x005B..0x0060 SYMBOL
0x007B..0x007E SYMBOL
"""
#: Class and mask of a code point u, as CHARS gives them.
CLASS_SQL = (
    "CASE WHEN {u} = 32 OR {u} BETWEEN 9 AND 13 THEN 1 WHEN {u} BETWEEN 48 AND 57 THEN 3 WHEN {u} BETWEEN 65 AND 90 OR {u} BETWEEN 97 AND 122 THEN 2 "
    "WHEN {u} BETWEEN 192 AND 383 THEN 4 WHEN {u} BETWEEN 33 AND 47 OR {u} BETWEEN 58 AND 64 OR {u} BETWEEN 91 AND 96 OR {u} BETWEEN 123 AND 126 THEN 5 ELSE 0 END"
)
MASK_SQL = "CASE {c} WHEN 4 THEN 20 ELSE (1 << {c}) END"
UNKNOWN = "DEFAULT,0,0,3000,UNK\nSPACE,0,0,3000,UNK\nALPHA,0,0,3000,UNK\nNUMERIC,0,0,2500,NUM\nLATIN,0,0,3100,UNK\nSYMBOL,0,0,1000,SYM\n"
#: One character at a time where no entry matches.
SIMPLE_CHARS = "DEFAULT 1 0 0\nSPACE 0 1 0\n0x0020 SPACE\n"
SIMPLE_UNKNOWN = "DEFAULT,0,0,3000,UNK\nSPACE,0,0,3000,UNK\n"
PENALTY = 1500
#: Connection costs by the right context of the left token and the left context of the right one: 0 unknown words and ends, 1 words, 2 pieces.
MATRIX = ((-300, 700, -150), (250, -900, 1300), (-40, 2100, -700))


def lines_sql(name: str, key: str, column: str) -> str:
    """CTE body: key, sent_id, sentence."""
    return f"SELECT {key}, CAST(unnest(range(len(l))) AS INTEGER) AS sent_id, unnest(l) AS sentence FROM (SELECT {key}, string_split({column}, chr(10)) AS l FROM {name})"


def lines_of(spark: SparkSession, sf_dir: str, name: str, key: str, column: str = "text") -> DataFrame:
    return sentences(table(spark, sf_dir, name), column, key)


def words(df: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    """keys, i, w: blank-separated words."""
    return df.select(*keys, F.posexplode(F.split(text, " ")).alias("i", "w")).filter("w <> ''")


def piece_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surface, word_cost, piece: words of the benchmark texts and their first two and three letters, priced by length."""
    w = words(lines_of(spark, sf_dir, "benchmark", "item_id"), []).select("w").distinct()
    every = w.select(F.explode(F.array(F.struct(F.col("w").alias("surface"), F.lit(0).alias("piece")), F.struct(F.left("w", F.lit(2)).alias("surface"), F.lit(1).alias("piece")), F.struct(F.left("w", F.lit(3)).alias("surface"), F.lit(1).alias("piece")))).alias("e"))
    return every.groupBy("e.surface").agg(F.min("e.piece").alias("piece")).select("surface", keyword_cost(F.col("surface")).alias("word_cost"), "piece")


PIECE_SQL = f"""l AS MATERIALIZED ({lines_sql("benchmark", "item_id", "text")}),
w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(sentence, ' ')) AS w FROM l) WHERE w <> ''),
lex AS MATERIALIZED (SELECT surface, CAST(greatest(-32767, trunc(-400 * pow(strlen(surface), 1.5))) AS INTEGER) AS word_cost, min(piece) AS piece
  FROM (SELECT w AS surface, 0 AS piece FROM w UNION ALL SELECT left(w, 2), 1 FROM w UNION ALL SELECT left(w, 3), 1 FROM w) GROUP BY surface)"""


def class_model() -> Model:
    """The classes of CHARS without a dictionary."""
    return Model.build([], None, CHARS, UNKNOWN)


def piece_model(spark: SparkSession, sf_dir: str, penalty: bool = False, contexts: bool = False, classes: bool = False) -> Model:
    rows = piece_lexicon(spark, sf_dir).orderBy("surface").collect()  # the dictionary of the benchmark words, which every executor holds
    conf = EngineConf(left_space_penalty_factor=f"2,{PENALTY}" if penalty else "")
    matrix = np.array(MATRIX) if contexts else np.zeros((1, 1), np.int64)
    ctx = lambda r: 1 + r["piece"] if contexts else 0
    return Model.build([(r["surface"], ctx(r), ctx(r), r["word_cost"], "WORD" if r["piece"] == 0 else "PIECE", 0, 1 + r["piece"]) for r in rows], conf, *((CHARS, UNKNOWN) if classes else (SIMPLE_CHARS, SIMPLE_UNKNOWN)), matrix)


def part_model(spark: SparkSession, sf_dir: str, pieces: bool = False, conf: EngineConf | None = None) -> Model:
    """The words of part names (feature: NOUN and their length), on demand with their two-letter beginnings and endings."""
    w = [r["w"] for r in words(table(spark, sf_dir, "part"), [], "p_name").select("w").distinct().orderBy("w").collect()]  # a dictionary
    entries = [(x, 0, 0, -100 * len(x), f"NOUN,{len(x)}") for x in w]
    if pieces:
        entries += [(x, 0, 0, 50, "PIECE,2") for x in sorted({y for z in w for y in (z[:2], z[-2:])} - set(w))]
    return Model.build(entries, conf, SIMPLE_CHARS, SIMPLE_UNKNOWN.replace("3000", "200"))
