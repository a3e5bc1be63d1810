"""Dictionary folders and whole workflows: index, train, generate, evaluate.

A source folder holds char.def, unk.def, matrix.def, *.csv, and as it may be dicrc, rewrite.def, pos-id.def, feature.def, left-id.def and
right-id.def. Files are read by Spark, so any store will do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import evaluate, lexicon, train
from lattica.operators.rewrite import Rule, pos_of, rewrite_one
from lattica.plans.model import MINIMAL_CHARS, MINIMAL_MATRIX, MINIMAL_UNKNOWN, EngineConf, Model
from lattica.sources import readers


def _text(spark: SparkSession, path: str, default: str | None = None) -> str:
    """A definition file; the default where there is none."""
    try:
        return spark.read.text(path, wholetext=True).first()["value"]
    except AnalysisException:
        if default is None:
            raise
        return default


def _rows(spark: SparkSession, text: str) -> DataFrame:
    return readers.split_lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")


def rewrite_rules(spark: SparkSession, folder: str) -> dict[str, list[Rule]]:
    rules: dict[str, list[Rule]] = {}
    for r in readers.rewrite_rules(_rows(spark, _text(spark, f"{folder}/rewrite.def", ""))).orderBy("ord").collect():  # a definition file
        rules.setdefault(r["section"], []).append((r["pattern"], r["target"]))
    return rules


def feature_templates(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    rows = readers.templates(_rows(spark, _text(spark, f"{folder}/feature.def"))).orderBy("ord").collect()
    return [r["template"] for r in rows if r["kind"] == "UNIGRAM"], [r["template"] for r in rows if r["kind"] == "BIGRAM"]


def pos_rules(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    return [(r["pattern"], r["pos_id"]) for r in readers.pos_rules(_rows(spark, _text(spark, f"{folder}/pos-id.def", ""))).orderBy("ord").collect()]


def source_entries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The entries of CSV files in the order given; entry_ord runs on from file to file."""
    out = None
    for k, path in enumerate(paths):
        one = readers.lexicon(readers.lines(spark, path)).withColumn("entry_ord", F.col("entry_ord") + F.lit(k << 32))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "entry_ord long, surface string, left_id int, right_id int, word_cost int, feature string")


def index(spark: SparkSession, folder: str, user: Sequence[str] = (), weights: DataFrame | None = None) -> Model:
    """A Model of a dictionary folder; user: CSV files of user dictionaries, looked up after it.

    Empty costs are computed from weights (alpha, feature), empty context ids from rewrite.def and the id lists."""
    conf = EngineConf.from_map(readers.parse_config(_text(spark, f"{folder}/dicrc", "")))
    chars, unknown = _text(spark, f"{folder}/char.def", MINIMAL_CHARS), _text(spark, f"{folder}/unk.def", MINIMAL_UNKNOWN)
    entries = source_entries(spark, readers.csv_files(spark, folder)).withColumn("dict_id", F.lit(0))
    for k, path in enumerate(user, 1):
        entries = entries.unionByName(source_entries(spark, [path]).withColumn("dict_id", F.lit(k)))
    if weights is not None:
        entries = lexicon.model_costs(entries, rewrite_rules(spark, folder), feature_templates(spark, folder)[0], weights, conf.cost_factor)
    if entries.filter("left_id is null or right_id is null or left_id < 0 or right_id < 0").limit(1).count():
        ids = [readers.id_list(_rows(spark, _text(spark, f"{folder}/{side}-id.def"))) for side in ("left", "right")]
        entries = lexicon.auto_ids(entries, rewrite_rules(spark, folder), *ids)
    return lexicon.load_model(entries, conf, chars, unknown, _text(spark, f"{folder}/matrix.def", MINIMAL_MATRIX), pos_rules(spark, folder))


def cost_train(spark: SparkSession, folder: str, corpus_path: str, c: float = 1.0, freq: int = 1, old: dict[str, float] | None = None, steps: int = 100) -> dict[str, float]:
    """Weights by feature from a seed folder and an annotated corpus."""
    tokens = readers.corpus(readers.lines(spark, corpus_path))
    model = index(spark, folder)
    known = spark.createDataFrame([(s.decode(), model.features[k]) for i, s in enumerate(model.surfaces) for k in range(model.first[i], model.first[i + 1])] or [("", "")], "surface string, feature string")
    extra = train.missing_entries(tokens, known).collect()  # entries of the training dictionary
    model = model.with_user_entries([(r["surface"], 0, 0, 0, r["feature"]) for r in extra]) if extra else model
    return train.train(train.corpus_sentences(tokens, ["file", "sent_id"]), model, rewrite_rules(spark, folder), *feature_templates(spark, folder), c=c, freq=freq, steps=steps, old=old)


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, v in sorted(weights.items())], "alpha double, feature string")


def generate(spark: SparkSession, folder: str, weights: dict[str, float]) -> Model:
    """The folder's dictionary with costs, context ids and matrix from weights."""
    return train.generate(index(spark, folder), weights, rewrite_rules(spark, folder), *feature_templates(spark, folder))


def write_sources(spark: SparkSession, model: Model, rules: dict[str, list[Rule]], out: str) -> None:
    """A model as dictionary sources: entries, unknown, matrix, left-id and right-id, each a folder of text files."""
    put = lambda name, rows: spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(f"{out}/{name}")
    from lattica.plans.model import csv_quote

    line = lambda surface, k: f"{csv_quote(surface)},{model.left[k]},{model.right[k]},{model.cost[k]},{model.features[k]}"
    put("entries.csv", [line(s.decode(), k) for i, s in enumerate(model.surfaces) for k in range(model.first[i], model.first[i + 1])])
    put("unk.def", [line(name, k) for c, name in enumerate(model.class_names) for k in range(model.unknown[c], model.unknown[c + 1])])
    rows, cols = model.matrix.shape
    put("matrix.def", [f"{rows} {cols}", *(f"{r} {c} {model.matrix[r, c]}" for r in range(rows) for c in range(cols))])
    for section, ids in (("left", model.left), ("right", model.right)):
        name = lambda f, s=section: (rewrite_one(rules[s], f) if rules.get(s) else f) or ""
        seen = {0: name(model.conf.bos_feature)}
        for k, f in zip(ids.tolist(), model.features, strict=True):
            seen.setdefault(k, name(f))
        put(f"{section}-id.def", [f"{k} {v}" for k, v in sorted(seen.items())])


def read_binary_matrix(raw: bytes) -> np.ndarray:
    """A compiled matrix: two 16-bit sizes, then 16-bit costs, the right token's context running slowest."""
    left, right = np.frombuffer(raw[:4], "<u2").astype(int)
    return np.frombuffer(raw[4:], "<i2")[: left * right].reshape(right, left).T.astype(np.int64)


def binary_matrix(matrix: np.ndarray) -> bytes:
    """The compiled form of a matrix [right context, left context]."""
    return np.array(matrix.shape, "<u2").tobytes() + np.ascontiguousarray(matrix.T).astype("<i2").tobytes()


def system_eval(system: DataFrame, gold: DataFrame, levels: Sequence[int] = (0, -1)) -> DataFrame:
    """Report lines for two corpora (file lines parted by EOS)."""
    one = lambda d: readers.corpus(d.withColumn("file", F.lit("f")))
    return evaluate.report(evaluate.evaluate(one(system), one(gold), ["sent_id"], levels))


def test_sentences(lines: DataFrame) -> DataFrame:
    """The raw sentences of a corpus."""
    return evaluate.raw_sentences(readers.corpus(lines), ["file", "sent_id"])


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Entries, classes, character map, matrix and settings as Parquet tables."""
    entries = [(i, s, int(model.left[k]), int(model.right[k]), int(model.pos[k]), int(model.cost[k]), int(model.dict_id[k]), model.features[k]) for i, s in enumerate(model.surfaces) for k in range(model.first[i], model.first[i + 1])]
    unknown = [(c, b"", int(model.left[k]), int(model.right[k]), int(model.pos[k]), int(model.cost[k]), -1, model.features[k]) for c in range(len(model.class_names)) for k in range(model.unknown[c], model.unknown[c + 1])]
    rows = [(n, *e) for n, e in enumerate(entries + unknown)]
    spark.createDataFrame(rows, "n long, owner long, surface binary, left_id int, right_id int, pos_id int, word_cost int, dict_id int, feature string").write.parquet(f"{path}/entries")
    classes = [(i, n, bool(a), bool(b), int(c)) for i, (n, a, b, c) in enumerate(zip(model.class_names, model.invoke, model.group, model.length, strict=True))]
    spark.createDataFrame(classes, "class_id int, class_name string, invoke boolean, grp boolean, length int").write.parquet(f"{path}/classes")
    points = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(model.char_class, model.char_mask, strict=True))]
    spark.createDataFrame(points, "code_point int, class_id int, type_mask int").write.parquet(f"{path}/characters")
    cells = [(int(r), int(c), int(model.matrix[r, c])) for r in range(model.matrix.shape[0]) for c in range(model.matrix.shape[1])]
    spark.createDataFrame(cells, "right_ctx int, left_ctx int, cost int").write.parquet(f"{path}/matrix")
    conf = {k: str(v) for k, v in asdict(model.conf).items() if k != "extra" and v is not None} | model.conf.extra
    spark.createDataFrame(list(conf.items()), "key string, value string").write.parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> Model:
    """The model that save_model wrote."""
    read = lambda name, *order: spark.read.parquet(f"{path}/{name}").orderBy(*order).toArrow()  # noqa: E731  a dictionary that every executor will hold
    e, c, p, m = read("entries", "n"), read("classes", "class_id"), read("characters", "code_point"), read("matrix", "right_ctx", "left_ctx")
    conf = EngineConf.from_map({r["key"].replace("_", "-") if hasattr(EngineConf(), r["key"]) else r["key"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()})
    col = lambda t, n: t.column(n).to_numpy()
    dict_id, owner = col(e, "dict_id").astype(np.int64), col(e, "owner")
    known = int((dict_id >= 0).sum())
    surfaces, first = [], []
    for k, s in enumerate(e.column("surface").to_pylist()[:known]):
        if not surfaces or surfaces[-1] != s:
            surfaces.append(s)
            first.append(k)
    names = c.column("class_name").to_pylist()
    matrix = np.zeros((int(col(m, "right_ctx").max()) + 1, int(col(m, "left_ctx").max()) + 1), np.int64)
    matrix[col(m, "right_ctx"), col(m, "left_ctx")] = col(m, "cost")
    long = lambda n: col(e, n).astype(np.int64)
    unknown = known + np.searchsorted(owner[known:], np.arange(len(names) + 1))
    return Model(
        conf, names, np.array(c.column("invoke").to_pylist()), np.array(c.column("grp").to_pylist()), col(c, "length"), col(p, "class_id").astype(np.int16), col(p, "type_mask").astype(np.int32),
        surfaces, np.array([*first, known], np.int64), long("left_id"), long("right_id"), long("pos_id"), long("word_cost"), dict_id, e.column("feature").to_pylist(), unknown, matrix,
    )


def pos_lookup(spark: SparkSession, folder: str):
    return pos_of(pos_rules(spark, folder))
