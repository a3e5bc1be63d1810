"""The workflows with options as command lines have them: each takes (spark, list of options) and gives a DataFrame, a model or weights.

Letters and names of options are an interface that users know; everything behind them is this package's own."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import decode, lexicon
from lattica.operators import format as fmt
from lattica.plans import build
from lattica.plans.model import Model
from lattica.sources import readers

#: Options that set a field of the settings.
SETTINGS = {"F": ("node-format", str), "U": ("unk-format", str), "B": ("bos-format", str), "E": ("eos-format", str), "S": ("eon-format", str), "x": ("unk-feature", str), "M": ("max-grouping-size", int), "t": ("theta", float), "c": ("cost-factor", int)}


def _parser(name: str, *flags: tuple) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=name, exit_on_error=False)
    for short, long, *rest in flags:
        kind = rest[0] if rest else None
        if kind is None:
            p.add_argument(f"-{short}", f"--{long}", action="store_true")
        else:
            p.add_argument(f"-{short}", f"--{long}", type=kind, default=rest[1] if len(rest) > 1 else None)
    return p


def _settings(model: Model, given: argparse.Namespace) -> Model:
    own = {long.replace("-", "_"): getattr(given, long.replace("-", "_")) for long, _ in SETTINGS.values()}
    return replace(model, conf=replace(model.conf, **{k: v for k, v in own.items() if v is not None}))


def tag(spark: SparkSession, options: Sequence[str], lines: DataFrame, text: str = "sentence") -> DataFrame:
    """lines with the column ``parsed``: analysis of each line. -D gives the dictionaries' sizes and -P the settings instead.

    -b SIZE splits lines of more bytes (see readers.split_long); -p reads blocks of fragments; -a, -N, -m, -l choose what is shown."""
    p = _parser(
        "tag", ("d", "dicdir", str, "."), ("u", "userdic", str), ("l", "lattice-level", int, 0), ("D", "dictionary-info"), ("P", "dump-config"), ("O", "output-format-type", str), ("a", "all-morphs"),
        ("N", "nbest", int, 1), ("p", "partial"), ("m", "marginal"), ("b", "input-buffer-size", int), ("C", "allocate-sentence"), *((k, *v) for k, v in SETTINGS.items()),
    )
    o = p.parse_args(list(options))
    model = _settings(build.index(spark, o.dicdir, o.userdic.split(",") if o.userdic else ()), o)
    if o.dictionary_info:
        return spark.createDataFrame(model.dictionary_info(), "dict_id int, type int, size long, lsize int, rsize int, charset string, version int")
    if o.dump_config:
        return spark.createDataFrame([(x,) for x in model.conf.lines()], "line string")
    if o.input_buffer_size:
        lines = readers.split_long(lines, o.input_buffer_size, text)
    if o.partial:
        found = decode.tokenize_partial(lines, model, text)
        keys = [c for c in lines.columns if c != text]
        token = F.concat("surface", F.lit("\t"), "feature", F.lit("\n"))
        return found.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", token.alias("t")))), lambda x: x["t"]), ""), F.lit("EOS\n")).alias("parsed"))  # one block each
    kind = o.output_format_type
    if o.nbest > 1:
        return fmt.nbest_text(decode.nbest(lines, model, o.nbest, text), [c for c in lines.columns if c != text], "").withColumnRenamed("text", "parsed")
    if o.all_morphs or o.marginal or o.lattice_level > 0:
        keys = [c for c in lines.columns if c != text]
        nodes, paths = decode.all_nodes(lines, model, text, theta=model.conf.theta), decode.lattice_paths(lines, model, text, theta=model.conf.theta)
        return fmt.dump(nodes if o.all_morphs else nodes.filter("isbest"), paths, keys).withColumnRenamed("text", "parsed")
    t = decode.tokens_column(lines, model, text, "__tokens")
    written = {"wakati": fmt.wakati, "none": fmt.nothing}.get(kind)
    shown = written(F.col("__tokens")) if written else fmt.user_format(model.conf, kind)(F.col("__tokens"), F.col(text))
    return t.withColumn("parsed", shown).drop("__tokens", "path_cost")


def index(spark: SparkSession, options: Sequence[str], files: Sequence[str] = ()) -> Model | DataFrame:
    """Compile a dictionary folder; with -o the model is stored there. -u compiles the files given as a user dictionary, and with -a
    only their costs and context ids are assigned: the result is a table of lines. -U, -M, -C, -s choose parts, which are always built together here."""
    p = _parser(
        "index", ("d", "dicdir", str, "."), ("o", "outdir", str), ("m", "model", str), ("u", "userdic", str), ("a", "assign-user-dictionary-costs"), ("U", "build-unknown"), ("M", "build-model"),
        ("C", "build-charcategory"), ("s", "build-sysdic"), ("w", "wakati"), ("p", "posid"), ("t", "charset", str, "utf-8"), ("f", "dictionary-charset", str, "utf-8"), ("F", "node-format", str),
    )
    o = p.parse_args(list(options))
    weights = readers.crf_model(readers.lines(spark, o.model))[1] if o.model else None
    if o.assign_user_dictionary_costs:
        entries = build.source_entries(spark, files)
        if weights is not None:
            conf = build.index(spark, o.dicdir).conf
            entries = lexicon.model_costs(entries, build.rewrite_rules(spark, o.dicdir), build.feature_templates(spark, o.dicdir)[0], weights, conf.cost_factor)
        ids = [readers.id_list(readers.lines(spark, f"{o.dicdir}/{side}-id.def")) for side in ("left", "right")]
        return lexicon.to_csv(lexicon.auto_ids(entries, build.rewrite_rules(spark, o.dicdir), *ids))
    model = build.index(spark, o.dicdir, files if o.userdic else (), weights)
    if o.wakati:
        model = replace(model, features=[""] * len(model.features))
    if o.node_format:
        model = replace(model, conf=replace(model.conf, node_format=o.node_format))
    if o.userdic or o.outdir:
        build.save_model(spark, model, o.userdic or o.outdir)
    return model


def train(spark: SparkSession, options: Sequence[str], corpus: str) -> DataFrame:
    """Weights (alpha, feature) of a corpus file; -m FILE goes on from an old model."""
    p = _parser("train", ("d", "dicdir", str, "."), ("c", "cost", float, 1.0), ("f", "freq", int, 1), ("M", "old-model", str), ("m", "model", str), ("e", "eta", float, 1e-4), ("p", "thread", int, 1), ("b", "build"))
    o = p.parse_args(list(options))
    name = o.old_model or o.model
    old = {r["feature"]: r["alpha"] for r in readers.crf_model(readers.lines(spark, name))[1].collect()} if name else None  # a model
    return build.weights_table(spark, build.cost_train(spark, o.dicdir, corpus, o.cost, o.freq, old))


def generate(spark: SparkSession, options: Sequence[str]) -> Model:
    """A folder's dictionary with costs from the weights of -m; with -o its sources are written there."""
    p = _parser("generate", ("d", "dicdir", str, "."), ("o", "outdir", str), ("m", "model", str), ("f", "cost-factor", int))
    o = p.parse_args(list(options))
    weights = {r["feature"]: r["alpha"] for r in readers.crf_model(readers.lines(spark, o.model))[1].collect()}  # a model
    model = build.generate(spark, o.dicdir, weights)
    if o.outdir:
        build.write_sources(spark, model, build.rewrite_rules(spark, o.dicdir), o.outdir)
    return model


def sentences(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """The raw sentences of corpus files."""
    return build.test_sentences(readers.lines(spark, *files))


def evaluate(spark: SparkSession, options: Sequence[str], system: str, gold: str) -> DataFrame:
    """Report lines; -l "0 1 2" chooses the levels, -1 is all."""
    o = _parser("evaluate", ("l", "level", str, "0 -1")).parse_args(list(options))
    return build.system_eval(readers.lines(spark, system), readers.lines(spark, gold), tuple(int(x) for x in o.level.split()))
