"""Steps whose work must follow the rows that they get."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.operators import decode, etl, evaluate, parts, relational, train
from lattica.operators import format as fmt
from lattica.operators.lattice import Dictionary, Lattice
from lattica.plans.model import EngineConf, Model
from lattica.plans.shapes import CHARS, SIMPLE_CHARS, SIMPLE_UNKNOWN, UNKNOWN, class_model
from lattica.plans.text_queries import _classified, _definition
from lattica.sources import readers
from tests.test_lattice import CHARS as WIDE_CHARS
from tests.test_lattice import UNKNOWN as WIDE_UNKNOWN
from tests.test_lattice import random_model


def words(count: int) -> list[str]:
    return [f"w{i:05d}" for i in range(count)]


def model(entries: list[str]) -> Model:
    return Model.build([(x, 0, 0, -100 * len(x), "NOUN," + x) for x in entries], EngineConf(), SIMPLE_CHARS, SIMPLE_UNKNOWN)


def test_constrained_blocks_are_linear():
    """A block's sentences each look at their own characters only, whatever else is in the block."""
    found = words(4000)
    dictionary = Dictionary(model(found[:50]))
    parsed = [decode.parse_partial(f"{w}\tFORCED\n{w}\nrest") for w in found]
    begin = time.perf_counter()
    lat = Lattice([x for x, _ in parsed], dictionary, [c for _, c in parsed])
    assert time.perf_counter() - begin < 6
    assert len(lat.eos) == 4000 and len(lat.virtual) == 3950 + 50


def test_equal_sentences_are_worked_on_once(spark):
    """Copies of a sentence in a batch share one analysis, and each row keeps its own keys."""
    texts = ["w00001 w00002", "", "w00003", None, "w00001 w00002", "   ", "w00001 w00002"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sentence string").coalesce(1)
    t = decode.tokenize(df, model(words(5))).select("id", "tok_idx", "surface").collect()
    assert sorted(t) == sorted((i, k, w) for i, x in enumerate(texts) for k, w in enumerate((x or "").split()))
    n = decode.nbest(df, model(words(5)), 2).filter("tok_idx = 0").groupBy("id").count().count()
    assert n == len(texts)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_characters_and_runs_move_nothing(spark):
    """Characters and runs are cut where a sentence is read: no exchange, and the same as by windows."""
    texts = ["ab  12é", "", None, "𝒳a,", "  ", "ab  12é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sentence string")
    made = relational.chars(df, ["id"])
    assert "Exchange" not in plan(made) and "Window" not in plan(made)
    assert sorted(tuple(r) for r in made.collect()) == sorted((i, k, c, ord(c), len(c.encode()), len(x[:k].encode())) for i, x in enumerate(texts) for k, c in enumerate(x or ""))
    runs = relational.class_runs(df, ["id"], class_model())
    assert "Exchange" not in plan(runs)
    classed = _classified(spark, df, ["id"])
    old = relational.runs(classed, ["id"]).groupBy("id", "run_id").agg(F.min_by("class_id", "ci"), F.min("ci"), F.max("run_end"))
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, old.collect()))


def test_surfaces_and_unknown_words_of_long_lines(spark):
    """A line's own length must not count once per position; counts are those of the rows."""
    line = "é".join(words(12000))
    lexicon = spark.createDataFrame([("w00001é", 1), ("w0", 2), ("é", 3), ("zz", 4), ("", 5)], "surface string, word_cost int")
    df = spark.createDataFrame([(1, line), (2, "w0 w0"), (3, "w0 w0"), (4, None)], "id int, sentence string")
    begin = time.perf_counter()
    rows = relational.prefix_matches(df, lexicon, ["id"])
    found = rows.groupBy("surface").agg(F.count("*"), F.sum("ci")).collect()
    assert time.perf_counter() - begin < 20
    at = {s: [i for x in (line, "w0 w0", "w0 w0") for i in range(len(x)) if x.startswith(s, i)] for s in ("w00001é", "w0", "é")}
    assert sorted(map(tuple, found)) == sorted((s, len(v), sum(v)) for s, v in at.items())
    assert sorted(map(tuple, relational.match_counts(df, lexicon).select("surface", "n", "positions").collect())) == sorted(map(tuple, found))
    assert rows.filter("id = 1 and surface = 'w00001é'").select("ci", "end_ci").collect() == [(7, 14)]


def test_unknown_counts_are_those_of_the_spans(spark):
    df = spark.createDataFrame([(1, "ab 12 éñ, x"), (2, "ab 12 éñ, x"), (3, "xyz  99"), (4, ""), (5, None)], "id int, sentence string")
    m = Model.build([("ab", 0, 0, 1, "W"), ("9", 0, 0, 1, "W")], EngineConf(), CHARS, UNKNOWN)
    lexicon = spark.createDataFrame([("ab",), ("9",)], "surface string")
    classes, _ = readers.char_classes(_definition(spark, CHARS))
    spans = relational.unknown_spans(relational.runs(_classified(spark, df, ["id"]), ["id"]), classes, relational.prefix_matches(df, lexicon, ["id"]), ["id"], 2)
    want = spans.groupBy("class_id", "step").agg(F.count("*"), F.sum(F.col("end_ci") - F.col("ci"))).collect()
    assert want and sorted(map(tuple, decode.unknown_counts(df, m).collect())) == sorted(map(tuple, want))


def texts_of_parts() -> list[bytes]:
    r = random.Random(3)
    some = ["".join(r.choice("abé1A-𝒳") for _ in range(r.randint(1, 9))) for _ in range(60)]
    made = ["".join(r.choice((" ", "  ", "   ", "")) + r.choice(some) for _ in range(r.randint(0, 12))) + r.choice(("", " ", "  ")) for _ in range(300)]
    return [x.encode() for x in [*made, "", " ", "   ", "a", " a ", "a" * 300]]


@pytest.mark.parametrize("seed", range(6))
def test_parts_give_what_whole_sentences_give(seed):
    """Costs under several contexts, and all fields of the best tokens under one, ties and penalties included."""
    m = random_model(seed, ties=seed % 3 == 0)
    keep = [(s, m.first[i], m.first[i + 1]) for i, s in enumerate(m.surfaces) if b" " not in s]
    entries = [(s, int(m.left[k]), int(m.right[k]), int(m.cost[k]), m.features[k], 0, int(m.pos[k])) for s, a, b in keep for k in range(a, b)]
    for contexts in (True, False):
        rows = entries if contexts else [(s, 0, 0, *rest) for s, _, _, *rest in entries]
        unknown = WIDE_UNKNOWN if contexts else "".join(f"{n},0,0,{c},U{n}\n" for n, c in (("DEFAULT", 300), ("SPACE", 10), ("ALPHA", 400), ("NUMERIC", 100), ("HEAD", 400)))
        model = Model.build(rows, m.conf, WIDE_CHARS, unknown, m.matrix if contexts else np.array([[7]]))
        d, texts = Dictionary(model), texts_of_parts()
        assert d.parted
        lat = Lattice(texts, d)
        assert parts.costs(texts, d, decode._blocks).tolist() == lat.cost[lat.eos].tolist()
        found = parts.best(texts, d, decode._blocks, decode._strings)
        if contexts:
            assert found is None
            continue
        nodes = lat.best()
        nodes = nodes[lat.stat[nodes] < 2]
        features = pa.array([*model.features, ""])
        assert found.total.tolist() == lat.cost[lat.eos].tolist() and found.sentence.tolist() == lat.sentence[nodes].tolist()
        a, b = decode._token_arrays(lat, nodes, features), decode._token_arrays(found, np.arange(len(nodes)), features)
        assert {k: v.to_pylist() for k, v in a.items()} == {k: v.to_pylist() for k, v in b.items()}


def test_surfaces_with_blanks_are_decoded_whole():
    d = Dictionary(Model.build([("a b", 0, 0, -500, "X")], EngineConf(), SIMPLE_CHARS, SIMPLE_UNKNOWN))
    assert not d.parted and parts.best([b"a b"], d, decode._blocks, decode._strings) is None
    assert parts.costs([b"a b"], d, decode._blocks).tolist() == [-500]


def test_equal_parts_are_decoded_once(monkeypatch):
    """The lattices of a block hold its distinct parts, however often they stand in it and however long its sentences are."""
    seen = []

    class Seen(Lattice):
        def __init__(self, sentences, *rest):
            seen.extend(sentences)
            super().__init__(sentences, *rest)

    monkeypatch.setattr(parts, "Lattice", Seen)
    d = Dictionary(model(words(5)))
    decode._best([b"w00001 w00002" + b" w00001" * 5000, b"w00001"] * 3, d)
    assert sorted(seen) == [b" w00001", b" w00002", b"w00001"]


def test_written_text_is_that_of_the_format_functions(spark):
    df = spark.createDataFrame([(1, "w00001 xw00002"), (2, ""), (3, None), (4, "  w00003 "), (5, "w00001 xw00002")], "id int, sentence string")
    m = model(words(5))
    for kind, function in ((None, fmt.default_format), ("wakati", fmt.wakati)):
        want = decode.tokens_column(df, m).select("id", function(F.col("tokens")).alias("text")).collect()
        assert sorted(decode.written(df, m, kind=kind).collect()) == sorted(want) and len(want) == 5


def test_evaluation_of_arrays_is_that_of_tables(spark):
    """Sentences with both token arrays in a row are counted without moving tokens; commas, quotes, empty and null lists included."""
    some = [([("ab", "N,x"), ("c", "V")], [("ab", "N,y"), ("c", "V")]), ([("a", "b")], [("a,b", "c")]), ([("é", '"N,1",z'), ("x", "")], [("é", '"N,1",z'), ("xy", "N")]), ([], [("q", "N")]), (None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "id int, system array<struct<surface:string,feature:string>>, gold array<struct<surface:string,feature:string>>")
    made = evaluate.evaluate_arrays(df, (0, 1, 2, -1))
    assert "SortMergeJoin" not in plan(made)
    table = lambda c: df.select("id", F.posexplode(c).alias("tok_idx", "t")).select("id", "tok_idx", "t.*")
    want = evaluate.evaluate(table("system"), table("gold"), ["id"], (0, 1, 2, -1))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


def test_training_makes_each_lattice_once(spark):
    """However many steps training takes, the corpus is read once, equal sentences count together, and so do sentences that no weight tells apart."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [["ab", "cd"], ["ab", "ef"], ["cd", "ab"], ["ab"], ["zz", "ab"], None, []] * 40
    df = spark.createDataFrame([(x,) for x in texts], "w array<string>").coalesce(1).mapInArrow(seen, "w array<string>")
    m = Model.build([(x, 0, 0, 0, "N,2") for x in ("ab", "cd", "ef")] + [("a", 0, 0, 0, "P,1")], EngineConf(), SIMPLE_CHARS, SIMPLE_UNKNOWN)
    rules = ({}, ["U:%F[0],%F[1]"], ["B:%L[0]/%R[0]"])
    corpus = train.array_sentences(df, F.col("w"), lambda w: F.lit("N,2"))
    log = []
    weights = train.train(corpus, m, *rules, log=log)
    assert read.value == len(texts) and len(log) > 2 and weights["U:N,2"] > 0
    index = train.FeatureIndex.build(m, *rules)
    found = {r["graph"]: r["n"] for r in train._distinct(corpus, m, index, train.Labels.build(index)).collect()}
    # ab cd and ab ef are alike; cd ab isn't, as only ab begins with an entry; zz is no entry; a sentence without tokens is its ends
    assert sorted(found.values()) == [40, 40, 40, 80] and found[b""] == 40
    plain = train.train(spark.createDataFrame([("".join(x), [(w, "N,2") for w in x]) for x in texts if x is not None], "sentence string, tokens array<struct<surface:string,feature:string>>"), m, *rules)
    assert weights == pytest.approx(plain)
    assert train.observed(corpus, m, *rules)["U:N,2"] == 40 * 7


@pytest.mark.parametrize("seed", range(4))
def test_sums_over_graphs_are_those_over_paths(seed):
    """Observed and expected counts and the loss, against all paths of each lattice; blanks, unknown words and unusable sentences included."""
    m = random_model(seed)
    d, r = Dictionary(m), random.Random(seed)
    index = train.FeatureIndex.build(m, {}, ["U0:%F[0]", "U1:%F[0]-%t"], ["B:%L[0]/%R[0]"])
    sentences = ["".join(r.choice("abA1 é") for _ in range(r.randint(0, 7))).encode() for _ in range(25)] * 2
    lat = Lattice(sentences, d)
    every = [[[math.nan, *nodes] for _, nodes in lat.paths(i)] for i in range(len(sentences))]
    gold = [[(int(lat.start[k]), int(lat.end[k]), lat.feature(k)) for k in r.choice(paths)[2:-1]] for paths in every]
    gold[3] = [(0, 99, "none")]
    chosen = train._gold(lat, gold, m.conf.eval_size, m.conf.unk_eval_size)
    x = np.random.default_rng(seed).normal(size=len(index.names))
    node_score, edge_score = index.scores(x)
    of = lambda k: (int(lat.entry[k]) + 1) * index.n_kinds + int(lat.kind[k])
    join = lambda a, b: int(index.right_ctx[lat.entry[a] + 1]) * index.n_left + int(index.left_ctx[lat.entry[b] + 1])
    seen, expected, loss = np.zeros(len(x)), np.zeros(len(x)), 0.0

    def counts(path):
        node, edge = np.zeros(index.n_nodes), np.zeros(index.n_left * index.n_right)
        for a, b in zip(path[:-1], path[1:], strict=True):
            node[of(b)] += 1
            edge[join(a, b)] += 1
        return index.spread(node, edge), float(node @ node_score + edge @ edge_score)

    for paths, path in zip(every, chosen, strict=True):
        if path:
            of_path = [counts(p[1:]) for p in paths]
            z = math.log(sum(math.exp(s) for _, s in of_path))
            observed, score = counts(path)
            seen, loss = seen + observed, loss + z - score
            expected = expected + sum(c * math.exp(s - z) for c, s in of_path)
    node, edge, _, n = train.sentence_sums(m, index, sentences, gold, None, None)
    assert n == sum(map(bool, chosen)) < len(sentences) and index.spread(node, edge).tolist() == pytest.approx(seen.tolist())
    node, edge, got, _ = train.sentence_sums(d, index, sentences, gold, node_score, edge_score)
    assert got == pytest.approx(loss) and index.spread(node, edge).tolist() == pytest.approx(expected.tolist())


def test_gold_sentences_move_nothing(spark):
    """Gold sentences of rows need no window or exchange, and equal ones meet before Python sees them, in small batches."""
    df = spark.createDataFrame([("ab cd",), ("ab cd",), ("cd",), (None,)], "s string")
    corpus = train.array_sentences(df, F.split("s", " "), lambda w: F.concat(F.lit("N,"), F.char_length(w).cast("string")))
    assert "Exchange" not in plan(corpus) and "Window" not in plan(corpus)
    m = Model.build([(x, 0, 0, 0, "N,2") for x in ("ab", "cd")], EngineConf(), SIMPLE_CHARS, SIMPLE_UNKNOWN)
    index = train.FeatureIndex.build(m, {}, ["%F[0],%F[1]"], [])
    made = plan(train._distinct(corpus, m, index, train.Labels.build(index)))
    assert "HashAggregate" in made[made.index("MapInArrow") :] and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert train.observed(corpus, m, {}, ["%F[0],%F[1]"], [])["N,2"] == 5
    table = df.select(F.monotonically_increasing_id().alias("k"), F.posexplode(F.split("s", " ")).alias("tok_idx", "surface")).withColumn("feature", F.lit("N,2"))
    rows = train.corpus_sentences(table, ["k"])
    assert "Window" not in plan(rows) and train.observed(rows, m, {}, ["%F[0],%F[1]"], [])["N,2"] == 5


def test_pairs_are_counted_where_texts_are_read(spark, monkeypatch):
    """Pairs of neighbouring words, against plain Python: frequent first words dealt over tasks, pieces of few texts, lines, nulls, blanks and letters of several bytes."""
    r = random.Random(7)
    texts = [None, "", " ", "\n", "a", "é  𝒳\n\nb ", "\na b", "a\tb a\tb"] + ["".join(r.choice(("of", "é", "w%d" % r.randint(0, 99))) + r.choice((" ", " ", "  ", "\n", " \n")) for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for line_break in ("\n", None):
        lines = [[w for w in s.split(" ") if w] for x in texts if x is not None for s in (x.split("\n") if line_break else [x])]
        pairs = Counter(p for w in lines for p in zip(w[:-1], w[1:], strict=True))
        left, kinds = Counter(), len({w for x in lines for w in x})
        for (a, _), n in pairs.items():
            left[a] += n
        made = etl.pair_costs(df, "text", line_break=line_break)
        assert "SortMergeJoin" not in plan(made) and "Generate explode(filter" not in plan(made)
        want = sorted((a, b, n, int(-math.log((n + 0.5) / (left[a] + 0.5 * kinds)) * 200)) for (a, b), n in pairs.items())
        assert sorted(map(tuple, made.collect())) == want
        assert {x["cost"] for x in etl.pair_costs(df, "text", vocabulary=9, line_break=line_break).filter("left = 'é' and right = 'of'").collect()} == {int(-math.log((pairs["é", "of"] + 0.5) / (left["é"] + 4.5)) * 200)}
    assert etl.pair_costs(df.filter("id < 4"), "text").collect() == []
    monkeypatch.setattr(etl, "PIECE", 64)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(etl._pieces([batch, batch], "\n"))
    assert len(parts) > 20 and sum(len(code) for code, _, _ in parts) == 2 * sum(len([w for w in s.split(" ") if w]) for x in texts for s in (x or "").split("\n"))
