"""Readers, formats, rewriting, evaluation, training, pipelines and streams on hand-made inputs."""

import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.operators import decode, etl, evaluate, lexicon, rewrite, train
from lattica.operators import format as fmt
from lattica.plans.model import EngineConf, Model
from lattica.sources import readers
from lattica.streaming import tokens as stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def text_lines(spark, text):
    return readers.split_lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")


@pytest.fixture(scope="module")
def model():
    conf = EngineConf(node_format="%m/%f[0,1,2]\\n", unk_format="?%m\\n", bos_feature="BOS,*,*")
    return Model.build([("a", 0, 0, 10, "N,*,x"), ("ab", 0, 0, 5, "V,q,y"), ("b", 0, 0, 7, "P,r,*")], conf)


def test_csv_columns(spark):
    df = spark.createDataFrame([('a,  "b,""c""",d,',), ("",), ("x",), ("a,,b",), ("a,b,",)], "line string")
    assert [r[0] for r in rows(df.select(C.csv_fields(F.col("line"))))] == [["a", 'b,"c"', "d"], [], ["x"], ["a", "", "b"], ["a", "b"]]
    head, rest = C.csv_head(F.col("line"), 2)
    one = spark.createDataFrame([(' "x,y",2,rest,"of",it',)], "line string").select(*head, rest)
    assert rows(one) == [("x,y", "2", 'rest,"of",it')]


def test_readers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,1,2,3,F,1\n,0,0,0,none\n")
    (tmp_path / "A.CSV").write_text('"y,z",,,,G\n')
    files = readers.csv_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["A.CSV", "b.csv"]
    assert rows(readers.lexicon(readers.lines(spark, files[1]))) == [(0, "x", 1, 2, 3, "F,1")]
    assert rows(readers.lexicon(readers.lines(spark, files[0]))) == [(0, "y,z", None, None, None, "G")]
    classes, ranges = readers.char_classes(text_lines(spark, "DEFAULT 0 1 0 # x\nSPACE 0 1 0\nA 1 1 2\nB 1 0 0\n0x0020 SPACE\n0x61..0x63 A B # letters\n0x63 B\n"))
    assert rows(classes)[2] == (2, "A", True, True, 2)
    got = {r[0]: r[1:] for r in rows(readers.char_map(classes, ranges))}
    assert got == {0x20: (1, 2), 0x61: (2, 12), 0x62: (2, 12), 0x63: (3, 8)}
    unk = readers.unknown_entries(text_lines(spark, "DEFAULT,0,0,1,D\nA,1,1,2,AA\n"), classes)
    assert {r[0] for r in rows(readers.uncovered_classes(classes, unk))} == {"SPACE", "B"}
    rules = rows(readers.rewrite_rules(text_lines(spark, "# c\n[unigram rewrite]\n*,* $1\n[left rewrite]\n(A|B) $2,x\n")))
    assert [(r[0], r[2], r[3]) for r in rules] == [("unigram", "*,*", "$1"), ("left", "(A|B)", "$2,x")]
    head, body = readers.crf_model(text_lines(spark, "cost-factor: 700\nbos: X\n\n0.5\tU0:a\n-1\tB0:b\n"))
    assert rows(head) == [("cost-factor", "700"), ("bos", "X")] and rows(body) == [(0.5, "U0:a"), (-1.0, "B0:b")]
    assert rows(readers.corpus(text_lines(spark, "a\tN\nb\tV\nEOS\nc\tX\nEOS\n"))) == [("f", 0, 0, "a", "N"), ("f", 0, 1, "b", "V"), ("f", 1, 0, "c", "X")]
    blocks = readers.partial_blocks(spark.createDataFrame([(1, "a\tN\nb\nEOS\nc\n\n")], "doc_id long, text string"))
    assert rows(blocks) == [(1, 0, 0, "a", "N"), (1, 0, 1, "b", None), (1, 1, 0, "c", None)]
    assert readers.parse_config("; c\na = 1\na = 2\nb=x = y\n") == {"a": "1", "b": "x = y"}
    assert readers.s_expressions('(a "b c" (d e))') == [["a", "b c", ["d", "e"]]]
    path = tmp_path / "s.xz"
    path.write_bytes(lzma.compress("p,q\nr\n".encode()))
    assert readers.xz_lines(str(path)) == ["p,q", "r"]
    assert [r[2] for r in rows(readers.xz_csv(spark.read.format("binaryFile").load(str(path))))] == ["p,q", "r"]
    raw = spark.createDataFrame([(1, "日本".encode("euc-jp")), (2, b"\xff\xff"), (3, None)], "i int, s binary")
    assert rows(readers.transcoded(raw, "s", "euc-jp")) == [(1, "日本"), (3, None)]
    assert rows(readers.id_list(text_lines(spark, "0 BOS\n1 N,x\n"))) == [(0, "BOS"), (1, "N,x")]
    assert [r[2] for r in rows(readers.pos_rules(text_lines(spark, "N,* 3\n")))] == [3]
    assert [(r[0], r[2]) for r in rows(readers.templates(text_lines(spark, "UNIGRAM U:%F[0]\nBIGRAM B:%L[0]\n")))] == [("UNIGRAM", "U:%F[0]"), ("BIGRAM", "B:%L[0]")]


def test_formats(spark, model):
    df = spark.createDataFrame([(1, "ab  a b"), (2, None), (3, "x ab"), (4, "  ")], "k long, sentence string")
    t = decode.tokens_column(df, model)
    got = {r[0]: r[1:] for r in rows(t.select("k", fmt.default_format(F.col("tokens")), fmt.wakati(F.col("tokens")), fmt.user_format(model.conf)(F.col("tokens"), F.col("sentence"))))}
    assert got[1] == ("ab\tV,q,y\na\tN,*,x\nb\tP,r,*\nEOS\n", "ab a b \n", "ab/V\tq\ty\na/Nx\nb/P\tr\nEOS\n")
    assert got[2] == got[4] == ("EOS\n", "\n", "EOS\n")
    full = EngineConf(node_format="%M|%pS|%ps-%pe|%pC|%pn|%pc|%pw|%c|%h|%t|%s|%L|%S|%phl%phr|%pl%pL|%%|%pb\\t", eos_format="")
    line = rows(t.filter("k = 3").select(fmt.user_format(full)(F.col("tokens"), F.col("sentence"))))[0][0]
    assert line == "x||0-1|0|0|0|0|0|1|0|1|4|x ab|00|11|%|*\t ab| |2-4|0|5|5|5|5|1|0|0|4|x ab|00|23|%|*\t"
    with pytest.raises(ValueError):
        fmt.compile_template("%q")
    with pytest.raises(Exception, match="out of range"):
        t.select(fmt.user_format(EngineConf(node_format="%f[9]"))(F.col("tokens"), F.col("sentence"))).collect()
    assert fmt.compile_template("%F-[0,2]\\s") == [("f", ("-", (0, 2))), " "]
    n, p = decode.all_nodes(df, model, theta=0.01), decode.lattice_paths(df, model, theta=0.01)
    dump = {r[0]: r[1] for r in rows(fmt.dump(n, p, ["k"]))}
    assert dump[2].startswith("0 BOS BOS,*,* 0 0") and dump[3].count("\n") == len(rows(n.filter("k = 3")))
    em = [r[1] for r in rows(fmt.expectation_lines(n, p, ["k"]).filter("k = 2"))]
    assert sorted(em) == ["B\tBOS,*,*\tBOS,*,*\t1.000000", "U\tBOS\tBOS,*,*\t1.000000", "U\tEOS\tBOS,*,*\t1.000000"]
    best = {r[0]: r[1] for r in rows(fmt.nbest_text(decode.nbest(df, model, 2), ["k"], "END\n"))}
    assert best[2] == "EOS\nEND\n" and best[1].count("EOS\n") == 2
    alt = rows(decode.alternatives(n.withColumn("isbest", F.col("isbest")), ["k"]))
    assert all(r for r in alt)


def test_parse_and_read_back(spark, model):
    df = spark.createDataFrame([(1, "ab a b")], "k long, sentence string")
    text = rows(decode.tokens_column(df, model).select(fmt.default_format(F.col("tokens"))))[0][0]
    back = readers.result_offsets(readers.corpus(text_lines(spark, text)))
    assert [(r["surface"], r["begin_pos"], r["length"]) for r in back.collect()] == [("ab", 0, 2), ("a", 2, 1), ("b", 3, 1)]


def test_table_function(spark, model):
    decode.register_sql(spark, model)
    spark.createDataFrame([(1, "ab b")], "k long, sentence string").createOrReplaceTempView("lines_t")
    assert [r[0] for r in rows(spark.sql("select surface from lines_t, lateral morph_tokenize(sentence) order by tok_idx"))] == ["ab", "b"]


def test_decode_has_no_exchange(spark, model):
    plan = decode.tokenize(spark.range(5).select(F.lit("ab").alias("sentence")), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rewrite(spark):
    rules = [("(A|B),*", "x$2,$1"), ("*,q", '"$1,z"'), ("*", "rest")]
    values = ["A,1", "C,q", "C", "B,\"p,r\""]
    df = spark.createDataFrame([(v,) for v in values], "f string")
    got = [r[0] for r in rows(df.select(rewrite.rewrite(rules, F.col("f"))))]
    assert got == [rewrite.rewrite_one(rules, v) for v in values] == ["x1,A", '"C,z"', "rest", '"xp,r",B']
    assert rewrite.rewrite_one([("A", "b")], "C") is None
    assert [rewrite.pos_of([("A,*", 3), ("*,q", 4)])(v) for v in values] == [3, 4, 65535, 65535]
    assert rewrite.unigram_features(["U:%F[0]-%F?[1]", "V:%t%u", "W:%F[7]"], "N,*", 4) == ["V:4N,*"]
    assert rewrite.bigram_features(["%L[0]/%R[1]", "%r+%l"], "a,b", "c,d") == ["a/d", "a,b+c,d"]
    with pytest.raises(ValueError):
        rewrite.template_text("%z", {}, {})


def test_evaluate_itself_is_perfect(spark):
    t = spark.createDataFrame([(1, 0, "ab", "N,x"), (1, 1, "c", "V,y"), (2, 0, "d", "N,x")], "k int, tok_idx int, surface string, feature string")
    for r in evaluate.evaluate(t, t, ["k"], (0, 1, -1)).collect():
        assert (r["precision"], r["recall"], r["f"], r["correct"]) == (100.0, 100.0, 100.0, 3)
    split = spark.createDataFrame([(1, 0, "a", "N,x"), (1, 1, "b", "N,x"), (1, 2, "c", "V,z"), (2, 0, "d", "N,x")], "k int, tok_idx int, surface string, feature string")
    got = {r["level"]: (r["correct"], r["n_system"], r["n_gold"]) for r in evaluate.evaluate(split, t, ["k"], (0, 1, -1)).collect()}
    assert got == {0: (2, 4, 3), 1: (2, 4, 3), -1: (1, 4, 3)}
    lines = [r["line"] for r in evaluate.report(evaluate.evaluate(split, t, ["k"], (0,))).collect()]
    assert lines == ["LEVEL 0:    50.0000(2/4) 66.6667(2/3) 57.1429"]
    assert rows(evaluate.raw_sentences(t, ["k"]).orderBy("k")) == [(1, "abc"), (2, "d")]


def test_gradient_and_training(spark):
    m = Model.build([("a", 0, 0, 0, "N,1"), ("ab", 0, 0, 0, "N,2"), ("b", 0, 0, 0, "V,1"), ("c", 0, 0, 0, "V,2")], EngineConf(bos_feature="B,0", eval_size=2))
    uni, bi = ["U:%F[0],%F[1]"], ["B:%L[0]/%R[0]"]
    index = train.FeatureIndex.build(m, {}, uni, bi)
    sentences = [b"abc", b"cab", b"ab"]
    gold = [[(0, 1, "N,1"), (1, 2, "V,1"), (2, 3, "V,2")], [(0, 1, "V,2"), (1, 3, "N,2")], [(0, 1, "N,1"), (1, 2, "V,1")]]
    node, edge, _, n = train.sentence_sums(m, index, sentences, gold, None, None)
    observed = index.spread(node, edge)
    assert n == 3

    def f(x):
        node, edge, loss, _ = train.sentence_sums(m, index, sentences, gold, *index.scores(x))
        return loss + float(x @ x) / 2, index.spread(node, edge) - observed + x

    x = np.random.default_rng(0).normal(size=len(index.names))
    grad = f(x)[1]
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-5
        assert grad[k] == pytest.approx((f(x + step)[0] - f(x - step)[0]) / 2e-5, abs=1e-4)
    tokens = spark.createDataFrame(
        [(i, j, sentences[i][a:b].decode(), feat) for i, g in enumerate(gold) for j, (a, b, feat) in enumerate(g)], "k int, tok_idx int, surface string, feature string"
    )
    log = []
    weights = train.train(train.corpus_sentences(tokens, ["k"]), m, {}, uni, bi, steps=15, log=log)
    local = train.lbfgs(f, np.zeros(len(x)), steps=60)
    assert log[-1] <= log[0] and [weights.get(n, 0) for n in index.names] == pytest.approx(local.tolist(), abs=0.05)
    made = train.generate(m, weights, {}, uni, bi)
    got = decode.tokenize(spark.createDataFrame([(1, "abc")], "k int, sentence string"), made).select("surface").collect()
    assert [r[0] for r in got] == ["a", "b", "c"]
    assert train.missing_entries(tokens.withColumn("surface", F.lit("zz")), tokens).count() == 4


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = train.lbfgs(lambda v: (float((v - 1) @ a @ (v - 1)) / 2, a @ (v - 1)), np.zeros(3), eta=1e-14)
    assert np.allclose(x, 1, atol=1e-4)


def test_dictionary_steps(spark, model):
    e = spark.createDataFrame([(0, "b", 0, 0, 1, "V"), (1, "a", 0, 9, 1, "N"), (2, "", 0, 0, 0, "X"), (3, "a", -1, 0, None, "N")], "entry_ord int, surface string, left_id int, right_id int, word_cost int, feature string")
    done = rows(lexicon.compile_entries(e, [("N", 5)]).select("surface", "entry_ord", "pos_id"))
    assert done == [("a", 1, 5), ("a", 3, 5), ("b", 0, 65535)]
    assert {r[0] for r in rows(lexicon.violations(e, 2, 2))} == {"a"}
    ids = rows(lexicon.context_ids(e, "feature", "BOS").orderBy("id"))
    assert ids == [(0, "BOS"), (1, "N"), (2, "V"), (3, "X")]
    assert rows(lexicon.to_csv(e.filter("entry_ord = 0"))) == [("b,0,0,1,V",)]
    m = lexicon.load_model(e.filter("entry_ord < 2").withColumn("right_id", F.lit(0)), EngineConf(), "DEFAULT 1 0 0\nSPACE 0 1 0\n0x0020 SPACE\n", "DEFAULT,0,0,9,U\nSPACE,0,0,9,U\n", "1 1\n0 0 0\n")
    assert m.surfaces == [b"a", b"b"] and m.transition_cost(0, 0) == 0 and m.compatible(model)
    bigger = model.with_user_entries([("abc", 0, 0, -50, "USER")])
    got = decode.tokenize(spark.createDataFrame([("abc",)], "sentence string"), bigger).select("surface", "feature").collect()
    assert [tuple(r) for r in got] == [("abc", "USER")]
    assert {d["type"] for d in bigger.dictionary_info()} == {0, 1, 2}
    with pytest.raises(ValueError):
        Model.build([("a", 3, 0, 0, "N")])
    with pytest.raises(ValueError):
        Model.build([], unknown="DEFAULT,0,0,0,*\n")


def test_pipelines(spark):
    lex = spark.createDataFrame([("가", "NNG", None, True, "가"), ("[", "SSO", None, True, "["), ("나", "NNP", "인명", False, "나")], "surface string, pos string, semantic_class string, is_available boolean, read string")
    assert [r["final"] for r in etl.with_final_consonant(lex).collect()] == ["F", "*", "F"]
    out = etl.export_lines(lex.withColumns({c: F.lit(None).cast("string") for c in ("type", "start_pos", "end_pos", "expression")}))
    assert {r["line"] for r in out.collect()} == {"가,0,0,0,NNG,*,F,가,*,*,*,*", "[,0,0,0,SSO,*,*,[,*,*,*,*"}
    ids = spark.createDataFrame([("]", 1, 1, "SSC,*"), (".", 7, 8, "SF,*")], "surface string, left_id int, right_id int, feature string")
    got = {r["surface"]: (r["left_id"], r["right_id"], r["feature"]) for r in etl.retag_like(ids, "]", ".", "SF").collect()}
    assert got == {"]": (7, 8, "SF,*"), ".": (7, 8, "SF,*")}
    change = lambda d: d.withColumn("pos", F.lit("NEW"))
    assert etl.edit(lex, F.col("pos") == "NNG", change, apply=False).count() == 1 and etl.edit(lex, F.col("pos") == "NNG", change, apply=True).count() == 3
    assert rows(etl.first_id(readers.id_list(text_lines(spark, "3 N,x\n2 N,y\n1 V\n")), F.col("feature").rlike("^N"))) == [(2,)]
    stems = spark.createDataFrame([("walk", "walk", "v")], "base string, stem string, ctype string")
    forms = spark.createDataFrame([("v", "past", "ed"), ("v", "base", "")], "ctype string, form string, ending string")
    assert {r["surface"] for r in etl.conjugate(stems, forms).collect()} == {"walk", "walked"}


def test_streams(spark, model, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("ab a\nb\n")
    source = spark.readStream.text(str(tmp_path / "in"))
    q = stream.tokenize_stream(source, model).writeStream.format("memory").queryName("toks").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in rows(spark.sql("select surface from toks"))) == ["a", "ab", "b"]
    versions = iter([("one", model), ("two", model.with_user_entries([("ab a", 0, 0, -99, "U")]))])
    seen = []
    q = stream.swapping(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), lambda: next(versions), lambda df, _: seen.extend(rows(df.select("surface", "model_version")))).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "2.txt").write_text("ab a\n")
    q.processAllAvailable()
    q.stop()
    assert ("ab", "one") in seen and ("ab a", "two") in seen
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:07:00", "x")], "t string, surface string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r[2] for r in rows(stream.token_counts(events))) == [1, 2]


def test_generators_of_costs(spark):
    w = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a")], "k int, i int, w string")
    got = {r["w"]: (r["n"], r["cost"]) for r in etl.word_costs(w).collect()}
    assert got == {"a": (3, int(-np.log(3.5 / 5) * 200)), "b": (1, int(-np.log(1.5 / 5) * 200))}
    pairs = {(r["left"], r["right"]): r["cost"] for r in etl.pair_costs(spark.createDataFrame([(1, "a b a"), (2, "a")], "k int, sentence string")).collect()}
    assert pairs == {("a", "b"): int(-np.log(1.5 / 2) * 200), ("b", "a"): int(-np.log(1.5 / 2) * 200)}
    every = {(r["left"], r["right"]): r["cost"] for r in etl.pair_matrix(etl.neighbours(spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "w array<string>"), "w"), w.select("w")).collect()}
    assert every == pairs | {("a", "a"): int(-np.log(0.5 / 2) * 200), ("b", "b"): int(-np.log(0.5 / 2) * 200)}
