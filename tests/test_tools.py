"""Workflows by their options, results one by one, weights without quantising, and pieces of readers."""

import itertools

import pytest

from lattica.operators import decode, train
from lattica.operators.lattice import Dictionary, Lattice
from lattica.plans import build, tools
from lattica.plans.model import Model
from lattica.plans.tagger import Tagger
from lattica.sources import readers
from tests.test_workflow import folder  # noqa: F401


def test_tag_by_options(spark, folder):  # noqa: F811
    lines = spark.createDataFrame([(1, "ab a zz"), (2, "")], "k int, sentence string")
    run = lambda *options: {r["k"]: r["parsed"] for r in tools.tag(spark, ["-d", folder, *options], lines).collect()}
    assert run() == {1: "ab\tN,x\na\tV,y\nzz\tW,*\nEOS\n", 2: "EOS\n"}
    assert run("-O", "wakati")[1] == "ab a zz \n" and run("-O", "none")[1] == "" and run("-O", "s")[1] == "ab \na \n."
    assert run("-F", "%m|", "-U", "?%m|", "-E", "!")[1] == "ab|a|?zz|!"
    assert run("-N", "2")[1].count("EOS\n") == 2 and run("-a")[1].count("\n") > run("-m")[1].count("\n")
    assert {r["size"] for r in tools.tag(spark, ["-d", folder, "-D"], lines).collect()} == {3}
    assert "cost-factor = 100" in [r["line"] for r in tools.tag(spark, ["-d", folder, "-P"], lines).collect()]
    blocks = spark.createDataFrame([(1, "a\tV,*\nb")], "k int, sentence string")
    assert tools.tag(spark, ["-d", folder, "-p"], blocks).first()["parsed"] == "a\tV,y\nb\tW,*\nEOS\n"
    parts = tools.tag(spark, ["-d", folder, "-b", "3", "-O", "wakati"], lines).filter("k = 1").orderBy("part").collect()
    assert [r["parsed"] for r in parts] == ["ab \n", "a z \n", "z \n"] and all(r["was_split"] for r in parts)


def test_train_generate_index_by_options(spark, folder, tmp_path):  # noqa: F811
    (tmp_path / "corpus").write_text("a\tV,y\nab\tN,x\nEOS\nab\tN,x\nEOS\n")
    weights = tools.train(spark, ["-d", folder, "-c", "2.0", "-f", "1"], str(tmp_path / "corpus"))
    rows = {r["feature"]: r["alpha"] for r in weights.collect()}
    assert rows and any(rows.values())
    (tmp_path / "model").write_text("cost-factor: 100\n\n" + "".join(f"{v:.16f}\t{k}\n" for k, v in rows.items()))
    m = tools.generate(spark, ["-d", folder, "-m", str(tmp_path / "model"), "-o", str(tmp_path / "out")])
    assert Tagger(m).parse("aab").startswith("a\tV,y\nab\tN,x")
    stored = tools.index(spark, ["-d", folder, "-o", str(tmp_path / "stored")])
    assert build.load_model(spark, str(tmp_path / "stored")).surfaces == stored.surfaces
    assert set(tools.index(spark, ["-d", folder, "-w"]).features) == {""}
    (tmp_path / "u").mkdir()
    (tmp_path / "u/user.csv").write_text("abc,,,,N,user\n")
    for side in ("left", "right"):
        (tmp_path / f"{side}-id.def").write_text("0 BOS,*\n1 N,*\n")
    for name in ("char.def", "unk.def", "matrix.def", "a.csv", "dicrc", "rewrite.def", "feature.def"):
        (tmp_path / name).write_text(open(f"{folder}/{name}").read())
    line = tools.index(spark, ["-d", str(tmp_path), "-a", "-m", str(tmp_path / "model")], [str(tmp_path / "u/user.csv")]).first()["line"]
    cells = line.split(",")
    assert cells[:3] == ["abc", "1", "1"] and cells[3].lstrip("-").isdigit() and cells[4:] == ["N", "user"]
    report = tools.evaluate(spark, ["-l", "0 1"], str(tmp_path / "corpus"), str(tmp_path / "corpus")).collect()
    assert [r["line"].split()[-1] for r in report] == ["100.0000", "100.0000"]
    assert [r["sentence"] for r in tools.sentences(spark, [str(tmp_path / "corpus")]).orderBy("sent_id").collect()] == ["aab", "ab"]


def test_results_come_one_by_one_in_order():
    m = Model.build([("a", 0, 0, 3, "A"), ("aa", 0, 0, 5, "AA"), ("aaa", 0, 0, 20, "AAA")])
    t = Tagger(m)
    lat = Lattice([b"aaaa"], Dictionary(m))
    every = list(lat.paths(0))
    costs = [c for c, _ in every]
    assert costs == sorted(costs) and [c for c, _ in lat.nbest(0, 3)] == costs[:3] and len(every) >= 7
    assert [c for c, _ in itertools.islice(t.results("aaaa"), 4)] == costs[:4]
    t.parse_nbest_init("aa")
    found = []
    while (text := t.next_result()) is not None:
        found.append(text)
    assert found[0] == "aa\tAA\nEOS\n" and found[1] == "a\tA\na\tA\nEOS\n" and t.next_result() is None
    with pytest.raises(ValueError):
        lat.nbest(0, 0)


def test_decoding_by_weights_is_not_quantised(spark):
    m = Model.build([("a", 0, 0, 0, "A"), ("aa", 0, 0, 0, "B")])
    weights = {"U:A": 1.00001, "U:B": 2.00001}  # two of A are better by less than a cost unit
    exact = train.generate(m, weights, {}, ["U:%F[0]"], [], exact=True)
    rounded = train.generate(m, weights, {}, ["U:%F[0]"], [])
    df = spark.createDataFrame([(1, "aa")], "k int, sentence string")
    assert [r["surface"] for r in decode.tokenize(df, exact).collect()] == ["a", "a"]
    assert 2 * int(rounded.cost[0]) == int(rounded.cost[1])


def test_long_lines_are_cut_between_characters(spark):
    df = spark.createDataFrame([(1, "aé字b" * 3), (2, None), (3, "字字")], "k int, sentence string")
    got = readers.split_long(df, 4).orderBy("k", "part").collect()
    assert "".join(r["sentence"] for r in got if r["k"] == 1) == "aé字b" * 3
    assert all(len((r["sentence"] or "").encode()) <= 4 for r in got) and [r["was_split"] for r in got if r["k"] != 1] == [False, True, True]
    assert [r["sentence"] for r in readers.split_long(df.filter("k = 3"), 2).collect()] == ["字", "字"]
