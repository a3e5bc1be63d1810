"""Dictionary folders, stored models, the tagger, and train - generate - evaluate from end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.hashing import fingerprint, murmur3_x86_128
from lattica.operators import decode
from lattica.plans import build
from lattica.plans.model import EngineConf, Model
from lattica.plans.tagger import Tagger, nodes_at
from lattica.sources import readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dic")
    (d / "char.def").write_text("DEFAULT 0 1 0\nSPACE 0 1 0\nALPHA 1 1 0\n0x0020 SPACE\n0x0061..0x007A ALPHA\n")
    (d / "unk.def").write_text("DEFAULT,0,0,500,X,*\nSPACE,0,0,500,X,*\nALPHA,0,0,400,W,*\n")
    (d / "matrix.def").write_text("2 2\n0 0 0\n0 1 0\n1 0 -10\n1 1 30\n")
    (d / "b.csv").write_text("ab,0,0,5,N,x\n")
    (d / "a.csv").write_text('a,1,1,3,V,y\n"c,d",0,0,1,N,z\n')
    (d / "dicrc").write_text("; settings\nbos-feature = BOS,*\ncost-factor = 100\neval-size = 2\nunk-eval-size = 1\nnode-format-s = %m \\n\neos-format-s = .\n")
    (d / "rewrite.def").write_text("[unigram rewrite]\n*,* $1,$2\n[left rewrite]\n*,* $1,*\n[right rewrite]\n*,* $1,*\n")
    (d / "pos-id.def").write_text("N,* 4\nV,* 5\n")
    (d / "feature.def").write_text("UNIGRAM U:%F[0],%F?[1]\nBIGRAM B:%L[0]/%R[0]\n")
    return str(d)


def test_index_and_store(spark, folder, tmp_path):
    m = build.index(spark, folder)
    assert m.surfaces == [b"a", b"ab", b"c,d"] and m.conf.cost_factor == 100 and m.matrix.tolist() == [[0, 0], [-10, 30]]
    assert [int(m.pos[m.first[i]]) for i in range(3)] == [5, 4, 4]
    build.save_model(spark, m, str(tmp_path / "m"))
    again = build.load_model(spark, str(tmp_path / "m"))
    for name in ("invoke", "group", "length", "char_class", "char_mask", "first", "left", "right", "pos", "cost", "dict_id", "unknown", "matrix"):
        assert np.array_equal(getattr(m, name), getattr(again, name)), name
    assert (m.surfaces, m.features, m.class_names, m.conf) == (again.surfaces, again.features, again.class_names, again.conf)
    user = tmp_path / "user.csv"
    user.write_text("abc,0,0,-100,N,user\n")
    text = Tagger(build.index(spark, folder, [str(user)])).parse("abc")
    assert text == "abc\tN,user\nEOS\n"


def test_tagger(spark, folder):
    m = build.index(spark, folder)
    t = Tagger(m)
    assert t.parse("ab a zz") == "ab\tN,x\na\tV,y\nzz\tW,*\nEOS\n" and t.parse("") == "EOS\n"
    assert Tagger(m, "s").parse("ab a") == "ab \na \n."
    assert t.parse_nbest("ab", 2).count("EOS\n") == 2
    assert t.parse_partial("a\tV,*\nb") == "a\tV,y\nb\tW,*\nEOS\n"
    every = Tagger(m, all_morphs=True).nodes("ab", marginal=True)
    assert [x.surface for x in every[1:-1]] and sum(x.prob for x in every if x.begin == 0 and x.stat < 2) == pytest.approx(1, abs=1e-4)
    assert sum(x.isbest for x in every) == len(t.nodes("ab"))
    df = spark.createDataFrame([(1, "ab a zz"), (2, None)], "k int, sentence string")
    assert [r["parsed"] for r in t.parse_column(df).orderBy("k").collect()] == [t.parse("ab a zz"), "EOS\n"]
    full = EngineConf(node_format="%M|%pS|%ps|%pe|%pC|%pn|%pc|%c|%h|%t|%s|%L|%phl|%pl|%pL|%f[0,1]\\n", unk_format="?%m\\n", bos_feature="BOS,*")
    other = Model.build([("ab", 0, 0, 5, "N,x"), ("a", 0, 0, 3, "V,*")], full)
    assert [r["parsed"] for r in Tagger(other).parse_column(df.filter("k = 1")).collect()] == [Tagger(other).parse("ab a zz")]
    assert nodes_at(decode.all_nodes(df, m), begin=0, end=2).filter("k = 1").count() >= 1
    t.swap(other)
    assert t.parse("ab") == "a\tV,*\nb\t*\nEOS\n" and t.log_partition("") == 0.0


def test_train_generate_evaluate(spark, folder, tmp_path):
    gold = "a\tV,y\nab\tN,x\nEOS\nab\tN,x\nab\tN,x\nEOS\na\tV,y\na\tV,y\nq\tN,x\nEOS\n"
    (tmp_path / "corpus").write_text(gold)
    weights = build.cost_train(spark, folder, str(tmp_path / "corpus"), steps=20)
    assert any(k.startswith("B:") for k in weights)
    m = build.generate(spark, folder, weights)
    rules = build.rewrite_rules(spark, folder)
    build.write_sources(spark, m, rules, str(tmp_path / "out"))
    ids = {r["value"] for r in spark.read.text(str(tmp_path / "out/left-id.def")).collect()}
    assert "0 BOS,*" in ids and "1 N,*" in ids
    lines = readers.lines(spark, str(tmp_path / "corpus"))
    raw = build.test_sentences(lines).orderBy("sent_id")
    assert [r["sentence"] for r in raw.collect()] == ["aab", "abab", "aaq"]
    text = "".join(Tagger(m).parse(r["sentence"]) for r in raw.collect())
    (tmp_path / "result").write_text(text)
    report = [r["line"] for r in build.system_eval(readers.lines(spark, str(tmp_path / "result")), lines, (0,)).collect()]
    assert report[0].startswith("LEVEL 0:") and float(report[0].split()[-1]) > 80
    costs = build.index(spark, folder, weights=build.weights_table(spark, weights))
    assert costs.surfaces == m.surfaces


def test_binary_forms():
    raw = np.array([2, 3], "<u2").tobytes() + np.arange(6, dtype="<i2").tobytes()
    assert build.read_binary_matrix(raw).tolist() == [[0, 2, 4], [1, 3, 5]]
    assert murmur3_x86_128(b"", 0) == (0, 0, 0, 0)
    assert murmur3_x86_128(b"The quick brown fox jumps over the lazy dog", 0) == (0x2F1583C3, 0xECEE2C67, 0x5D7BF66C, 0xE5E91D2C)
    assert 0 <= fingerprint("U0:x") < 1 << 64
