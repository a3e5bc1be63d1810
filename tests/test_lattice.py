import random

import numpy as np
import pytest

from lattica.operators.lattice import INSIDE, TOKEN, Dictionary, Lattice
from lattica.plans.model import BOS, EOS, EngineConf, Model, csv_quote, csv_split
from tests.plain import plain_best, plain_lattice, plain_marginals, plain_paths

CHARS = """DEFAULT 0 0 1
SPACE 0 1 0
ALPHA 1 1 2
NUMERIC 0 1 0
HEAD 1 0 3
0x0020 SPACE
0x0061..0x007A ALPHA
0x00E0..0x00FF ALPHA HEAD
0x0030..0x0039 NUMERIC
0x0041..0x005A HEAD ALPHA
"""
UNKNOWN = "DEFAULT,0,0,300,SYM\nSPACE,0,0,10,SP\nALPHA,1,1,400,A1\nALPHA,2,2,420,A2\nNUMERIC,1,2,100,N\nHEAD,2,1,350,H\n"


def random_model(seed: int, ties: bool = False) -> Model:
    r = random.Random(seed)
    words = set()
    while len(words) < 25:
        words.add("".join(r.choice("abé1A ") for _ in range(r.randint(1, 4))).strip() or "a")
    entries = []
    for w in sorted(words):
        for _ in range(r.randint(1, 2)):
            entries.append((w, r.randint(0, 2), r.randint(0, 2), 0 if ties else r.randint(-300, 600), f"F{r.randint(0, 3)}", r.randint(0, 1), r.randint(1, 3)))
    matrix = np.zeros((3, 3)) if ties else np.array([[r.randint(-100, 100) for _ in range(3)] for _ in range(3)])
    conf = EngineConf(max_grouping_size=3, left_space_penalty_factor="2,150,3,70,2,999")
    return Model.build(entries, conf, CHARS, UNKNOWN.replace("300", "0").replace("400", "0").replace("420", "0") if ties else UNKNOWN, matrix)


def random_text(r: random.Random) -> str:
    return "".join(r.choice("abé1A  -𝒳ñ") for _ in range(r.randint(0, 14)))


@pytest.mark.parametrize("seed", range(12))
def test_best_path_equals_plain_decoder(seed):
    m = random_model(seed, ties=seed % 3 == 0)
    r = random.Random(seed + 100)
    texts = [random_text(r).encode() for _ in range(60)] + [b"", b"   ", b" a ", "é".encode()]
    lat = Lattice(texts, Dictionary(m))
    best = lat.best()
    for i, s in enumerate(texts):
        mine = best[lat.sentence[best] == i]
        want, cost = plain_best(m, s)
        got = [(int(lat.begin[k]), int(lat.start[k]), int(lat.end[k]), int(lat.entry[k]), int(lat.stat[k]), int(lat.id[k])) for k in mine]
        assert got == [(*n[:5], n[6]) for n in want]
        assert lat.cost[lat.eos[i]] == cost


@pytest.mark.parametrize("seed", range(6))
def test_all_nodes_nbest_and_marginals(seed):
    m = random_model(seed + 50)
    r = random.Random(seed)
    texts = [random_text(r)[:8].encode() for _ in range(12)]
    lat = Lattice(texts, Dictionary(m))
    theta = 0.01
    _, _, prob, (left, right, _, edge), z = lat.marginals(theta)
    for i, s in enumerate(texts):
        nodes, _, _, into = plain_lattice(m, s)
        mine = np.flatnonzero(lat.sentence == i)
        assert [(int(lat.begin[k]), int(lat.end[k]), int(lat.entry[k])) for k in mine] == [(n[0], n[2], n[3]) for n in nodes]
        paths = plain_paths(m, s)
        got = lat.nbest(i, 10)
        assert [c for c, _ in got] == [c for c, _ in paths[:10]]
        probs, logz = plain_marginals(m, s, theta)
        assert z[i] == pytest.approx(logz, abs=1e-6)
        assert [float(prob[k]) for k in mine] == pytest.approx([probs.get(k, 0.0) for k in range(len(nodes))], abs=1e-5)
        assert sum(map(len, into)) == int((lat.sentence[right] == i).sum())
        eos = right == lat.eos[i]
        assert float(edge[eos].sum()) == pytest.approx(1.0, abs=1e-5)
    assert len(left) == len(right)


def test_tie_takes_the_left_node_that_begins_last():
    m = Model.build([("a", 0, 0, 0, "A"), ("ab", 0, 0, 0, "AB"), ("b", 0, 0, 0, "B")])
    lat = Lattice([b"ab"], Dictionary(m))
    assert lat.surfaces(lat.best()[1:-1]) == ["a", "b"]


def test_constraints():
    m = Model.build([("ab", 0, 0, 0, "N,x"), ("a", 0, 0, 100, "N,y"), ("b", 0, 0, 100, "V,z"), ("abc", 0, 0, -500, "W,w")])
    d = Dictionary(m)
    texts = [b"abc", b"abc", b"abc", b"abc"]
    lat = Lattice(
        texts,
        d,
        [
            None,
            ({0: TOKEN, 1: TOKEN, 3: TOKEN}, {}),
            ({0: TOKEN, 1: INSIDE, 2: TOKEN, 3: TOKEN}, {0: (2, "N,*")}),
            ({0: TOKEN, 1: INSIDE, 2: TOKEN, 3: TOKEN}, {0: (2, "Q,*")}),
        ],
    )
    best = lat.best()
    rows = [[(lat.surfaces(np.array([k]))[0], lat.feature(int(k))) for k in best if lat.sentence[k] == i and lat.stat[k] not in (BOS, EOS)] for i in range(4)]
    assert rows[0] == [("abc", "W,w")]
    assert rows[1][0] == ("a", "N,y") and "".join(x for x, _ in rows[1]) == "abc" and len(rows[1]) >= 2
    assert rows[2][0] == ("ab", "N,x")
    assert rows[3][0] == ("ab", "Q,*")


def test_csv_fields():
    assert csv_split('a,  "b,""c""",d,') == ["a", 'b,"c"', "d"]
    assert csv_split("a,b,c,d", 3) == ["a", "b", "c,d"]
    assert csv_split("") == []
    assert csv_quote('x,"y"') == '"x,""y"""'


def test_settings():
    conf = EngineConf.from_map({"cost-factor": "700", "left-space-penalty-factor": "1,10,2,20,1,99", "node-format-x": "%m", "eval-size": "3"})
    assert conf.cost_factor == 700 and conf.penalties() == {1: 10, 2: 20} and conf.formats("x").node_format == "%m" and conf.formats("x").unk_format == ""
    with pytest.raises(ValueError):
        conf.formats("y")
    with pytest.raises(ValueError):
        EngineConf.from_map({"bos-feature": ""})
