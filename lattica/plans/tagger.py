"""One object for single sentences and for tables: parse, n-best, nodes, partial parses, formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import decode
from lattica.operators import format as fmt
from lattica.operators.lattice import Dictionary, Lattice
from lattica.plans.model import BOS, EOS, UNKNOWN, EngineConf, Model, csv_split


@dataclass
class Token:
    surface: str
    feature: str
    begin: int
    start: int
    end: int
    left_id: int
    right_id: int
    pos_id: int
    char_type: int
    stat: int
    wcost: int
    cost: int
    node_id: int
    prob: float = 0.0
    alpha: float = 0.0
    beta: float = 0.0
    isbest: bool = False

    @property
    def length(self) -> int:
        return self.end - self.start

    @property
    def rlength(self) -> int:
        return self.end - self.begin


def format_token(parts: list, t: Token, sentence: bytes, previous: Token | None = None) -> str:
    """The template of operators.format for one token."""
    out, before = [], previous.cost if previous else 0
    for part in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        macro, arg = part
        if macro == "f":
            sep, cells = arg
            fields, printed = csv_split(t.feature), False
            for n in cells:
                if n >= len(fields):
                    raise ValueError("given index is out of range")
                if shown := not fields[n].startswith("*"):
                    out.append(sep * printed + fields[n])
                printed = shown
        elif macro == "pp":
            raise ValueError("no path information is available")
        else:
            special = {
                "S": sentence.decode(),
                "L": len(sentence),
                "M": sentence[t.begin : t.end].decode(),
                "pS": sentence[t.begin : t.start].decode(),
                "pC": t.cost - before - t.wcost,
                "pn": t.cost - before,
                "pb": "*" if t.isbest else " ",
                "ph": t.left_id if arg == "l" else t.right_id,
            }
            value = special[macro] if macro in special else getattr(t, fmt.SIMPLE.get(macro) or fmt.AFTER_P[macro[1]])
            out.append(f"{value:.6f}" if isinstance(value, float) else str(value))
    return "".join(out)


class Tagger:
    """Analysis with one model; options: a named output format, theta, all candidates, n-best."""

    def __init__(self, model: Model, format: str | None = None, theta: float | None = None, all_morphs: bool = False):
        self.model, self.key, self.theta, self.all_morphs = model, format, theta, all_morphs
        self.dictionary = Dictionary(model)
        conf = model.conf.formats(format)
        self.templates = {k: fmt.compile_template(getattr(conf, f"{k}_format")) for k in ("node", "bos", "eos", "eon")}
        falls_back = format is None and conf.unk_format == EngineConf().unk_format
        self.templates["unk"] = self.templates["node"] if falls_back else fmt.compile_template(conf.unk_format)

    def swap(self, model: Model) -> None:
        """Another model; formats stay."""
        self.model, self.dictionary = model, Dictionary(model)

    def _tokens(self, lat: Lattice, nodes, marginal: bool = False) -> list[Token]:
        import numpy as np

        best = set(lat.best().tolist())
        alpha, beta, prob = lat.marginals(self.theta)[:3] if marginal else (np.zeros(len(lat.stat)),) * 3
        surfaces = lat.surfaces(np.asarray(nodes, np.int64))
        return [
            Token(s, lat.feature(int(k)), int(lat.begin[k]), int(lat.start[k]), int(lat.end[k]), int(lat.left[k]), int(lat.right[k]), int(lat.pos[k]), int(lat.kind[k]), int(lat.stat[k]), int(lat.wcost[k]), int(lat.cost[k]), int(lat.id[k]), float(prob[k]), float(alpha[k]), float(beta[k]), int(k) in best)
            for k, s in zip(nodes, surfaces, strict=True)
        ]

    def nodes(self, sentence: str, marginal: bool = False) -> list[Token]:
        """Tokens of the best path, or with all_morphs every candidate, ends included."""
        lat = Lattice([sentence.encode()], self.dictionary)
        if not self.all_morphs:
            return self._tokens(lat, lat.best(), marginal)
        order = sorted(range(len(lat.stat)), key=lambda k: (-1 if lat.stat[k] == BOS else 1 << 40 if lat.stat[k] == EOS else int(lat.begin[k]), -int(lat.id[k])))
        return self._tokens(lat, order, marginal)

    def _written(self, tokens: list[Token], sentence: bytes) -> str:
        out, before = [], None
        for t in tokens:
            name = {BOS: "bos", EOS: "eos", UNKNOWN: "unk"}.get(t.stat, "node")
            out.append(format_token(self.templates[name], t, sentence, before))
            before = t
        return "".join(out)

    def parse(self, sentence: str, marginal: bool = False) -> str:
        return self._written(self.nodes(sentence, marginal), sentence.encode())

    def parse_nbest(self, sentence: str, n: int) -> str:
        """The n cheapest results one after another, then the end-of-n-best text."""
        lat = Lattice([sentence.encode()], self.dictionary)
        out = [self._written(self._tokens(lat, path), sentence.encode()) for _, path in lat.nbest(0, n)]
        end = self._tokens(lat, [int(lat.eos[0])])[0]
        return "".join(out) + format_token(self.templates["eon"], end, sentence.encode())

    def results(self, sentence: str):
        """The results of a sentence one by one, cheapest first, each as (cost, text): ask for as many as are wanted."""
        lat = Lattice([sentence.encode()], self.dictionary)
        for cost, path in lat.paths(0):
            yield cost, self._written(self._tokens(lat, path), sentence.encode())

    def parse_nbest_init(self, sentence: str) -> None:
        """Begin a search that next_result goes on with."""
        self._results = self.results(sentence)

    def next_result(self) -> str | None:
        """The next cheapest result of the sentence begun last; None after the last one."""
        return next((text for _, text in getattr(self, "_results", iter(()))), None)

    def parse_partial(self, block: str) -> str:
        """A block of fragments and constrained tokens."""
        text, given = decode.parse_partial(block)
        lat = Lattice([text], self.dictionary, [given])
        return self._written(self._tokens(lat, lat.best()), text)

    def log_partition(self, sentence: str) -> float:
        return float(Lattice([sentence.encode()], self.dictionary).marginals(self.theta)[4][0])

    def tokenize(self, df: DataFrame, text: str = "sentence") -> DataFrame:
        return decode.tokenize(df, self.model, text)

    def parse_column(self, df: DataFrame, text: str = "sentence", out: str = "parsed") -> DataFrame:
        """df with the formatted best path of a text column."""
        t = decode.tokens_column(df, self.model, text, "__tokens")
        written = fmt.user_format(self.model.conf, self.key)(F.col("__tokens"), F.col(text))
        return t.withColumn(out, written).drop("__tokens", "path_cost")


def nodes_at(nodes: DataFrame, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Candidates that begin, or end, at a byte (all_nodes input)."""
    out = nodes if begin is None else nodes.filter(F.col("begin") == begin)
    return out if end is None else out.filter(F.col("end") == end)
