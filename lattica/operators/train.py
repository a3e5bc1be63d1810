"""Cost training: a conditional random field over lattices, by L-BFGS on the driver and distributed gradients.

The weights' scores depend on a node only through (entry, character class) and on an edge only through (right context of the left token, left context of the right
token), so executors sum probabilities by those keys, Spark adds the partial sums, and the driver (which holds one weight per feature anyway)
spreads them over features. Sentences are never gathered: their lattices are made once, as graphs of labelled nodes, equal graphs are counted, and each step
goes over the written table of distinct ones. Gold tokens that no dictionary entry gives become entries of the training dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.decode import _blocks
from lattica.operators.lattice import Dictionary, Lattice, _ranges, _waves
from lattica.operators.rewrite import Rule, bigram_features, rewrite_one, unigram_features
from lattica.plans.model import BOS, EOS, Model, csv_split
from lattica.plans.shared import bound_batches, materialize, scratch

TEXT = 1 << 17  # bytes of sentences a block
GRAPHS = 1 << 20  # and of graphs
WIDTH = 12  # bytes of a node of a graph


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 5, steps: int = 100, eta: float = 1e-5, patience: int = 3, log: list | None = None) -> np.ndarray:
    """Minimise f (value, gradient): two-loop recursion with a strong Wolfe line search by bracketing and bisection; stops after
    ``patience`` steps in a row of relative change below eta."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    calm = 0
    for _ in range(steps):
        direction = -grad
        stack = []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ direction)
            stack.append(a)
            direction = direction - a * y
        if pairs:
            s, y, rho = pairs[-1]
            direction = direction / (rho * (y @ y))
        for (s, y, rho), a in zip(pairs, reversed(stack), strict=True):
            direction = direction + s * (a - rho * (y @ direction))
        slope = float(grad @ direction)
        if slope >= 0:
            direction, slope, pairs = -grad, -float(grad @ grad), []
        if slope == 0:
            break
        low, high, rate = 0.0, np.inf, 1.0 if pairs else 1 / max(1.0, float(np.sqrt(-slope)))
        for _ in range(25):
            new = x + rate * direction
            new_value, new_grad = f(new)
            if new_value > value + 1e-4 * rate * slope:
                high = rate
            elif float(new_grad @ direction) < 0.9 * slope:
                low = rate
            else:
                break
            rate = (low + high) / 2 if np.isfinite(high) else 2 * rate
        s, y = new - x, new_grad - grad
        if float(s @ y) > 1e-12:
            pairs = [*pairs, (s, y, 1 / float(s @ y))][-memory:]
        change = abs(value - new_value) / max(abs(value), 1e-12)
        x, value, grad = new, new_value, new_grad
        if log is not None:
            log.append(value)
        calm = calm + 1 if change < eta else 0
        if calm >= patience:
            break
    return x


@dataclass
class FeatureIndex:
    """Features of nodes by (entry + 1, class) and of edges by (right context, left context), numbered in order of meeting."""

    names: list[str]
    node_of: np.ndarray  # rows of (node key, feature)
    edge_of: np.ndarray
    n_kinds: int
    left_ctx: np.ndarray  # per entry + 1 (0: ends of the sentence)
    right_ctx: np.ndarray
    n_left: int
    n_right: int
    n_nodes: int

    @classmethod
    def build(cls, model: Model, rules: dict[str, Sequence[Rule]], unigrams: Sequence[str], bigrams: Sequence[str]) -> FeatureIndex:
        ids: dict[str, int] = {}
        features = [model.conf.bos_feature, *model.features]
        need = lambda s, f: rewrite_one(rules[s], f) if rules.get(s) else f

        def contexts(section):
            seen: dict[str, int] = {}
            out = []
            for f in features:
                value = need(section, f)
                if value is None:
                    raise ValueError(f"no {section} rule for {f}")
                out.append(seen.setdefault(value, len(seen)))
            return np.array(out), list(seen)

        left, left_names = contexts("left")
        right, right_names = contexts("right")
        kinds = len(model.class_names)
        node_rows, memo = [], {}
        for e, f in enumerate(features):
            u = need("unigram", f)
            surface = ""
            for k in range(kinds):
                if (u, k) not in memo:
                    memo[u, k] = [ids.setdefault(x, len(ids)) for x in unigram_features(unigrams, u or "", k, surface)]
                node_rows += [(e * kinds + k, i) for i in memo[u, k]]
        edge_rows = []
        for r, rf in enumerate(right_names):
            for k, lf in enumerate(left_names):
                edge_rows += [(r * len(left_names) + k, ids.setdefault(x, len(ids))) for x in bigram_features(bigrams, rf, lf)]
        return cls(list(ids), np.array(node_rows, np.int64).reshape(-1, 2), np.array(edge_rows, np.int64).reshape(-1, 2), kinds, left, right, len(left_names), len(right_names), len(features) * kinds)

    def scores(self, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights by node key and by edge key."""
        return np.bincount(self.node_of[:, 0], alpha[self.node_of[:, 1]], self.n_nodes), np.bincount(self.edge_of[:, 0], alpha[self.edge_of[:, 1]], self.n_left * self.n_right)

    def spread(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Counts by key as counts by feature."""
        out = np.bincount(self.node_of[:, 1], node[self.node_of[:, 0]], len(self.names))
        return out + np.bincount(self.edge_of[:, 1], edge[self.edge_of[:, 0]], len(self.names))


@dataclass
class Labels:
    """Sorts of nodes whose features and contexts are the same, so that no weight tells them apart; node keys of a sort share a number."""

    of: np.ndarray  # per node key
    key: np.ndarray  # a node key of each
    right: np.ndarray  # contexts
    left: np.ndarray
    n_left: int
    n_edges: int

    @classmethod
    def build(cls, index: FeatureIndex) -> Labels:
        rows = index.node_of[np.argsort(index.node_of[:, 0], kind="stable")]
        cuts = np.searchsorted(rows[:, 0], np.arange(1, index.n_nodes))
        seen: dict[bytes, int] = {}
        same = np.array([seen.setdefault(np.sort(x).tobytes(), len(seen)) for x in np.split(rows[:, 1], cuts)])
        entry = np.arange(index.n_nodes) // index.n_kinds
        _, key, of = np.unique(np.stack([same, index.right_ctx[entry], index.left_ctx[entry]]), axis=1, return_index=True, return_inverse=True)
        return cls(of.reshape(-1), key, index.right_ctx[key // index.n_kinds], index.left_ctx[key // index.n_kinds], index.n_left, index.n_left * index.n_right)


def _gold(lat: Lattice, tokens: list[list[tuple[int, int, str]]], size: int, unk_size: int, cells: Callable[[str], list[str]] = csv_split) -> list[list[int]]:
    """Nodes of each sentence's gold tokens (start, end, feature): the first whose leading features agree; none where one is missing, the ends included."""
    out = []
    stat, starts, ends = lat.stat.tolist(), lat.start.tolist(), lat.end.tolist()
    for wanted, bos, eos in zip(tokens, lat.bos.tolist(), lat.eos.tolist(), strict=True):
        spans: dict[tuple[int, int], list[int]] = {}
        for k in range(bos + 1, eos):
            spans.setdefault((starts[k], ends[k]), []).append(k)
        path = [bos]
        for start, end, feature in wanted:
            own = cells(feature)
            same = lambda k: cells(lat.feature(k))[: size if stat[k] == 0 else unk_size] == own[: size if stat[k] == 0 else unk_size]  # noqa: E731, B023
            found = next((k for k in spans.get((start, end), []) if same(k)), None)
            if found is None:
                path = []
                break
            path.append(found)
        out.append([*path, eos] if path else [])
    return out


def _graphs(dictionary: Dictionary, n_kinds: int, labels: Labels, sentences: list[bytes], tokens: list, cells: Callable[[str], list[str]] = csv_split) -> tuple[pa.Array, np.ndarray]:
    """(graphs of the usable sentences, whether each is usable). A graph is a lattice as training sees it: for all nodes between the ends, in order, the ranks of the places where they begin and end, and
    twice their label, one more for gold ones. Sentences of equal graphs have equal sums."""
    lat = Lattice(sentences, dictionary)
    conf = dictionary.model.conf
    gold = _gold(lat, tokens, conf.eval_size, conf.unk_eval_size, cells)
    on = np.zeros(len(lat.stat), np.int64)
    on[[k for path in gold for k in path]] = 1
    usable = np.array([bool(path) for path in gold], bool)
    nodes = np.flatnonzero((lat.stat != BOS) & (lat.stat != EOS) & usable[lat.sentence])
    sentence = lat.sentence[nodes]
    wide = int(lat.text.sizes.max(initial=0)) + 1
    places, rank = np.unique(np.concatenate([sentence * wide + lat.begin[nodes], sentence * wide + lat.end[nodes]]), return_inverse=True)
    rank = rank.reshape(2, -1) - np.searchsorted(places, sentence * wide)
    code = 2 * labels.of[(lat.entry[nodes] + 1) * n_kinds + lat.kind[nodes]] + on[nodes]
    order = np.lexsort((code, rank[1], rank[0], sentence))
    raw = np.stack([rank[0], rank[1], code], 1)[order].astype("<i4").tobytes()
    offsets = np.concatenate([[0], np.cumsum(WIDTH * np.bincount(sentence, minlength=len(sentences))[usable])])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(usable.sum()), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]), usable


def _graph_sums(graphs: list[bytes], copies: np.ndarray, labels: Labels, scores: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Sums by label, then by edge key, of graphs that stand for so many sentences each, then the loss and the number of sentences: observed counts without
    scores (of labels and edges); expected counts and the sum of log Z - gold score with them."""
    rows = np.frombuffer(b"".join(graphs), "<i4").reshape(-1, 3).astype(np.int64)
    size = np.array([len(x) // WIDTH for x in graphs], np.int64) + 2
    eos = np.cumsum(size) - 1
    bos = eos - size + 1
    sentence = np.repeat(np.arange(len(graphs)), size)
    inner = np.ones(len(sentence), bool)
    inner[bos] = inner[eos] = False
    reach = np.zeros(len(graphs), np.int64)
    np.maximum.at(reach, sentence[inner], rows[:, 1])
    begin, end, code = (np.zeros(len(sentence), np.int64) for _ in range(3))
    begin[inner], end[inner], code[inner] = rows.T
    begin[bos], begin[eos], end[eos] = -1, reach, -1
    label, gold = code >> 1, (code & 1).astype(bool)
    label[bos] = label[eos] = labels.of[0]
    gold[bos] = gold[eos] = True
    edge_key = lambda a, b: labels.right[label[a]] * labels.n_left + labels.left[label[b]]
    weight = copies[sentence].astype(np.float64)
    path = np.flatnonzero(gold)
    of_gold = path[1:][begin[path[1:]] >= 0], path[:-1][begin[path[1:]] >= 0]
    total = lambda right, key, w: np.concatenate([np.bincount(label[right], w, len(labels.key)), np.bincount(key, w, labels.n_edges)])
    observed = total(of_gold[0], edge_key(of_gold[1], of_gold[0]), weight[of_gold[0]])
    if scores is None:
        return np.concatenate([observed, [0.0, copies.sum()]])
    # edges by the place where two nodes meet, then by the right node
    slot = np.cumsum(reach + 1) - (reach + 1)
    ending = np.flatnonzero(end >= 0)
    place = slot[sentence[ending]] + end[ending]
    ending = ending[np.argsort(place, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=int((reach + 1).sum())))])
    nodes = np.flatnonzero(begin >= 0)
    nodes = nodes[np.argsort(begin[nodes], kind="stable")]
    wanted = slot[sentence[nodes]] + begin[nodes]
    count = upto[wanted + 1] - upto[wanted]
    right = np.repeat(nodes, count)
    left = ending[np.repeat(upto[wanted], count) + _ranges(count)]
    key = edge_key(left, right)
    score = scores[0][label[right]] + scores[1][key]
    alpha, beta = np.full(len(sentence), -np.inf), np.full(len(sentence), -np.inf)
    alpha[bos] = beta[eos] = 0.0
    _waves(alpha, left, right, score, begin[right])
    order = np.lexsort((left, -begin[right]))
    _waves(beta, right[order], left[order], score[order], -begin[right[order]])
    z = alpha[eos]
    p = np.exp(alpha[left] + score + beta[right] - z[sentence[right]]) * weight[right]
    loss = float(copies @ z) - float(observed @ np.concatenate(scores))
    return np.concatenate([total(right, key, p), [loss, copies.sum()]])


def _by_keys(sums: np.ndarray, index: FeatureIndex, labels: Labels):
    node = np.zeros(index.n_nodes)
    node[labels.key] = sums[: len(labels.key)]
    return node, sums[len(labels.key) : -2], float(sums[-2]), int(sums[-1])


def sentence_sums(model: Model, index: FeatureIndex, sentences: list[bytes], tokens: list, node_score: np.ndarray | None, edge_score: np.ndarray | None):
    """Sums by node and edge key: observed counts without scores; expected counts and sum of log Z - gold score with them. Unusable sentences are left out.

    Of node keys with the same features and contexts one has the sum of all."""
    labels = Labels.build(index)
    graphs = _graphs(Dictionary(model) if not isinstance(model, Dictionary) else model, index.n_kinds, labels, sentences, tokens)[0].to_pylist()
    scores = None if node_score is None else (node_score[labels.key], edge_score)
    return _by_keys(_graph_sums(graphs, np.ones(len(graphs), np.int64), labels, scores), index, labels)


def _distinct(corpus: DataFrame, model: Model, index: FeatureIndex, labels: Labels) -> DataFrame:
    """graph, n: the distinct graphs of a corpus (sentence, tokens array) and how many sentences have each. Equal sentences meet before their lattices are made."""
    spark = corpus.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model, index.n_kinds, labels))
    same = corpus.select("sentence", F.transform("tokens", lambda t: F.struct(t["surface"].alias("surface"), t["feature"].alias("feature"))).alias("tokens")).groupBy("sentence", "tokens").agg(F.count("*").alias("n"))

    def run(batches):
        model, n_kinds, labels = shared.value
        dictionary, cells = Dictionary(model), lru_cache(1 << 14)(csv_split)
        for batch in batches:
            copies = batch.column("n").to_numpy()
            for rows, sentences in _blocks(batch.column("sentence"), TEXT):
                tokens = batch.column("tokens").take(pa.array(rows))
                flat = tokens.flatten()
                size = pc.fill_null(pc.binary_length(flat.field("surface")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                stop = np.cumsum(size)
                bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)))
                first = np.append(stop - size, 0)[bounds[:-1]]
                feature, stop, size = flat.field("feature").to_pylist(), stop.tolist(), size.tolist()
                gold = [[(stop[k] - size[k] - base, stop[k] - base, feature[k]) for k in range(a, b)] for a, b, base in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), strict=True)]
                graphs, usable = _graphs(dictionary, n_kinds, labels, sentences, gold, cells)
                one = graphs.dictionary_encode()
                n = np.bincount(one.indices.to_numpy(zero_copy_only=False), copies[rows][usable], len(one.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([one.dictionary.cast(pa.binary()), pa.array(n)], names=["graph", "n"])

    return same.mapInArrow(run, "graph binary, n long").groupBy("graph").agg(F.sum("n").alias("n"))


def _distributed(graphs: DataFrame, index: FeatureIndex, labels: Labels, shared, scores: tuple[np.ndarray, np.ndarray] | None):
    """Sums of sentence_sums over distinct graphs as arrays; scores None for observed counts."""
    spark = graphs.sparkSession
    score_shared = spark.sparkContext.broadcast(scores and (scores[0][labels.key], scores[1]))

    def run(batches):
        labels, scores = shared.value, score_shared.value
        sums = np.zeros(len(labels.key) + labels.n_edges + 2)
        for batch in batches:
            copies = batch.column("n").to_numpy()
            for rows, some in _blocks(batch.column("graph"), GRAPHS):
                sums += _graph_sums(some, copies[rows], labels, scores)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["k", "v"])

    rows = graphs.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # a row per key at most
    out = np.zeros(len(labels.key) + labels.n_edges + 2)
    out[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    score_shared.destroy()
    return _by_keys(out, index, labels)


def corpus_sentences(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sentence, tokens (tok_idx, surface, feature) of a token table."""
    t = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tok_idx", "surface", "feature"))).alias("tokens"))
    return t.withColumn("sentence", _joined())


def array_sentences(rows: DataFrame, surfaces: Column, feature: Callable[[Column], Column]) -> DataFrame:
    """sentence, tokens (surface, feature) of rows that hold all surfaces of a sentence as an array; rows without one are left out. Nothing is moved."""
    t = rows.select(F.transform(surfaces, lambda w: F.struct(w.alias("surface"), feature(w).alias("feature"))).alias("tokens"))
    return t.filter(F.col("tokens").isNotNull()).withColumn("sentence", _joined())


def _joined() -> Column:
    return F.array_join(F.transform("tokens", lambda x: x["surface"]), "")


def missing_entries(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct gold (surface, feature) that the lexicon doesn't have."""
    return tokens.select("surface", "feature").distinct().join(lexicon.select("surface", "feature"), ["surface", "feature"], "left_anti")


def observed(corpus: DataFrame, model: Model, rules: dict[str, Sequence[Rule]], unigrams: Sequence[str], bigrams: Sequence[str]) -> dict[str, float]:
    """How often each feature stands on a gold path."""
    index = FeatureIndex.build(model, rules, unigrams, bigrams)
    labels = Labels.build(index)
    node, edge, _, _ = _distributed(_distinct(corpus, model, index, labels), index, labels, corpus.sparkSession.sparkContext.broadcast(labels), None)
    return dict(zip(index.names, index.spread(node, edge).tolist(), strict=True))


def train(corpus: DataFrame, model: Model, rules: dict[str, Sequence[Rule]], unigrams: Sequence[str], bigrams: Sequence[str], c: float = 1.0, freq: int = 1, steps: int = 100, eta: float = 1e-4, old: dict[str, float] | None = None, log: list | None = None) -> dict[str, float]:
    """Weights by feature, from a corpus of sentences with gold tokens; the penalty pulls toward the old weights (0 without).

    Features observed fewer than freq times are dropped."""
    spark = corpus.sparkSession
    index = FeatureIndex.build(model, rules, unigrams, bigrams)
    labels = Labels.build(index)
    shared = spark.sparkContext.broadcast(labels)
    with scratch(spark):
        graphs = materialize(_distinct(corpus, model, index, labels), "graphs")
        node, edge, _, _ = _distributed(graphs, index, labels, shared, None)
        observed = index.spread(node, edge)
        keep = observed >= freq
        start = np.array([(old or {}).get(n, 0.0) for n in index.names])

        def f(x: np.ndarray) -> tuple[float, np.ndarray]:
            alpha = np.where(keep, x, 0.0)
            node, edge, loss, _ = _distributed(graphs, index, labels, shared, index.scores(alpha))
            grad = np.where(keep, index.spread(node, edge) - observed + (alpha - start) / c, 0.0)
            return loss + float(((alpha - start) ** 2)[keep].sum()) / (2 * c), grad

        x = lbfgs(f, np.where(keep, start, 0.0), steps=steps, eta=eta, log=log)
    return {n: float(v) for n, v, k in zip(index.names, x, keep, strict=True) if k}


EXACT = 1 << 20


def generate(model: Model, weights: dict[str, float], rules: dict[str, Sequence[Rule]], unigrams: Sequence[str], bigrams: Sequence[str], exact: bool = False) -> Model:
    """A model with costs from weights: word costs, context ids (0 for the ends of sentences, then byte order) and the whole matrix.

    exact: costs are the weights themselves in steps of 1 / EXACT, not quantised to 16 bits; such a model decodes by the weights."""
    index = FeatureIndex.build(model, rules, unigrams, bigrams)
    alpha = np.array([weights.get(n, 0.0) for n in index.names])
    node, edge = index.scores(alpha)
    cost = lambda x: np.round(-x * EXACT).astype(np.int64) if exact else np.trunc(np.clip(-x * model.conf.cost_factor, -32767, 32767)).astype(np.int64)
    features = [model.conf.bos_feature, *model.features]

    def numbering(section, ctx):
        names: dict[int, str] = {}
        for f, k in zip(features, ctx.tolist(), strict=True):
            names.setdefault(k, (rewrite_one(rules[section], f) if rules.get(section) else f) or "")
        first = ctx[0]
        order = [first, *sorted((k for k in names if k != first), key=lambda k: names[k].encode())]
        new = np.empty(len(names), np.int64)
        new[order] = np.arange(len(order))
        return new

    left, right = numbering("left", index.left_ctx), numbering("right", index.right_ctx)
    matrix = np.zeros((index.n_right, index.n_left), np.int64)
    matrix[right] = cost(edge.reshape(index.n_right, index.n_left))[:, np.argsort(left)]
    per_entry = node.reshape(len(features), index.n_kinds)[1:]
    kind = np.array([model.char_class[ord(s.decode()[0]) if ord(s.decode()[0]) < 65536 else 0] for s in model.surfaces] or [0])
    of_entry = np.concatenate([np.repeat(kind, np.diff(model.first)), np.repeat(np.arange(len(model.class_names)), np.diff(model.unknown))]).astype(np.int64)
    from dataclasses import replace

    return replace(model, left=left[index.left_ctx[1:]], right=right[index.right_ctx[1:]], cost=cost(per_entry[np.arange(len(of_entry)), of_entry]), matrix=matrix)
