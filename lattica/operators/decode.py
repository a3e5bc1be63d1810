"""Sentence analysis as DataFrame operators: one stage from scan to tokens, no exchange.

The model goes to the executors once, as a broadcast of fixed size (``Model.size`` is checked against LIMIT; larger dictionaries use
``operators.relational``). Each Arrow batch is decoded in blocks of about BLOCK bytes of sentences.

Null sentences are empty; an empty or blank sentence has no tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.lattice import INSIDE, TOKEN, Dictionary, Lattice, Text, characters, parted, unknown_spans
from lattica.operators.parts import CONTEXTS, Best, best, costs
from lattica.plans.model import BOS, EOS, Model

BLOCK = 1 << 20
PARTS = 1 << 22
ROWS = 1 << 18  # results of a batch that goes out at once, where sentences repeat
LIMIT = 1 << 30
TOKEN_FIELDS = "surface string, feature string, begin int, start int, end int, length int, rlength int, left_id int, right_id int, pos_id int, char_type int, stat int, wcost int, cost long, node_id int"
FIELDS = tuple(x.split()[0] for x in TOKEN_FIELDS.split(", "))
_FEATURES: dict[str, tuple] = {}


def _schema(fields: Sequence[str]) -> str:
    return ", ".join(x for x in TOKEN_FIELDS.split(", ") if x.split()[0] in fields)




class _Decoder:
    """Holds a broadcast model and, per Python worker, its dictionary."""

    def __init__(self, spark: SparkSession, model: Model):
        if model.size > LIMIT:
            raise ValueError("the dictionary is too large to send to every executor; use operators.relational")
        self.shared = spark.sparkContext.broadcast(model)
        self.key = uuid.uuid4().hex

    def ready(self) -> tuple[Dictionary, pa.Array]:
        if self.key not in _FEATURES:  # one model a worker at a time
            m = self.shared.value
            _FEATURES.clear()
            _FEATURES[self.key] = (Dictionary(m), pa.array([*m.features, m.conf.bos_feature], pa.string()))
        return _FEATURES[self.key]


def _blocks(column: pa.Array, limit: int = BLOCK, alike: bool = True) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rows, sentences) of similar lengths, or of any where alike isn't asked for, about so many bytes together."""
    texts = column.cast(pa.large_binary()).to_pylist()
    if column.null_count:
        texts = [b"" if x is None else x for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    total = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        if alike:
            stop = max(at + 1, min(stop, int(np.searchsorted(sizes[order], 2 * sizes[order[at]] + 64, "right"))))
        rows = order[at:stop]
        yield rows, [texts[i] for i in rows]
        at = stop


def _parted(model: Model, contexts: int = 1) -> bool:
    return parted(model) and len(np.unique(np.append(model.right, 0))) <= contexts and (contexts > 1 or model.matrix.shape == (1, 1))


def _best(sentences: list[bytes], dictionary: Dictionary) -> tuple[Lattice | Best, np.ndarray, np.ndarray]:
    """(lattice or its best paths by parts, tokens of the best paths, total costs)."""
    found = best(sentences, dictionary, _blocks, _strings)
    if found is not None:
        return found, np.arange(len(found.sentence)), found.total
    lat = Lattice(sentences, dictionary)
    nodes = lat.best()
    return lat, nodes[(lat.stat[nodes] != BOS) & (lat.stat[nodes] != EOS)], lat.cost[lat.eos]


def _strings(lat: Lattice | Best, nodes: np.ndarray) -> pa.Array:
    """Surfaces of nodes, gathered from the block's bytes."""
    if isinstance(lat, Best):
        return lat.strings()  # its nodes are all asked for
    base = lat.text.offsets[lat.sentence[nodes]]
    start, size = base + lat.start[nodes], lat.end[nodes] - lat.start[nodes]
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(nodes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lat.text.data[at])))


def _features(lat: Lattice, nodes: np.ndarray, features: pa.Array) -> pa.Array:
    entry = lat.entry[nodes]
    out = features.take(pa.array(np.where(entry >= 0, entry, len(features) - 1)))
    if lat.virtual:
        values = out.to_pylist()
        for i, k in enumerate(nodes.tolist()):
            if k in lat.virtual:
                values[i] = lat.virtual[k]
        out = pa.array(values, pa.string())
    return out


def _token_arrays(lat: Lattice | Best, nodes: np.ndarray, features: pa.Array, fields: Sequence[str] = FIELDS) -> dict[str, pa.Array]:
    i32 = lambda a: pa.array(a.astype(np.int32))
    blank = lambda: (lat.stat[nodes] == BOS) | (lat.stat[nodes] == EOS)
    plain = {"start": "start", "end": "end", "left_id": "left", "right_id": "right", "pos_id": "pos", "char_type": "kind", "stat": "stat", "wcost": "wcost", "node_id": "id"}
    made = {
        "surface": lambda: _strings(lat, nodes),
        "feature": lambda: _features(lat, nodes, features),
        "begin": lambda: i32(np.where(lat.stat[nodes] == EOS, lat.start[nodes], lat.begin[nodes])),
        "length": lambda: i32(np.where(blank(), 0, lat.end[nodes] - lat.start[nodes])),
        "rlength": lambda: i32(np.where(blank(), 0, lat.end[nodes] - lat.begin[nodes])),
        "cost": lambda: pa.array(lat.cost[nodes]),
    }
    return {f: i32(getattr(lat, plain[f])[nodes]) if f in plain else made[f]() for f in fields}


def _copies(counts: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(copy, index into row) of the results that each copy of a sentence takes, where sentence i has counts[i] copies that follow one another
    and row, the sentence of each result, doesn't fall; in pieces of about ROWS results."""
    first = np.searchsorted(row, np.arange(len(counts) + 1))
    begin, size = np.repeat(first[:-1], counts), np.repeat(np.diff(first), counts)  # of each copy
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ROWS, "right")))
        n = size[at:stop]
        yield np.repeat(np.arange(at, stop), n), np.repeat(begin[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = stop


def _apply(df: DataFrame, text: str, schema: str, work, by_parts: bool = False) -> DataFrame:
    """work(sentences) -> (index of the sentence, arrays) for rows of schema, beside all columns of df; the index doesn't fall.

    Equal sentences of a batch are worked on once. Work by parts takes larger blocks, in which more of them are equal."""
    kept = [f for f in df.schema if f.name != text]
    names = [f.name for f in kept] + [x.split()[0] for x in _columns(schema)]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            one = batch.column(at).cast(pa.large_binary()).fill_null(b"").dictionary_encode()  # nulls are empty
            code = one.indices.to_numpy(zero_copy_only=False)
            by_code = np.argsort(code, kind="stable")  # rows of the same sentence together
            copies = np.bincount(code, minlength=len(one.dictionary))
            first = np.cumsum(copies) - copies
            for which, sentences in _blocks(one.dictionary, *((PARTS, False) if by_parts else ())):
                row, arrays = work(sentences)
                if len(by_code) == len(one.dictionary):
                    parts = [(row, None)]
                else:
                    parts = _copies(copies[which], row)
                n = copies[which]
                rows = by_code[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                for copy, index in parts:
                    take = pa.array(rows[copy])
                    got = arrays if index is None else [a.take(pa.array(index)) for a in arrays]
                    yield pa.RecordBatch.from_arrays([batch.column(f.name).take(take) for f in kept] + got, names=names)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{out}, {schema}" if out else schema)


def _sums(df: DataFrame, text: str, schema: str, work) -> DataFrame:
    """Partial sums of a text column: work(sentences, copies of each) -> arrays of schema, for each block of a batch."""
    names = [x.split()[0] for x in _columns(schema)]

    def run(batches):
        for batch in batches:
            one = batch.column(0).cast(pa.large_binary()).fill_null(b"").dictionary_encode()
            copies = np.bincount(one.indices.to_numpy(zero_copy_only=False), minlength=len(one.dictionary))
            for which, sentences in _blocks(one.dictionary):
                yield pa.RecordBatch.from_arrays(work(sentences, copies[which]), names=names)

    return df.select(text).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew only where its scan has fewer partitions than the cluster has cores (a small file, one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def _columns(schema: str) -> list[str]:
    depth, out, now = 0, [], ""
    for ch in schema:
        depth += ch in "<(" and 1 or 0
        depth -= ch in ">)" and 1 or 0
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def tokenize(df: DataFrame, model: Model, text: str = "sentence", with_ends: bool = False, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per token of the cheapest path: the other columns of df, tok_idx and TOKEN_FIELDS, or those of them that are asked for.

    with_ends keeps the begin and end nodes (tok_idx of BOS is -1)."""
    decoder, fields = _Decoder(df.sparkSession, model), [f for f in FIELDS if f in fields]

    def work(sentences):
        dictionary, features = decoder.ready()
        if with_ends:
            lat = Lattice(sentences, dictionary)
            nodes = lat.best()
        else:
            lat, nodes, _ = _best(sentences, dictionary)
        row = lat.sentence[nodes]
        first = np.searchsorted(row, row, "left")
        return row, [pa.array((np.arange(len(row)) - first - with_ends).astype(np.int32)), *_token_arrays(lat, nodes, features, fields).values()]

    return _apply(df, text, f"tok_idx int, {_schema(fields)}", work, by_parts=_parted(model))


def tokens_column(df: DataFrame, model: Model, text: str = "sentence", out: str = "tokens", fields: Sequence[str] = FIELDS) -> DataFrame:
    """df with an array column of token structs (of the fields asked for) and the path's cost; the text column stays."""
    decoder, fields = _Decoder(df.sparkSession, model), [f for f in FIELDS if f in fields]

    def work(sentences):
        dictionary, features = decoder.ready()
        lat, nodes, total = _best(sentences, dictionary)
        arrays = _token_arrays(lat, nodes, features, fields)
        values = pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays))
        offsets = np.searchsorted(lat.sentence[nodes], np.arange(len(sentences) + 1)).astype(np.int32)
        return np.arange(len(sentences)), [pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(total)]

    schema = ",".join(x.replace(" ", ":") for x in _schema(fields).split(", "))
    return _apply(df.withColumn("__s", F.col(text)), "__s", f"{out} array<struct<{schema}>>, path_cost long", work, by_parts=_parted(model))


def written(df: DataFrame, model: Model, text: str = "sentence", kind: str | None = None, out: str = "text") -> DataFrame:
    """The other columns of df and the best path as text, made where it is found: by default the lines of format.default_format, for "wakati" those of format.wakati."""
    decoder = _Decoder(df.sparkSession, model)

    def work(sentences):
        dictionary, features = decoder.ready()
        lat, nodes, _ = _best(sentences, dictionary)
        surface = _strings(lat, nodes)
        if kind == "wakati":
            token, end = pc.binary_join_element_wise(surface, " ", ""), "\n"
        else:
            token, end = pc.binary_join_element_wise(surface, _features(lat, nodes, features), "\t"), "EOS\n"
            token = pc.binary_join_element_wise(token, "\n", "")
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(lat.sentence[nodes], np.arange(len(sentences) + 1)).astype(np.int32)), token)
        return np.arange(len(sentences)), [pc.binary_join_element_wise(pc.binary_join(lists, ""), end, "")]

    if kind not in (None, "wakati"):
        raise ValueError(f"no such format: {kind}")
    return _apply(df, text, f"{out} string", work, by_parts=_parted(model))


def min_cost(df: DataFrame, model: Model, text: str = "sentence") -> DataFrame:
    """Cost of the cheapest path of each sentence."""
    decoder = _Decoder(df.sparkSession, model)

    def work(sentences):
        return np.arange(len(sentences)), [pa.array(costs(sentences, decoder.ready()[0], _blocks))]

    return _apply(df, text, "path_cost long", work, by_parts=_parted(model, CONTEXTS))


def all_nodes(df: DataFrame, model: Model, text: str = "sentence", theta: float | None = None) -> DataFrame:
    """Every reachable node in printing order (by begin, last made first), with probabilities and whether it is on the best path."""
    decoder = _Decoder(df.sparkSession, model)

    def work(sentences):
        dictionary, features = decoder.ready()
        lat = Lattice(sentences, dictionary)
        alpha, beta, prob, _, _ = lat.marginals(theta)
        on = np.zeros(len(lat.stat), bool)
        on[lat.best()] = True
        key = np.where(lat.stat == BOS, -1, np.where(lat.stat == EOS, np.int64(1) << 40, lat.begin))
        nodes = np.lexsort((-lat.id, key, lat.sentence))
        arrays = list(_token_arrays(lat, nodes, features).values())
        return lat.sentence[nodes], [*arrays, pa.array(on[nodes]), pa.array(alpha[nodes]), pa.array(np.where(np.isfinite(beta[nodes]), beta[nodes], np.float32(0))), pa.array(prob[nodes])]

    return _apply(df, text, f"{TOKEN_FIELDS}, isbest boolean, alpha float, beta float, prob float", work)


def lattice_paths(df: DataFrame, model: Model, text: str = "sentence", theta: float | None = None) -> DataFrame:
    """Every edge: lnode_id, rnode_id, cost, prob, and the features of both nodes."""
    decoder = _Decoder(df.sparkSession, model)

    def work(sentences):
        dictionary, features = decoder.ready()
        lat = Lattice(sentences, dictionary)
        _, _, _, (left, right, cost, prob), _ = lat.marginals(theta)
        order = np.lexsort((lat.id[left], lat.id[right], lat.sentence[right]))
        left, right = left[order], right[order]
        ids = [pa.array(lat.id[x].astype(np.int32)) for x in (left, right)]
        return lat.sentence[right], [*ids, pa.array(cost[order]), pa.array(prob[order]), _features(lat, left, features), _features(lat, right, features)]

    return _apply(df, text, "lnode_id int, rnode_id int, path_cost long, path_prob float, lfeature string, rfeature string", work)


def log_partition(df: DataFrame, model: Model, text: str = "sentence", theta: float | None = None) -> DataFrame:
    """log Z of each sentence."""
    decoder = _Decoder(df.sparkSession, model)

    def work(sentences):
        lat = Lattice(sentences, decoder.ready()[0])
        return np.arange(len(sentences)), [pa.array(lat.marginals(theta)[4])]

    return _apply(df, text, "z double", work)


def unknown_counts(df: DataFrame, model: Model, text: str = "sentence") -> DataFrame:
    """class_id, step, n, n_chars: unknown words of all positions, counted by class and step (see lattice.unknown_spans)."""
    decoder = _Decoder(df.sparkSession, model)

    def work(sentences, copies):
        dictionary, block = decoder.ready()[0], Text(sentences)
        c = characters(block, dictionary.model)
        last = np.searchsorted(c.sentence, np.arange(len(block.sizes)), "right")[c.sentence] if len(c.at) else c.at
        heads = np.flatnonzero((c.mask & dictionary.model.char_mask[0x20]) == 0)
        who, _, _ = dictionary.matches(block, c.at[heads], block.offsets[c.sentence[heads] + 1])
        hit = np.zeros(len(heads), bool)
        hit[who] = True
        want, wu, end, step = unknown_spans(c, dictionary.model, last, heads, hit)
        begin = heads[want][wu]
        key, index = np.unique(c.kind[begin] << 21 | step, return_inverse=True)
        n = copies[c.sentence[begin]]
        total = lambda x: pa.array(np.bincount(index, x, len(key)).astype(np.int64))
        return [pa.array((key >> 21).astype(np.int32)), pa.array((key & ((1 << 21) - 1)).astype(np.int32)), total(n), total(n * (end - begin))]

    parts = _sums(df, text, "class_id int, step int, n long, n_chars long", work)
    return parts.groupBy("class_id", "step").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"))


def nbest(df: DataFrame, model: Model, n: int, text: str = "sentence") -> DataFrame:
    """Up to n cheapest paths of each sentence: rank (from 1), path_cost, tok_idx and TOKEN_FIELDS; token costs are those of the best path to each node."""
    decoder = _Decoder(df.sparkSession, model)
    if not 1 <= n <= 512:
        raise ValueError("n must be between 1 and 512")

    def work(sentences):
        dictionary, features = decoder.ready()
        lat = Lattice(sentences, dictionary)
        row, rank, cost, idx, nodes = [], [], [], [], []
        for i in range(len(sentences)):
            for r, (c, path) in enumerate(lat.nbest(i, n), 1):
                inner = path[1:-1] or [path[-1]]  # a sentence without tokens is its end alone
                nodes += inner
                row += [i] * len(inner)
                rank += [r] * len(inner)
                cost += [c] * len(inner)
                idx += range(len(inner))
        at = np.array(nodes, np.int64)
        head = [pa.array(np.array(rank, np.int32)), pa.array(np.array(cost, np.int64)), pa.array(np.array(idx, np.int32))]
        return np.array(row, np.int64), [*head, *_token_arrays(lat, at, features).values()]

    return _apply(df, text, f"rank int, path_cost long, tok_idx int, {TOKEN_FIELDS}", work)


def parse_partial(block: str) -> tuple[bytes, tuple[dict[int, int], dict[int, tuple[int, str]]]]:
    """Sentence and constraints of a block of surface[TAB pattern] lines; a lone EOS ends it."""
    text, edges, features = bytearray(), {}, {}
    for line in block.split("\n"):
        surface, tab, pattern = line.partition("\t")
        if line == "EOS":
            break
        raw = surface.encode()
        a, b = len(text), len(text) + len(raw)
        edges[a] = edges[b] = TOKEN
        if tab:
            features[a] = (b, pattern)
            edges.update({p: INSIDE for p in range(a + 1, b)})
        text += raw
    return bytes(text), (edges, features)


def tokenize_partial(df: DataFrame, model: Model, text: str = "block") -> DataFrame:
    """Tokens of blocks under their own boundaries and features."""
    decoder = _Decoder(df.sparkSession, model)

    def work(blocks):
        dictionary, features = decoder.ready()
        parsed = [parse_partial(x.decode()) for x in blocks]
        lat = Lattice([x for x, _ in parsed], dictionary, [c for _, c in parsed])
        nodes = lat.best()
        nodes = nodes[(lat.stat[nodes] != BOS) & (lat.stat[nodes] != EOS)]
        row = lat.sentence[nodes]
        first = np.searchsorted(row, row, "left")
        return row, [pa.array((np.arange(len(row)) - first).astype(np.int32)), *_token_arrays(lat, nodes, features).values()]

    return _apply(df, text, f"tok_idx int, {TOKEN_FIELDS}", work)


def alternatives(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes beside a best one: the same begin and end (all_nodes input)."""
    best = nodes.filter("isbest and stat < 2").select(*keys, "begin", "end", F.col("node_id").alias("best_id"), F.col("feature").alias("best_feature"))
    return nodes.filter("stat < 2").join(best, [*keys, "begin", "end"]).filter("node_id <> best_id")


def register_sql(spark: SparkSession, model: Model, name: str = "morph_tokenize") -> None:
    """A table function for SQL: SELECT ... FROM t, LATERAL morph_tokenize(t.sentence). A call is one sentence; tokenize decodes blocks of them at once."""
    from pyspark.sql.functions import udtf

    shared = _Decoder(spark, model).shared  # checks the size

    @udtf(returnType="tok_idx: int, surface: string, feature: string, start: int, stat: int, cost: long")
    class Tokenize:
        def __init__(self):
            self.dictionary = Dictionary(shared.value)

        def eval(self, sentence: str):
            lat = Lattice([(sentence or "").encode()], self.dictionary)
            nodes = lat.best()[1:-1]
            for i, (k, surface) in enumerate(zip(nodes.tolist(), lat.surfaces(nodes), strict=True)):
                yield i, surface, lat.feature(k), int(lat.start[k]), int(lat.stat[k]), int(lat.cost[k])

    spark.udtf.register(name, Tokenize)


def token_type() -> T.StructType:
    return T._parse_datatype_string(TOKEN_FIELDS)


def expected_counts(nodes: DataFrame, paths: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Corpus-level expected counts: kind U or B, left, right, expected, of probabilities of floor and more."""
    u = nodes.filter(F.col("prob") >= floor).groupBy(F.lit("U").alias("kind"), F.lit("").alias("left"), F.col("feature").alias("right")).agg(F.sum(F.col("prob").cast("double")).alias("expected"))
    b = paths.filter(F.col("path_prob") >= floor).groupBy(F.lit("B").alias("kind"), F.col("lfeature").alias("left"), F.col("rfeature").alias("right")).agg(F.sum(F.col("path_prob").cast("double")).alias("expected"))
    return u.unionByName(b)


def column(tokens: Column, field: str) -> Column:
    return F.transform(tokens, lambda t: t[field])
