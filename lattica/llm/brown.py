"""Brown class-based bigram scores: P(text) = product of P(class | class before) * P(word | class).

Learning, over all training documents:
1. counts: every word's count and form (length and kind of its last byte), in one distributed aggregation; the table of counts is
   written and stays a table, whatever its size;
2. exchange of the HOT most frequent words into CLASSES classes, all others standing in the class of their form and the end of a text in
   its own: bigrams are counted once over the whole corpus and written. Each round sums them by word and neighbouring class, in a
   distributed aggregation of at most HOT * classes sums, and moves words on the driver to the class that raises the class bigram
   likelihood most, updating class counts after each move; the best round is kept;
3. exchange of all other words, in tables: every word of the corpus with its counts by neighbouring class is moved from its form to
   the class that raises the likelihood most, by the class counts of step 2, each partition of words by itself;
4. model: class bigrams are counted again with the classes that all words have now (words beyond the NEAR most frequent meet their class by
   joins); transitions with ADD smoothing, emissions (count + EMIT) / (class count + EMIT * (class's words + 1)). A word that training has
   not seen takes the one free place of a class: that where most words of its form stand which occur once.

Scoring: classes and counts of the NEAR most frequent words (fixed bound) are broadcast, so transitions between them are summed where
the text is. All other occurrences leave the text with the classes of their neighbours, meet the written table by a join on distinct words of a
text and come back per text. No count is approximated, no word left out.

Words are identified by 64-bit hashes of their bytes, A-Z lower-cased. Defined results: null and empty texts are the end token alone; null
ids are learned from as the fold of the empty text; repeated rows are scored each; without training rows every token is unseen; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches, materialize, scratch

from .columns import crc_mod
from .textblocks import as_bytes, blocks, word_hashes, word_spans

HOT, CLASSES, ROUNDS = 8192, 64, 4
NEAR = 1 << 17
ADD, EMIT = 0.1, 0.5
FEW = 16
FORMS = 16
END = np.int64(0x7F3A5C1D2B4E6F80)
_BITS = 20
KEYS = 1 << 20
_KIND = np.zeros(256, np.int64)
_KIND[48:58] = 1  # digits
_KIND[65:91] = _KIND[97:123] = 2
_KIND[128:] = 3


def form(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """0 to FORMS - 1, by length and last byte."""
    return np.searchsorted([4, 7, 11], ends - starts, "right") * 4 + _KIND[data[ends - 1]]


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and forms of a block's tokens, ends of texts included (form FORMS), and where each text begins (n + 1)."""
    starts, ends, before = word_spans(offsets, data)
    n = np.diff(before)
    begins = before + np.arange(len(before))
    at = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    h, f = np.full(begins[-1], END), np.full(begins[-1], FORMS)
    h[at] = word_hashes(starts, ends, data).view(np.int64)
    f[at] = form(starts, ends, data)
    return h, f, begins


class Lookup:
    """Sorted hashes behind a bit filter; position of each hash asked for, -1 if it isn't there. slots: numbers set aside for them."""

    def __init__(self, hashes: np.ndarray, slots: int = 0):
        self.hashes, self.slots = hashes, slots
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[hashes & ((1 << _BITS) - 1)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1)
        if len(self.hashes):
            maybe = np.flatnonzero(self.filter[h & ((1 << _BITS) - 1)])
            k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[k] == h[maybe], k, -1)
        return out


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (one array a column) with the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(n[order], first) if len(first) else n


def _counted(names: tuple[str, ...], found):
    """A mapInArrow function that counts the keys which found yields for a block; sums go out whenever about KEYS keys have come together."""

    def run(batches):
        parts, size = [], 0

        def together():
            return _summed([np.concatenate(x) for x in zip(*(keys for keys, _ in parts), strict=True)], np.concatenate([n for _, n in parts]))

        def rows(keys, n):
            return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(n)], names=[*names, "n"])

        for batch in batches:
            offsets, data = as_bytes(batch.column("text"))
            for _, _, offs, part in blocks(offsets, data):
                for keys in found(*tokens(offs, part)):
                    parts.append(_summed([k.astype(np.int64) for k in keys], np.ones(len(keys[0]), np.int64)))
                    size += len(parts[-1][1])
                if size >= KEYS:
                    parts = [together()]
                    size = len(parts[0][1])
                    if size >= KEYS // 2:  # else most were repeats: go on with the sums
                        yield rows(*parts[0])
                        parts, size = [], 0
        if parts:
            yield rows(*together())

    return run


def word_counts(training: DataFrame) -> DataFrame:
    """h, form, n of every token of the training texts (column text)."""
    counts = training.select("text").mapInArrow(_counted(("h", "form"), lambda h, f, _: [(h, f)]), "h long, form long, n long")
    return counts.groupBy("h").agg(F.min("form").cast("int").alias("form"), F.sum("n").alias("n"))


def _symbols(lookup: Lookup, h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Hot words first (lookup.slots numbers), then forms, then the end."""
    k = lookup(h)
    return np.where(k >= 0, k, lookup.slots + f)


def _before(values: np.ndarray, begins: np.ndarray, end: int) -> np.ndarray:
    """The value before each token of its text; the end's at a text's first."""
    out = np.concatenate([[end], values[:-1]])
    out[begins[:-1]] = end
    return out


def _symbol_pairs(lookup: Lookup):
    def found(h, f, begins):
        s = _symbols(lookup, h, f)
        yield _before(s, begins, lookup.slots + FORMS), s

    return found


def _neighbours(lookup: Lookup, classes: np.ndarray):
    """(word, class before) and (word, classes + class after) of every token that is neither hot nor an end."""
    k = int(classes.max()) + 1

    def found(h, f, begins):
        c = classes[_symbols(lookup, h, f)]
        others = np.flatnonzero((lookup(h) < 0) & (h != END))
        yield h[others], _before(c, begins, k - 1)[others]
        yield h[others], k + c[others + 1]

    return found


def _by_class(classes: np.ndarray):
    """Pairs -> sums by (left symbol, right class) and (right symbol, left class)."""
    size, k = len(classes), int(classes.max()) + 1

    def run(batches):
        right, left = np.zeros((size, k), np.int64), np.zeros((size, k), np.int64)
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
            right += np.bincount(a * k + classes[b], n, size * k).astype(np.int64).reshape(size, k)
            left += np.bincount(b * k + classes[a], n, size * k).astype(np.int64).reshape(size, k)
        both = np.concatenate([right.reshape(-1), left.reshape(-1)])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], names=["cell", "n"])

    return run


def _class_sums(pairs: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, k = len(classes), int(classes.max()) + 1
    rows = pairs.mapInArrow(_by_class(classes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * size * k
    both = np.zeros(2 * size * k)
    both[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return both[: size * k].reshape(size, k), both[size * k :].reshape(size, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _likelihood(n: np.ndarray) -> float:
    return float(_xlogx(n).sum() - _xlogx(n.sum(1)).sum() - _xlogx(n.sum(0)).sum())


def _both(cell, r, l):  # noqa: E741
    """What adding r and l to one cell gains beyond adding each by itself."""
    return _xlogx(cell + r + l) - _xlogx(cell + r) - _xlogx(cell + l) + _xlogx(cell)


def exchange(classes: np.ndarray, right: np.ndarray, left: np.ndarray, hot: int) -> np.ndarray:
    """One pass of moves. right[s, c]: bigrams of symbol s before class c; left[s, c]: after class c."""
    classes, k = classes.copy(), right.shape[1]
    n = np.zeros((k, k))
    np.add.at(n, classes, right)
    size = np.bincount(classes[:hot], minlength=k)
    movable = slice(0, CLASSES)
    for w in range(hot):
        r, l, own = right[w], left[w], classes[w]
        if size[own] <= 1 or not (r.any() or l.any()):
            continue
        n[own] -= r
        n[:, own] -= l
        np.maximum(n, 0, out=n)
        rows, columns = n[movable], n[:, movable]
        before, after = rows.sum(1) + l[movable], columns.sum(0) + r[movable]  # the neighbours' own totals don't depend on the class
        gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(columns + l[:, None]) - _xlogx(columns)).sum(0) + _both(n.diagonal()[movable], r[movable], l[movable])
        gain -= _xlogx(before + r.sum()) - _xlogx(before) + _xlogx(after + l.sum()) - _xlogx(after)
        new = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own
        n[new] += r
        n[:, new] += l
        size[own] -= 1
        size[new] += 1
        classes[w] = new
    return classes


def _place(table: np.ndarray):
    """Rows (h, cell, n) sorted by h and cell -> (h, c): the class of CLASSES that gains most by the word's counts with its neighbours' classes."""
    k = len(table)
    rows, columns = table[:CLASSES].T.copy(), table[:, :CLASSES].copy()  # by neighbour: counts of each class before, after it
    sides = np.concatenate([columns, rows])  # cell c: neighbour c stands before; cell k + c: after
    totals = np.stack([table[:, :CLASSES].sum(0), table[:CLASSES].sum(1)])
    plain_sides, plain_totals = _xlogx(sides), _xlogx(totals)
    few = np.stack([_xlogx(sides + x) - plain_sides for x in range(FEW)])  # the gains of small counts, which most are

    def gains(h, cell, n):
        own = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])])  # tasks have counted apart
        h, cell, n = h[own], cell[own], np.add.reduceat(n, own)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        out = np.zeros((len(first), CLASSES))
        step = 1 << 15
        word = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        for lo in range(0, len(h), step):
            c, x, w = cell[lo : lo + step], n[lo : lo + step], word[lo : lo + step]
            gain = few[np.minimum(x, FEW - 1).astype(np.int64), c]
            more = np.flatnonzero(x >= FEW)
            gain[more] = _xlogx(sides[c[more]] + x[more, None]) - plain_sides[c[more]]
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out[w[begin]] += np.add.reduceat(gain, begin)
        sums = [np.add.reduceat(np.where(cell // k == side, n, 0.0), first) for side in (0, 1)]
        for side in (0, 1):
            out -= _xlogx(totals[side] + sums[side][:, None]) - plain_totals[side]
        # where a neighbour is of the class in question, its cells and totals change together
        near = np.flatnonzero(cell % k < CLASSES)
        key, inverse = np.unique(word[near] * CLASSES + cell[near] % k, return_inverse=True)
        w, c = key // CLASSES, key % CLASSES
        at = [np.bincount(inverse, np.where(cell[near] // k == side, n[near], 0.0), len(key)) for side in (0, 1)]
        more = _both(sides[c, c], at[1], at[0])
        for side in (0, 1):
            total, mine, other = totals[side][c], sums[side][w], at[1 - side]
            more -= _both(total, mine, other)
        out[w, c] += more
        return h[first], out.argmax(1)

    def run(batches):
        held = None
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ("h", "cell", "n")]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if len(held[0]) >= 1 << 16:
                cut = int(np.searchsorted(held[0], held[0][-1], "left"))
                if cut:
                    h, c = gains(held[0][:cut], held[1][:cut], held[2][:cut].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int32))], names=["h", "c"])
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            h, c = gains(held[0], held[1], held[2].astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int32))], names=["h", "c"])

    return run


@dataclass
class Model:
    near: np.ndarray  # sorted hashes of the most frequent words, and the end
    near_counts: np.ndarray
    near_classes: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    emit_total: np.ndarray  # per class: denominators of emissions
    unseen: np.ndarray  # per form: class of words that training has not seen
    total: int
    distinct: int

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10((counts + EMIT) / self.emit_total[classes])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def classify(training: DataFrame, counts: DataFrame, hot_words: int = HOT) -> DataFrame:
    """The written table h, form, n, c: every training word's class (0 to CLASSES - 1; the end's is CLASSES)."""
    spark = training.sparkSession
    top = counts.filter(F.col("h") != F.lit(int(END))).orderBy(F.desc("n"), "h").limit(hot_words).toArrow()  # a fixed bound
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    hot = h[np.lexsort((h, -n))]
    by_hash = np.argsort(hot)
    classes = np.concatenate([np.full(hot_words, 0), CLASSES + np.arange(FORMS + 1)])
    classes[: len(hot)] = (np.arange(len(hot)) % CLASSES)[by_hash]
    lookup = Lookup(hot[by_hash], hot_words)
    texts = training.select("text")
    pairs = materialize(texts.mapInArrow(_counted(("a", "b"), _symbol_pairs(lookup)), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "brown-pairs")
    best = None
    for r in range(ROUNDS + 1):
        right, left = _class_sums(pairs, classes)
        table = np.zeros((CLASSES + FORMS + 1,) * 2)
        np.add.at(table, classes, right)
        value = _likelihood(table)
        if best is not None and value <= best[0] + 1e-9 * abs(best[0]):
            break
        best = (value, classes, table)
        if r < ROUNDS:
            classes = exchange(classes, right, left, len(hot))
    _, classes, table = best
    others = texts.mapInArrow(_counted(("h", "cell"), _neighbours(lookup, classes)), "h long, cell long, n long")
    placed = others.repartition("h").sortWithinPartitions("h", "cell").mapInArrow(_place(table), "h long, c int")
    known = spark.createDataFrame(pa.table({"h": pa.array(np.append(lookup.hashes, END)), "c": pa.array(np.append(classes[: len(hot)], CLASSES).astype(np.int32))}))
    return materialize(counts.join(placed.unionByName(known), "h").select("h", "form", "n", "c"), "brown-words")


def _class_pairs(near: Lookup, classes: np.ndarray):
    """(kind, a, b) of neighbouring tokens: the class of near words, the hash of others; kind says which (1: b is a hash, 2: a is, 3: both)."""

    def found(h, f, begins):
        k = near(h)
        c = np.where(k >= 0, classes[k], 0)
        named = np.where(k >= 0, c, h)
        yield 2 * _before(k < 0, begins, False) + (k < 0), _before(named, begins, CLASSES), named

    return found


def _transitions(training: DataFrame, words: DataFrame, near: Lookup, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts of the training texts by the classes of all words."""
    pairs = training.select("text").mapInArrow(_counted(("kind", "a", "b"), _class_pairs(near, classes)), "kind long, a long, b long, n long")
    pairs = materialize(pairs.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "brown-bigrams")
    c = words.select(F.col("h").alias("w"), F.col("c").cast("long").alias("wc"))
    first = pairs.filter("kind >= 2").join(c, F.col("a") == F.col("w")).select((F.col("kind") - 2).alias("kind"), F.col("wc").alias("a"), "b", "n")
    pairs = pairs.filter("kind < 2").unionByName(first)
    second = pairs.filter("kind = 1").join(c, F.col("b") == F.col("w")).select("a", F.col("wc").alias("b"), "n")
    rows = pairs.filter("kind = 0").select("a", "b", "n").unionByName(second).groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # classes squared
    table = np.zeros((CLASSES + 1,) * 2)
    table[rows.column("a").to_numpy(), rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    return table


def learn(training: DataFrame, counts: DataFrame, hot_words: int = HOT, near_words: int = NEAR) -> tuple[Model, DataFrame]:
    """The model of training texts and their written counts table, and the written table of their words (h, form, n, c)."""
    with scratch(training.sparkSession) as keep:
        words = classify(training, counts, hot_words)
        keep(words)
        top = words.filter(F.col("h") != F.lit(int(END))).orderBy(F.desc("n"), "h").limit(near_words).toArrow()  # a fixed bound
        ends = words.filter(F.col("h") == F.lit(int(END))).first()
        h, n, c = (np.append(top.column(x).to_numpy(), y) for x, y in (("h", END), ("n", ends["n"] if ends else 0), ("c", CLASSES)))
        order = np.argsort(h)
        h, n, c = h[order], n[order], c[order].astype(np.int64)
        table = _transitions(training, words, Lookup(h), c)
        step = np.log10((table + ADD) / (table.sum(1, keepdims=True) + ADD * len(table)))
        class_n, class_v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
        for x in words.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a class
            class_n[x["c"]], class_v[x["c"]] = x["n"], x["v"]
        once = np.zeros((FORMS, CLASSES))
        for x in words.filter(f"n = 1 and form < {FORMS}").groupBy("form", "c").agg(F.count("*").alias("v")).collect():  # a row a form and class
            once[x["form"], x["c"]] = x["v"]
        unseen = np.where(once.any(1), once.argmax(1), int(class_v[:CLASSES].argmax()))
    return Model(h, n, c, step, class_n + EMIT * (class_v + 1), unseen, int(class_n.sum()), int(class_v.sum())), words


_FAR = pa.struct([("h", pa.int64()), ("left", pa.int16()), ("right", pa.int16()), ("form", pa.int8())])


def _score_here(model: Model):
    """Sums over near words, and every far occurrence with the classes of its neighbours (-1: far too)."""

    def run(batches):
        near = Lookup(model.near)
        for batch in batches:
            offsets, data = as_bytes(batch.column("text"))
            for a, b, offs, part in blocks(offsets, data):
                h, f, begins = tokens(offs, part)
                k = near(h)
                here = k >= 0
                c = np.where(here, model.near_classes[k], -1)
                n = np.where(here, model.near_counts[k], 0)
                prev = _before(c, begins, CLASSES)
                score = np.where(here, model.emission(n, c) + np.where(prev >= 0, model.step[prev, c], 0.0), 0.0)
                base = np.where(here, model.base(n), 0.0)
                doc = np.repeat(np.arange(b - a), np.diff(begins))
                far = np.flatnonzero(~here)
                items = pa.StructArray.from_arrays(
                    [pa.array(h[far]), pa.array(prev[far].astype(np.int16)), pa.array(c[far + 1].astype(np.int16)), pa.array(f[far].astype(np.int8))], fields=list(_FAR)
                )  # the end follows a text's last word, so far + 1 is in the same text
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(begins).astype(np.int64)),
                        pa.array(np.add.reduceat((n > 0).astype(np.int64), begins[:-1])),
                        pa.array(np.add.reduceat(base, begins[:-1])),
                        pa.array(np.add.reduceat(score, begins[:-1])),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[far], np.arange(b - a + 1)).astype(np.int32)), items),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "far"],
                )

    return run


def _flat(column) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each element of a list column, and the elements; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy()), column.flatten()


def _score_far(model: Model):
    """Adds the far occurrences, whose words' counts and classes have come back per row."""

    def run(batches):
        for batch in batches:
            at, items = _flat(batch.column("far"))
            row, met = _flat(batch.column("met"))
            h, left, right, form = (items.field(x).to_numpy() for x in ("h", "left", "right", "form"))
            known = met.field("h").to_numpy()
            names, inverse = np.unique(np.concatenate([h, known]), return_inverse=True)
            wanted, there = at * max(len(names), 1) + inverse[: len(h)], row * max(len(names), 1) + inverse[len(h) :]
            order = np.argsort(there)
            n, c = np.zeros(len(h), np.int64), model.unseen[form.astype(np.int64)]
            if len(order):
                k = np.minimum(np.searchsorted(there[order], wanted), len(order) - 1)
                found = there[order][k] == wanted
                n[found] = met.field("n").to_numpy()[order][k[found]]
                c[found] = met.field("c").to_numpy()[order][k[found]]
            before = np.where(left >= 0, left, np.concatenate([[0], c[:-1]]) if len(c) else c)  # a far neighbour is the item before
            score = model.emission(n, c) + model.step[before, c] + np.where(right >= 0, model.step[c, np.maximum(right, 0)], 0.0)
            sums = lambda x: np.bincount(at, x, batch.num_rows)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_tokens"),
                    pa.array(batch.column("n_known").to_numpy() + sums(n > 0).astype(np.int64)),
                    pa.array(batch.column("base_score").to_numpy() + sums(model.base(n))),
                    pa.array(batch.column("score").to_numpy() + sums(score)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of docs (doc_id, text)."""
    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    here = docs.select("doc_id", "text").mapInArrow(_score_here(model), f"{columns}, far array<struct<h:long,left:smallint,right:smallint,form:tinyint>>")
    here = materialize(here.withColumn("row", F.monotonically_increasing_id()), "brown-scores")  # written, so that row numbers stay
    far = here.select("row", F.explode(F.array_distinct(F.col("far.h"))).alias("h"))
    met = far.join(words.select("h", "n", "c"), "h").groupBy("row").agg(F.collect_list(F.struct("h", "n", "c")).alias("met"))  # a text's distinct words
    some = here.filter(F.size("far") > 0).join(met, "row", "left").drop("row").mapInArrow(_score_far(model), columns)
    return here.filter(F.size("far") == 0).drop("row", "far").unionByName(some)


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fold: int = 5, held: int = 1, hot_words: int = HOT, near_words: int = NEAR) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all: one row per document."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    training = rows.filter(crc_mod(F.col("doc_id"), fold) != held)
    counts = materialize(word_counts(training), "brown-counts")
    model, words = learn(training, counts, hot_words, near_words)
    scored = score(rows, model, words)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
