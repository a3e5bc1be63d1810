"""Toxic spans and document scores from a linear-chain conditional random field over two token labels.

Tokens are runs of letters. Their features are the word and its first PREFIXES bytes (stems with changing endings).

Training, on a bounded sample of labelled documents (at most TOXIC_ROWS toxic and CLEAN_ROWS others, those with the
lowest hashes of their ids, one row an id, texts of at most ROW_BYTES; all three are parameters, so the one task that fits has at most their product
in bytes, whatever the tables hold; features are as many as this sample gives):
1. features are kept that stand in at least SUPPORT toxic documents and PLACES different surroundings there (so that copies do
   not count) and whose document rate among toxic ones is LIFT times that
   among others; a token of a toxic document that has such a feature is labelled 1, all others 0;
2. the field is fitted to windows of labelled tokens around such tokens, in both kinds of documents, and to evenly spread windows
   of clean text, by L2-penalised likelihood with forward-backward gradients;
3. a logistic layer maps each document's marginals (largest log-odds, expected number of toxic tokens) to its score; its rows
   count by the inverse of their kind's sampling rate, so that scores follow the labels' true share at every size.

Scoring covers whole texts. Tokens without features all have the same factors, so a run of n of them is the n-th power of
one 2x2 matrix, in closed form; forward-backward runs over the others and is exact. Marginals of 0.5 and more make
spans. Memory follows a block of texts.

Defined results: null and empty texts score like a text without toxic tokens; equal texts score equally (ids, languages
and sources are never read); without labelled rows of either kind every score is the share of toxic rows or 0; labelled
ids without a document, null labels and null ids are not learned from; repeated rows are rows of their own.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches

from .columns import crc_mod
from .textblocks import Prefixes, as_bytes, blocks, is_letter_table, lower_latin, word_spans

PREFIXES = (3, 4, 5, 6, 7, 8)
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
SUPPORT, PLACES, LIFT = 4, 4, 8.0
WINDOW = 8
ROW_BYTES = 1 << 16
FILTER_BITS = 20
_LETTER = is_letter_table()


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    chain: np.ndarray  # bias of label 1, and the factors' logs 0->1, 1->0, 1->1
    layer: np.ndarray  # intercept, and factors of the document's two figures
    constant: float = 0.0  # the score where nothing could be learned

    def filter(self) -> np.ndarray:
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[self.features & np.uint64((1 << FILTER_BITS) - 1)] = True
        return seen


def _spans(offsets, data):
    data = lower_latin(data)
    starts, ends, before = word_spans(offsets, data, _LETTER)
    return data, starts, ends, before


def _features(starts, ends, data):
    """(token, hash) of every feature of a block."""
    p = Prefixes(starts, ends, data)
    yield np.arange(len(starts)), p.whole()
    for k in PREFIXES:
        yield p.first(k)


def _found(model: Model, seen: np.ndarray, starts, ends, data) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with known features, rising, and the sums of their weights."""
    ats, ws = [], []
    for at, h in _features(starts, ends, data):
        hit = np.flatnonzero(seen[h & np.uint64((1 << FILTER_BITS) - 1)])
        h = h[hit]
        k = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
        same = model.features[k] == h
        ats.append(at[hit][same])
        ws.append(model.weights[k[same]])
    at, w = np.concatenate(ats), np.concatenate(ws)
    tokens, inverse = np.unique(at, return_inverse=True)
    return tokens, np.bincount(inverse, w, len(tokens))


def _power(chain: np.ndarray, n: np.ndarray) -> np.ndarray:
    """M**n up to a positive factor, M[i, j] = factor of i -> j times that of a token without features; n >= 0."""
    b, t01, t10, t11 = chain
    m = np.array([[1.0, np.exp(t01 + b)], [np.exp(t10), np.exp(t11 + b)]])
    half, root = (m[0, 0] + m[1, 1]) / 2, np.sqrt(((m[0, 0] - m[1, 1]) / 2) ** 2 + m[0, 1] * m[1, 0])
    one, two = half + root, half - root
    ratio = (two / one) ** n.astype(float)
    eye = np.eye(2)
    return ((m - two * eye)[None] - ratio[:, None, None] * (m - one * eye)[None]) / (one - two)


def marginals(chain: np.ndarray, doc: np.ndarray, token: np.ndarray, weight: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """P(label 1) at the given tokens (sorted by document and place) of documents of n_tokens; exact forward-backward."""
    if not len(doc):
        return np.zeros(0)
    b, t01, t10, t11 = chain
    t = np.exp(np.array([[0.0, t01], [t10, t11]]))
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)])
    place = np.arange(len(doc)) - np.repeat(first, count)
    gap = token - np.r_[-1, token[:-1]] - 1
    gap[first] = token[first]
    tail = n_tokens[doc[first + count - 1]] - token[first + count - 1] - 1
    # documents by falling number of tokens: those still running are always the first ones
    rank = np.argsort(-count, kind="stable")
    first, count, tail = first[rank], count[rank], tail[rank]
    steps = int(count[0])
    running = np.searchsorted(-count, -np.arange(1, steps + 1), "right")
    emit = np.exp(np.clip(weight + b, -30, 30))
    between = _power(chain, gap) @ t  # run of plain tokens, then the step into this token
    start = np.ones((len(first), 2))
    alpha = np.zeros((len(doc), 2))
    state = start
    for s in range(steps):
        r = running[s]
        at = first[:r] + s
        if s == 0:  # the first token of a text has no step before it: its factors alone
            begins = np.where(gap[at] > 0, gap[at] - 1, 0)
            lead = np.stack([np.ones(r), np.full(r, np.exp(b))], 1)
            into = np.einsum("ij,ijk->ik", lead, _power(chain, begins)) @ t
            new = np.where((gap[at] > 0)[:, None], into, 1.0)
        else:
            new = np.einsum("ij,ijk->ik", state[:r], between[at])
        new = new * np.stack([np.ones(r), emit[at]], 1)
        state = new / new.sum(1, keepdims=True)
        alpha[at] = state
    beta = np.zeros((len(doc), 2))
    last = first + count - 1
    ending = _power(chain, tail).sum(2)
    beta[last] = ending / ending.sum(1, keepdims=True)
    for s in range(steps - 2, -1, -1):
        r = running[s + 1]
        at = first[:r] + s
        nxt = np.stack([np.ones(r), emit[at + 1]], 1) * beta[at + 1]
        back = np.einsum("ijk,ik->ij", between[at + 1], nxt)
        beta[at] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1)


def _figures(doc: np.ndarray, p: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Per document: largest log-odds, and log of 1 + the expected number of toxic tokens."""
    top = np.full(len(n_tokens), 1e-6)
    np.maximum.at(top, doc, np.clip(p, 1e-6, 1 - 1e-6))
    return np.stack([np.log(top / (1 - top)), np.log1p(np.bincount(doc, p, len(n_tokens)))], 1)


def _score(model: Model, figures: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.layer[0] + figures @ model.layer[1:], -40, 40)))


# ---------------------------------------------------------------------------------------------------------- training


def _window_gradient(theta, chain_n, slots, token_features, shape, labels, mask, l2):
    """Penalised negative log-likelihood and gradient over windows (rows) of equal length, padded on the right."""
    chain, weights = theta[:chain_n], theta[chain_n:]
    b, t01, t10, t11 = chain
    emit = np.zeros(shape[0] * shape[1])
    np.add.at(emit, slots, weights[token_features])
    emit = emit.reshape(shape) + b
    t = np.array([[0.0, t01], [t10, t11]])
    n, length = shape
    la = np.zeros((n, length, 2))
    la[:, 0, 1] = emit[:, 0]
    for s in range(1, length):
        step = np.logaddexp(la[:, s - 1, 0:1] + t[0], la[:, s - 1, 1:2] + t[1])
        step[:, 1] += emit[:, s]
        la[:, s] = np.where(mask[:, s : s + 1], step, la[:, s - 1])
    z = np.logaddexp(la[:, -1, 0], la[:, -1, 1])
    lb = np.zeros((n, length, 2))
    p11, p01, p10 = 0.0, 0.0, 0.0
    for s in range(length - 2, -1, -1):
        ahead = lb[:, s + 1].copy()
        ahead[:, 1] += emit[:, s + 1]
        step = np.stack([np.logaddexp(ahead[:, 0] + t[i, 0], ahead[:, 1] + t[i, 1]) for i in (0, 1)], 1)
        on = mask[:, s + 1]
        lb[:, s] = np.where(on[:, None], step, lb[:, s + 1])
        pair = lambda i, j: float(np.exp(la[:, s, i] + t[i, j] + ahead[:, j] - z)[on].sum())  # noqa: E731, B023
        p01, p10, p11 = p01 + pair(0, 1), p10 + pair(1, 0), p11 + pair(1, 1)
    p = np.where(mask, np.exp(la[:, :, 1] + lb[:, :, 1] - z[:, None]), 0.0)
    y = np.where(mask, labels, 0)
    both = mask[:, 1:]
    o01, o10, o11 = (float(((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()) for i, j in ((0, 1), (1, 0), (1, 1)))
    gold = float((emit * y).sum()) + o01 * t01 + o10 * t10 + o11 * t11
    diff = (p - y).reshape(-1)
    grad = np.empty_like(theta)
    grad[:chain_n] = diff.sum(), p01 - o01, p10 - o10, p11 - o11
    grad[chain_n:] = np.bincount(token_features, diff[slots], len(weights))
    return float(z.sum()) - gold + l2 / 2 * float(theta @ theta), grad + l2 * theta


def _descend(f, theta: np.ndarray, steps: int = 60, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = f(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            used.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        rate = 1.0
        for _ in range(20):
            new = theta - rate * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * rate * float(grad @ q):
                break
            rate /= 2
        else:
            return theta
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-10:
            pairs = [*pairs, (s, y)][-memory:]
        small = value - new_value < 1e-6 * abs(value)
        theta, value, grad = new, new_value, new_grad
        if small:
            break
    return theta


def _document_features(texts: pa.Array, wanted=None):
    """Per block: first row, token counts, and arrays (doc, token, hash) of all features or of the wanted ones; last, the tokens' hashes."""
    offsets, data = as_bytes(texts)
    for a, _, offs, part in blocks(offsets, data):
        part, starts, ends, before = _spans(offs, part)
        n = np.diff(before)
        doc = np.repeat(np.arange(len(n)), n)
        ats, hs, whole = [], [], None
        for at, h in _features(starts, ends, part):
            whole = h if whole is None else whole
            if wanted is not None:
                k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = np.flatnonzero(wanted[k] == h)
                at, h = at[hit], k[hit]
            ats.append(at)
            hs.append(h)
        at, h = np.concatenate(ats), np.concatenate(hs)
        yield a, n, doc[at], at - before[doc[at]], h, (at, whole)


def _once(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """h without repeats inside a document."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    return h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]] if len(h) else h


def _surroundings(whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the tokens before and after."""
    around = np.concatenate([np.zeros(1, np.uint64), whole, np.zeros(1, np.uint64)])
    return around[at] * np.uint64(0x9E3779B97F4A7C15) + around[at + 2]


def _select(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features that mark toxic documents. The others' features are only counted, never kept.

    Support counts different surroundings, not documents: a word of a text that was copied often stands in one place only."""
    bad = texts.filter(pa.array(toxic))
    marked, times = np.unique(np.concatenate([_once(doc, h) for _, _, doc, _, h, _ in _document_features(bad)]), return_counts=True)
    marked, times = marked[times >= SUPPORT], times[times >= SUPPORT]
    if not len(marked):
        return marked
    places = [_pairs(k.astype(np.uint64), _surroundings(whole, at)) for _, _, _, _, k, (at, whole) in _document_features(bad, marked)]
    support = np.bincount(_pairs(*np.concatenate(places, 1))[0].astype(np.int64), minlength=len(marked))
    keep = (support >= PLACES) & (support >= times / 4)
    marked, times = marked[keep], times[keep]
    if not len(marked):
        return marked
    clean = np.zeros(len(marked), np.int64)
    for _, _, doc, _, k, _ in _document_features(texts.filter(pa.array(~toxic)), marked):
        clean += np.bincount(_once(doc, k), minlength=len(marked))
    lift = (times / toxic.sum()) / ((clean + 0.5) / max(1, (~toxic).sum()))
    keep = lift >= LIFT
    return marked[keep]


def _pairs(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distinct pairs, by h."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
    return np.stack([h[new], c[new]])


def fit(texts: pa.Array, toxic: np.ndarray, chain_l2: float = 1.0, counts_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of labelled texts; a sampled row that is not toxic, or is, stands for so many labelled rows."""
    share = np.where(toxic, counts_for[1], counts_for[0])
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(4), np.zeros(3), float(np.average(toxic, weights=share)) if len(toxic) else 0.0)
    if not len(toxic) or toxic.all() or not toxic.any():
        return nothing
    features = _select(texts, toxic)
    if not len(features):
        return nothing
    rows, counts = [], np.zeros(len(texts), np.int64)
    for a, n, doc, token, k, _ in _document_features(texts, features):
        counts[a : a + len(n)] = n
        rows.append(np.stack([doc + a, token, k]))
    doc, token, k = np.concatenate(rows, 1) if rows else np.zeros((3, 0), np.int64)
    order = np.lexsort((token, doc))
    doc, token, k = doc[order], token[order], k[order]
    length = 2 * WINDOW + 1
    wide = int(counts.max()) + length + 1
    # windows: around marked tokens, not overlapping much, and evenly in clean texts
    centre = np.unique(doc * wide + token)
    picked, last = [], -(10**18)
    for c in centre.tolist():
        if c - last > WINDOW:
            picked.append(c)
            last = c
    plain = np.flatnonzero(~toxic & (counts > 0))
    every = np.concatenate([[d * wide + x for x in range(0, int(counts[d]), max(length, int(counts[d]) // 4))] for d in plain]) if len(plain) else np.zeros(0)
    at = np.unique(np.concatenate([np.array(picked, np.int64), every.astype(np.int64)]))
    wdoc, wtok = at // wide, np.maximum(at % wide - WINDOW, 0)
    place = wtok[:, None] + np.arange(length)
    mask = place < counts[wdoc][:, None]
    cell = (wdoc[:, None] * wide + place).reshape(-1)
    key = doc * wide + token
    lo, hi = np.searchsorted(key, cell, "left"), np.searchsorted(key, cell, "right")
    times = np.where(mask.reshape(-1), hi - lo, 0)
    slots = np.repeat(np.arange(len(cell)), times)
    token_features = k[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    labels = ((times > 0).reshape(mask.shape) & toxic[wdoc][:, None]).astype(float)
    theta = np.zeros(4 + len(features))
    theta[0] = -5.0
    theta = _descend(lambda x: _window_gradient(x, 4, slots, token_features, mask.shape, labels, mask, chain_l2), theta)
    model = Model(features, theta[4:], theta[:4], np.zeros(3))
    new = np.r_[True, key[1:] != key[:-1]]
    weight = np.bincount(np.cumsum(new) - 1, model.weights[k]) if len(k) else np.zeros(0)
    x = _figures(doc[new], marginals(model.chain, doc[new], token[new], weight, counts), counts)
    y = toxic.astype(float)
    model.layer = _logistic(x, y, share)
    if (model.layer[1:] < 0).any():  # the figures go together; more of either must not lower a score
        model.layer = np.append(_logistic(x[:, :1], y, share), 0.0)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, l2: float = 0.01) -> np.ndarray:
    """Newton's method for an L2-penalised logistic layer of weighted rows."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (share * (p - y)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


# ----------------------------------------------------------------------------------------------------------- scoring


def score_texts(model: Model, texts: pa.Array, with_spans: bool = False):
    """Scores, and per text the (start, end, probability) byte spans of toxic tokens if asked for."""
    if not len(model.features):
        return np.full(len(texts), model.constant), [[] for _ in range(len(texts))] if with_spans else None
    seen, scores, spans = model.filter(), np.zeros(len(texts)), [[] for _ in range(len(texts))] if with_spans else None
    offsets, data = as_bytes(texts)
    for a, b, offs, part in blocks(offsets, data):
        part, starts, ends, before = _spans(offs, part)
        tokens, weight = _found(model, seen, starts, ends, part)
        n = np.diff(before)
        doc = np.searchsorted(before, tokens, "right") - 1
        p = marginals(model.chain, doc, tokens - before[doc], weight, n)
        scores[a:b] = _score(model, _figures(doc, p, n))
        if with_spans:
            for i in np.flatnonzero(p >= 0.5).tolist():
                d = int(doc[i])
                spans[a + d].append((int(starts[tokens[i]] - offs[d]), int(ends[tokens[i]] - offs[d]), float(p[i])))
    return scores, spans


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, row_bytes: int = ROW_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows outside of fold 0; ids may be of any type that can be compared."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows at most
    counts_for = max(1.0, n.get(0, 0) / max(1, clean_rows)), max(1.0, n.get(1, 0) / max(1, toxic_rows))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.filter("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(clean_rows))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= row_bytes)
    rows = texts.join(F.broadcast(sample), "doc_id")  # at most toxic_rows + clean_rows ids
    one_each = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))  # repeated rows are merged before they move

    def fitted(batches):
        table = pa.Table.from_batches(held) if (held := list(batches)) else None
        if table is not None:
            table = table.sort_by([("doc_id", "ascending")])
            model = fit(table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(bool), counts_for=counts_for)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = one_each.repartition(1).mapInArrow(fitted, "model binary")  # one task fits the bounded sample, not the driver
    found = one.first()
    return pickle.loads(found["model"]) if found else fit(pa.array([], pa.string()), np.zeros(0, bool))


def score_documents(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = False) -> DataFrame:
    """docs with toxic_score, and toxic_spans (byte offsets in UTF-8) if asked for; other columns stay."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("toxic_score", "toxic_spans")]
    names = kept + ["toxic_score"] + ["toxic_spans"] * with_spans

    def run(batches):
        for batch in batches:
            scores, spans = score_texts(model, batch.column("__text"), with_spans)
            out = [batch.column(c) for c in kept] + [pa.array(scores)]
            if with_spans:
                out.append(pa.array([[{"start": s, "end": e, "p": p} for s, e, p in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + ", toxic_score double" + ", toxic_spans array<struct<start:long,end:long,p:double>>" * with_spans
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, reject: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score below reject, with their own columns whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body"))
    kept = score_documents(rows, model, "body").filter(F.col("toxic_score") < reject)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
