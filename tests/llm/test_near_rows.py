"""The near-duplicate stage tells rows apart by id and content."""

import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lattica.llm import minhash
from lattica.plans.shared import materialize
from tests.llm.test_operators import plain_components, word_salad


def test_drop_near_keeps_unique_texts_without_or_with_repeated_ids(spark):
    alone = [word_salad(100 + i, 40) for i in range(9)]
    base = word_salad(1, 60)
    near = base + " more"
    rows = [(None, t) for t in alone[:5]] + [(7, alone[5]), (7, alone[6])]
    rows += [(1, base), (2, near)] + [(2, t) for t in alone[7:]]  # the near copy's id also has texts of its own
    rows += [(None, base), (None, ""), (None, None), (3, ""), (3, alone[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    got = minhash.drop_near(docs)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = [(None, t) for t in alone[1:5]] + [(7, alone[5]), (7, alone[6]), (1, base), (2, alone[7]), (2, alone[8]), (3, ""), (3, alone[0])]
    key = lambda x: (str(x[0]), x[1])
    assert sorted((x for x in got if x != (None, "") and x != (None, None)), key=key) == sorted(want, key=key)
    assert sum(not (t or "") and i is None for i, t in got) == 1  # a null text is an empty one


def edited(words, seed, share):
    r = random.Random(seed)
    return " ".join(f"edit{seed}x{i}" if r.random() < share else w for i, w in enumerate(words))


def test_long_lists_of_passages_and_near_copies(spark, monkeypatch):
    """Near copies of many degrees and texts around one passage, in lists far beyond PIECE: all links, and work that follows the rows."""
    monkeypatch.setattr(minhash, "PIECE", 16)
    monkeypatch.setattr(minhash, "BLOCK", 32)
    base, passage = word_salad(1, 120).split(), word_salad(2, 90)
    rows = [(i, edited(base, 100 + i, 0.004 * (i % 14))) for i in range(160)]
    rows += [(1000 + i, passage + " " + word_salad(3000 + i, 25 + i % 20)) for i in range(160)]
    sizes = {}

    def counted(df, label):
        out = materialize(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs, shingle=4).collect())
    assert got == plain_components(rows, 4)
    assert sizes["minhash-bounded"] <= 32 * len(rows), sizes


def test_a_pair_is_named_once(monkeypatch):
    """Near copies collide in many coordinates; candidates come in parts, each pair is compared and named in one of them."""
    monkeypatch.setattr(minhash, "PAIRS", 8)
    r = np.random.default_rng(1)
    size = 12
    sig = np.repeat(r.integers(0, 1 << 30, (1, minhash.COORDINATES)), size, axis=0).astype(np.int32)
    sig[np.arange(size), np.arange(size)] += 1  # no two are equal, all are near
    sketch = r.integers(0, 256, minhash.SKETCH).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_pydict(
        {"token": [5] * size, "side": [3] * size, "node": list(range(size)), "n": [100] * size, "comp": list(range(size)), "sig": pa.array(sig.tolist(), pa.list_(pa.int32())), "sketch": [sketch] * size, "lists": [[5]] * size}
    )
    got = [(x["a"], x["b"]) for part in minhash._merge(80, minhash.MATCHES, False)([batch]) for x in part.to_pylist()]
    assert sorted(got) == [(a, b) for a in range(size) for b in range(a + 1, size)]


def test_prefixes_of_long_lists_are_posted_once(spark, monkeypatch):
    """drop_near on a long list: the rows of prefixes are those of the signatures, at most COORDINATES - MATCHES + 1 a text."""
    monkeypatch.setattr(minhash, "PIECE", 8)
    made, plain = [], minhash._prefixes

    def counted(posted, matches):
        out = plain(posted, matches)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_prefixes", counted)
    passage = word_salad(2, 90)
    rows = [(i, passage + " " + word_salad(3000 + i, 25 + i % 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x["doc_id"] for x in minhash.drop_near(docs).collect())
    assert got == sorted(i for (i, _, _, stays) in plain_components(rows, 5) if stays)
    assert sum(made) <= (minhash.COORDINATES - minhash.MATCHES + 1) * len(rows), made


def test_pairs_that_full_sets_would_refute_are_not_named(spark, monkeypatch):
    """Texts that are nearly similar enough pass the thresholds, but their bucket counts tell most of them apart: rows to confirm follow the texts, not their square."""
    r, base = random.Random(5), word_salad(1, 300).split()
    rows = []
    for i in range(120):
        w = list(base)
        for j in r.sample(range(len(w)), 5):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    named = []

    def counted(df, label):
        out = materialize(df, label)
        if label == "minhash-pairs":
            named.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs, shingle=4).collect())
    assert got == plain_components(rows, 4)
    assert named[-1] <= len(rows), named  # the pass before them names at most one a node and list


def test_bucket_counts_refute_no_link():
    """Pairs around the threshold, of few shingles to buckets that are full, in a coordinate's 255 and beyond."""
    r = np.random.default_rng(2)
    refuted = 0
    for size, spread in [(1, 1 << 62), (30, 1 << 62), (400, 1 << 62), (5000, 1 << 62), (3000, 4)]:
        for same in np.linspace(0.5, 1, 26):
            pool = r.choice(1 << 20, 2 * size, replace=False).astype(np.uint64) * np.uint64(minhash.COUNTS) + r.integers(0, spread, 2 * size, dtype=np.uint64) % np.uint64(minhash.COUNTS)
            k = round(same * size)
            a, b = pool[:size], np.concatenate([pool[:k], pool[size : 2 * size - k]])
            counts = minhash._bucket_counts(pa.array([a.tobytes(), b.tobytes()], pa.binary()))
            may = bool(minhash._may_link(counts[:1], counts[1:], np.array([2 * size]), 80)[0])
            link = 100 * k >= 80 * (2 * size - k)
            assert may or not link, (size, same)
            refuted += not may
    assert refuted >= 26, refuted
