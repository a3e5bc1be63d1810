"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lattica.llm import toxicity
from tests.llm.test_operators import lower, plain_components, plain_targets, rows_of, word_salad, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int"


def corpus():
    r = random.Random(5)
    rows, toxic = [], {}
    for i in range(360):
        w = word_salad(i, r.randint(8, 60)).split()
        w = ["".join("abcdefghij"[int(c)] if c.isdigit() else c for c in x) for x in w]
        toxic[i] = i % 9 == 0
        if toxic[i]:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vexoid", "grumth"]) + r.choice(["", "en", "ig"]))
        rows.append((i, " ".join(w)))
    base = [rows[k][1] for k in (1, 2, 4)]
    rows += [(1000 + k, base[k % 3].upper() if k % 2 else base[k % 3]) for k in range(30)]
    for k in range(20):
        w = (base[0] + " " + base[1] + " " + base[2]).split()
        w[r.randrange(len(w))] = f"edit{'abcdefghijklmnopqrst'[k]}"
        rows.append((2000 + k, " ".join(w)))
    rows += [(3000, None), (3001, ""), (3002, "   ")]
    return [(i, t, "en", None if i % 41 == 0 else f"s{i % 7}", len(t or ""), 1) for i, t in rows], toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, toxic = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    return d


def test_stages_do_what_plain_python_does(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    rows, toxic = corpus()
    by_name = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    civil = by_name["toxicity"](spark, docs, folder)
    assert civil.columns == docs.columns
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(folder + "/labels.parquet"))
    scores, _ = toxicity.score_texts(model, pa.array([t for _, t, *_ in rows], pa.string()))
    want = {x[0] for x, s in zip(rows, scores, strict=True) if s < 0.5}
    left = {r["doc_id"] for r in rows_of(civil)}
    assert left == want and not any(toxic.get(i) for i in left) and len([i for i in toxic if not toxic[i] and i in left]) >= 0.98 * sum(not t for t in toxic.values())
    civil = civil.cache()
    unique = by_name["exact dedup"](spark, civil, folder)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        if i in left:
            groups[lower(t)].append(i)
    assert sorted(r["doc_id"] for r in rows_of(unique)) == sorted(max(g) for g in groups.values())
    unique = unique.cache()
    near = by_name["MinHash near-dedup"](spark, unique, folder)
    kept = [(r["doc_id"], r["text"]) for r in rows_of(unique)]
    assert sorted(r["doc_id"] for r in rows_of(near)) == sorted(i for (i, _, _, stays) in plain_components(kept, 5) if stays)
    near = near.cache()
    mixed = by_name["mixing sources to target weights"](spark, near, folder)
    assert mixed.columns == docs.columns
    size_of, taken, times = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows_of(near):
        size_of[r["source"]] += len(words(r["text"]))
    for r in rows_of(mixed):
        taken[r["source"]] += len(words(r["text"]))
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    for s, t in plain_targets(size_of).items():
        assert abs(taken[s] - t) <= max(8, 0.02 * t)
    packed = rows_of(by_name["best-fit packing"](spark, mixed.cache(), folder))
    assert sum(r["n_words"] for r in packed) == sum(taken.values())
    per_bin = collections.Counter()
    for r in packed:
        if r["bin_id"] is not None:
            per_bin[r["bin_id"], r["bin_size"]] += r["n_words"]
    assert all(n <= size for (_, size), n in per_bin.items())


def test_run_chains_the_stages(spark, folder):
    got = pipeline.run(spark, folder)
    assert {"doc_id", "piece", "text", "bin_id", "bin_size"} <= set(got.columns) and got.count() > 100
    assert got.filter(F.lower("text").contains("vexoid")).count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
