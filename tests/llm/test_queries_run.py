"""The registered functions themselves, on tables with nulls, other types, repeats, clashing names, and empty ones."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_dedup, mixing, packing, registered, toxicity, warc
from tests.llm.test_operators import lower, plain_components, plain_targets, rows_of, word_salad, words

KEY = "q8ZrT2vLw9XcB4nM7kPd3sHf6jYgA1uE"


def tables():
    base = word_salad(1, 40)
    docs = [(i, word_salad(10 + i, 5 + i % 23), "en", f"s{i % 4}" if i % 9 else None, 1) for i in range(120)]
    docs += [(500 + i, base if i % 2 else base.upper(), "en", "s1", 1) for i in range(12)]
    docs += [(600, None, None, None, None), (601, "", "en", "s0", 0), (602, " \t\n", "en", "s0", 3), (603, "long word " * 9000, "en", "s2", 1), (604, f"auth = {KEY} password=abcdefghijklmnop", "en", "s3", 1)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(120)] + [(600, 1, 1), (None, 1, 1), (9999, 0, 1), (3, 1, None)]
    pages = [(i, f"http://h/{i}", f"<p>page {i % 7}") for i in range(40)] + [(100, None, None), (101, "u", "")]
    return docs, labels, pages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels, pages = tables()
    names = {"component_id": F.lit("x"), "kept": F.lit(1), "node": F.lit(2), "size": F.lit("z"), "target": F.lit(0), "h": F.lit("y"), "media": F.lit(1), "row": F.lit(3), "score": F.lit("s"), "spans": F.lit(1), "bin_id": F.lit("b"), "sha": F.lit(5)}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns(names).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"keeper": F.lit(1), "salt": F.lit("x"), "first": F.lit(0)}).write.parquet(d + "/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_gives_one_row_each(spark, folder, name):
    docs, _, pages = tables()
    got = rows_of(registered.queries()[name](spark, folder))
    by = "page_id" if "page_id" in got[0] else "doc_id"
    ids = [r[0] for r in (pages if by == "page_id" else docs)]
    if name.startswith("op2"):
        assert {r["doc_id"] for r in got} == set(ids) and sum(r["n_words"] for r in got) == sum(len(words(t)) for _, t, *_ in docs)
        return
    assert sorted(r[by] for r in got) == sorted(ids)
    text = {i: t for i, t, *_ in docs}
    fold = lambda i, k: zlib.crc32(str(i).encode()) % k
    if name.startswith("op6"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    if name.startswith("op7"):
        sizes = collections.Counter()
        for _, t, _, s, _ in docs:
            sizes[s] += len(words(t))
        want = plain_targets(sizes)
        for r in got:
            assert r["size"] == len(words(text[r["doc_id"]])) and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    if name.startswith("op8"):
        row = next(r for r in got if r["doc_id"] == 604)
        a = text[604].index(KEY)
        assert row["n_assign"] == 1 and f"novel:{a}:{a + len(KEY)}" in row["spans"]
    if name.startswith("op9"):
        assert all(r["n_tokens"] == len(words(text[r["doc_id"]])) + 1 and r["held_out"] == (fold(r["doc_id"], 5) == 1) and r["score"] < 0 for r in got)
    if name.startswith("op10"):
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == plain_components([(i, t) for i, t, *_ in docs], 4)
    if name.startswith("op1_"):
        assert all(r["text_sha256"] == hashlib.sha256(lower(text[r["doc_id"]]).encode()).hexdigest() for r in got)


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(9,0)", "double", "date"])
def test_ids_and_sources_of_other_types(spark, kind):
    rows = [(i, word_salad(i, 3 + i), i % 3) for i in range(20)] + [(None, "one two", None)] * 3
    cast = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)
    other = F.date_add(F.lit("2020-01-01").cast("date"), F.col("source").cast("int")) if kind == "date" else F.col("source").cast(kind)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source long").withColumns({"doc_id": cast, "source": other})
    labels = docs.select("doc_id", F.lit(1).alias("toxic")).limit(5).unionByName(docs.select("doc_id", F.lit(0).alias("toxic")).limit(12))
    model = toxicity.train(docs, labels)
    assert toxicity.score_documents(docs, model).count() == 23
    packed = rows_of(packing.pack_documents(docs))
    assert sum(r["n_words"] for r in packed) == sum(len(words(t)) for _, t, _ in rows)
    mixed = rows_of(mixing.mix(mixing.document_sizes(docs)))
    assert len(mixed) == 23 and sum(r["copies"] * r["size"] for r in mixed) <= 2 * sum(len(words(t)) for _, t, _ in rows)
    assert mixing.mixed_documents(docs).schema == docs.schema
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    got = rows_of(warc.read(warc.write(pages)))
    assert collections.Counter(r["page_id"] is None for r in got) == {True: 3, False: 20} and all(r["verified"] for r in got)


def test_odd_page_ids_come_back(spark):
    odd = ["null", "", "a b", "<urn:no-page>", "é/%41\r\nX: y", "urn:page:1", None, "7", "7"]
    pages = spark.createDataFrame([(x, f"u{i}", f"page {i}") for i, x in enumerate(odd)], "page_id string, url string, html string")
    assert collections.Counter(r["page_id"] for r in rows_of(warc.read(warc.write(pages)))) == collections.Counter(odd)


@pytest.mark.parametrize("salts", [1, 4])
def test_contents_are_told_apart_whatever_the_digest(spark, salts):
    rows = [(i, "ab"[i % 2] * (3 + i % 3)) for i in range(40)] + [(100, "AAA"), (None, "aaa"), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda norm: [F.sha2(F.octet_length(norm).cast("string"), 256).alias("__sha"), F.lit(0).cast("long").alias("__h2"), F.octet_length(norm).alias("__len")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = collections.Counter((i, max(x for x in groups[lower(t)] if x is not None), len(groups[lower(t)])) for i, t in rows)
    got = rows_of(exact_dedup.exact_dedup(docs, salts=salts, digest=weak))
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    kept = rows_of(exact_dedup.drop_exact(docs, salts=salts, digest=weak))
    assert sorted(lower(r["text"]) for r in kept) == sorted(groups)


def test_repeated_rows_are_spread_and_packed(spark):
    docs = spark.createDataFrame([(None, "five words in this one")] * 3000 + [(i, word_salad(i, 9)) for i in range(50)], "doc_id long, text string").repartition(4)
    got = rows_of(packing.pack_documents(docs, lengths=(16, 64), shard=100))
    shards = collections.Counter(r["bin_id"] >> 32 for r in got)
    assert len(shards) >= 25 and max(shards.values()) < 400 and len(got) == 3050


def test_shards_lose_little_fill():
    import random

    r = random.Random(4)
    sizes = [min(4096, int(r.paretovariate(1.1) * 60)) for _ in range(40_000)]
    price = lambda final, bins: sum(packing.cost(f) for f in dict(zip(bins, final, strict=True)).values())
    whole = packing.pack(sizes)
    apart = [packing.pack(sizes[k::5]) for k in range(5)]
    assert sum(price(x[2], x[0]) for x in apart) <= 1.01 * price(whole[2], whole[0])


def test_mixing_is_the_same_on_every_partitioning(spark):
    rows = [(i if i % 5 else None, word_salad(i % 40, 1 + i % 17), f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda d: collections.Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in rows_of(mixing.mix(mixing.document_sizes(d))))
    one, two = run(docs.coalesce(1)), run(docs.repartition(7).orderBy(F.rand(1)))
    assert one == two and sum(one.values()) == 400
    sums = collections.Counter()
    for (i, source, size, copies), n in one.items():
        sums[i, source, size] += copies * n
    taken = collections.Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows_of(mixing.mixed_documents(docs)))
    assert taken == +sums


def test_near_duplicate_recall_on_planted_pairs():
    """Pairs of similarity 0.80 to 0.82 pass both thresholds: signatures of 64, sketches of 512 bytes, 256 whole minima."""
    import numpy as np

    from lattica.llm import minhash

    r = np.random.default_rng(3)
    missed, n = 0, 3000
    for k in range(n):
        same = 80 + k % 3
        sets = r.integers(1, 1 << 63, 100, dtype=np.uint64)
        half = (100 - same) // 2
        a, b = sets[: 100 - half], np.concatenate([sets[:same], sets[100 - half :]])
        agree = lambda multipliers, shift, mask=None: sum(
            int((a * m).min() >> np.uint64(shift)) & (mask or -1) == int((b * m).min() >> np.uint64(shift)) & (mask or -1) for m in multipliers  # noqa: B023
        )
        ok = agree(minhash._MULTIPLIERS, 32) >= minhash.MATCHES
        if k % 10 == 0:
            ok = ok and agree(minhash._SKETCH, 40, 255) >= minhash.SKETCH_MATCHES and agree(minhash._SKETCH[: minhash.WIDE], 0) >= minhash.WIDE_MATCHES
        missed += not ok
    assert missed <= 1
