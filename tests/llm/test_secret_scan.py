"""Novel spans against a plain search, the reach of their parameters, and long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lattica.llm import secrets

KEY = "q8ZrT2vLw9XcB4nM7kPd3sHf6jYgA1uE"


def plain_candidates(text):
    """Every run against every sensitive word."""
    runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text)]
    ends = [(m.start(), m.end()) for m in re.finditer("|".join(secrets._SENSITIVE), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    out = set()
    for a, b in runs:
        starts, names = [], set()
        for s, q in ends:
            if a <= s < b:
                signs = [m.end() for m in re.finditer("=+", text[q:b])][:1]
                starts += [q + x for x in signs if x < 48 and b - q - x >= 16]
            elif q <= a < q + 48 and "\n" not in text[q:a] and b - a >= 16:
                sign = re.search("=+", text[a:b])
                if sign and b - a - sign.end() >= 16:
                    starts.append(a + sign.end())
                    if sign.start() >= 16:
                        names.add((a, a + sign.start()))
                else:
                    starts.append(a)
        out |= names | ({(max(starts), b)} if starts else set())
    return sorted(out)


def plain_novel(text):
    base = secrets.scan(text)[0]
    out = []
    for a, b in plain_candidates(text):
        inner = text[a:b]
        if not any(s < b and a < e for s, _, e in base) and re.search(r"[0-9]", inner) and re.search("[A-Za-z]", inner):
            k = b - a
            if secrets.novelty(inner, text[:a][-(secrets.AROUND + k - 1) :], text[b:][: secrets.AROUND + k - 1]) >= secrets.NOVELTY:
                out.append((a, 3, b))
    return out


def test_novel_spans_equal_a_plain_search():
    r = random.Random(8)
    pieces = ["key", "Token", "auth", " ", " ", "=", "==", "\n", ": ", '"', KEY, KEY[:16], KEY[3:20], "user_session_identifier_2024", "x" * 30, "é", "password=", "abcdefabcdef012345678", ",", "/", "-" * 9]
    found = 0
    for _ in range(1500):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 16)))
        got = [x for x in secrets.scan(text)[1] if x[1] == 3]
        assert got == plain_novel(text)
        found += len(got)
    assert found > 100


@pytest.mark.parametrize("gap,found", [(secrets.CONTEXT - 1, True), (secrets.CONTEXT, False)])
def test_context_reaches_so_far(gap, found):
    text = "key" + "." * gap + KEY
    assert bool(secrets.scan(text)[1]) == found
    assert secrets.scan(text, context=gap + 1)[1]


@pytest.mark.parametrize("gap,explained", [(0, True), (secrets.AROUND, False)])
def test_code_around_explains_so_far(gap, explained):
    name = "zwqv7kjhx_plmqtr_9bvfd_wqzx"
    text = f"{name[:13]} {name[13:]}".replace("_", " ") + " " + ". " * (gap // 2 + 1) + "key " + name
    inside = secrets.novelty(name, text[: -len(name)], "") < secrets.novelty(name, "", "")
    assert inside == explained


@pytest.mark.parametrize("piece", ["token here, ", "key = value; ", "key", "key=a=", "token=abcdef0123456789 ", "key" + " " * 45, "session " + KEY + " ", "a1", "password" + " " * 90])
def test_long_texts_take_time_in_proportion(piece):
    def seconds(n):
        text, start = piece * (n // len(piece)), time.perf_counter()
        secrets.scan(text)
        return time.perf_counter() - start

    seconds(20_000)
    assert seconds(400_000) < 60 * max(seconds(20_000), 0.005)  # 20 times the text


def test_clashing_columns_and_other_ids(spark):
    docs = spark.createDataFrame([("x", "key " + KEY), (None, None)], "doc_id string, text string").withColumns({"spans": F.lit(1), "n_hex": F.lit("x")})
    got = [r.asDict() for r in secrets.scan_documents(docs).collect()]
    assert [(r["doc_id"], r["spans"], r["n_hex"], r["n_novel"]) for r in got] == [("x", f"novel:4:{4 + len(KEY)}", 0, 1), (None, "", 0, 0)]
