import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import resample as rs

ROWS = [
    (3, "The quick brown fox, jumps over-the lazy dog " * 3), (1, None), (2, ""), (9, "Größe ist 中文 das; wort " * 9), (5, "a b c d e f g h i j k l m n o p q r s t"), (7, "A B C D E F G H I J K L M N O P Q R S T"),
    (7, "A B C D E F G H I J K L M N O P Q R S T"), (None, "fox dog " * 15), (-8, "fox dog " * 15), (11, "x" * 300 + " " + " ".join(f"w{i}" for i in range(700))), (12, "short text"), (2**60, "lazy dog " * 11), (-(2**62), "brown fox " * 11),
]
TARGET = [(1, "the lazy dog and the fox"), (2, None), (3, "lazy, lazy dog"), (3, "größe")]


def runs(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def expected(rows, target, n, buckets, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in side for f in runs(x, n)[1]) for side in (rows, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in rows:
        words, found = runs(x, n)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([i, len(found), weight, weight + rs.noise(i, 2024), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_like_brute_force(spark, documents, monkeypatch, n):
    monkeypatch.setattr(rs, "BLOCK", 4)
    target = spark.createDataFrame([(i, x, "w") for i, x in TARGET], "item_id long, text string, weight string")
    got = rs.resample(documents(ROWS), target, share=60, max_words=n, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS, TARGET, n, 500, 60, 20)


def test_noise():
    h = int(__import__("hashlib").sha256(b"2024:17").hexdigest()[:8], 16)
    assert rs.noise(17, 2024) == math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))


@pytest.mark.parametrize("rows, target", [([], TARGET), (ROWS, []), ([], []), ([(1, "")], [])])
def test_empty_tables(spark, documents, rows, target):
    got = rs.resample(documents(rows), spark.createDataFrame(target, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, target, 1, rs.BUCKETS, rs.SHARE, rs.LEAST_WORDS)


@pytest.mark.parametrize("low, high", [(0, 0), (-5, 5), (-(2**40), 2**40), (-(2**63), 2**63 - 1)])
def test_radix_sort(spark, monkeypatch, low, high):
    monkeypatch.setattr(rs, "BLOCK", 32)
    rng = np.random.default_rng(high % 1000)
    a = rng.integers(low, high, 400, endpoint=True)
    a[:200] = a[0]  # half of the rows share a key
    a[200:202] = low, high
    b = rng.integers(-3, 3, 400)
    rows = [(int(x), None if y == 2 else int(y), k * 5, "t") for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a long, b long, place long, tag string").repartition(3)
    got = sorted(tuple(r) for r in rs.radix_places(df, [("a", False), ("b", True)]).select("place", "a", "b").collect())
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert got == [(k, r[0], r[1]) for k, r in enumerate(want)]
