import math
import re
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import ranked_search as rs


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, size = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * total) // size
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(spark, documents, docs, items, **how):
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = rs.search(documents(docs), table, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(rng, n):
    words = [f"w{k}" for k in range(300)]
    share = 1 / (1 + np.arange(300)) ** 0.9
    make = lambda size: " ".join(rng.choice(words, size, p=share / share.sum()))
    return [(i, make(int(rng.integers(0, 80)))) for i in range(n)], [(i, make(int(rng.integers(3, 25)))) for i in range(12)]


ODD = [(None, "w1 W2, w250"), (5, None), (900, ""), (901, "w1 " * 20_000 + "w299"), (902, "w299 w299"), (902, "w299 w299"), (903, "Größe 中文 w299_x"), (-4, "w299 w299"), (2**50, "...")]


@pytest.mark.parametrize("owners, block", [(1, 8192), (4, 16), (7, 1)])
def test_like_brute_force(spark, documents, monkeypatch, owners, block):
    monkeypatch.setattr(rs, "BLOCK_DOCS", block)
    monkeypatch.setattr(rs, "BLOCK_SUMS", 1 << 10)
    rng = np.random.default_rng(owners)
    docs, items = corpus(rng, 300)
    items += [(50, "W299 größe 中文 absent"), (51, None), (52, " ., "), (3, "w299"), (3, "w299"), (None, "w298 w1")]
    assert found(spark, documents, docs + ODD, items, top=5, owners=owners) == expected(docs + ODD, items, 5)


def test_pruning_keeps_the_best(spark, documents, monkeypatch):
    """Many documents a block, so that most are left out before the last stage."""

    rng = np.random.default_rng(3)
    docs, items = corpus(rng, 2000)
    assert found(spark, documents, docs, items, top=3, owners=6) == expected(docs, items, 3)


def test_copies_of_one_document(spark, documents):
    docs = [(i, "one two three") for i in range(400)] + [(1000 + i, f"four {i}") for i in range(50)]
    assert found(spark, documents, docs, [(1, "two four")]) == expected(docs, [(1, "two four")], 50)


def test_items_in_blocks(spark, documents):
    docs, items = corpus(np.random.default_rng(4), 60)
    assert found(spark, documents, docs, items, items_at_once=5) == expected(docs, items, 50)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([], []), ([(1, None), (2, "")], [(1, "a")]), ([(1, "a")], [(1, "b")]), ([(1, "a")], [(1, "a")])])
def test_empty_tables(spark, documents, docs, items):
    assert found(spark, documents, docs, items) == expected(docs, items, 50)
