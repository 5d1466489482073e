import random
import re

import numpy as np

from panelkit.llm import decontaminate
from panelkit.llm.decontaminate import Items, drop_leaks, edit_distance, edited, embed, leaks


def brute_distance(item, words):
    """Smallest edit distance of item to any part of words."""
    row = [0] * (len(words) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_and_its_place():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        words = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        d, s, e = edit_distance(np.array(item, np.uint64), np.array(words, np.uint64))
        assert d == brute_distance(item, words) == plain_distance(item, words[s:e])


def test_embedding_keeps_close_sequences_close():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 2**62, (200, 40), dtype=np.uint64)
    b = np.zeros_like(a)
    for row, source in zip(b, a, strict=True):
        copy = edited(source, 2, rng)
        row[: len(copy)] = copy
    lengths = np.full(200, 40)
    agree = (embed(a, lengths, 0, 80) == embed(b, lengths, 0, 80)).mean()
    apart = (embed(a, lengths, 0, 80) == embed(b[::-1].copy(), lengths, 0, 80)).mean()
    assert agree > 0.5 and apart < 0.2


def test_samples_reach_the_recall_on_new_edits():
    rng = np.random.default_rng(9)
    words = [f"w{rng.integers(3000)}" for _ in range(2000)]
    items = Items.of([(k, " ".join(words[30 * k : 30 * k + 20 + k])) for k in range(30)])
    found = total = 0
    for k in range(30):
        for _ in range(20):
            copy = edited(items.words[k], items.edits[k], rng)
            window = np.zeros((1, items.width), np.uint64)
            window[0, : len(copy)] = copy
            found += bool(items.meet(window, np.array([k]))[0])
            total += 1
    assert found / total >= 0.99


def test_like_brute_force(documents, spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(150)]
    bench = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 50)))) for k in range(25)]
    bench += [(90, None), (91, ""), (92, "?!"), (93, bench[3][1].upper())]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if i % 2:
            item = bench[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(0, 1 + len(item) // 4)):
                at = rng.randrange(len(item))
                item[at : at + rng.randrange(2)] = [f"n{rng.randrange(999)}"] * rng.randrange(2) or item[at : at + 1]
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "x " * 50_000 + bench[0][1]), (None, bench[1][1]), (1, rows[1][1])]
    want = set()
    for i, t in rows:
        words = re.findall(r"\w+", (t or "").lower())
        for k, u in bench:
            item = re.findall(r"\w+", (u or "").lower())
            if item and (len(words) < 9000 or k == 0):
                allowed = int(0.2 * len(item)) if len(item) >= 8 else 0
                d = brute_distance(item, words[-200:] if len(words) > 9000 else words)
                if d <= allowed:
                    want.add((i, k, d))
    table = spark.createDataFrame([(k, t, "x") for k, t in bench], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in leaks(documents(rows), table).collect() if r["doc_id"] != 502 or r["item_id"] == 0}
    assert {g[:2] for g in got} <= {w[:2] for w in want} and len(got & want) >= 0.99 * len(want) and len(want) > 40
    assert {w for w in want if w[2] == 0} <= got
    several = leaks(documents(rows), table, items_at_once=7)
    assert {(r["doc_id"], r["item_id"]) for r in several.collect()} >= {g[:2] for g in got}
    kept = drop_leaks(documents(rows), table)
    gone = {w[0] for w in want}
    assert kept.schema == documents(rows).schema and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - gone
    assert {r["doc_id"] for r in drop_leaks(documents(rows), table, items_at_once=7).collect()} == {i for i, _ in rows} - gone


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert leaks(documents([(1, "a b c d e f g h")]), none).count() == 0
    assert leaks(documents([]), some).count() == 0
    assert drop_leaks(documents([(1, "a b c d e f g h"), (2, "c")]), some).count() == 1
    assert decontaminate.ITEMS_AT_ONCE > 0


def test_all_windows_are_verified_where_samples_miss_the_recall():
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(2000)]
    items = Items.of([(k, " ".join(words[200 * k : 200 * k + 200])) for k in range(10)], share=0.9)
    at = rng.integers(0, 10, 300)
    windows = [edited(items.words[k], items.edits[k], rng) for k in at]
    assert items.verify_all and items.meet(items._table(windows)[0], at).all()
    assert not Items.of([(k, " ".join(words[200 * k : 200 * k + 200])) for k in range(10)]).verify_all
