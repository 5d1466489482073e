import random
import re

import numpy as np
import pytest

from panelkit.llm import near_dedup
from panelkit.llm.components import components
from panelkit.llm.near_dedup import dart_signatures, near_duplicates, shingles


def jaccard(a, b):
    def grams(text):
        words = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = grams(a or ""), grams(b or "")
    return len(x & y) / max(1, len(x | y))


def brute_classes(rows, threshold=0.8):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if jaccard(t, u) >= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(8)
    n, k = 60, 4000
    elements = rng.integers(1, 2**62, n, dtype=np.uint64)
    a, b = rng.uniform(0.2, 3.0, n), rng.uniform(0.2, 3.0, n)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    both = dart_signatures(np.repeat([0, 1], n), np.r_[elements, elements], np.r_[a, b], 2, k)
    agree = (both[0] == both[1])[(both != 0).all(0)].mean()
    assert abs(agree - want) < 0.03 and (both == 0).mean() < 0.02


def test_signatures_do_not_depend_on_the_batch():
    texts = [b"a b c d e f g h", b"", "é ß x y z w".encode(), b"one", b"word " * 50 + b"x " * 40]
    doc, grams, copies = shingles(texts)
    together = dart_signatures(doc, grams, np.ones(len(grams)), len(texts), 20)
    for i, text in enumerate(texts):
        d, g, _ = shingles([text])
        assert (dart_signatures(d, g, np.ones(len(g)), 1, 20)[0] == together[i]).all()


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    noise = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    noise = [(a, b) for a, b in noise if a != b]
    edges = chain + star + noise
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {i: find(i) for i in parent}


def test_like_brute_force(documents):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, next_id = [], 0
    for size, length in ((30, 120), (3, 60), (2, 200), (5, 80), (40, 100)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for copy in range(size):
            rows.append((next_id, " ".join(edited(rng, base, 0 if copy == 0 else rng.randrange(0, 3)))))
            next_id += 1
    for _ in range(40):
        rows.append((next_id, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90)))))
        next_id += 1
    rows += [(next_id, None), (next_id + 1, ""), (next_id + 2, "three words only"), (next_id + 3, "Three, words ONLY"), (next_id + 4, "x " * 100_000), (next_id + 5, "?!")]
    rng.shuffle(rows)
    want = brute_classes([(i, t) for i, t in sorted(rows)])
    got = near_duplicates(documents(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    kept = near_dedup.drop_near_duplicates(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_large_bucket_is_not_compared_pair_by_pair(documents):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(150)]
    docs = documents(rows)
    sketch = near_dedup.sketches(docs)
    pairs = near_dedup.candidate_pairs(sketch).count()
    assert pairs < 150 * near_dedup.SMALL_BUCKET
    assert {r["class_id"] for r in near_duplicates(docs).collect()} == {0}


def test_shuffled_texts_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    test_weights(documents, False)


def test_edge_rows(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None), (3, "")]
    got = near_duplicates(documents(rows)).collect()
    assert sorted(str((r["doc_id"], r["class_id"], r["class_size"], r["kept"])) for r in got) == sorted(map(str, [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, True), (None, None, 1, True), (2, 2, 1, True), (3, 3, 1, True)]))
    assert near_duplicates(documents([])).count() == 0
    assert near_dedup.drop_near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_weights(documents, weighted):
    rows = [(1, "a b c d e f " * 9 + "x y z"), (2, "a b c d e f " * 3 + "x y z")]
    assert (len({r["class_id"] for r in near_duplicates(documents(rows), weighted=weighted).collect()}) == 2) == weighted


def brute_links(sets, threshold):
    n = {i: 0 for i in sets}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        x = sets[i]
        for j in ids[:k]:
            both = len(x & sets[j])
            if both / max(1, len(x) + len(sets[j]) - both) >= threshold:
                n[i] += 1
                n[j] += 1
    return n


@pytest.mark.parametrize(("size", "block"), [(1000, None), (200, 2500)])
def test_original_of_many_copies_is_not_the_smallest(documents, monkeypatch, size, block):
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(near_dedup, "STEP_CELLS", 300)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(size):
        words = list(base)
        for at in rng.sample(range(100), 2):
            words[at] = f"new{rng.randrange(10**9)}"
        if i % 10 == 0:  # other lengths too
            words += [f"end{i}_{k}" for k in range(rng.randrange(12))]
        rows.append((i, " ".join(words)))
    rows.append((size, " ".join(base)))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    got = near_duplicates(documents(rows)).collect()
    assert {r["doc_id"]: r["links"] for r in got} == brute_links(sets, 0.8)
    assert {r["class_id"] for r in got if r["links"]} == {min(r["doc_id"] for r in got if r["links"])}
    assert all(r["class_id"] == r["doc_id"] for r in got if not r["links"])


@pytest.mark.parametrize("weighted", [False, True])
def test_blocks_like_brute_force(weighted):
    rng = np.random.default_rng(3)
    sets, copies = [], []
    for _ in range(60):
        x = rng.choice(40, rng.integers(10, 40), replace=False).astype(np.uint64)
        sets.append(np.sort(x))
        copies.append(rng.integers(1, 4, len(x)).astype("<u4").tobytes() if weighted else b"")
    elements = [near_dedup._elements(x.tobytes(), c) for x, c in zip(sets, copies, strict=True)]
    for side in (np.zeros(60, int), np.arange(60) % 2):
        got = [(int(a), int(b)) for i, j in near_dedup._similar_in_blocks(elements, side, 0.5) for a, b in zip(i, j, strict=True)]
        pairs = [(a, b) for a in range(60) for b in range(60) if (side[a] < side[b] if side.any() else a < b)]
        want = [(a, b) for a, b in pairs if near_dedup._similarity(sets[a].tobytes(), sets[b].tobytes(), copies[a], copies[b]) >= 0.5]
        assert sorted(got) == want and want


def test_two_texts_under_one_doc_id_give_the_same_result_in_any_order(spark, documents):
    words = [f"w{k}" for k in range(40)]
    a, b = " ".join(words), " ".join(words[::-1])
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " more"), (5, b + " more")]
    got = {tuple(sorted(map(tuple, near_dedup.near_duplicates(documents(rows[::s], parts=p)).select("doc_id", "class_id", "kept", "links").collect()))) for s in (1, -1) for p in (1, 3)}
    assert len(got) == 1


def test_recall_of_the_bands_at_the_threshold():
    """Pairs at a similarity of exactly 0.8 agree in a band (the README has the figure)."""

    rng, pairs = np.random.default_rng(12), 1500
    met = []
    for size, common in ((9, 8), (90, 80)):
        pools = rng.integers(1, 2**63, (pairs, 2 * size - common), dtype=np.uint64)
        sets = np.stack([pools[:, :size], np.concatenate([pools[:, :common], pools[:, size:]], axis=1)], axis=1).reshape(2 * pairs, size)
        doc = np.repeat(np.arange(2 * pairs), size)
        signature = dart_signatures(doc, np.sort(sets, axis=1).ravel(), np.ones(len(doc)), 2 * pairs, near_dedup.BANDS * near_dedup.ROWS)
        keys = near_dedup._band_keys(signature, near_dedup.BANDS, near_dedup.ROWS)
        met += [bool((set(a) & set(b)) - {None}) for a, b in zip(keys[::2], keys[1::2], strict=True)]
    assert np.mean(met) >= 0.999
