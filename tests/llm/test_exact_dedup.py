import hashlib
import random

from panelkit.llm.exact_dedup import CuckooIndex, drop_exact_duplicates, exact_duplicates


def test_index_inserts_deletes_and_grows():
    rng = random.Random(3)
    index, live = CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(12000):
        key = rng.choice(keys)
        if rng.random() < 0.35:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            index.put(key, step)
            live[key] = step
    assert index.buckets > 2 and len(index) == len(live) and dict(index.items()) == live
    assert all(index.get(k) == live.get(k) for k in keys)


def test_hit_is_checked_against_the_stored_digest():
    index = CuckooIndex(1)
    a = bytes(8) + b"\x07\x00" + bytes(22)
    b = bytes(8) + b"\x07\x00" + b"\x01" * 22
    index.put(a, 1)
    assert index.get(b) is None and not index.delete(b)
    index.put(b, 2)
    assert (index.get(a), index.get(b)) == (1, 2)


def test_many_colliding_keys_resize_until_they_fit():
    index = CuckooIndex(2)
    keys = [i.to_bytes(8, "little") + (i % 3 + 1).to_bytes(2, "little") + bytes(22) for i in range(400)]
    for i, key in enumerate(keys):
        index.put(key, i)
    assert [index.get(k) for k in keys] == list(range(400))


def brute(rows):
    def norm(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")

    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in by.items()}
    return sorted(((i, top[norm(t)], len(by[norm(t)]), i == top[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000), (9, "X" * 300_000), (None, "abc"), (None, "alone"), (10, "abc "), (11, "K")]


def test_same_as_brute_force(documents):
    got = sorted((tuple(r) for r in exact_duplicates(documents(ROWS)).collect()), key=str)
    assert got == brute(ROWS)


def test_stage_keeps_rows_as_they_are(documents):
    docs = documents(ROWS)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    # rows without doc_id can't be told apart: one of them stays, so all do
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("2 3 5 6 7 9 9 None None 10 11".split())


def test_empty_table(documents):
    assert exact_duplicates(documents([])).count() == 0 and drop_exact_duplicates(documents([])).count() == 0


def test_large_random_groups(documents):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(1, 60)}" if rng.random() < 0.7 else "HOT") for i in range(600)]
    got = sorted((tuple(r) for r in exact_duplicates(documents(rows, 7)).collect()), key=str)
    assert got == brute(rows)
