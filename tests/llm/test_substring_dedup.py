import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelkit.llm import substring_dedup
from panelkit.llm.substring_dedup import SuffixAutomaton, remove_repeats, repeated_spans


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_automaton_statistics_like_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        texts = [([rng.randrange(3) for _ in range(rng.randrange(1, 14))], rng.choice([1, 1, 1, 2])) for _ in range(rng.randrange(1, 5))]
        automaton = SuffixAutomaton()
        counts = Counter()
        for text, copies in texts:
            automaton.add(text, copies)
            for i in range(len(text)):
                for j in range(i + 1, len(text) + 1):
                    counts[tuple(text[i:j])] += copies
        automaton.settle()
        probe = [rng.randrange(3) for _ in range(12)]
        for text in [probe, *(t for t, _ in texts)]:
            want = [max((n for n in range(1, e + 1) if counts[tuple(text[e - n : e])] > 1), default=0) for e in range(1, len(text) + 1)]
            assert automaton.statistics(text) == want, (texts, text)


def passages(rng, n_docs, vocabulary, shared):
    rows = []
    for i in range(n_docs):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            piece = rng.choice(shared)
            a = rng.randrange(len(piece))
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece[a : a + rng.randrange(1, 90)]
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    return rows


@pytest.mark.parametrize(("window", "shard"), [(35, 256), (35, 2), (12, 5), (6, 256)])
def test_like_brute_force(documents, window, shard):
    rng = random.Random(window + shard)
    vocabulary = ["é", "und"] + [f"w{i}" for i in range(200)]
    shared = [[rng.choice(vocabulary) for _ in range(100)] for _ in range(4)]
    rows = passages(rng, 150, vocabulary, shared)
    rows += [(900, None), (901, ""), (902, "la " * 3000), (903, "a b c d e " * 40), (904, rows[3][1]), (905, rows[3][1]), (906, "y".join(map(str, range(20000)))), (907, "z" * 50_000)]
    rows += [(904, rows[3][1]), (None, rows[5][1]), (None, rows[7][1]), (5, "another text of an id that is there already " * 9), (908, "odd\x0bword\x1ckept together " * 50)]
    got = sorted((tuple(r) for r in remove_repeats(documents(rows, 5), window, shard).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table_and_no_repeats(documents):
    assert remove_repeats(documents([])).count() == 0
    text = " ".join(map(str, range(100)))
    assert [tuple(r) for r in remove_repeats(documents([(1, text)])).collect()] == [(1, 100, 0, text)]
    assert substring_dedup.WINDOW == 35


def test_a_row_repeated_very_often(spark, documents):
    """Lists of spans don't grow with the copies."""

    text = " ".join(f"w{k}" for k in range(60))
    docs = documents([(1, text)] * 2000 + [(2, "other words " * 3)])
    longest = repeated_spans(docs, 20).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("s")).select(F.max(F.size("s"))).first()[0]
    assert longest <= 60
    got = remove_repeats(docs, 20).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 60, 60, 2000), (2, 6, 0, 1)]
