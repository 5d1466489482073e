import random

import public_tokenizers
import pytest

from panelkit.llm.token_counts import RULES, count_in_spans, count_tokens, encoding

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text, rule):
    """[(start, end, tokens, crossing)] by going over tokens and characters one by one."""
    lines, at = [], 0
    for part in text.split("\n"):
        end = min(len(text), at + len(part) + 1)
        if end > at:
            lines.append((at, end))
        at = end
    owner = [k for k, (a, b) in enumerate(lines) for _ in range(b - a)]
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, partly, byte = [0.0] * len(lines), [0] * len(lines), 0
    for token in encoding(PATH, PATTERN)[0].encode_ordinary(text):
        size = len(encoding(PATH, PATTERN)[0].decode_single_token_bytes(token))
        chars = [of_byte[b] for b in range(byte, byte + size)]
        begun = [i for b, i in zip(range(byte, byte + size), chars, strict=True) if b == 0 or of_byte[b - 1] != i]
        sections = sorted({owner[i] for i in chars})
        if len(sections) == 1 or rule == "first":
            counts[sections[0]] += 1
        elif rule == "last":
            counts[sections[-1]] += 1
        else:
            held = [sum(owner[i] == s for i in begun) for s in sections]
            if rule == "most":
                counts[sections[held.index(max(held))]] += 1
            else:
                for s, h in zip(sections, held, strict=True):
                    counts[s] += h / sum(held)
        if len(sections) > 1:
            for s in sections:
                partly[s] += 1
        byte += size
    return [(a, b, n, p) for (a, b), n, p in zip(lines, counts, partly, strict=True)]


@pytest.mark.parametrize("rule", RULES)
def test_like_brute_force(documents, rule):
    rng = random.Random(3)
    parts = ["word", " the", "\n", "\n\n", "\n\n\n\n", " ", "é", "東🙂", "\t", "!", "\n  ", ");\n\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "a\n" * 20_000), (5, "x\ny"), (None, "é\n🙂\n\n")]
    got = {}
    for r in count_tokens(documents(rows), PATH, PATTERN, rule).collect():
        got.setdefault(str(r["doc_id"]), []).append((r["section"], r["start"], r["end"], round(r["n_tokens"], 6), r["n_crossing"]))
    want = {}
    for i, t in rows:
        for k, (a, b, n, p) in enumerate(brute(t or "", rule)):
            want.setdefault(str(i), []).append((k, a, b, round(n, 6), p))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_counts_add_up_and_tokens_do_cross(documents):
    text = "if (x) {\n\n\n  y();\n}\n\n"
    for rule in RULES:
        rows = count_tokens(documents([(1, text)]), PATH, PATTERN, rule).collect()
        assert sum(r["n_tokens"] for r in rows) == pytest.approx(len(encoding(PATH, PATTERN)[0].encode_ordinary(text)))
    assert any(r["n_crossing"] for r in rows)
    assert count_tokens(documents([]), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError):
        count_tokens(documents([]), PATH, PATTERN, "middle")


def brute_spans(text, spans, rule):
    """(tokens, crossing) of each span by sets of characters."""
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, partly, byte = [0.0] * len(spans), [0] * len(spans), 0
    sets = [set(range(max(0, a or 0), min(len(text), len(text) if b is None else b))) for a, b in spans]
    for token in encoding(PATH, PATTERN)[0].encode_ordinary(text):
        size = len(encoding(PATH, PATTERN)[0].decode_single_token_bytes(token))
        at = range(byte, byte + size)
        touched = {of_byte[b] for b in at}
        own = {of_byte[b] for b in at if b == 0 or of_byte[b - 1] != of_byte[b]} or touched
        held = [len(own & s) for s in sets]
        for k, s in enumerate(sets):
            partly[k] += bool(touched & s) and not touched <= s
            if rule == "share":
                counts[k] += held[k] / len(own)
            elif rule != "most":
                counts[k] += (min(touched) if rule == "first" else max(touched)) in s
        if rule == "most" and sets and max(held):
            counts[held.index(max(held))] += 1
        byte += size
    return [(round(n, 6), p) for n, p in zip(counts, partly, strict=True)]


@pytest.mark.parametrize("rule", RULES)
def test_spans_like_brute_force(spark, documents, rule):
    rng = random.Random(5)
    parts = ["word", " the", "\n", "\n\n", "é", "東🙂", "🙂", "!", ");\n\n", " indivisible"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "word " * 20_000), (93, "no spans"), (None, "x")]
    spans = []
    for i, t in rows:
        if i is not None and i != 93:
            n = len(t or "")
            spans += [(i, f"s{k}", *sorted((rng.randrange(0, n + 1), rng.randrange(0, n + 3)))) for k in range(rng.randrange(1, 6))]
    spans += [(0, "open", None, None), (1, None, None, 3), (2, "back", 5, 2), (2, "before", -4, 2), (None, "nobody", 0, 3), (777, "unknown", 0, 3)]
    table = spark.createDataFrame([(*s, "clash") for s in spans + spans[:7]], "doc_id long, section string, start int, end int, text string")
    got = {(r["doc_id"], r["section"], r["start"], r["end"]): (round(r["n_tokens"], 6), r["n_crossing"]) for r in count_in_spans(documents(rows), table, PATH, PATTERN, rule).collect()}
    want = {}
    for i, t in rows:
        own = sorted({(a, b, n) for d, n, a, b in spans if d is not None and d == i}, key=lambda s: [(v is not None, v) for v in s])
        for (a, b, n), found in zip(own, brute_spans(t or "", [(a, b) for a, b, _ in own], rule), strict=True):
            want[i, n, a, b] = found
    assert got == want


def test_spans_of_nothing(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, section string, start long, end long")
    assert count_in_spans(documents([(1, "a b")]), empty, PATH, PATTERN).count() == 0
    assert count_in_spans(documents([]), spark.createDataFrame([(1, "a", 0, 2)], empty.schema), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError):
        count_in_spans(documents([]), empty, PATH, PATTERN, "middle")
    twice = count_in_spans(documents([(1, "a b"), (1, "a b")]), spark.createDataFrame([(1, "a", 0, 2)], empty.schema), PATH, PATTERN)
    assert twice.count() == 2
