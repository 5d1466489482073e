import hashlib
import random
import re

import pytest

from panelkit.llm import pii
from panelkit.llm.pii import KINDS, all_spans, base_spans, default_model, sample_texts, spelled

# the patterns as they are defined
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def fits(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else d * 2 - 9 if d > 4 else d * 2 for k, d in enumerate(digits[::-1])]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    out = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m.group())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@pytest.fixture(scope="module")
def model():
    return default_model()


def test_base_like_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "B9", "@", ".", "..", "-", " ", "  ", "1", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", "+", "+49", "(0)", "x@y.z", "_", "%", "é", "٣", "\n", "0000", "12345678901234"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert base_spans(text) == brute(text), text


def test_long_odd_input_is_linear(model):
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "+1 " * 60_000, "1 2-" * 50_000, "@ x " * 40_000):
        assert len(all_spans([text], model)) == 1


def test_held_out_texts(model):
    right = found = gold = base = 0
    for text, spans in sample_texts(250, seed=4):
        want = {tuple(s.split(":")) for s in spans.split(",") if s}
        (own, every), = all_spans([text], model)
        got = {(k, str(a), str(b)) for k, a, b in every}
        right, found, gold, base = right + len(got & want), found + len(got), gold + len(want), base + len({(k, str(a), str(b)) for k, a, b in own} & want)
    assert right / gold > 0.95 and right / found > 0.95 and base < 0.7 * gold


def test_additions_touch_no_base_span(model):
    for text, _ in sample_texts(120, seed=31):
        (own, every), = all_spans([text], model)
        assert own == base_spans(text) and set(own) <= set(every)
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in set(every) - set(own) for b in own)


def test_operator(documents, model):
    mail = "write to kim@mail7.example.com. "
    rows = [(1, mail), (2, None), (3, ""), (4, "é" * 5 + mail), (5, "word " * 100_000 + mail), (1, mail), (None, "+1 (826) 555-4081"), (7, "card 4111 1111 1111 1111!"), (8, "ip 10.0.0.300 and 10.0.0.30")]
    got = pii.digest(pii.find(documents(rows), model)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        text = dict((str(i), t) for i, t in rows)[str(r["doc_id"])] or ""
        own = brute(text)
        assert r["base_sha256"] == hashlib.sha256(spelled(own).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in own) for k in KINDS]
        assert {spelled([s]) for s in own} <= set(r["spans"].split(","))
        seen[r["doc_id"]] = r["spans"]
    assert seen[4] == "email:14:35" and seen[2] == "" and seen[None] == "phone:0:17"
    assert pii.find(documents([]), model).count() == 0


def test_fit_on_a_table(spark):
    table = spark.createDataFrame([*sample_texts(150, seed=2), (None, "x"), ("", None)], "text string, spans string")
    small = pii.fit_table(table, rounds=60)
    (_, every), = all_spans(["call (826) 555-4081 now"], small)
    assert ("phone", 5, 19) in every
