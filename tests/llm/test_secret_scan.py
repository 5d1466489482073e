import random
import re

import pytest

from panelkit.llm import secret_scan
from panelkit.llm.secret_scan import candidates, describe, labelled_findings, scan, train

NAMED = re.compile(rf"(?<![A-Za-z0-9])(?:{secret_scan.KEY_NAMES})[\"']?[ \t\n\x0b\f\r]{{0,3}}[:=]{{1,2}}>?[ \t\n\x0b\f\r]{{0,3}}[\"']?", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
KEY_FILE = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
VALUE = re.compile(r"[^ \t\n\x0b\f\r\"'<>]{6,}")


def brute(text):
    """(start, end, value) by going through the text place by place."""
    out, at = [], 0
    while at < len(text):
        key, named = KEY_FILE.match(text, at), NAMED.match(text, at)
        if key:
            out.append((at, key.end(), key.group()))
            at = key.end()
            continue
        value = None
        if named:
            # the longest name, sign and quote that still leave a value, as backtracking tries them
            for end in range(named.end(), at, -1):
                if NAMED.fullmatch(text, at, end) and (value := VALUE.match(text, end)):
                    break
        if value:
            out.append((value.start(), value.end(), value.group()))
            at = value.end()
            continue
        run = RUN.match(text, at) if at == 0 or not RUN.fullmatch(text[at - 1]) else None
        if run and len(run.group()) >= 16 and re.search("[0-9]", run.group()):
            out.append((at, run.end(), run.group()))
            at = run.end()
            continue
        at += 1
    return out


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled_findings(spark), trees=15)


def test_candidates_like_brute_force(documents):
    rng = random.Random(8)
    parts = ["token", "TOKEN", " = ", "=", ": ", '"', "'", "abcdef", "0123456789abcdef", "a1", "é", "\n", " ", "-----BEGIN RSA PRIVATE KEY-----", "/path/", "x" * 15, "7", "password", ".", "==", "<", "api_key"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 14)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "a" * 100_000), (903, "word " * 50_000 + "token=abc123xyz"), (904, "token=" * 20_000), (3, rows[4][1]), (4, rows[4][1]), (None, "secret: hunter2!")]
    got = sorted((str(r["doc_id"]), r["start"], r["end"], r["value"]) for r in candidates(documents(rows)).collect())
    want = sorted((str(i), *found) for i, t in rows for found in brute(t or ""))
    assert got == want


def test_held_out_findings(spark, model):
    rows = model.transform(describe(labelled_findings(spark, 1500, seed=5))).groupBy("label", "prediction").count().collect()
    count = {(r["label"], int(r["prediction"])): r["count"] for r in rows}
    assert count[1, 1] / (count[1, 1] + count.get((1, 0), 0)) > 0.93 and count[0, 0] / (count[0, 0] + count.get((0, 1), 0)) > 0.93


def test_scan(documents, model):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'la token = "{key}" de'), (2, "nr 4785380592391139 de"), (3, "see /static/js/main.3f2a9c81d2e4b7a6.js here"), (4, None), (1, f'la token = "{key}" de'), (5, "password = changeme")]
    got = [(r["doc_id"], r["value"], r["kept"]) for r in scan(documents(rows), model).collect()]
    assert got.count((1, key, True)) == 2 and (2, "4785380592391139", False) in got
    assert not any(kept for i, _, kept in got if i in (3, 5))
    assert scan(documents([]), model).count() == 0


def test_plan_is_native(documents, model):
    plan = scan(documents([(1, "x")]), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_training_ignores_nulls(spark):
    rows = [("a1b2c3d4e5f6a7b8", "token=", "", 1), ("hello", "password=", "", 0), (None, "x", "y", 1), ("z", None, "", 0), ("q", "", "", None)] * 4
    small = train(spark.createDataFrame(rows, "value string, left string, right string, label int"), trees=3)
    assert small.getNumTrees == 3
