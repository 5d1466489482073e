import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from panelkit.llm import quality  # noqa: E402
from panelkit.llm.bpe import read_ranks  # noqa: E402
from tests.llm.test_decontaminate import brute_distance  # noqa: E402
from tests.llm.test_near_dedup import brute_classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows, good, bench):
    """Ids that stay after each of the first four stages."""
    kept = [(i, t or "") for i, t in rows if i in good]
    top = {}
    for i, t in kept:
        key = re.sub("[A-Z]", lambda m: m.group().lower(), t)
        top[key] = max(i, top.get(key, i))
    kept = [(i, t) for i, t in kept if i in set(top.values())]
    classes = brute_classes(sorted(kept))
    kept = [(i, t) for i, t in kept if classes[i] == i]
    items = [w for w in (re.findall(r"\w+", (t or "").lower()) for _, t in bench) if w]

    def leaked(text):
        words = re.findall(r"\w+", text.lower())
        have = set(words)
        # an item with more absent words than it may have edits can't be near; this only saves time
        close = (w for w in items if sum(x not in have for x in w) <= 0.2 * len(w))
        return any(brute_distance(w, words) <= (int(0.2 * len(w)) if len(w) >= 8 else 0) for w in close)

    return [(i, t) for i, t in kept if not leaked(t)]


def test_stages_are_the_ordered_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i for i, t in rows if model.score(quality.text_features([(t or "").encode()]))[0] >= 0.3}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = set()
    for i, t in brute(rows, good, bench):
        ids = coder.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True))
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_accept_odd_rows(documents, stage):
    rows = [(1, "plain words of a text that is quite fine"), (1, "plain words of a text that is quite fine"), (None, None), (2, None), (3, ""), (4, "x" * 100_000), (5, "a b " * 50_000)]
    step = corpus_pipeline.STAGES[stage][1]
    for docs in (documents(rows), documents([])):
        out = step(docs.sparkSession, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
