import html
import itertools
import random
import re

import numpy as np
import pytest

from panelkit.llm import html_text
from panelkit.llm.crf import LinearChainCrf
from panelkit.llm.html_text import blocks, default_model, extract, features, labels_of, main_text, sample_pages


def test_viterbi_like_brute_force():
    rng = np.random.default_rng(2)
    names = {"": 0} | {f"f{k}": k + 1 for k in range(6)}
    model = LinearChainCrf(names, 3)
    model.weights, model.steps, model.first, model.last = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    sequences = [[[f"f{k}" for k in rng.permutation(6)[: rng.integers(0, 4)]] for _ in range(n)] for n in (1, 0, 5, 3, 6, 5, 2)]

    def score(sequence, path):
        emit = [model.weights[0] + sum((model.weights[names[f]] for f in item), np.zeros(3)) for item in sequence]
        return model.first[path[0]] + model.last[path[-1]] + sum(e[y] for e, y in zip(emit, path, strict=True)) + sum(model.steps[a, b] for a, b in itertools.pairwise(path))

    for cells in (1, 1 << 20):
        for sequence, path in zip(sequences, model.decode(sequences, cells), strict=True):
            if sequence:
                best = max(itertools.product(range(3), repeat=len(sequence)), key=lambda p: score(sequence, p))
                assert tuple(path) == best
            else:
                assert len(path) == 0


def test_fit_learns_steps_between_labels():
    rng = random.Random(3)
    sequences, labels = [], []
    for _ in range(60):
        y = [rng.randrange(2)]
        for _ in range(9):
            y.append(1 - y[-1] if rng.random() < 0.95 else y[-1])
        sequences.append([[f"x{v}"] if rng.random() < 0.6 else ["none"] for v in y])
        labels.append(y)
    model = LinearChainCrf.fit(sequences[:50], labels[:50], 2)
    right = [a == b for path, y in zip(model.decode(sequences[50:]), labels[50:], strict=True) for a, b in zip(path, y, strict=True)]
    assert np.mean(right) > 0.9


def test_blocks_of_broken_markup():
    page = "a<p>one &amp; two<br>three<p>four <b>bold<script>var x='</p>';</script> more</div><!-- no --> end<style>p{}</style><td x='>'>cell&nbsp;\n here<unclosed "
    assert [b.text for b in blocks(page)] == ["a", "one & two three", "four bold more", "end", "cell here"]
    assert blocks("") == [] and blocks("<<<>>>") != [] and blocks("<script>never closed") == []
    nested = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert [b.text for b in blocks(nested)] == ["deep"]


def test_long_odd_input_is_linear():
    for page in ("<" * 200_000, "<a " * 60_000, "<p " + "x='" * 60_000, "<!--" * 50_000, "<p>" * 20_000 + "x"):
        blocks(page)


def test_held_out_layouts():
    model, test = default_model(), sample_pages(120, seed=5)
    found = [blocks(p) for p, _ in test]
    labels = model.decode([features(p) for p in found])
    gold = [labels_of(p, t) for p, (_, t) in zip(found, test, strict=True)]
    right = [a == b for x, y in zip(labels, gold, strict=True) for a, b in zip(x, y, strict=True)]
    assert np.mean(right) > 0.98
    assert np.mean([main_text(p, x) == t for p, x, (_, t) in zip(found, labels, test, strict=True)]) > 0.85


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages, default_model()).collect()}
    for row in pages.collect():
        article = re.search("<article>(.*?)</article>", row["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(x for x in lines if x)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)


def test_edge_rows(spark):
    schema = "page_id long, url string, html string, text string"
    long = "<article>" + "<p>Some words of the main text are here.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<nav>a</nav>", "x"), (3, "u", long, "x"), (3, "u", long, "x")]
    got = extract(spark.createDataFrame(rows, schema), default_model()).collect()
    assert sorted((str(r["page_id"]), r["n_chars"], r["n_blocks"]) for r in got) == sorted([("1", 0, 0), ("2", 0, 0), ("None", 0, 1), ("3", 20_000 * 38 - 1, 20_000), ("3", 20_000 * 38 - 1, 20_000)])
    assert extract(spark.createDataFrame([], schema), default_model()).count() == 0


def test_fit_on_a_table(spark):
    table = spark.createDataFrame([*sample_pages(150, seed=8), (None, "x"), ("", None)], "html string, main string")
    model = html_text.fit_table(table, rounds=150)
    page = blocks("<body><nav><a href=x>Home</a></nav><article><p>Here is a text, and it goes on for a while.</p></article><footer>c</footer>")
    assert main_text(page, model.decode([features(page)])[0]) == "Here is a text, and it goes on for a while."


@pytest.mark.parametrize(
    "page, want",
    [
        # drawings: closed, nested, self-closed, never closed
        ("<p>A first.</p><svg viewBox='0 0 1 1'><text>no</text></svg><p>B second.", ["A first.", "B second."]),
        ("<p>A <svg><svg><text>no</text></svg><text>no</text></svg> b", ["A b"]),
        ('<p>A first.</p><svg viewBox="0 0 1 1"/><p>B second.</p>', ["A first.", "B second."]),
        ("<p>A first.</p><svg><g/><text>no<p>B second.</p>tail", ["A first.", "B second.", "tail"]),
        ("<p>A</p><svg><title>no</title><desc>no<b>no</b></desc><foreignObject><p>no</p><div>no</div></foreignObject><text>no</text></svg>B", ["A", "B"]),
        ("<p>A <svg><script>if (a < '<p>') b</script><path d='x'></svg>b", ["A b"]),
        ("A<svg>no", ["A"]),
        ("A</svg> b", ["A b"]),
        # formulas
        ("Let <math><mi>x</mi></math> be real", ["Let x be real"]),
        ("Let <math/> be", ["Let be"]),
        ("Let <math><mi>x<p>next", ["Let x", "next"]),
        # objects with something instead
        ("<object data=x><p>instead</p></object><p>B", ["instead", "B"]),
        ("<object data=x><p>instead<p>B", ["instead", "B"]),
        ("A<object data=x />b", ["Ab"]),
        # templates
        ("A<template><p>no<template>no</template>no</template>b", ["Ab"]),
        ("A<template><svg/><p>no</p></template>b", ["Ab"]),
        # left out to the end of the page, as browsers do
        ("A<style>p{}", ["A"]),
        ("<p>A<iframe src=x>no</iframe>b<noframes><p>no</noframes>c", ["Abc"]),
        ("<p>A <xmp><b>shown &amp; as it is</xmp> b", ["A <b>shown &amp; as it is b"]),
        # a tag without its end
        ("if a<b then c", ["if a"]),
        ("if a<b then c</p>d", ["if ad"]),
        ("if a < b then c", ["if a < b then c"]),
    ],
)
def test_elements_that_are_left_out(page, want):
    assert [b.text for b in blocks(page)] == want
