"""Token counts by section: whole documents are encoded once, and their tokens are given to sections by character spans.

Encoding each section by itself would give other tokens at the borders. Here the document's own tokens are laid over the
sections; a token that crosses a border goes where the chosen rule says, so the sections' counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.bpe import read_ranks
from panelkit.llm.text import document_columns, per_batch

#: Where a token that crosses a border goes: to the section of its first character, of its last one, to the one with most
#: of its characters (the first of equals), or to each by its share of the characters.
RULES = ("first", "last", "most", "share")

_ROWS = 1 << 16


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer, and the bytes of each token id."""

    ranks = read_ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_bounds(text: str, path: str, pattern: str) -> np.ndarray:
    """Byte offsets of the tokens of the whole text: token k is from bounds[k] to bounds[k + 1]."""

    coder, sizes = encoding(path, pattern)
    return np.r_[0, np.cumsum(sizes[coder.encode_to_numpy(text, disallowed_special=())])]


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte offsets of lines: section k is from bounds[k] to bounds[k + 1]; the newline belongs to the line that it ends."""

    ends = np.flatnonzero(data == 0x0A) + 1
    return np.unique(np.r_[0, ends, len(data)]) if len(data) else np.zeros(1, np.int64)


def allot(tokens: np.ndarray, sections: np.ndarray, data: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by the rule, tokens that lie in part) of each section, from the byte offsets of both."""

    n = len(sections) - 1
    first, last = tokens[:-1], tokens[1:] - 1
    begins = np.searchsorted(sections, first, side="right") - 1
    ends = np.searchsorted(sections, last, side="right") - 1
    crossing = np.flatnonzero(begins != ends)
    partly = np.zeros(n)
    if rule == "last":
        counts = np.bincount(ends, minlength=n).astype(float)
    else:
        counts = np.bincount(begins, minlength=n).astype(float)
    if len(crossing):
        # a character begins at each byte that doesn't continue one
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        for k in crossing:
            inside = np.arange(begins[k], ends[k] + 1)
            partly[inside] += 1
            if rule in ("most", "share"):
                cuts = np.clip(sections[begins[k] : ends[k] + 2], tokens[k], tokens[k + 1])
                held = np.diff(chars[cuts]).astype(float)
                counts[begins[k]] -= 1
                if rule == "most" or not held.sum():
                    counts[begins[k] + int(held.argmax())] += 1
                else:
                    counts[inside] += held / held.sum()
    return counts, partly


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "first") -> DataFrame:
    """One row per line of each document: doc_id, section (from 0), start, end (code points), n_tokens, n_crossing.

    n_tokens follows the rule for tokens that cross a border (a number of tokens; with "share" a part of one may count);
    n_crossing counts the tokens that lie in the line only in part. Over a document n_tokens adds up to its tokens. Null and
    empty texts have no lines and give no row; nor does an empty table. Rows are independent: repeated rows give repeated
    results. Texts of any length are encoded whole. Columns other than doc_id and text aren't read.
    """

    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                data = np.frombuffer(text.encode(), np.uint8)
                sections = line_bounds(data)
                counts, partly = allot(token_bounds(text, path, pattern), sections, data, rule)
                places = sections if len(text) == len(data) else np.r_[0, np.cumsum((data & 0xC0) != 0x80)][sections]
                yield doc_id, places[:-1], places[1:], counts, partly

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        held: list = []
        size = 0
        for row in rows(batch):
            held.append(row)
            size += len(row[1])
            if size >= _ROWS:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    def pack(held: list) -> dict:
        sizes = [len(row[1]) for row in held]
        start, end, counts, partly = (np.concatenate([row[k] for row in held]) for k in (1, 2, 3, 4))
        return {
            "doc_id": pa.array([row[0] for row in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes))), "section": np.concatenate([np.arange(n) for n in sizes]).astype(np.int32),
            "start": start.astype(np.int64), "end": end.astype(np.int64), "n_tokens": counts, "n_crossing": partly.astype(np.int64),
        }

    return per_batch(document_columns(docs), make, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")


def allot_spans(tokens: np.ndarray, spans: np.ndarray, data: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by the rule, tokens that lie in part) of each [start, end) of code points; spans may overlap and leave gaps."""

    # characters that begin before each byte; a token's characters are those that begin in it, or the one it continues
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    spans = np.clip(spans, 0, chars[-1])
    spans[:, 1] = spans.max(axis=1)
    if len(tokens) < 2:
        return np.zeros(len(spans)), np.zeros(len(spans))
    lo, hi = chars[tokens[:-1] + 1] - 1, chars[tokens[1:]]
    begun = np.minimum(chars[tokens[:-1]], hi - 1)
    a, b = spans[:, 0], spans[:, 1]
    # tokens that touch a span: from the first that ends behind its start to the last that starts before its end
    head, tail = np.searchsorted(hi, a, side="right"), np.searchsorted(lo, b)
    tail = np.where(b > a, np.maximum(tail, head), head)
    within = np.searchsorted(hi, b, side="right") - np.searchsorted(lo, a)
    partly = tail - head - np.where(b > a, np.clip(within, 0, None), 0)
    if rule == "first":
        counts = np.searchsorted(lo, b) - np.searchsorted(lo, a)
    elif rule == "last":
        counts = np.searchsorted(hi, b, side="right") - np.searchsorted(hi, a, side="right")
    else:
        counts = np.zeros(len(spans))
        most, owner = np.zeros(len(lo)), np.full(len(lo), -1)
        for k in range(len(spans)):
            at = slice(head[k], tail[k])
            held = np.clip(np.minimum(hi[at], b[k]) - np.maximum(begun[at], a[k]), 0, None)
            if rule == "share":
                counts[k] = (held / (hi[at] - begun[at])).sum()
            else:
                better = held > most[at]
                most[at] = np.where(better, held, most[at])
                owner[at] = np.where(better, k, owner[at])
        if rule == "most":
            counts = np.bincount(owner[owner >= 0], minlength=len(spans))
    return counts.astype(float), partly.astype(float)


def count_in_spans(docs: DataFrame, spans: DataFrame, path: str, pattern: str, rule: str = "first") -> DataFrame:
    """Tokens of the caller's sections: one row per document and span with doc_id, section, start, end, n_tokens, n_crossing.

    ``spans`` has doc_id, section (its name), start and end in code points, the end exclusive. Spans may overlap, nest, leave
    gaps or reach beyond the text. A token goes to each span with its first ("first") or last character ("last"), to each
    by its share of the characters ("share"), or only to the span with most of them, the first by start, end and name of
    equals ("most"). n_crossing counts the tokens that lie in the span only in part.

    A null start is the text's begin and a null end its end; a null name stays null. Spans without characters count 0, also
    those of null and empty texts. Repeated span rows count once, repeated documents each; spans with a null doc_id, or of
    no document, give no row, nor do documents without spans or empty tables. Other columns aren't read. A document's
    distinct spans go to the task that encodes it.
    """

    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    one = spans.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("section").cast("string")).where("doc_id is not null").distinct()
    listed = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "section"))).alias("__spans"))
    joined = document_columns(docs).join(listed, "doc_id").select("doc_id", "text", "__spans")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or ""
            data = np.frombuffer(text.encode(), np.uint8)
            places = np.array([[s["start"] or 0, len(text) if s["end"] is None else s["end"]] for s in found], np.int64)
            counts, partly = allot_spans(token_bounds(text, path, pattern), places, data, rule)
            yield {
                "doc_id": pa.array([doc_id] * len(found), pa.int64()), "section": pa.array([s["section"] for s in found], pa.string()),
                "start": pa.array([s["start"] for s in found], pa.int64()), "end": pa.array([s["end"] for s in found], pa.int64()),
                "n_tokens": counts, "n_crossing": partly.astype(np.int64),
            }

    return per_batch(joined, make, "doc_id long, section string, start long, end long, n_tokens double, n_crossing long")
