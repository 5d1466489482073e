"""Ranked lexical search by pipelined term partitioning.

The index is cut by term among a few owners, and each owner's part by blocks of documents. A bundle is what one item has
gathered in one block: a sparse set of documents and their sums so far. Bundles pass the owners one after another; at each
stage a cogroup by block brings them to the owner's postings of that block, which add integer contributions. Owners of
rare terms come first, so that later stages can leave out documents that cannot reach the block's best any more: a
document goes only if its sum and all that the item's later terms can still add stay under the block's k-th sum. What a
bundle has at the end is its block's best, from which a ranking per item selects the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.text import NOT_ALNUM, Words, chunks, document_columns, hash_words, per_batch, shared_table

#: Documents returned for an item, at most.
TOP = 50
#: Length normalisation: percent of a document's length that counts, and what a term's occurrences are set against.
LENGTH_SHARE, SATURATION = 50, 20
#: Term owners, the stages of the pipeline.
OWNERS = 4
#: Items that go through the pipeline at once; more take several passes over the documents.
ITEMS_AT_ONCE = 5_000
#: Sums that the bundles of one block may hold, documents of a block at most, and postings after which a block is closed.
BLOCK_SUMS, BLOCK_DOCS, BLOCK_POSTINGS = 1 << 21, 8_192, 1 << 22

_FULL = 10**6  # a term's factor stays under it, however often the term occurs


@dataclass
class Terms:
    """The distinct terms of some items: sorted hashes, and of each item its terms (places among the hashes)."""

    item_ids: list[int | None]
    items: list[np.ndarray]
    hashes: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Terms:
        hashes = [np.unique(hash_words(np.frombuffer((t or "").encode().lower(), np.uint8), NOT_ALNUM)[2]) for _, t in rows]
        every = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        return cls([i for i, _ in rows], [np.searchsorted(every, h) for h in hashes], every)


def postings(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """Of each document with a term: doc_id, n (its terms, repeats counted), and those of the given terms that it holds, with occurrences."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Words([t.lower() for t in texts], NOT_ALNUM)  # of bytes: A-Z alone
            n = np.diff(words.first)
            place = np.minimum(np.searchsorted(hashes, words.hashes), max(0, len(hashes) - 1))
            hit = hashes[place] == words.hashes if len(hashes) else np.zeros(len(place), bool)
            pairs, times = np.unique(words.doc[hit] * max(1, len(hashes)) + place[hit], return_counts=True)
            doc, term = np.divmod(pairs, max(1, len(hashes)))
            held = np.flatnonzero(n)
            ends = np.searchsorted(doc, held, side="right")
            offsets = np.r_[0, ends].astype(np.int32)
            yield {
                "doc_id": pa.array(ids, pa.int64()).take(pa.array(held)), "n": n[held],
                "terms": pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            }

    return per_batch(document_columns(docs), make, "doc_id long, n long, terms array<int>, times array<int>")


def document_counts(found: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each term, the documents that hold it and its most occurrences in one. Tasks send one row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, most = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        for batch in batches:
            term, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            count += np.bincount(term, minlength=terms)
            np.maximum.at(most, term, times)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(most[held])], names=["term", "docs", "most"])

    sums = found.select("terms", "times").mapInArrow(run, "term long, docs long, most long").groupBy("term").agg(F.sum("docs").alias("docs"), F.max("most").alias("most"))
    count, most = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for row in sums.collect():
        count[row["term"]], most[row["term"]] = row["docs"], row["most"]
    return count, most


def factors(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times.astype(np.int64) // (1000 * times.astype(np.int64) + SATURATION * length)


def index(found: DataFrame, owner: np.ndarray, n_docs: int, n_terms: int, block_docs: int) -> DataFrame:
    """Inverted lists: one row per block and owner with the owner's terms in the block and, of each, documents and factors.

    A block is some consecutive documents of a task; the last owner's row also has their doc_ids.
    """

    owners = int(owner.max(initial=0)) + 1

    def block_rows(block: int, doc_ids: list, n: list, terms: list[np.ndarray], times: list[np.ndarray]) -> Iterator[dict]:
        length = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * n_docs // n_terms for x in n], np.int64)
        doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term, factor = np.concatenate(terms), factors(np.concatenate(times), length[doc])
        order = np.lexsort((doc, term, owner[term]))
        term, doc, factor = term[order], doc[order], factor[order]
        cuts = np.searchsorted(owner[term], np.arange(owners + 1))
        ids = pa.array(doc_ids, pa.int64())
        for k in range(owners):
            a, b = cuts[k], cuts[k + 1]
            if a < b or k == owners - 1:
                own, first = np.unique(term[a:b], return_index=True)
                yield {
                    "owner": [k], "block": [block], "terms": [own.astype("<i4").tobytes()], "first": [first.astype("<i4").tobytes()], "docs": [doc[a:b].astype("<i4").tobytes()],
                    "factors": [factor[a:b].astype("<i4").tobytes()], "doc_ids": pa.array([ids.to_pylist() if k == owners - 1 else None], pa.list_(pa.int64())),
                }

    schema = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("terms", pa.binary()), ("first", pa.binary()), ("docs", pa.binary()), ("factors", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = [batch.column(k) for k in (2, 3)]
            values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]
            ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))
            for i, (doc_id, words, stop) in enumerate(zip(ids, n, ends.tolist(), strict=True)):
                start = int(ends[i - 1]) if i else 0
                if start < stop:
                    for part, value in zip(held, (doc_id, words, values[0][start:stop], values[1][start:stop]), strict=True):
                        part.append(value)
                    size += stop - start
                if len(held[0]) >= block_docs or size >= BLOCK_POSTINGS:
                    yield from (pa.RecordBatch.from_pydict(r, schema) for r in block_rows(block, *held))
                    block, held, size = block + 1, ([], [], [], []), 0
        if held[0]:
            yield from (pa.RecordBatch.from_pydict(r, schema) for r in block_rows(block, *held))

    return found.mapInArrow(run, "owner int, block long, terms binary, first binary, docs binary, factors binary, doc_ids array<long>")


_BUNDLES = "block long, item int, docs binary, sums binary"
_BEST = "item int, doc_id long, score long"


def _stage(k: int, items: Terms, weights: np.ndarray, owner: np.ndarray, later: np.ndarray, top: int, last: bool):
    """What owner k does with the bundles of a block. later: of each item, what owners after k can still add."""

    mine = [t[owner[t] == k] for t in items.items]
    bundles, best = pa.schema([("block", pa.int64()), ("item", pa.int32()), ("docs", pa.binary()), ("sums", pa.binary())]), pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        carried = {i: (np.frombuffer(d, "<i4"), np.frombuffer(s, "<i8")) for i, d, s in zip(*(left.column(c).to_pylist() for c in ("item", "docs", "sums")), strict=True)}
        parts = {c: np.frombuffer(right.column(c)[0].as_py(), "<i4") if right.num_rows else np.zeros(0, "<i4") for c in ("terms", "first", "docs", "factors")}
        doc_ids = right.column("doc_ids")[0].as_py() if last and right.num_rows else None
        cuts = np.r_[parts["first"], len(parts["docs"])]
        size = 1 + max([int(parts["docs"].max(initial=-1)), *(int(d.max(initial=-1)) for d, _ in carried.values())])
        out: list[tuple] = []
        for item, terms in enumerate(mine):
            held = carried.get(item)
            place = np.searchsorted(parts["terms"], terms)
            known = place < len(parts["terms"])
            known[known] = parts["terms"][place[known]] == terms[known]
            if held is None and not known.any():
                continue
            sums = np.zeros(size, np.int64)
            if held is not None:
                sums[held[0]] = held[1]
            for at, term in zip(place[known].tolist(), terms[known].tolist(), strict=True):
                a, b = cuts[at], cuts[at + 1]
                sums[parts["docs"][a:b]] += weights[term] * parts["factors"][a:b]
            docs = np.flatnonzero(sums)
            sums = sums[docs]
            if len(docs) > top:
                bar = np.partition(sums, len(sums) - top)[len(sums) - top]
                stay = sums + later[item] >= bar
                docs, sums = docs[stay], sums[stay]
            if last:
                # of equal sums, the smaller doc_id; a missing one comes last
                ids = [doc_ids[d] for d in docs.tolist()]
                order = sorted(range(len(ids)), key=lambda j: (-sums[j], ids[j] is None, ids[j] or 0))[:top]
                out += [(item, ids[j], int(sums[j])) for j in order]
            elif len(docs):
                out.append((item, docs.astype("<i4").tobytes(), sums.astype("<i8").tobytes()))
        if last:
            return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(best)], schema=best)
        block = (left if left.num_rows else right).column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array([block] * len(out), pa.int64()), *(pa.array([r[c] for r in out], bundles[c + 1].type) for c in range(3))], schema=bundles)

    return run


def _ranked(docs: DataFrame, items: Terms, top: int, owners: int, block_docs: int) -> DataFrame:
    """item (place in items), doc_id, score of each block's best."""

    spark = docs.sparkSession
    found = shared_table(postings(docs, items.hashes), "postings")
    totals = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not totals["docs"]:
        return spark.createDataFrame([], _BEST)
    n_docs, n_terms = totals["docs"], totals["terms"]
    count, most = document_counts(found, len(items.hashes))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in count.tolist()], np.int64)
    bound = weights * np.minimum(_FULL, factors(most, np.full(len(most), 100 - LENGTH_SHARE)))
    # rare terms first, and as many postings for each owner
    owner, order = np.zeros(len(count), np.int64), np.argsort(count, kind="stable")
    owner[order] = np.minimum(owners - 1, (np.cumsum(count[order]) - count[order]) * owners // max(1, int(count.sum())))
    lists = shared_table(index(found, owner, n_docs, n_terms, block_docs).repartition("owner", "block").sortWithinPartitions("owner"), "lists")
    bundles = spark.createDataFrame([], _BUNDLES)
    last = int(owner.max(initial=0))
    for k in range(last + 1):
        later = np.array([int(bound[t[owner[t] > k]].sum()) for t in items.items], np.int64)
        step = _stage(k, items, weights, owner, later, top, k == last)
        held = lists.where(F.col("owner") == k).drop("owner") if k == last else lists.where(F.col("owner") == k).drop("owner", "doc_ids")
        bundles = bundles.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(step, _BEST if k == last else _BUNDLES)
    return bundles


def search(docs: DataFrame, benchmark: DataFrame, *, top: int = TOP, owners: int = OWNERS, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The best documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased, compared by a 64-bit hash. An item's terms
    count once each. Scores are whole numbers; those above 0 are ranked, equal scores by ascending doc_id (a null doc_id
    last). Null and empty texts and items have no terms and give no rows; nor do empty tables. Documents that repeat are
    ranked one by one, as are items that repeat. Only doc_id, text and item_id, text are read.
    """

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts, out = max(1, -(-items.count() // items_at_once)), None
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        terms = Terms.of([(r["item_id"], r["text"]) for r in rows])
        block_docs = max(64, min(BLOCK_DOCS, BLOCK_SUMS // max(1, len(rows))))
        ranked = _ranked(docs, terms, top, owners, block_docs).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        # the items of a pass, a bounded number
        names = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(terms.item_ids)], "item int, item_id long")
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionAll(named)
    return out
