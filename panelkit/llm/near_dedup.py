"""Near-duplicate documents by DartMinHash signatures.

Every element (a word shingle) owns the region [0, weight) x [0, infinity) of a plane on which darts fall at unit rate:
how many hit a cell of a fixed grid, and where, follows from a hash of element and cell. A dart's height is its rank and
its hash names one of the signature's coordinates; each coordinate keeps its earliest dart. Two weighted sets then agree
in a coordinate with the probability of their weighted Jaccard similarity. Only darts up to a height of about
DARTS x coordinates / total weight are thrown, so a long document costs little more than a short one.

Signatures are cut into bands. Documents with equal shingle sets are folded into one first; the others meet where a band
agrees. Small buckets give all their pairs. Documents that are chained by larger buckets form a group, and in a group every
document is compared with every other whose length allows the similarity, block by block, whether they share a bucket or
not. Exact similarity decides, and linked documents form classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.components import components
from panelkit.llm.text import NOT_WORD, Words, chunks, document_columns, drop_ids, lowered, mix, per_batch, shared_table, signed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Darts per coordinate thrown at least; a coordinate without any (1 in 148) leaves its band out.
DARTS = 5
#: Buckets of so many documents or fewer are compared pair by pair; those of larger ones are compared as blocks.
SMALL_BUCKET = 16
#: Shingles in a block of a group (8 bytes each); a task compares two blocks.
BLOCK_SHINGLES = 1 << 19
#: Cells and index entries that a task counts in one step.
STEP_CELLS = 1 << 21
#: Up to so many candidate ids are sent to the tasks that read the texts (16 MB of longs); beyond, the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: Height of the lowest cell of the grid; each next cell is as high as all below it.
CELL = 1 / 64

_SALT = np.uint64(0x2545F4914F6CDD1D)


def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, copies) of the distinct n-word shingles of each text, sorted; a shorter text is one shingle."""

    words = Words(lowered(texts), NOT_WORD)
    at, grams = words.ngrams(n)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.array([mix(np.uint64(k) + np.sum(words.hashes[words.first[k_] : words.first[k_ + 1]] * (np.arange(k, dtype=np.uint64) * np.uint64(2) + np.uint64(3))).reshape(1))[0] for k_, k in zip(short, count[short], strict=True)], np.uint64)
    doc, grams = np.r_[doc, short], np.r_[grams, whole]
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])]) if len(doc) else np.zeros(0, int)
    return doc[first], grams[first], np.diff(np.r_[first, len(doc)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _poisson_counts(u: np.ndarray, mean: float) -> np.ndarray:
    """Number of darts in a cell of that area, by the inverse distribution function."""

    term, total, table = np.exp(-mean), np.exp(-mean), []
    k = 0
    while total < 1 - 1e-12 and k < mean + 12 * np.sqrt(mean) + 20:
        table.append(total)
        k += 1
        term *= mean / k
        total += term
    return np.searchsorted(np.array(table), u, side="right")


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, coordinates: int) -> np.ndarray:
    """n_docs x coordinates hashes of the earliest darts; 0 where a coordinate was not hit.

    Weights are positive; elements of one document are distinct. Equal weighted sets get equal rows.
    """

    total = np.bincount(doc, weights=weight, minlength=n_docs)
    with np.errstate(divide="ignore"):
        cells = np.where(total > 0, np.ceil(np.log2(np.maximum(DARTS * coordinates / np.maximum(total, 1e-300) / CELL, 1))), 0).astype(int)
    best_key, best_rank, best_dart = [], [], []
    # one unit column of the weight axis for each whole or begun unit of weight
    columns = np.ceil(weight).astype(int)
    column = np.arange(int(columns.sum())) - np.repeat(np.cumsum(columns) - columns, columns)
    d, w = np.repeat(doc, columns), np.repeat(weight, columns)
    base = mix(np.repeat(element, columns) + column.astype(np.uint64) * _SALT)
    need = cells[d]
    for cell in range(int(cells.max(initial=0)) + 1):
        live = np.flatnonzero(need >= cell)
        if not len(live):
            break
        low, height = (0.0, CELL) if cell == 0 else (CELL * 2 ** (cell - 1), CELL * 2 ** (cell - 1))
        seed = mix(base[live] ^ np.uint64(cell * 0x9E3779B1 + 1))
        hits = _poisson_counts(_uniform(seed), height)
        dart = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)
        of = np.repeat(live, hits)
        code = mix(np.repeat(seed, hits) + (dart.astype(np.uint64) + np.uint64(1)) * _SALT)
        inside = column[of] + _uniform(mix(code ^ np.uint64(7))) < w[of]
        of, code = of[inside], code[inside]
        best_key.append(d[of] * coordinates + (mix(code ^ np.uint64(5)) % np.uint64(coordinates)).astype(np.int64))
        best_rank.append(low + height * _uniform(mix(code ^ np.uint64(3))))
        best_dart.append(code)
    out = np.zeros(n_docs * coordinates, np.uint64)
    if best_key:
        key, rank, code = np.concatenate(best_key), np.concatenate(best_rank), np.concatenate(best_dart)
        order = np.lexsort((code, rank))[::-1]  # the earliest is written last
        out[key[order]] = code[order] | np.uint64(1)
    return out.reshape(n_docs, coordinates)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> list[list[int | None]]:
    """Hash of each band; None where a coordinate of it was not hit."""

    parts = signature.reshape(len(signature), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        keys = mix(keys + parts[:, :, r] * (_SALT + np.uint64(2 * r)))
    keys = mix(keys + np.arange(bands, dtype=np.uint64))
    full = (parts != 0).all(2)
    return [[k if ok else None for k, ok in zip(row, some, strict=True)] for row, some in zip(signed(keys).tolist(), full.tolist(), strict=True)]


def sketches(docs: DataFrame, *, weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, set_key (hash of the shingle set, null without words), keys (one per band).

    weighted takes a shingle's number of copies as its weight; else each counts 1.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc, grams, copies = shingles(texts)
            weight = copies.astype(float) if weighted else np.ones(len(grams))
            some = np.bincount(doc, minlength=len(ids)) > 0
            first = np.searchsorted(doc, np.arange(len(ids)))
            sums = np.zeros(len(ids), np.uint64)
            if len(grams):
                sums[some] = np.add.reduceat(mix(grams * (weight.astype(np.uint64) * np.uint64(2) - np.uint64(1)) + np.uint64(9)), first[some])
            set_keys = [int(k) if ok else None for k, ok in zip(signed(mix(sums)), some, strict=True)]
            yield {"doc_id": ids, "set_key": set_keys, "keys": _band_keys(dart_signatures(doc, grams, weight, len(ids), bands * rows), bands, rows)}

    return per_batch(document_columns(docs), make, "doc_id long, set_key long, keys array<long>")


def _shingle_sets(docs: DataFrame, weighted: bool) -> DataFrame:
    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc, grams, copies = shingles(texts)
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            packed = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            counts = [copies[a:b].astype("<u4").tobytes() if weighted else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            size = np.r_[0, np.cumsum(copies)][bounds] if weighted else bounds
            yield {"doc_id": ids, "grams": packed, "copies": counts, "size": np.diff(size)}

    return per_batch(docs, make, "doc_id long, grams binary, copies binary, size long")


def _similarity(a: bytes, b: bytes, a_copies: bytes, b_copies: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not a_copies and not b_copies:
        return len(i) / max(1, len(x) + len(y) - len(i))
    p, q = np.frombuffer(a_copies, "<u4").astype(float), np.frombuffer(b_copies, "<u4").astype(float)
    both = np.minimum(p[i], q[j]).sum()
    return float(both / max(1.0, p.sum() + q.sum() - both))


def _compare(batch: pa.RecordBatch) -> Iterator[dict]:
    a, b, *sets = (c.to_pylist() for c in batch.columns)
    yield {"a": a, "b": b, "similarity": [_similarity(*x) for x in zip(*sets, strict=True)]}


def _elements(grams: bytes, copies: bytes) -> np.ndarray:
    """The shingles of a set; of a multiset, an element of its own for each copy."""

    x = np.frombuffer(grams, np.uint64)
    if not copies:
        return x
    n = np.frombuffer(copies, "<u4").astype(np.int64)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(x, n) + nth.astype(np.uint64) * _SALT)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give nodes that are linked the smallest label among them, in place."""

    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _similar_in_blocks(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sets that are similar: one of either side, or any two if there is one side only.

    Shared elements are counted for all pairs of a step at once: a matrix product for elements that an eighth of the
    right-hand sets hold, lists of their holders for the rest.
    """

    size = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    _, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[col] > 1
    doc, col = doc[shared], col[shared]
    col = np.unique(col, return_inverse=True)[1]
    width = int(col.max(initial=-1)) + 1
    one_side = not side.any()
    left, right = np.flatnonzero(side == 0), np.arange(len(sets)) if one_side else np.flatnonzero(side == 1)
    m = len(right)
    place = np.full(len(sets), -1)
    place[right] = np.arange(m)
    of_right = np.flatnonzero(place[doc] >= 0)
    of_right = of_right[np.argsort(col[of_right], kind="stable")]
    holders = place[doc[of_right]]
    held = np.bincount(col[of_right], minlength=width)
    first = np.cumsum(held) - held
    hot = held * 8 >= m
    at_hot = np.cumsum(hot) - 1
    n_hot = int(hot.sum())
    dense = np.zeros((m, n_hot), np.float32)
    is_hot = hot[col[of_right]]
    dense[holders[is_hot], at_hot[col[of_right][is_hot]]] = 1
    bounds = np.searchsorted(doc, np.arange(len(sets) + 1))
    work = np.r_[0, np.cumsum(np.where(hot, 0, held)[col])][bounds]
    step = np.cumsum(np.diff(work)[left] + m + n_hot) // STEP_CELLS
    for rows in np.split(left, np.flatnonzero(np.diff(step)) + 1):
        inside = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
        c, r = col[inside], np.repeat(np.arange(len(rows)), np.diff(bounds)[rows])
        some = np.zeros((len(rows), n_hot), np.float32)
        some[r[hot[c]], at_hot[c[hot[c]]]] = 1
        both = (some @ dense.T).astype(np.int64)
        r, c = r[~hot[c]], c[~hot[c]]
        n = held[c]
        entry = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both += np.bincount(np.repeat(r, n) * m + holders[entry], minlength=both.size).reshape(both.shape)
        similar = both / np.maximum(1, size[rows][:, None] + size[right][None, :] - both) >= threshold
        i, j = np.nonzero(similar)
        i, j = rows[i], right[j]
        yield (i[i < j], j[i < j]) if one_side else (i, j)


def _compare_blocks(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids, side = rows["doc_id"].to_numpy(), rows["side"].to_numpy()
        sets = [_elements(g, c) for g, c in zip(rows["grams"].to_pylist(), rows["copies"].to_pylist(), strict=True)]
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(np.unique(side)) == 2 or rows["same"][0].as_py():
            for i, j in _similar_in_blocks(sets, side, threshold):
                links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                _unite(label, i, j)
        some = links > 0
        return pa.table({"a": ids[label[some]], "b": ids[some], "links": links[some]})

    return run


def buckets(heads: DataFrame) -> DataFrame:
    """The documents of (doc_id, keys) rows by band, where it agrees: doc_id, key, n (of the bucket), head (smallest doc_id)."""

    rows = heads.select("doc_id", F.explode("keys").alias("key")).where("key is not null")
    sizes = shared_table(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).where("n > 1"), "sizes")
    return shared_table(rows.join(sizes, "key"), "buckets")  # both sides are shuffled, so a hot bucket can be split


def _small_pairs(sized: DataFrame, small: int) -> DataFrame:
    little = sized.where(f"n <= {small}").groupBy("key").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    pairs = little.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p"))
    return pairs.select("p.a", "p.b").distinct()


def candidate_pairs(heads: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """Distinct (a, b), a < b, of (doc_id, keys) rows that meet in a bucket of up to `small` documents.

    Those of larger buckets are not paired here: large_groups() says which are compared as blocks.
    """

    return _small_pairs(buckets(heads), small)


def large_groups(sized: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """(doc_id, grp) of the documents in buckets() of more than `small`; those of one bucket are in one group."""

    star = sized.where(f"n > {small} and doc_id > head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    return components(star).select(F.col("node").alias("doc_id"), F.col("label").alias("grp"))


def links_in_groups(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Similar documents of each group of (doc_id, grp): rows (a, b, links), a in the class of b, links parts of b's number.

    A group is cut by length into classes of a factor 1 / threshold, so that similar documents are in the same or in
    neighbouring ones, and a class into blocks of a bounded size. Every two blocks of those classes meet in one task, which
    tells a row for each document with links: the smallest one it is linked with there and how many there are.
    """

    width = max(1e-9, -math.log(max(threshold, 1e-9))) * (1 + 1e-9)
    members = groups.join(sets.select("doc_id", "size"), "doc_id").withColumn("cls", F.floor(F.log("size") / width))
    members = shared_table(members, "members")
    cells = members.groupBy("grp", "cls").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("parts"))
    above = cells.select("grp", (F.col("cls") - 1).alias("cls"), F.col("parts").alias("above"))
    below = cells.select("grp", (F.col("cls") + 1).alias("cls"), F.col("parts").alias("below"))
    placed = members.join(cells, ["grp", "cls"]).join(above, ["grp", "cls"], "left").join(below, ["grp", "cls"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    meetings = F.expr("""concat(
        transform(sequence(0L, parts - 1), x -> struct(cls as c, least(part, x) as p, cls as d, greatest(part, x) as q, if(part <= x, 0, 1) as side)),
        if(above is null, array(), transform(sequence(0L, above - 1), x -> struct(cls as c, part as p, cls + 1 as d, x as q, 0 as side))),
        if(below is null, array(), transform(sequence(0L, below - 1), x -> struct(cls - 1 as c, x as p, cls as d, part as q, 1 as side))))""")
    tasks = placed.select("doc_id", "grp", F.explode(meetings).alias("t")).select("doc_id", "grp", "t.*", F.expr("t.c = t.d and t.p = t.q").alias("same"))
    return tasks.join(sets.drop("size"), "doc_id").groupBy("grp", "c", "p", "d", "q").applyInArrow(_compare_blocks(threshold), "a long, b long, links long")


def near_duplicates(docs: DataFrame, *, threshold: float = SIMILARITY, weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept, links.

    Documents are linked when the Jaccard similarity of their sets of five-word shingles (words: runs of letters, digits,
    underscores and non-ASCII characters, lower-cased) is threshold or more; weighted compares multisets. Texts under five
    words are one shingle. Documents that agree in no band and are in no common group of large buckets are not compared.
    Classes are the connected documents; the smallest doc_id is kept. links counts the differing shingle sets that the
    document's own was compared with and found similar to.
    Null, empty and wordless texts have no shingles: each is a class of its own. Rows with equal doc_id are taken as one
    document for the class and keep a row each; where they have several texts, the smallest shingle set is compared. Rows without doc_id are always kept; they have the class of the documents
    with an equal shingle set if there are any, else a class of their own (class_id null).
    An empty table gives no rows. Columns other than doc_id and text aren't read.
    """

    source = document_columns(docs)
    sketch = shared_table(sketches(source, weighted=weighted, bands=bands, rows=rows), "sketches")
    named = sketch.where("doc_id is not null and set_key is not null")
    folded = shared_table(named.groupBy("set_key").agg(F.min("doc_id").alias("head"), F.min("keys").alias("keys")), "heads")
    heads = folded.select(F.col("head").alias("doc_id"), "keys")
    sized = buckets(heads)
    groups = shared_table(large_groups(sized), "groups")
    of_a, of_b = groups.select(F.col("doc_id").alias("a"), F.col("grp").alias("grp_a")), groups.select(F.col("doc_id").alias("b"), F.col("grp").alias("grp_b"))
    pairs = _small_pairs(sized, SMALL_BUCKET).join(of_a, "a", "left").join(of_b, "b", "left")
    pairs = shared_table(pairs.where("grp_a is null or grp_b is null or grp_a <> grp_b").select("a", "b"), "pairs")  # the rest meet in blocks
    wanted = shared_table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(groups.select("doc_id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:  # else the texts are shuffled to their ids
        wanted = F.broadcast(wanted)
    found = _shingle_sets(source.join(wanted, "doc_id", "left_semi"), weighted)
    # where a doc_id has several texts, the smallest set counts, on every run
    sets = found.groupBy("doc_id").agg(F.min(F.struct("grams", *[c for c in found.columns if c not in ("doc_id", "grams")])).alias("s")).select("doc_id", "s.*").select(*found.columns)
    sets = shared_table(sets, "sets")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("grams").alias(f"{name}_grams"), F.col("copies").alias(f"{name}_copies"))

    compared = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_grams", "b_grams", "a_copies", "b_copies")
    links = per_batch(compared, _compare, "a long, b long, similarity double").where(F.col("similarity") >= threshold)
    links = links.select("a", "b", F.explode(F.array("a", "b")).alias("head"), F.lit(1).cast("long").alias("links"))
    in_groups = links_in_groups(groups, sets, threshold).select("a", "b", F.col("b").alias("head"), "links")
    links = shared_table(links.union(in_groups), "links")
    label = components(links.where("a <> b").select("a", "b"))
    degree = links.groupBy("head").agg(F.sum("links").alias("links"))
    of_head = folded.join(label.withColumnRenamed("node", "head"), "head", "left").join(degree, "head", "left")
    of_head = of_head.select("set_key", F.coalesce("label", "head").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rows_ = sketch.select("doc_id", "set_key").join(of_head, "set_key", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    sizes = shared_table(rows_.groupBy("class_id").agg(F.count("*").alias("class_size")), "classes")
    out = rows_.join(sizes, rows_["class_id"].eqNullSafe(sizes["class_id"])).select("doc_id", rows_["class_id"], "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    return out.select("doc_id", "class_id", F.when(F.col("class_id").isNull(), 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "links")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep, columns as they are.

    Of a class the smallest doc_id stays. Rows without doc_id stay, as do null, empty and wordless texts. Rows that repeat a
    doc_id stay or go together. An empty table stays empty.
    """

    return drop_ids(docs, near_duplicates(docs, **options).where("not kept").select("doc_id"))
