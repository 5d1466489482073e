"""Building blocks every operator family shares.

All of them are written for groups of any size: grouped moments are partial aggregates joined back
(AQE splits a skewed join side), ranks and order statistics run on value counts cut into blocks when
a group is large, and look-back windows can be cut into blocks that carry the rows they need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import scalar as S
from panelkit.session import stored

# Largest number of distinct values one task sorts for one group before the group is cut into blocks.
BLOCK_ROWS = 5_000_000
BLOCKS_PER_GROUP = 64


def zsum(c: Column) -> Column:
    """Sum that is 0 when there is nothing to add."""

    return F.coalesce(F.sum(c), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


# Key columns of the data model are never null, so they join on plain equality and keep the
# partitioning they already have; other group columns match null with null.
NEVER_NULL = {"date_id", "time_id", "symbol_id", "fold"}


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach one row per group; null group values match null.

    No broadcast hint: AQE broadcasts the group table once its measured size is under the session
    threshold, and otherwise joins on the keys and splits a skewed key over several tasks.
    """

    if not keys:
        raise ValueError("keys must not be empty")
    if set(keys) <= NEVER_NULL:
        return df.join(groups, list(keys), how)
    renamed = groups.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__key_{k}") if k in NEVER_NULL else F.col(k).eqNullSafe(F.col(f"__key_{k}")))
    return df.join(renamed, condition, how).drop(*[f"__key_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Group aggregates attached to every row, robust to one huge group."""

    return join_groups(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def assert_rows(df: DataFrame, checks: Mapping[str, Column]) -> None:
    """Raise when any row violates a condition; all checks share one aggregate."""

    row = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in checks.items()]).first()
    bad = [f"{name} ({row[name]} rows)" for name in checks if row[name]]
    if bad:
        raise ValueError("; ".join(bad))


def distinct_sorted(df: DataFrame, column: str, limit: int = 100_000) -> list:
    """Distinct values of a fold- or calendar-like column. The size is checked, not assumed."""

    values = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted(v for v in values if v is not None)


# --------------------------------------------------------------------------- order statistics


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    *,
    by: str | None = None,
    interpolation: str = "linear",
    max_values: int = 200_000,
) -> dict:
    """Exact quantiles as ``{group: {name: [q, ...]}}`` without gathering a group anywhere.

    A mergeable sketch cuts each column's values into cells, narrow ones around the wanted order statistics.
    Spark counts the rows of every cell and adds the counts up, which says what cells hold the wanted ranks
    however good the sketch is; only the values of these are put in order, in blocks where a cell has more than
    ``max_values`` rows. The driver gets cut points, cells and values in proportion to groups x probabilities.
    """

    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("a quantile is a share of the rows, from 0 to 1")
    spark = df.sparkSession
    group = F.col(by) if by else F.lit(0)
    names = list(values)
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.when(S.is_finite(c), S.dbl(c)).alias("v")) for n, c in values.items()])
    long = df.select(group.alias("__g"), F.explode(entries).alias("e")).select("__g", "e.name", "e.v").where("v is not null")
    accuracy, margin = 4_000, 7.5e-4
    padded = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    keys = ["__g", "name"]
    sketch = long.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", padded, accuracy).alias("q"))
    # collected once so that every later use sees the same cuts, also after a lost executor
    columns = [(r["__g"], r["name"], r["q"], wanted_ranks(r["n"], probs, interpolation)) for r in sketch.collect()]
    if not columns:
        return {} if by else {0: {n: [None] * len(probs) for n in names}}
    key_fields = [long.schema["__g"], T.StructField("name", T.StringType())]
    ranks_field = T.StructField("ranks", T.ArrayType(T.LongType()))
    cuts = spark.createDataFrame([(g, name, q) for g, name, q, _ in columns], T.StructType([*key_fields, T.StructField("cuts", T.ArrayType(T.DoubleType()))]))
    ranks = spark.createDataFrame([(g, name, sorted({k for w in wanted for k in w[:2]})) for g, name, _, wanted in columns], T.StructType([*key_fields, ranks_field]))
    # a few groups hold all rows: joined by a shuffle on the group, these would be sorted in a few tasks
    placed = join_groups(long, F.broadcast(cuts), keys, "inner").select(*keys, "v", cell_of("v", "cuts", len(padded)).alias("cell"))
    cells = placed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("n"))
    held = F.filter("ranks", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    held = join_groups(cells, F.broadcast(ranks), keys, "inner").withColumn("ranks", held).where(F.size("ranks") > 0).collect()
    cell_field = placed.schema["cell"]
    chosen = spark.createDataFrame([(r["__g"], r["name"], r["cell"], r["before"], r["ranks"]) for r in held], T.StructType([*key_fields, cell_field, T.StructField("before", T.LongType()), ranks_field]))
    hot = [(r["__g"], r["name"], r["cell"]) for r in held if r["n"] > max_values]
    inside = join_groups(placed, F.broadcast(chosen.select(*keys, "cell")), [*keys, "cell"], "left_semi")
    counts = join_groups(ordered_counts(inside, [*keys, "cell"], "v", hot=hot), F.broadcast(chosen), [*keys, "cell"], "inner")
    at = F.filter("ranks", lambda k: (k >= F.col("before") + F.col("cum") - F.col("n")) & (k < F.col("before") + F.col("cum")))
    found = {(r["__g"], r["name"], r["k"]): r["v"] for r in counts.select(*keys, F.col("__v").alias("v"), F.explode(at).alias("k")).collect()}
    result: dict = {}
    for g, name, _, wanted in columns:
        low_high = [(found[g, name, k], found[g, name, k2], frac) for k, k2, frac in wanted]
        result.setdefault(g, {n: [None] * len(probs) for n in names})[name] = [lo + (hi - lo) * frac for lo, hi, frac in low_high]
    return result


def order_statistics(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], by: str, *, max_values: int = 200_000) -> dict:
    """The values on both sides of each quantile and the share of the upper one: ``{group: {name: [(low, high, share), ...]}}``.

    For many columns and a handful of groups: as ``exact_quantiles``, but a task finds the cells of its values in arrays, so
    that no row is made per column. A column without values has None in place of each triple.
    """

    spark, names = df.sparkSession, list(values)
    wide = df.select(F.col(by).alias("__g"), *[F.when(S.is_finite(c), S.dbl(c)).alias(f"v{k}") for k, c in enumerate(values.values())])
    padded = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-7.5e-4, 7.5e-4)})
    sketch = [e for k in range(len(names)) for e in (F.count(f"v{k}").alias(f"n{k}"), F.percentile_approx(f"v{k}", padded, 4_000).alias(f"q{k}"))]
    # collected once so that every later use sees the same cuts, also after a lost executor
    groups = {r["__g"]: r.asDict() for r in wide.groupBy("__g").agg(*sketch).collect()}
    cuts = {(g, k): np.array(r[f"q{k}"]) for g, r in groups.items() for k in range(len(names)) if r[f"n{k}"]}
    wanted = {(g, k): wanted_ranks(groups[g][f"n{k}"], probs, "linear") for g, k in cuts}

    def cells(chosen: Mapping[tuple, np.ndarray] | None):
        """Rows of each cell, or of each value in the chosen cells, batch by batch."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0)
                for g in own.unique().to_pylist():
                    mine = (own.is_null() if g is None else pc.equal(own, pa.scalar(g, own.type)).fill_null(False)).to_numpy(zero_copy_only=False)
                    for k in range(len(names)):
                        if (g, k) not in cuts:
                            continue
                        v = batch.column(k + 1).to_numpy(zero_copy_only=False)[mine]
                        v = v[~np.isnan(v)]
                        cell = np.searchsorted(cuts[g, k], v, side="left")
                        if chosen is None:
                            n = np.bincount(cell)
                            at = np.flatnonzero(n)
                            v, cell, n = np.zeros(len(at)), at, n[at]
                        else:
                            inside = np.isin(cell, chosen[g, k])
                            v, first, n = np.unique(v[inside], return_index=True, return_counts=True)
                            cell = cell[inside][first]
                        columns = [pa.array([g] * len(v), own.type), pa.array(np.full(len(v), k, np.int32)), pa.array(cell.astype(np.int32)), pa.array(v), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["__g", "k", "cell", "__v", "n"])

        kind = wide.schema["__g"].dataType.simpleString()
        return wide.mapInArrow(count, f"__g {kind}, k int, cell int, __v double, n long")

    keys = ["__g", "k", "cell"]
    sizes: dict = {}
    for r in cells(None).groupBy(*keys).agg(F.sum("n").alias("n")).collect():
        sizes.setdefault((r["__g"], r["k"]), {})[r["cell"]] = r["n"]
    before = {(*key, c): sum(n for other, n in held.items() if other < c) for key, held in sizes.items() for c in held}
    asked = {key: sorted({i for w in wanted[key] for i in w[:2]}) for key in cuts}
    held = {(*key, c): [i for i in asked[key] if before[(*key, c)] <= i < before[(*key, c)] + n] for key, of in sizes.items() for c, n in of.items()}
    held = {key: ranks for key, ranks in held.items() if ranks}
    if not held:
        return {g: {n: [None] * len(probs) for n in names} for g in groups}
    lines = cells({key: np.array(sorted(c for g, k, c in held if (g, k) == key)) for key in cuts})
    counts = stored(lines.groupBy(*keys, "__v").agg(F.sum("n").alias("n")), "cell-values")
    counts = running_counts(counts, counts, keys, hot_groups(counts, keys, max_values))
    types = T.StructType([*[lines.schema[c] for c in keys], T.StructField("before", T.LongType()), T.StructField("ranks", T.ArrayType(T.LongType()))])
    table = spark.createDataFrame([(*key, before[key], ranks) for key, ranks in held.items()], types)
    at = F.filter("ranks", lambda i: (i >= F.col("before") + F.col("cum") - F.col("n")) & (i < F.col("before") + F.col("cum")))
    rows = join_groups(counts, F.broadcast(table), keys, "inner").select(*keys, "__v", F.explode(at).alias("i")).collect()
    found = {(r["__g"], r["k"], r["i"]): r["__v"] for r in rows}
    triples = {key: [(found[(*key, lo)], found[(*key, hi)], share) for lo, hi, share in wanted[key]] for key in cuts}
    return {g: {n: triples.get((g, k), [None] * len(probs)) for k, n in enumerate(names)} for g in groups}


def cell_of(value: str, cuts: str, n: int) -> Column:
    """How many of the ``n`` cuts lie below the value: plain comparisons, which compile, while a lambda runs value by value."""

    return S.total([(F.col(cuts)[i] < F.col(value)).cast("int") for i in range(n)])


def wanted_ranks(n: int, probs: Sequence[float], interpolation: str) -> list[tuple[int, int, float]]:
    """(rank, next rank, weight of the next) of each quantile among n rows, from 0."""

    wanted = []
    for p in probs:
        h = p * (n - 1)
        k = math.floor(h + 0.5) if interpolation == "nearest" else math.floor(h)
        wanted.append((k, k, 0.0) if interpolation == "nearest" else (k, min(k + 1, n - 1), h - k))
    return wanted


def quantile(df: DataFrame, value: Column, probs: Sequence[float], interpolation: str = "linear") -> list[float]:
    """Exact quantiles of one column over the whole table."""

    groups = exact_quantiles(df, {"v": value}, probs, interpolation=interpolation)
    found = groups.get(0, {"v": [None] * len(probs)})["v"]
    if any(q is None for q in found):
        raise ValueError("quantile of an empty column")
    return found


def tercile_edges(q: Sequence[float | None], low: float | None, high: float | None) -> tuple[float, float]:
    """Two strictly increasing edges out of the 1/3 and 2/3 quantiles, with the tie fallbacks."""

    if q[0] is None:
        return 0.0, 1.0
    lo, hi = q
    if lo >= hi:
        lo, hi = low, high
    return (lo, lo + 1.0) if lo >= hi else (lo, hi)


# --------------------------------------------------------------------------- ranks


def hot_groups(df: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> list[tuple]:
    """Groups with more than ``block_rows`` rows. At most rows / block_rows groups can be that large."""

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows)
    return [tuple(r[k] for k in keys) for r in sizes.collect()]


def _hot_edges(df: DataFrame, keys: Sequence[str], value: str, hot: Sequence[tuple], blocks: int) -> DataFrame:
    """Value edges that cut each hot group into ``blocks`` parts of similar size."""

    spark = df.sparkSession
    probs = [i / blocks for i in range(1, blocks)]
    only = df
    if keys:
        only = join_groups(df, F.broadcast(spark.createDataFrame(list(hot), T.StructType([df.schema[k] for k in keys]))), keys, "left_semi")
    edges = only.groupBy(*keys).agg(F.percentile_approx(value, probs, 10_000).alias("__edges"))
    # collected once so that every later use sees the same edges, also after a lost executor
    return spark.createDataFrame(edges.collect(), edges.schema)


def ordered_counts(
    df: DataFrame, keys: Sequence[str], value: str, *, counted: Column | None = None, block_rows: int = BLOCK_ROWS, blocks: int = BLOCKS_PER_GROUP,
    hot: Sequence[tuple] | None = None, sums: Sequence[str] = (),
) -> DataFrame:
    """Distinct values per group with ``n`` rows each and ``cum`` rows up to and including the value.

    With ``counted`` only rows where it holds are counted, while every value gets a line; columns named in ``sums``
    are added up for each value. Groups above ``block_rows`` are cut into blocks of values whose totals are added up first.
    """

    rows = df.select(*keys, S.dbl(value).alias("__v"), (F.lit(True) if counted is None else counted).alias("__c"), *sums).where("__v is not null")
    counts = rows.groupBy(*keys, "__v").agg(F.count_if("__c").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return running_counts(counts, rows, keys, hot_groups(rows, keys, block_rows) if hot is None else hot, blocks)


def running_counts(counts: DataFrame, rows: DataFrame, keys: Sequence[str], hot: Sequence[tuple], blocks: int = BLOCKS_PER_GROUP) -> DataFrame:
    """Counts ``n`` of values ``__v`` with their running sum ``cum``; hot groups are cut into blocks of values at the quantiles of ``rows``."""

    if not hot:
        order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return counts.withColumn("cum", F.sum("n").over(order.orderBy("__v")))
    edges = _hot_edges(rows, keys, "__v", hot, blocks)
    if keys:
        block = F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col("__v"))), F.lit(0))
        cut = join_groups(counts, F.broadcast(edges), keys).withColumn("__block", block).drop("__edges")
    else:
        cut = counts.withColumn("__block", S.total([F.lit(0), *[(F.col("__v") > F.lit(e)).cast("int") for e in edges.first()["__edges"]]]))
    within = cut.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys, "__block").orderBy("__v")))
    prior = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__block").agg(F.sum("n").alias("__t"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__t").over(prior), F.lit(0))).drop("__t")
    joined = join_groups(within, totals, [*keys, "__block"])
    return joined.withColumn("cum", F.col("cum") + F.col("__before")).drop("__before", "__block")


def with_average_ranks(df: DataFrame, keys: Sequence[str], ranks: Mapping[str, str], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1-based average rank of each value column inside its group; null values get a null rank.

    The group sizes are checked once. While every group fits a task this is one window exchange shared by
    all columns; otherwise ranks come from value counts cut into blocks and are joined back.
    """

    if not ranks:
        return df
    hot = hot_groups(df, keys, block_rows)
    if keys and not hot:
        added = {}
        for value, output in ranks.items():
            v = S.dbl(value)
            ties = F.count(v).over(Window.partitionBy(*keys, v))
            place = F.rank().over(Window.partitionBy(*keys).orderBy(v.asc_nulls_last()))
            added[output] = F.when(v.isNotNull(), place + (ties - 1) / 2)
        return df.withColumns(added)
    for value, output in ranks.items():
        table = ordered_counts(df, keys, value, hot=hot)
        table = table.select(*keys, "__v", (F.col("cum") - (F.col("n") - 1) / 2).alias(output))
        matched = join_groups(df.withColumn("__v", S.dbl(value)), table, [*keys, "__v"])
        df = matched.withColumn(output, F.when(F.col("__v").isNotNull(), F.col(output))).drop("__v")
    return df


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, output: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return with_average_ranks(df, keys, {value: output}, block_rows=block_rows)


# --------------------------------------------------------------------------- look-back windows


def with_halo(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, rows: int, *, block_name: str = "__block"
) -> DataFrame:
    """Cut long ordered groups into blocks and repeat in each block the ``rows`` rows before it.

    Row counts of the blocks say which blocks look back on a row; it is sent to those alone, as it is.

    Repeated rows carry ``__halo = true``. A window partitioned by ``keys + block`` that looks back at
    most ``rows`` rows sees exactly what the window over the whole group would; drop the halo after.
    ``block`` must not decrease along ``order``.
    """

    if rows <= 0:
        raise ValueError("rows must be positive")
    columns = df.columns
    own = df.withColumn(block_name, block)
    recent = Window.partitionBy(*keys, block_name).orderBy(*[F.desc(c) for c in order])
    # rows up to and including each block, and the block that begins there
    blocks = Window.partitionBy(*keys).orderBy(block_name)
    ends = own.groupBy(*keys, block_name).agg(F.count(F.lit(1)).alias("__n"))
    ends = ends.withColumns({"__e": F.sum("__n").over(blocks.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.lead(block_name).over(blocks)})
    # of each block, the later ones that begin fewer than `rows` rows after its end
    near = Window.partitionBy(*keys).orderBy("__e").rangeBetween(0, rows - 1)
    begun = F.when(F.col("__next").isNotNull(), F.struct(F.col("__next").alias("b"), F.col("__e").alias("at")))
    routes = ends.select(*keys, block_name, "__e", F.collect_list(begun).over(near).alias("__to"))
    tail = own.withColumn("__r", F.row_number().over(recent)).where(F.col("__r") <= rows)
    reached = F.filter("__to", lambda t: F.col("__r") - 1 + t["at"] - F.col("__e") < rows)
    routed = join_groups(tail, routes, [*keys, block_name]).select(*columns, F.explode(F.transform(reached, lambda t: t["b"])).alias(block_name))
    return own.withColumn("__halo", F.lit(False)).unionByName(routed.withColumn("__halo", F.lit(True)))


def with_ewm(
    df: DataFrame,
    specs: Sequence[tuple[Column, int, str]],
    keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Exponentially weighted means seeded with the first value, ``alpha = 2 / (span + 1)``.

    Each spec is (value, span, output). The recurrence is written as weighted running sums over blocks
    short enough that the weights stay inside double range; what a block inherits is the mean at the end
    of the block before it, anything older having decayed below 1e-100.
    """

    path = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(path) - 1)
    for value, span, name in specs:
        if span <= 0:
            raise ValueError("span must be positive")
        if span == 1:
            out = out.withColumn(name, value)
            continue
        alpha = 2.0 / (span + 1)
        keep = 1.0 - alpha
        block_len = max(2, int(100 * math.log(10) / -math.log(keep)))
        j = F.pmod(F.col("__i"), F.lit(block_len))
        start = F.when(F.col("__i") == 0, 1.0).otherwise(alpha)
        block = Window.partitionBy(*keys, F.floor(F.col("__i") / block_len)).orderBy(*order)
        weighted = F.sum(start * value * F.pow(F.lit(keep), -j)).over(block)
        out = out.withColumn("__local", weighted * F.pow(F.lit(keep), j))
        ended = F.when(j == block_len - 1, F.col("__local"))
        carried = F.last(ended, ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(name, F.col("__local") + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(keep), j + 1)).drop("__local")
    return out.drop("__i")
