"""Signal screens and audits: transform views, interactions, nulls, periodicity, spectra and digits.

A screen expands rows to (feature, view, value) inside codegen and collapses them to a dozen sums per view;
fits and scores follow from the sums, so every screen is one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.blocks import LINE, Totals, added_up, matrix, pair_views, single_views, view_sums
from panelkit.operators.core import BLOCK_ROWS, exact_quantiles, hot_groups, join_groups, order_statistics, ordered_counts, ratio, running_counts, wanted_ranks, with_group_stats, with_halo, zsum
from panelkit.operators.layout import Layout, lay_out
from panelkit.operators.metrics import valid_rows
from panelkit.operators.profiles import unpivot
from panelkit.operators.sampling import bijection, row_index
from panelkit.operators.stats import normal_stats, standardizer, z_expr
from panelkit.schema import DATE, KEYS, SYMBOL, TARGET, TIME, WEIGHT
from panelkit.session import stored

# Fixed view names.
VIEWS = ("z", "rank", "sign", "abs_z", "square_z", "positive_indicator", "top05_indicator", "bottom05_indicator", "signed_tail05")
INTERACTIONS = ("sign_product", "rank_diff", "z_diff", "abs_z_diff", "z_product", "rank_product")
NULL_KINDS = ("iid", "block", "date", "circular")
MODULI = (*range(2, 65), 89, 97, 127)

IS_TRAIN = "is_train"


def split_frame(df: DataFrame, first_valid_date: int) -> DataFrame:
    return df.withColumn(IS_TRAIN, F.col(DATE) < first_valid_date)


# --------------------------------------------------------------------------- fits from sums


def fit_sums(df: DataFrame, by: Sequence[str], phi: str = "phi", y: str = TARGET, w: str = WEIGHT) -> DataFrame:
    """Train and validation sums of every view."""

    out = []
    for tag, cond in (("t", F.col(IS_TRAIN)), ("v", ~F.col(IS_TRAIN))):
        out += [zsum(F.when(cond, c)).alias(f"{tag}_{n}") for n, c in _terms(phi, y, w).items()]
    return df.where(valid_rows([phi, y], w)).groupBy(*by).agg(*out)


def _terms(phi: str, y: str, w: str) -> dict[str, Column]:
    x, t, m = S.dbl(phi), S.dbl(y), S.dbl(w)
    return {"sw": m, "swx": m * x, "swy": m * t, "swxx": m * x * x, "swyy": m * t * t, "swxy": m * x * t}


def with_fit(sums: DataFrame) -> DataFrame:
    """``alpha`` from the train sums; R2 and correlation of ``alpha x`` on both splits."""

    alpha = F.when(F.col("t_swxx") > 0, F.try_divide(F.col("t_swxy"), F.col("t_swxx"))).otherwise(0.0)
    out = sums.withColumn("alpha", alpha)
    for tag, name in (("t", "train"), ("v", "valid")):
        s = {n: F.col(f"{tag}_{n}") for n in ("sw", "swx", "swy", "swxx", "swyy", "swxy")}
        numerator = s["swyy"] - 2 * F.col("alpha") * s["swxy"] + F.col("alpha") * F.col("alpha") * s["swxx"]
        out = out.withColumn(f"{name}_r2", F.when(s["swyy"] > 0, 1.0 - F.try_divide(numerator, s["swyy"])).otherwise(0.0))
        vx = s["swxx"] - F.coalesce(ratio(s["swx"] * s["swx"], s["sw"]), F.lit(0.0))
        vy = s["swyy"] - F.coalesce(ratio(s["swy"] * s["swy"], s["sw"]), F.lit(0.0))
        cov = s["swxy"] - F.coalesce(ratio(s["swx"] * s["swy"], s["sw"]), F.lit(0.0))
        flat = (vx <= 1e-13 * s["swxx"]) | (vy <= 1e-13 * s["swyy"])
        out = out.withColumn(f"{name}_corr", F.when((s["sw"] > 0) & ~flat, F.try_divide(cov, F.sqrt(vx * vy))).otherwise(0.0))
    return out


# --------------------------------------------------------------------------- views


def wide_views(df: DataFrame, features: Sequence[str], *, ranks: bool = True) -> DataFrame:
    """Columns ``__x_f``, ``__z_f`` and ``__r_f`` in place of each feature f: train-only imputation, scaling and ranks.

    Train rows rank among themselves, validation rows get the share of train values not above them.
    """

    n, fill, scale = _filling(df, features)
    wide = df.select(*[c for c in df.columns if c not in features], *[_filled(c, fill[c]).alias(f"__x_{c}") for c in features])
    if ranks:
        wide = _with_ranks(wide, features, n)
    return wide.withColumns({f"__z_{c}": (F.col(f"__x_{c}") - F.lit(fill[c])) / F.lit(scale[c]) for c in features})


def _filled(feature: str, fill: float) -> Column:
    return F.coalesce(F.when(S.is_finite(feature), S.dbl(feature)), F.lit(fill))


def _filling(df: DataFrame, features: Sequence[str]) -> tuple[int, dict[str, float], dict[str, float]]:
    """Train rows, and of each feature the train mean that fills it and its scale once filled."""

    filled = {c: F.when(S.is_finite(c), S.dbl(c)) for c in features}
    train = F.col(IS_TRAIN)
    row = df.agg(
        F.count_if(train).alias("n"),
        *[F.avg(F.when(train, x)).alias(f"m_{c}") for c, x in filled.items()],
        *[F.count(F.when(train, x)).alias(f"k_{c}") for c, x in filled.items()],
        *[F.stddev_pop(F.when(train, x)).alias(f"s_{c}") for c, x in filled.items()],
    ).first()
    n = row["n"]
    fill = {c: row[f"m_{c}"] if row[f"m_{c}"] is not None else 0.0 for c in features}
    # filling with the mean leaves the mean alone and dilutes the variance by the share of missing rows
    spread = {c: (row[f"s_{c}"] or 0.0) * math.sqrt(row[f"k_{c}"] / n) if n else 0.0 for c in features}
    return n, fill, {c: v if v > 0 else 1.0 for c, v in spread.items()}


#: Largest number of distinct values of a feature whose ranks are sent to all tasks.
RANK_VALUES = 1_000_000


def _with_ranks(wide: DataFrame, features: Sequence[str], n: int) -> DataFrame:
    """Ranks of filled features from their counted values: the rows stay where they are unless a feature has very many values."""

    counts = _value_ranks(wide, features, n)
    values = {r["feature"]: r["count"] for r in counts.groupBy("feature").count().collect()}
    for c in features:
        table = counts.where(F.col("feature") == c).select(F.col("__v").alias(f"__x_{c}"), "__own", "__reference")
        wide = wide.join(F.broadcast(table) if values.get(c, 0) <= RANK_VALUES else table, f"__x_{c}")
        wide = wide.withColumn(f"__r_{c}", F.when(F.col(IS_TRAIN), F.col("__own")).otherwise(F.col("__reference"))).drop("__own", "__reference")
    return wide


def _value_ranks(wide: DataFrame, features: Sequence[str], n: int, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Each filled value ``__v`` of a feature with its rank among the train rows (``__own``), the one it gets outside of them
    (``__reference``), its train rows ``n``, and sums over its rows. Rows are read once; only their values are put in order."""

    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__x_{c}").alias("__v")) for c in features])
    sums = sums or {}
    long = wide.select(IS_TRAIN, *[c.alias(k) for k, c in sums.items()], F.explode(entries).alias("e")).select(IS_TRAIN, *sums, "e.*")
    cells = stored(long.groupBy("feature", "__v").agg(F.count_if(IS_TRAIN).alias("n"), *[F.sum(k).alias(k) for k in sums]), "values")
    counts = running_counts(cells, cells, ["feature"], hot_groups(cells, ["feature"]))
    own = (F.col("cum") - (F.col("n") + 1) / 2) / F.lit(float(max(n - 1, 1))) - 0.5 if n > 1 else F.lit(0.0)
    reference = F.col("cum") / F.lit(float(max(n, 1))) - 0.5 if n > 1 else F.lit(0.0)
    return stored(counts.select("feature", "__v", "n", own.alias("__own"), reference.alias("__reference"), *sums), "value-ranks")


def base_views(df: DataFrame, features: Sequence[str], *, ranks: bool = True) -> DataFrame:
    """Long table ``feature, x, z, rank`` of the columns that ``wide_views`` makes."""

    wide, names = wide_views(df, features, ranks=ranks), {"x": "x", "z": "z"} | ({"rank": "r"} if ranks else {})
    entries = [F.struct(F.lit(c).alias("feature"), *[F.col(f"__{k}_{c}").alias(n) for n, k in names.items()]) for c in features]
    return wide.select(*[c for c in df.columns if c not in features], F.explode(F.array(*entries)).alias("__e")).select("*", "__e.*").drop("__e")


def transform_views(df: DataFrame, features: Sequence[str], views: Sequence[str] = VIEWS) -> DataFrame:
    """Long table ``feature, transform, phi`` of the univariate views."""

    unknown = sorted(set(views) - set(VIEWS))
    if unknown:
        raise ValueError(f"unknown transform: {unknown}")
    base = base_views(df, features, ranks="rank" in views)
    x, z = F.col("x"), F.col("z")
    exprs = {
        "z": z,
        "sign": S.sign(x),
        "abs_z": F.abs(z),
        "square_z": z * z,
        "positive_indicator": (x > 0).cast("double"),
    }
    if "rank" in views:
        exprs["rank"] = F.col("rank")
    if any(v.endswith("05_indicator") or v == "signed_tail05" for v in views):
        edges = exact_quantiles(base.where(F.col(IS_TRAIN)), {"x": x}, [0.05, 0.95], by="feature")
        low = reduce(lambda acc, f: acc.when(F.col("feature") == f, F.lit(edges[f]["x"][0])), features, F.when(F.lit(False), F.lit(0.0)))
        high = reduce(lambda acc, f: acc.when(F.col("feature") == f, F.lit(edges[f]["x"][1])), features, F.when(F.lit(False), F.lit(0.0)))
        top, bottom = (x >= high).cast("double"), (x <= low).cast("double")
        exprs |= {"top05_indicator": top, "bottom05_indicator": bottom, "signed_tail05": top - bottom}
    entries = F.array(*[F.struct(F.lit(v).alias("transform"), exprs[v].alias("phi")) for v in views])
    return base.withColumn("__v", F.explode(entries)).select("*", "__v.*").drop("__v", "x", "z", "rank")


def univariate_screen(df: DataFrame, features: Sequence[str], views: Sequence[str] = VIEWS, *, details: bool = True, bins: int = 10) -> DataFrame:
    """Fit, R2, correlation and (with ``details``) tail means and binned information of every view."""

    shown = ["feature", "transform", "alpha", "train_r2", "valid_r2", "train_corr", "valid_corr"]
    if not details:
        return with_fit(fit_sums(transform_views(df, features, views), ["feature", "transform"])).select(*shown)
    sums = _screen_sums(df, features, views, bins)
    by = ["feature", "transform"]
    alone = sums.where("xb < 0")
    terms = _terms("", "", "")
    both = [zsum(F.when(cond, F.col(n))).alias(f"{tag}_{n}") for tag, cond in (("t", F.col(IS_TRAIN)), ("v", ~F.col(IS_TRAIN))) for n in terms]
    fits = with_fit(alone.groupBy(*by).agg(F.sum("n").alias("rows"), *both).where("rows > 0")).select(*shown)
    mean = {t: F.coalesce(ratio(F.col(f"{t}wy"), F.col(f"{t}w")), F.lit(0.0)) for t in "lh"}
    tails = alone.select(*by, IS_TRAIN, mean["l"].alias("tail_low_mean"), mean["h"].alias("tail_high_mean"), (mean["h"] - mean["l"]).alias("tail_spread"))
    known = _information(sums.where("xb >= 0"), [*by, IS_TRAIN]).select(*by, IS_TRAIN, "binned_mi")
    tails = tails.join(known, [*by, IS_TRAIN])
    wide = tails.groupBy(*by).agg(
        *[
            F.max(F.when(F.col(IS_TRAIN) == flag, F.col(c))).alias(f"{name}_{c}")
            for flag, name in ((True, "train"), (False, "valid"))
            for c in ("tail_low_mean", "tail_high_mean", "tail_spread", "binned_mi")
        ]
    )
    return fits.join(wide, by)


_FIT_NAMES, _TAIL_NAMES = ("sw", "swx", "swy", "swxx", "swyy", "swxy"), ("lw", "lwy", "hw", "hwy")


def _screen_sums(df: DataFrame, features: Sequence[str], views: Sequence[str], bins: int) -> DataFrame:
    """What a screen needs of each view and split, as a small written table ``feature, transform, is_train, xb, yb``.

    Lines of a cell of bins hold its rows ``n``; the line with xb = -1 holds the sums of the fit and of the tails, and as n
    the rows that the fit counts. A view is a monotone function of the filled value or of the size of its z-score: the order
    statistics of these two give those of all views, and sums with ranks come from sums per value. No row is made per view.
    """

    if unknown := sorted(set(views) - set(VIEWS)):
        raise ValueError(f"unknown transform: {unknown}")
    n, fill, scale = _filling(df, features)
    w, y, valid = S.dbl(WEIGHT), S.dbl(TARGET), valid_rows([TARGET])
    x = {f: F.col(f"__x_{f}") for f in features}
    z = {f: (x[f] - F.lit(fill[f])) / F.lit(scale[f]) for f in features}
    wide = df.select(IS_TRAIN, w.alias("w"), y.alias("y"), valid.alias("valid"), *[_filled(f, fill[f]).alias(f"__x_{f}") for f in features])
    probs = [0.05, 0.95, *[i / bins for i in range(1, bins)]]
    sizes = {f"a_{f}": F.abs(z[f]) for f in features} if {"abs_z", "square_z"} & set(views) else {}
    found = order_statistics(wide, {"y": F.col("y"), **{f"x_{f}": x[f] for f in features}, **sizes}, probs, IS_TRAIN)
    near = {part: {f: got[f"x_{f}"] for f in features} for part, got in found.items()}
    edges = {f: [lo + (hi - lo) * share for lo, hi, share in near[True][f][:2]] if True in near else [math.nan, math.nan] for f in features}
    # rows of each split, and those in the lower tail: the only view that falls while the value rises has two values
    tails = [F.count_if(x[f] <= F.lit(edges[f][0])).alias(f"l_{f}") for f in features]
    rows = {r[IS_TRAIN]: r.asDict() for r in wide.groupBy(IS_TRAIN).agg(F.count(F.lit(1)).alias("n"), *tails).collect()}
    ranked = _value_ranks(wide, features, n, _rank_terms()) if "rank" in views else None
    cuts = _view_cuts(features, views, found, rows, edges, fill, scale, probs)
    if ranked is not None:
        cuts |= _rank_cuts(ranked, near)
    y_edges = {part: sorted({lo + (hi - lo) * share for lo, hi, share in got["y"][2:]}) if got["y"][0] else [] for part, got in found.items()}
    code = reduce(lambda c, part: c.when(F.col(IS_TRAIN) == part, S.edge_code("y", y_edges[part])), y_edges, F.when(F.lit(False), F.lit(0)))
    base = wide.select(
        IS_TRAIN, F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce(F.col("w") * F.col("y"), F.lit(0.0)).alias("wy"), F.when(F.col("valid"), F.col("y")).otherwise(0.0).alias("y"),
        "valid", F.coalesce(code, F.lit(0)).alias("yb"), F.array(*x.values()).alias("x"),
    )
    m, s = (np.array([d[f] for f in features]) for d in (fill, scale))
    # in place of its rank a value stands itself, with the cuts of the ranks brought back to values
    functions = dict(zip(views, _single(features, views, {f: {"x": e} for f, e in edges.items()}), strict=True)) | {"rank": lambda x, z, r: x}
    names, splits = ["feature", "transform", IS_TRAIN, "xb", "yb", "n", *_TAIL_NAMES, *_FIT_NAMES], list(rows)
    schema = f"feature string, transform string, {IS_TRAIN} boolean, xb int, yb int, " + ", ".join(f"{c} double" for c in names[5:])
    order = [(f, v) for f in features for v in views]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {(part, *fv): np.zeros((bins + 1, bins + 1)) for part in splits for fv in order}
        alone = {key: np.zeros(11) for key in cells}
        for batch in batches:
            split, w, wy, y, ok, yb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            x = matrix(batch.column(6), batch.num_rows)
            for part in splits:
                mine = split == part
                if not mine.any():
                    continue
                own, ws, wys, ys, oks, ybs = x[mine], w[mine], wy[mine], y[mine], ok[mine], yb[mine]
                zs, wf = (own - m) / s, np.where(oks, ws, 0.0)
                for v in views:
                    phis = functions[v](own, zs, None)
                    for k, f in enumerate(features):
                        phi, key = phis[:, k], (part, f, v)
                        below, above, bounds = cuts[key]
                        low, high = phi <= below if v != "rank" else phi < below, phi >= above
                        cells[key] += np.bincount(np.searchsorted(bounds, phi, side="right") * (bins + 1) + ybs, minlength=(bins + 1) ** 2).reshape(bins + 1, -1)
                        fit = np.zeros(6)
                        if v != "rank":
                            finite = np.isfinite(phi)
                            counted, phi = np.where(finite, wf, 0.0), np.where(finite, phi, 0.0)
                            wx = counted * phi
                            fit = np.array([counted.sum(), wx.sum(), counted @ ys, wx @ phi, (counted * ys) @ ys, wx @ ys])
                        alone[key] += [float((oks & finite).sum()) if v != "rank" else 0.0, ws[low].sum(), wys[low].sum(), ws[high].sum(), wys[high].sum(), *fit]
        lines = [(f, v, part, -1, -1, *alone[part, f, v]) for part, f, v in cells]
        for part, f, v in cells:
            xb, yb = np.nonzero(cells[part, f, v])
            lines += [(f, v, part, int(a), int(b), cells[part, f, v][a, b], *[0.0] * 10) for a, b in zip(xb, yb, strict=True)]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), *[pa.float64()] * 11], strict=True)], names=names)

    lines = base.mapInArrow(partial, schema)
    if ranked is not None:
        lines = lines.unionByName(_rank_sums(ranked, names))
    return stored(lines.groupBy(*names[:5]).agg(*[F.sum(c).alias(c) for c in names[5:]]), "screen-sums")


def _view_cuts(
    features: Sequence[str], views: Sequence[str], found: Mapping[bool, dict], rows: Mapping[bool, dict], edges: Mapping[str, list], fill: Mapping[str, float], scale: Mapping[str, float], probs: Sequence[float]
) -> dict:
    """Tail bounds and bin edges ``{(split, feature, view): (low, high, edges)}`` of the views without ranks."""

    cuts = {}
    for part, got in found.items():
        total = rows[part]["n"]
        for f in features:
            one = dict(zip(views, _single([f], views, {f: {"x": edges[f]}}), strict=True))
            for v in views:
                if v == "rank":
                    continue
                if v == "bottom05_indicator":
                    first = total - rows[part][f"l_{f}"]
                    triples = [(float(k >= first), float(k2 >= first), share) for k, k2, share in wanted_ranks(total, probs, "linear")]
                elif v in ("abs_z", "square_z"):
                    triples = [(a, b, share) if v == "abs_z" else (a * a, b * b, share) for a, b, share in got[f"a_{f}"]]
                else:
                    ends = np.array([[q[0], q[1]] for q in got[f"x_{f}"]])
                    at = one[v](ends.reshape(-1, 1), (ends.reshape(-1, 1) - fill[f]) / scale[f], None).reshape(-1, 2)
                    triples = [(float(a), float(b), q[2]) for (a, b), q in zip(at, got[f"x_{f}"], strict=True)]
                q = [lo + (hi - lo) * share for lo, hi, share in triples]
                cuts[part, f, v] = (q[0], q[1], np.array(sorted(set(q[2:]))))
    return cuts


def _rank_terms() -> dict[str, Column]:
    """Sums per value that give the rank's sums: weights, weighted targets and counted rows of both splits."""

    w, y, train = F.col("w"), F.col("y"), F.col(IS_TRAIN)
    terms = {"k": F.lit(1.0), "sw": w, "swy": w * y, "swyy": w * y * y}
    return {f"{t}_{n}": F.when(F.col("valid") & cond, c).otherwise(0.0) for t, cond in (("t", train), ("v", ~train)) for n, c in terms.items()}


def _rank_sums(ranked: DataFrame, names: Sequence[str]) -> DataFrame:
    """The fit's sums of the rank view, a line for each feature and split."""

    parts = []
    for t, part, r in (("t", True, F.col("__own")), ("v", False, F.col("__reference"))):
        sw, swy = F.col(f"{t}_sw"), F.col(f"{t}_swy")
        terms = {"n": F.col(f"{t}_k"), "sw": sw, "swx": sw * r, "swy": swy, "swxx": sw * r * r, "swyy": F.col(f"{t}_swyy"), "swxy": swy * r}
        # a split without rows has no line
        sums = ranked.groupBy("feature").agg(*[F.sum(c).alias(k) for k, c in terms.items()]).where("n > 0")
        fixed = {"transform": F.lit("rank"), IS_TRAIN: F.lit(part), "xb": F.lit(-1), "yb": F.lit(-1)} | {c: F.lit(0.0) for c in _TAIL_NAMES}
        parts.append(sums.withColumns(fixed).select(*names))
    return parts[0].unionByName(parts[1])


def _rank_cuts(ranked: DataFrame, near: Mapping[bool, dict]) -> dict:
    """Tail bounds and bin edges of the rank view as values: a rank is at or above an edge where its value is at or above the cut."""

    spark = ranked.sparkSession
    asked = sorted({(f, float(e)) for got in near.values() for f, qs in got.items() for q in qs for e in q[:2]})
    wanted = F.broadcast(spark.createDataFrame(asked, "feature string, __v double"))
    ranks = {(r["feature"], r["__v"]): (r["__own"], r["__reference"]) for r in ranked.join(wanted, ["feature", "__v"], "left_semi").collect()}
    keyed = []
    for part, got in near.items():
        for f, qs in got.items():
            ends = [(ranks[f, lo][0 if part else 1], ranks[f, hi][0 if part else 1], share) for lo, hi, share in qs]
            q = [lo + (hi - lo) * share for lo, hi, share in ends]
            keyed += [(f, part, 0, q[0], True), (f, part, 1, q[1], False), *[(f, part, 2, e, False) for e in sorted(set(q[2:]))]]
    table = F.broadcast(spark.createDataFrame(keyed, "feature string, part boolean, role int, edge double, strict boolean"))
    rank = F.when(F.col("part"), F.col("__own")).otherwise(F.col("__reference"))
    reached = (~F.col("part") | (F.col("n") > 0)) & F.when(F.col("strict"), rank > F.col("edge")).otherwise(rank >= F.col("edge"))
    first = ranked.join(table, "feature").groupBy("feature", "part", "role", "edge").agg(F.min(F.when(reached, F.col("__v"))).alias("at")).collect()
    cuts = {}
    for part, got in near.items():
        for f in got:
            mine = {role: sorted(math.inf if r["at"] is None else r["at"] for r in first if (r["feature"], r["part"], r["role"]) == (f, part, role)) for role in (0, 1, 2)}
            cuts[part, f, "rank"] = (mine[0][0], mine[1][0], np.array(mine[2]))
    return cuts


def _information(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mutual information of a count table with the tail sums carried along. At most bins^2 cells per view."""

    view = Window.partitionBy(*by)
    shares = cells.withColumns({"tot": F.sum("n").over(view), "nx": F.sum("n").over(Window.partitionBy(*by, "xb")), "ny": F.sum("n").over(Window.partitionBy(*by, "yb"))})
    info = F.sum(F.col("n") / F.col("tot") * F.log(F.col("n") * F.col("tot") / (F.col("nx") * F.col("ny"))))
    varied = (F.max("xb") > 0) & (F.max("yb") > 0)
    mean = {t: F.coalesce(ratio(F.sum(f"{t}wy"), F.sum(f"{t}w")), F.lit(0.0)) for t in "lh"}
    return shares.groupBy(*by).agg(
        mean["l"].alias("tail_low_mean"), mean["h"].alias("tail_high_mean"), (mean["h"] - mean["l"]).alias("tail_spread"),
        F.when(varied, info).otherwise(0.0).alias("binned_mi"),
    )


def binned_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information of two columns over quantile bins with distinct edges."""

    if bins < 2:
        raise ValueError("mutual information takes two bins or more")
    finite = df.where(S.is_finite(x) & S.is_finite(y)).select(S.dbl(x).alias("x"), S.dbl(y).alias("y"))
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(finite, {"x": F.col("x"), "y": F.col("y")}, probs)[0]
    code = {c: S.edge_code(c, sorted(set(edges[c]))) for c in "xy"}
    cells = finite.groupBy(code["x"].alias("xb"), code["y"].alias("yb")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = cells.withColumns({"g": F.lit(0), **{c: F.lit(0.0) for c in ("lw", "lwy", "hw", "hwy")}})
    return _information(cells, ["g"]).select("binned_mi")


def tail_spread(df: DataFrame, x: str, *, y: str = TARGET, weight: str = WEIGHT, low_q: float = 0.05, high_q: float = 0.95) -> DataFrame:
    """Weighted target means in the two tails of ``x`` and their difference."""

    if not 0.0 < low_q < high_q < 1.0:
        raise ValueError("tail quantiles must satisfy 0 < low < high < 1")
    rows = df.where(valid_rows([x, y], weight))
    low, high = exact_quantiles(rows, {"x": S.dbl(x)}, [low_q, high_q])[0]["x"]
    w, t = S.dbl(weight), S.dbl(y)

    def mean(cond: Column) -> Column:
        return F.coalesce(ratio(zsum(F.when(cond, w * t)), zsum(F.when(cond, w))), F.lit(0.0))

    out = rows.agg(mean(S.dbl(x) <= low).alias("tail_low_mean"), mean(S.dbl(x) >= high).alias("tail_high_mean"))
    return out.withColumn("tail_spread", F.col("tail_high_mean") - F.col("tail_low_mean"))


def reference_rank(df: DataFrame, column: str, output: str = "reference_rank") -> DataFrame:
    """Share of train values not above each validation value, centred; train rows get their own rank."""

    ranked = base_views(df.withColumn("__c", S.dbl(column)), ["__c"]).withColumnRenamed("rank", output)
    return ranked.drop("feature", "x", "z")


#: The six views of a feature pair as products, differences and distances of signs, ranks and z-scores.
_PAIRS = dict(zip(INTERACTIONS, ("product:sign", "difference:rank", "difference:z", "distance:z", "product:z", "product:rank"), strict=True))


def feature_arrays(df: DataFrame, features: Sequence[str], *columns: str) -> DataFrame:
    """One row per key with arrays ``x``, ``z`` and ``rank`` of the features, in their order, for block products.

    Rows whose target or weight can't count are left out.
    """

    keep = [*KEYS, WEIGHT, TARGET, IS_TRAIN, *columns]
    wide = wide_views(df.where(valid_rows([TARGET])).select(*keep, *features), features)
    return wide.select(*keep, *[F.array(*[F.col(f"__{k}_{f}") for f in features]).alias(n) for n, k in (("x", "x"), ("z", "z"), ("rank", "r"))])


def _single(features: Sequence[str], views: Sequence[str], edges: Mapping[str, dict]):
    """The univariate views as functions of matrices."""

    if unknown := sorted(set(views) - set(VIEWS)):
        raise ValueError(f"unknown transform: {unknown}")
    low, high = (np.array([edges[f]["x"][k] if f in edges else math.nan for f in features]) for k in (0, 1))
    known = {
        "z": lambda x, z, r: z, "rank": lambda x, z, r: r, "sign": lambda x, z, r: np.sign(x), "abs_z": lambda x, z, r: np.abs(z), "square_z": lambda x, z, r: z * z,
        "positive_indicator": lambda x, z, r: (x > 0).astype(float), "top05_indicator": lambda x, z, r: (x >= high).astype(float),
        "bottom05_indicator": lambda x, z, r: (x <= low).astype(float), "signed_tail05": lambda x, z, r: (x >= high).astype(float) - (x <= low),
    }
    return [known[v] for v in views]


def _edges(wide: DataFrame, features: Sequence[str]) -> dict:
    """5 % and 95 % quantiles of each filled feature's train values."""

    found = order_statistics(wide, {f: F.col(f) for f in features}, [0.05, 0.95], "__s").get(0, {})
    return {f: {"x": [lo + (hi - lo) * share for lo, hi, share in q]} for f, q in found.items()}


def _named(sums: DataFrame, features: Sequence[str], kinds: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Names in place of the numbers of features and kinds: (feature, kind) or (first, second, kind)."""

    feature, kind = F.array(*[F.lit(f) for f in features]), F.array(*[F.lit(k) for k in kinds])
    parts = [F.col("a"), F.col("b")][: len(names) - 1]
    return sums.select(*[feature[p].alias(n) for p, n in zip(parts, names, strict=False)], kind[F.col("code")].alias(names[-1]), "*").drop("a", "b", "code")


def interaction_screen(df: DataFrame, features: Sequence[str], *, details: bool = True) -> DataFrame:
    """Six views of every feature pair: fit on train, score on validation.

    Sums of all pairs are products of blocks of rows inside the tasks; the plan doesn't grow with the pairs.
    """

    rows = feature_arrays(df, features).withColumn("ys", F.array(S.dbl(TARGET)))
    sums, alone = view_sums(rows, IS_TRAIN, WEIGHT, "ys", 1, pair_views(_PAIRS))
    one = {f"{t}_swxy": F.col(f"{t}_swxy")[0] for t in "tv"} | {f"{t}_sw": F.lit(alone[f"{t}_sw"]) for t in "tv"} | {f"{t}_{n}": F.lit(alone[f"{t}_{n}"][0]) for t in "tv" for n in ("swy", "swyy")}
    out = with_fit(_named(sums, features, INTERACTIONS, ["left", "right", "interaction"]).withColumns(one))
    return out.select("left", "right", "interaction", "alpha", "valid_r2", "valid_corr") if details else out


def xs_screen(df: DataFrame, features: Sequence[str], groupings: Mapping[str, Sequence[str]], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fit cross-sectional z-scores and ranks of each grouping, computed inside each split.

    Both are functions of the group and the value, so rows collapse to sums per value before ranks are counted; a group
    of more than ``block_rows`` rows is cut into blocks of values. No task holds the rows of a group.
    """

    y, w = S.dbl(TARGET), S.dbl(WEIGHT)
    counts = F.when(valid_rows([TARGET]), w)
    sums = {"sw": counts, "swy": counts * y, "swyy": counts * y * y}
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), S.dbl(f).alias("x")) for f in features])).alias("e")
    parts = []
    for name, groups in groupings.items():
        keys = [IS_TRAIN, *groups]
        long = df.select(*keys, *[c.alias(n) for n, c in sums.items()], entries).select("e.*", *keys, *sums)
        hot = [(f, *g) for g in hot_groups(df, keys, block_rows) for f in features]
        cells = ordered_counts(long, ["feature", *keys], "x", hot=hot, sums=list(sums))
        moments = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("m"), F.col(f"s_{f}").alias("s")) for f in features])).alias("e")
        stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for f in features for n, c in ((f"m_{f}", F.avg(S.dbl(f))), (f"s_{f}", F.stddev_samp(S.dbl(f))))])
        placed = join_groups(cells, stats.select(*keys, "rows", moments).select(*keys, "rows", "e.*"), ["feature", *keys], "inner")
        z = (F.col("__v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
        rank = (F.col("cum") - (F.col("n") - 1) / 2 - 1.0) / F.when(F.col("rows") > 1, F.col("rows") - 1).otherwise(1) - 0.5
        # missing values have both views at 0
        missing = long.where("x is null").groupBy("feature", IS_TRAIN).agg(*[F.sum(n).alias(n) for n in sums])
        both = placed.select("feature", IS_TRAIN, *sums, z.alias("cs_z"), rank.alias("cs_rank"))
        both = both.unionByName(missing.withColumns({"cs_z": F.lit(0.0), "cs_rank": F.lit(0.0)}))
        views = F.explode(F.array(*[F.struct(F.lit(t).alias("transform"), F.col(t).alias("phi")) for t in ("cs_z", "cs_rank")])).alias("e")
        parts.append(both.select("feature", IS_TRAIN, F.lit(name).alias("grouping"), *sums, views).select("feature", IS_TRAIN, "grouping", *sums, "e.*"))
    cells = reduce(lambda a, b: a.unionByName(b), parts).where(S.is_finite("phi"))
    phi = F.col("phi")
    terms = {n: F.col(n) for n in sums} | {"swx": F.col("sw") * phi, "swxx": F.col("sw") * phi * phi, "swxy": F.col("swy") * phi}
    both = [zsum(F.when(cond, c)).alias(f"{tag}_{n}") for tag, cond in (("t", F.col(IS_TRAIN)), ("v", ~F.col(IS_TRAIN))) for n, c in terms.items()]
    return with_fit(cells.groupBy("feature", "grouping", "transform").agg(*both)).select("feature", "grouping", "transform", "alpha", "valid_r2", "valid_corr")


# --------------------------------------------------------------------------- null targets


def _placer(block_size: int):
    """Positions that a null of whole rows, blocks or a shift gives to positions i of 0..n-1."""

    def place(i: np.ndarray, kind: str, seed: int, n: int) -> np.ndarray:
        if kind == "iid":
            return bijection(i, n, seed)
        if kind == "circular":
            return (i + 1 + seed * 7919 % max(1, n - 1)) % n
        blocks = -(-n // block_size)
        to = bijection(np.arange(blocks), blocks, seed)
        # the last block is short: those placed after it move up
        return to[i // block_size] * block_size - np.where(to[i // block_size] > to[-1], blocks * block_size - n, 0) + i % block_size

    return place


def _date_shifts(rows: DataFrame, dated: Sequence[tuple[int, str, int]], split: str) -> DataFrame:
    """By how much the rows of each date move in each slot: only the calendar is ordered."""

    before = Window.partitionBy(split).orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    dates = rows.groupBy(split, DATE).agg(F.count(F.lit(1)).alias("__m")).withColumn("first", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    own = F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(int(seed)).alias("seed")) for k, _, seed in dated])
    order = Window.partitionBy(split, "slot").orderBy(F.xxhash64(F.col(DATE).cast("long"), "seed"), DATE).rowsBetween(Window.unboundedPreceding, -1)
    starts = dates.select(split, DATE, "first", "__m", F.explode(own).alias("s")).select(split, DATE, "first", "__m", "s.slot", "s.seed")
    return starts.withColumn("shift", F.coalesce(F.sum("__m").over(order), F.lit(0)) - F.col("first"))


#: Positions of a stretch of rows that meet their null targets in one task, and rows that a task packs at once.
STRETCH, PACKED = 65_536, 1_000_000


def packed_nulls(rows: DataFrame, slots: Sequence[tuple[int, str, int]], sizes: Mapping[int, int], *, split: str, block_size: int = 2048) -> DataFrame:
    """The null targets of ``null_positions`` by stretch of positions: ``split, stretch, slot, at, y``.

    A line holds what one task sends to one stretch in one slot: places in it (16-bit) and values, as bytes.
    """

    if unknown := sorted({k for _, k, _ in slots} - set(NULL_KINDS)):
        raise ValueError(f"no null target is made by {', '.join(unknown)}")
    dated = sorted(s for s in slots if s[1] == "date")
    column, place = {s[0]: k for k, s in enumerate(dated)}, _placer(block_size)
    y = rows.select(F.col(split).cast("int").alias(split), F.col("i").cast("long").alias("i"), DATE, S.dbl(TARGET).alias("y"))
    shifts = F.array().cast("array<long>")
    if dated:
        table = _date_shifts(rows, dated, split).groupBy(F.col(split).cast("int").alias(split), DATE)
        table = table.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "shift"))), lambda e: e["shift"]).alias("shifts"))
        y, shifts = y.join(F.broadcast(table), [split, DATE]), F.col("shifts")
    names = [split, "stretch", "slot", "at", "y"]

    def send(part: np.ndarray, i: np.ndarray, value: np.ndarray, shift: np.ndarray) -> Iterator[pa.RecordBatch]:
        for which, n in sizes.items():
            mine = part == which
            for slot, kind, seed in slots if mine.any() else ():
                p = i[mine] + shift[mine, column[slot]] if kind == "date" else place(i[mine], kind, seed + which, n)
                order = np.argsort(p, kind="stable")
                p, v = p[order], value[mine][order]
                first = np.flatnonzero(np.r_[True, np.diff(p // STRETCH) > 0])
                cuts = list(zip(first, np.r_[first[1:], len(p)], strict=True))
                at = (p % STRETCH).astype(np.uint16)
                columns = [np.full(len(cuts), which, np.int32), p[first] // STRETCH, np.full(len(cuts), slot, np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([at[a:b].tobytes() for a, b in cuts]), pa.array([v[a:b].tobytes() for a, b in cuts])], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)), matrix(batch.column(3), batch.num_rows) if batch.num_rows else np.zeros((0, len(dated)), np.int64)])
            n += batch.num_rows
            if n >= PACKED:
                yield from send(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from send(*map(np.concatenate, zip(*held, strict=True)))

    return y.select(split, "i", "y", shifts.alias("shifts")).mapInArrow(pack, f"{split} int, stretch long, slot int, at binary, y binary")


@lru_cache(maxsize=64)
def _moved_runs(kind: str, seed: int, n: int, block_size: int) -> np.ndarray:
    """Runs of positions that a null of blocks or a shift moves as they are: (first place, first position, rows), by place."""

    if kind == "circular":
        by = (1 + seed * 7919 % max(1, n - 1)) % n
        return np.array([run for run in ((0, n - by, by), (by, 0, n - by)) if run[2]])
    first = np.arange(0, n, block_size)
    runs = np.column_stack([_placer(block_size)(first, "block", seed, n), first, np.minimum(block_size, n - first)])
    return runs[np.argsort(runs[:, 0])]


#: Cells that the values of a feature are ranked in, at least; and rows of a cell above that.
RANK_CELLS, RANK_ROWS = 1_000, 500_000


class PlacedRanks:
    """Ranks of the rows of a layout: train rows among themselves, others by the share of train values not above them.

    Cuts at quantiles make cells of each feature's values. Rows that hold a cut itself, so also any frequent value, get their
    rank where they are; the others go to their cell as bytes, are put in order there and go back to their stretch. No cell
    grows with a value's frequency, and no table of values is made.
    """

    def __init__(self, laid: Layout, n: int, cuts: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.laid, self.n, self.cuts = laid, n, cuts
        # train rows inside cell j stand at 2 j, those on its upper cut at 2 j + 1
        self.before = [np.r_[0, np.cumsum(c)[:-1]] for c in counts]
        self.on_cut = [(self.rank(b[1::2] + c[1::2], c[1::2], 0), self.rank(b[1::2] + c[1::2], c[1::2], 1)) for b, c in zip(self.before, counts, strict=True)]

    @classmethod
    def of(cls, laid: Layout, wide: DataFrame, features: Sequence[str], n: int) -> PlacedRanks:
        cells = max(RANK_CELLS, sum(laid.sizes.values()) // RANK_ROWS)
        probs = [k / cells for k in range(cells + 1)]
        row = wide.agg(*[F.percentile_approx(f, probs, 10 * cells).alias(f"q{k}") for k, f in enumerate(features)]).first()
        cuts = [np.unique(row[f"q{k}"] or []) for k in range(len(features))]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for which, start, end in laid.read(batches):
                if which == 0:
                    x = laid.rows(which, start, end)[:, 1:]
                    for k, c in enumerate(cuts):
                        j = np.searchsorted(c, x[:, k])
                        held = np.bincount(2 * j + (np.append(c, np.nan)[j] == x[:, k]))
                        at = np.flatnonzero(held)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["k", "at", "n"])

        counts = [np.zeros(2 * len(c) + 2, np.int64) for c in cuts]
        for r in laid.stretches(wide.sparkSession).mapInArrow(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
            counts[r["k"]][r["at"]] = r["n"]
        return cls(laid, n, cuts, counts)

    def rank(self, cum: np.ndarray, n: np.ndarray, which: int) -> np.ndarray:
        if self.n <= 1:
            return np.zeros(len(cum))
        return (cum - (n + 1) / 2) / float(self.n - 1) - 0.5 if which == 0 else cum / float(self.n) - 0.5

    def at_cuts(self, x: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of rows whose value is a cut, and the cells of the others (-1 for those ranked)."""

        out, cell = np.zeros(x.shape), np.empty(x.shape, np.int64)
        for k, c in enumerate(self.cuts):
            j = np.searchsorted(c, x[:, k])
            known = np.append(c, np.nan)[j] == x[:, k]
            out[known, k] = self.on_cut[k][which][j[known]]
            cell[:, k] = np.where(known, -1, j)
        return out, cell

    def lines(self, spark: SparkSession) -> DataFrame:
        """The ranks of rows between cuts, by stretch: ``__s, stretch, slot, at, y`` with slot -1 for the first feature, -2 for the next."""

        laid, names = self.laid, ["__s", "stretch", "slot", "cell", "at", "y"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for which, start, end in laid.read(batches):
                x = laid.rows(which, start, end)[:, 1:]
                _, cells = self.at_cuts(x, which)
                for k in range(x.shape[1]):
                    order = np.argsort(cells[:, k], kind="stable")
                    order = order[cells[order, k] >= 0]
                    if not len(order):
                        continue
                    cell, at, v = cells[order, k], order.astype(np.uint16), x[order, k]
                    first = np.flatnonzero(np.r_[True, np.diff(cell) > 0])
                    ends = list(zip(first, np.r_[first[1:], len(cell)], strict=True))
                    columns = [[which] * len(ends), [start // laid.stretch_rows] * len(ends), [-1 - k] * len(ends), cell[first], [at[a:b].tobytes() for a, b in ends], [v[a:b].tobytes() for a, b in ends]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def order(sent: pa.Table) -> pa.Table:
            k, cell = -1 - sent.column("slot")[0].as_py(), sent.column("cell")[0].as_py()
            held = [np.frombuffer(v) for v in sent.column("y").to_pylist()]
            sizes = [len(v) for v in held]
            train = np.repeat(sent.column("__s").to_numpy() == 0, sizes)
            found, at = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(at, weights=train, minlength=len(found)).astype(np.int64)
            cum = self.before[k][2 * cell] + np.cumsum(n)
            ranks = np.where(train, self.rank(cum, n, 0)[at], self.rank(cum, n, 1)[at])
            ends = np.cumsum(sizes)
            values = pa.array([ranks[b - m : b].tobytes() for b, m in zip(ends, sizes, strict=True)], pa.binary())
            return sent.select(["__s", "stretch", "slot", "at"]).append_column("y", values)

        sent = laid.stretches(spark).mapInArrow(send, "__s int, stretch long, slot int, cell int, at binary, y binary")
        return sent.groupBy("slot", "cell").applyInArrow(order, "__s int, stretch long, slot int, at binary, y binary")


def null_positions(rows: DataFrame, slots: Sequence[tuple[int, str, int]], sizes: Mapping[int, int], *, split: str, block_size: int = 2048) -> DataFrame:
    """Where each null target sends each row: ``split, slot, p, null_y`` for rows with a position ``i`` in their split.

    A slot is (number, kind, seed); ``sizes`` has the rows of each split. Positions come from seeded bijections of the row,
    its block or its date, so that any number of slots is one plan without a sort of rows; only the calendar is ordered.
    """

    if unknown := sorted({k for _, k, _ in slots} - set(NULL_KINDS)):
        raise ValueError(f"no null target is made by {', '.join(unknown)}")
    y = rows.select(split, F.col("i").cast("long").alias("i"), DATE, S.dbl(TARGET).alias("null_y"))
    dated, free = ([s for s in slots if (s[1] == "date") == own] for own in (True, False))
    place = _placer(block_size)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, i, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            for which, n in sizes.items():
                mine = part == which
                for slot, kind, seed in free if mine.any() else ():
                    p, held = place(i[mine], kind, seed + which, n), int(mine.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(held, which, np.int32)), pa.array(np.full(held, slot, np.int32)), pa.array(p), pa.array(value[mine])], names=[split, "slot", "p", "null_y"])

    schema = f"{split} int, slot int, p long, null_y double"
    parts = [y.withColumn(split, F.col(split).cast("int")).mapInArrow(move, schema)] if free else []
    if dated:
        starts = _date_shifts(rows, dated, split)
        moved = y.join(starts.select(split, DATE, "slot", "shift"), [split, DATE])
        parts.append(moved.select(F.col(split).cast("int").alias(split), "slot", (F.col("i") + F.col("shift")).cast("long").alias("p"), "null_y"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def null_targets(indexed: DataFrame, kind: str, *, seed: int, rows: int, block_size: int = 2048) -> DataFrame:
    """Target values moved to other positions: table ``(i, null_y)`` for positions ``0..rows-1``.

    ``indexed`` carries the position ``i``.
    """

    whole = indexed.withColumn("__s", F.lit(0))
    return null_positions(whole, [(0, kind, seed)], {0: rows}, split="__s", block_size=block_size).select(F.col("p").alias("i"), "null_y")


def _split_positions(df: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """df with its split (``__s``, 0 for train) and the position ``i`` of each row in it, and the rows of each split."""

    # train rows come first in the index, so that validation positions are the rest
    indexed = row_index(df.withColumn("__s", (~F.col(IS_TRAIN)).cast("int")), ["__s", *KEYS], "i")
    n_train = df.where(F.col(IS_TRAIN)).count()
    n_valid = df.where(~F.col(IS_TRAIN)).count()
    return indexed.withColumn("i", F.when(F.col(IS_TRAIN), F.col("i")).otherwise(F.col("i") - n_train)), {0: n_train, 1: n_valid}


def with_null_targets(df: DataFrame, slots: Sequence[tuple[int, str, int]], *, block_size: int = 2048) -> DataFrame:
    """df with an array ``null_ys`` of null targets, one per slot; train and validation rows are permuted separately."""

    rows, sizes = _split_positions(df)
    moved = null_positions(rows, slots, sizes, split="__s", block_size=block_size)
    held = moved.groupBy("__s", F.col("p").alias("i")).agg(F.sort_array(F.collect_list(F.struct("slot", "null_y"))).alias("__y"))
    return rows.join(held, ["__s", "i"]).withColumn("null_ys", F.transform("__y", lambda e: e["null_y"])).drop("__y", "__s", "i")


def null_screen(
    df: DataFrame, features: Sequence[str], *, pairs: bool = False, views: Sequence[str] = VIEWS, kinds: Sequence[str] = NULL_KINDS, runs: int = 10, seed: int = 17, block_size: int = 2048
) -> DataFrame:
    """Best validation R2 over all views when the target is replaced by each null target, per kind and run.

    Views are those of single features, or with ``pairs`` the six of each pair. One plan holds all kinds and runs: the null
    targets of a row are one array, and the sums of a view against all of them come from the same block products. Rows lie in
    files in the order of their positions: blocks, dates and shifts are read from there as runs, and only the targets of
    ``iid`` nulls are shuffled. Rows whose target or weight can't count are left out before.
    """

    if unknown := sorted(set(kinds) - set(NULL_KINDS)):
        raise ValueError(f"no null target is made by {', '.join(unknown)}")
    slots = [(k * runs + run, kind, seed + 1000 * run + k) for k, kind in enumerate(kinds) for run in range(runs)]
    df = df.where(valid_rows([TARGET])).select(*KEYS, WEIGHT, TARGET, IS_TRAIN, *features)
    n, fill, scale = _filling(df, features)
    wide = df.select(*KEYS, (~F.col(IS_TRAIN)).cast("int").alias("__s"), S.dbl(WEIGHT).alias("w"), S.dbl(TARGET).alias("y"), *[_filled(f, fill[f]).alias(f) for f in features])
    if pairs:
        make, names, shown = pair_views(_PAIRS), ["left", "right", "interaction"], INTERACTIONS
    else:
        edges = _edges(wide, features) if any("05" in v for v in views) else {}
        make, names, shown = single_views(_single(features, views, edges)), ["feature", "transform"], tuple(views)
    laid = lay_out(wide, ["w", *features], "y", split="__s", stretch_rows=STRETCH)
    dated = [slot for slot in slots if slot[1] == "date"]
    moves: dict = {}
    for r in _date_shifts(wide, dated, "__s").collect() if dated else ():
        moves.setdefault((r["slot"], r["__s"]), []).append((r["first"] + r["shift"], r["first"], r["__m"]))
    moves = {key: np.array(sorted(of)) for key, of in moves.items()}
    ranks = PlacedRanks.of(laid, wide, features, n)
    count, free = len(slots), [slot for slot in slots if slot[1] == "iid"]
    middle, spread = (np.array([of[f] for f in features]) for of in (fill, scale))

    def meet(own: pa.Table, sent: pa.Table) -> pa.Table:
        totals = Totals(count, make)
        for which, stretch in zip(own.column("__s").to_pylist(), own.column("stretch").to_pylist(), strict=True):
            start, end = laid.stretch(which, stretch)
            ys, rows = np.empty((end - start, count)), laid.rows(which, start, end)
            w, x = rows[:, 0], np.ascontiguousarray(rows[:, 1:])
            r, _ = ranks.at_cuts(x, which)
            for slot, at, value in zip(*(sent.column(c).to_pylist() for c in ("slot", "at", "y")), strict=True):
                (ys[:, slot] if slot >= 0 else r[:, -1 - slot])[np.frombuffer(at, np.uint16)] = np.frombuffer(value)
            with laid.targets(which) as targets:
                for slot, kind, seed in slots:
                    if kind != "iid":
                        runs_of = moves[slot, which] if kind == "date" else _moved_runs(kind, seed + which, laid.sizes[which], block_size)
                        ys[:, slot] = targets.gather(runs_of, start, end)
            totals.add(np.full(len(w), which == 0), w, ys, x, (x - middle) / spread, r)
        return pa.Table.from_batches(totals.lines())

    keys = ["__s", "stretch"]
    lines = packed_nulls(laid.target_rows(df.sparkSession, "__s"), free, laid.sizes, split="__s", block_size=block_size).unionByName(ranks.lines(df.sparkSession))
    places = laid.stretches(df.sparkSession)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.count() // 8)
    sums, alone = added_up(places.repartition(parts, *keys).groupBy(*keys).cogroup(lines.repartition(parts, *keys).groupBy(*keys)).applyInArrow(meet, LINE), count)
    labels = F.array(*[F.struct(F.lit(kind).alias("null_kind"), F.lit(k % runs).alias("run"), F.lit(alone["v_swyy"][k]).alias("swyy")) for k, kind, _ in slots])
    scored = _named(sums, features, shown, names).select(*names, "t_swxx", "v_swxx", F.posexplode(F.arrays_zip("t_swxy", "v_swxy", labels.alias("label"))).alias("k", "e"))
    e = F.col("e")
    alpha = F.when(F.col("t_swxx") > 0, F.try_divide(e["t_swxy"], F.col("t_swxx"))).otherwise(0.0)
    numerator = e["label"]["swyy"] - 2 * alpha * e["v_swxy"] + alpha * alpha * F.col("v_swxx")
    fit = F.when(e["label"]["swyy"] > 0, 1.0 - F.try_divide(numerator, e["label"]["swyy"])).otherwise(0.0)
    fits = scored.select(*names, e["label"]["null_kind"].alias("null_kind"), e["label"]["run"].alias("run"), fit.alias("valid_r2"))
    best = F.max_by(F.struct(*names), F.struct("valid_r2", *names)).alias("b")
    return fits.groupBy("null_kind", "run").agg(F.max("valid_r2").alias("best_valid_r2"), best).select("null_kind", "run", "best_valid_r2", "b.*")


# --------------------------------------------------------------------------- order and digit audits


def modulo_screen(df: DataFrame, moduli: Sequence[int] = MODULI, *, index: str = "row_index") -> DataFrame:
    """Does the target depend on the row position modulo m? Bucket means from train, R2 on validation.

    (modulus, code) pairs are made inside codegen and collapse map-side to at most the sum of the moduli.
    """

    w, y = S.dbl(WEIGHT), S.dbl(TARGET)
    entries = F.array(*[F.struct(F.lit(m).alias("modulo"), F.pmod(F.col(index), F.lit(m)).alias("code")) for m in moduli])
    long = df.select(IS_TRAIN, w.alias("w"), y.alias("y"), F.explode(entries).alias("e"))
    train = F.col(IS_TRAIN)
    cells = long.groupBy("e.modulo", "e.code").agg(
        F.count_if(train).alias("n"), zsum(F.when(train, F.col("w"))).alias("tw"), zsum(F.when(train, F.col("w") * F.col("y"))).alias("twy"),
        zsum(F.when(~train, F.col("w"))).alias("vw"), zsum(F.when(~train, F.col("w") * F.col("y"))).alias("vwy"), zsum(F.when(~train, F.col("w") * F.col("y") * F.col("y"))).alias("vwyy"),
    )
    every = Window.partitionBy("modulo")
    overall = F.coalesce(ratio(F.sum("twy").over(every), F.sum("tw").over(every)), F.lit(0.0))
    mean = F.when(F.col("n") > 0, F.coalesce(ratio(F.col("twy"), F.col("tw")), F.lit(0.0))).otherwise(overall)
    out = cells.withColumn("mean", mean).groupBy("modulo").agg(
        F.count_if(F.col("n") >= 0).alias("codes"), F.min("n").alias("n"), F.max(F.abs("mean")).alias("max_abs_bucket_mean"),
        zsum(F.col("vwyy") - 2 * F.col("mean") * F.col("vwy") + F.col("mean") * F.col("mean") * F.col("vw")).alias("numerator"), zsum(F.col("vwyy")).alias("denominator"),
    )
    smallest = F.when(F.col("codes") < F.col("modulo"), F.lit(0)).otherwise(F.col("n"))
    return out.select("modulo", smallest.alias("min_train_bucket_rows"), "max_abs_bucket_mean", F.when(F.col("denominator") > 0, 1.0 - ratio(F.col("numerator"), F.col("denominator"))).otherwise(0.0).alias("valid_r2"))


def correlation_spectrum(df: DataFrame, features: Sequence[str], sigma2: float = 1.0) -> dict:
    """Eigenvalues of the feature correlation against the bounds of pure noise.

    Spark sums the p x p products of mean-imputed z-scores; only that matrix is decomposed on the driver.
    """

    if not math.isfinite(sigma2) or sigma2 <= 0.0:
        raise ValueError("the noise variance is a finite number above 0")
    means, scales = standardizer(df, features, impute="mean")
    names = [f"z{i}" for i in range(len(features))]
    z = df.select(*[z_expr(c, means[c], scales[c]).alias(n) for c, n in zip(features, names)], F.lit(1.0).alias("one"), F.lit(0.0).alias("none"))
    stats = normal_stats(z, names, target="none", weight="one")
    if stats.rows <= 1:
        raise ValueError("one row has no spectrum")
    values = np.linalg.eigvalsh(stats.g / (stats.rows - 1))
    q = math.sqrt(len(features) / stats.rows)
    low, high = sigma2 * max(0.0, 1.0 - q) ** 2, sigma2 * (1.0 + q) ** 2
    return {
        "rows": stats.rows, "features": len(features), "lambda_minus": low, "lambda_plus": high, "eigenvalues": values.tolist(),
        "upper_outliers": int((values > high).sum()), "lower_outliers": int((values < low).sum()),
    }


def acf(df: DataFrame, lags: Sequence[int], *, value: Column | None = None, dates_per_block: int = 8) -> DataFrame:
    """Autocorrelation of each symbol's series in key order at the given row lags.

    The series is unbounded in time, so look-back runs over date blocks that repeat the rows before them.
    """

    if any(k <= 0 for k in lags):
        raise ValueError("a lag is 1 or more")
    x = S.dbl(TARGET) if value is None else value
    series = with_group_stats(df.select(*KEYS, x.alias("x")).where(S.is_finite("x")), [SYMBOL], {"m": F.avg("x")})
    cut = with_halo(series, [SYMBOL], [DATE, TIME], F.floor(F.col(DATE) / dates_per_block), max(lags))
    order = Window.partitionBy(SYMBOL, "__block").orderBy(DATE, TIME)
    centred = cut.withColumn("c", F.col("x") - F.col("m"))
    products = centred.select(SYMBOL, "__halo", "c", *[(F.col("c") * F.lag("c", k).over(order)).alias(f"p{k}") for k in lags]).where(~F.col("__halo"))
    sums = products.groupBy(SYMBOL).agg(F.sum(F.col("c") * F.col("c")).alias("v"), *[zsum(F.col(f"p{k}")).alias(f"p{k}") for k in lags])
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("v") > 0, F.col(f"p{k}") / F.col("v")).otherwise(0.0).alias("acf")) for k in lags])
    return sums.select(SYMBOL, F.explode(entries).alias("e")).select(SYMBOL, "e.*")


def global_acf(df: DataFrame, lags: Sequence[int], *, value: Column | None = None) -> DataFrame:
    """Autocorrelation of the whole table in key order, by shifting the row position.

    Each row is sent to position ``i`` and to ``i + lag`` for every lag; products meet in one shuffle.
    """

    if any(k <= 0 for k in lags):
        raise ValueError("a lag is 1 or more")
    x = S.dbl(TARGET) if value is None else value
    series = df.select(*KEYS, x.alias("x")).where(S.is_finite("x"))
    mean = series.agg(F.avg("x")).first()[0]
    indexed = row_index(series, list(KEYS), "i").select("i", (F.col("x") - F.lit(mean)).alias("c"))
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("i") + F.lit(k)).alias("j")) for k in [0, *lags]]))
    sent = indexed.select("c", shifts.alias("e")).select("c", "e.lag", "e.j")
    met = sent.groupBy("j").agg(*[F.max(F.when(F.col("lag") == k, F.col("c"))).alias(f"c{k}") for k in [0, *lags]])
    sums = met.agg(*[zsum(F.col("c0") * F.col(f"c{k}")).alias(f"s{k}") for k in [0, *lags]])
    entries = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("s0") > 0, F.col(f"s{k}") / F.col("s0")).otherwise(0.0).alias("acf")) for k in lags])
    return sums.select(F.explode(entries).alias("e")).select("e.*")


#: Rows of a series that one task transforms at once.
FOURIER_BLOCK = 1 << 16


def periodogram(df: DataFrame, *, top_k: int = 10, by: Sequence[str] = (SYMBOL,), order: Sequence[str] = (DATE,), value: Column | None = None, block: int = FOURIER_BLOCK, dates_per_part: int = 64) -> DataFrame:
    """Strongest nonzero frequencies of each group's series.

    The series is the mean per ``order`` value (a date by default; date and time give the raw rows of a unique key). Fourier
    sums are additive: a task transforms blocks of consecutive rows, padded and turned to their place in the series, and adds
    up those of one stretch of the series; Spark adds up the stretches, so that no group has to fit a task. A series that
    lies in one stretch sends its strongest frequencies and its total alone. Series under four values have none.
    """

    if top_k <= 0:
        raise ValueError("top_k must be positive")
    by, order = list(by), list(order)
    x = S.dbl(TARGET) if value is None else value
    rows = df.select(*by, *order, x.alias("x"), F.floor(F.col(order[0]) / dates_per_part).alias("__part")).where(S.is_finite("x"))
    # parts of a series: its values in order as one array; rows are shuffled once and the parts are read twice
    means = rows.repartition(*by, "__part").groupBy(*by, "__part", *order).agg(F.avg("x").alias("x"))
    held = F.sort_array(F.collect_list(F.struct(*order, "x")))
    parts = stored(means.groupBy(*by, "__part").agg(held.alias("v"), F.sum("x").alias("__s")).select(*by, "__part", F.size("v").cast("long").alias("__c"), "__s", F.col("v.x").alias("x")), "series")
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("__c").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    n = F.sum("__c").over(whole)
    places = parts.select(*by, "__part", before.alias("start"), n.alias("n"), (F.sum("__s").over(whole) / n).alias("mean")).where("n >= 4")
    stretch = F.floor(F.col("start") / max(block, FOURIER_BLOCK)).alias("__stretch")
    pieces = join_groups(parts, places, [*by, "__part"], "inner").groupBy(*by, stretch).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("start").alias("start"), F.flatten(F.sort_array(F.collect_list(F.struct("start", "x")))["x"]).alias("x")
    )
    kinds = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "n long, k int, re double, im double, total double"])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, n, mean, start in zip(batch.column("x"), *[batch.column(c).to_numpy() for c in ("n", "mean", "start")], strict=True):
                sums = _fourier_sums(x.values.to_numpy() - mean, int(n), int(start), block)
                found.append(_strongest(sums, int(n), top_k) if len(x) == n else (np.arange(1, len(sums) + 1), sums, np.nan))
            sent = np.repeat(np.arange(len(found)), [len(k) for k, *_ in found])
            held = batch.select([*by, "n"]).take(pa.array(sent))
            f = np.concatenate([f for _, f, _ in found])
            total = pa.array(np.array([t for *_, t in found])[sent], from_pandas=True)
            k = pa.array(np.concatenate([k for k, *_ in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([*held.columns, k, pa.array(f.real), pa.array(f.imag), total], names=[*by, "n", "k", "re", "im", "total"])

    sums = pieces.mapInArrow(transform, kinds).groupBy(*by, "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.first("n").alias("n"), F.max("total").alias("total"))
    power = sums.select(*by, "k", "n", "total", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power"))
    strongest = whole.orderBy(F.desc("power"), "k")
    best = power.withColumns({"__all": F.coalesce("total", F.sum("power").over(whole)), "__r": F.row_number().over(strongest)}).where(F.col("__r") <= top_k)
    share = F.when(F.col("__all") > 0, F.col("power") / F.col("__all")).otherwise(0.0)
    return best.select(*by, F.col("k").alias("frequency_index"), (F.col("k") / F.col("n")).alias("frequency"), (F.col("n") / F.col("k")).alias("period_rows"), "power", share.alias("power_share"))


def _fourier_sums(x: np.ndarray, n: int, start: int, block: int) -> np.ndarray:
    """Fourier sums 1..n/2 of a series of n values, out of its values from ``start`` on, a block at a time."""

    k, sums = np.arange(n // 2 + 1), np.zeros(n // 2 + 1, complex)
    for at in range(0, len(x), block):
        sums += np.fft.rfft(x[at : at + block], n) * np.exp(-2j * np.pi * (k * (start + at) % n) / n)
    return sums[1:]


def _strongest(sums: np.ndarray, n: int, top_k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``top_k`` strongest frequencies, their sums, and the power of all."""

    power = (sums.real * sums.real + sums.imag * sums.imag) / n
    at = np.lexsort((np.arange(len(sums)), -power))[:top_k]
    return at + 1, sums[at], power.sum()


def hill_table(df: DataFrame, k: int, *, value: Column | None = None) -> DataFrame:
    """Tail index from the ``k`` largest magnitudes: one lazy aggregate over the top ``k + 1`` (a bounded TakeOrdered)."""

    if k < 1:
        raise ValueError("the tail has one value or more")
    x = F.abs(S.dbl(TARGET) if value is None else value)
    top = df.select(x.alias("x")).where(S.is_finite("x") & (F.col("x") > 0)).orderBy(F.desc("x")).limit(k + 1)
    out = top.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("x")).alias("s"), F.min("x").alias("edge"))
    total = F.col("s") - (k + 1) * F.log("edge")
    return out.select(F.when((F.col("n") > k) & (total > 0), F.lit(float(k)) / total).otherwise(0.0).alias("hill_index"))


def digit_audit(df: DataFrame, features: Sequence[str], decimals: int = 6) -> DataFrame:
    """Histogram of the last kept decimal digit of each feature and its distance from uniform."""

    long = unpivot(df, features).where(S.is_finite("value"))
    digit = S.final_digit("value", decimals)
    counts = long.groupBy("feature").agg(F.count(F.lit(1)).alias("total_digits"), *[F.count_if(digit == d).alias(f"digit_{d}") for d in range(10)])
    expected = F.col("total_digits") / 10.0
    gaps = S.total([(F.col(f"digit_{d}") - expected) * (F.col(f"digit_{d}") - expected) for d in range(10)])
    largest = F.greatest(*[F.col(f"digit_{d}") for d in range(10)])
    return counts.withColumns({"chi_square_vs_uniform": gaps / F.greatest(expected, F.lit(1.0)), "max_digit_share": largest / F.col("total_digits")})
