"""Model experts fitted as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.calibrate import fit_grouped_scale, fit_residual_rule, risk_mean
from panelkit.operators.core import exact_quantiles, ordered_counts, tercile_edges
from panelkit.operators.folds import Fold, inner_folds
from panelkit.operators.metrics import candidate_scores
from panelkit.operators.profiles import unpivot
from panelkit.operators.sampling import hash_sample
from panelkit.operators.stats import Normal, linear_expr, normal_stats, solve, standardizer
from panelkit.schema import FOLD, TARGET, WEIGHT, number_tag
from panelkit.session import stored


def stacker_columns(df: DataFrame, left: str, right: str, ensemble: str) -> DataFrame:
    """Expert gaps, clocks and bucket codes that a residual stacker reads.

    Magnitude buckets carry their own labels, so their code is mapped from those labels.
    """

    def code(column: str, labels) -> object:
        expr = F.lit(3)
        for i, label in reversed(list(enumerate(labels[:3]))):
            expr = F.when(F.col(column) == label, F.lit(i)).otherwise(expr)
        return expr.cast("int")

    sin967, cos967 = S.cyclic("time_id", 967)
    sin483, cos483 = S.cyclic("time_id", 483)
    out = df.withColumns(
        {
            "gap": S.filled(left) - S.filled(right),
            "ensemble_abs": F.abs(S.filled(ensemble)),
            "abs_gap": F.abs(S.filled(left) - S.filled(right)),
            "weight_feature": S.filled("weight"),
            "time_sin_967": sin967,
            "time_cos_967": cos967,
            "time_sin_483": sin483,
            "time_cos_483": cos483,
            "weight_bucket_code": code("weight_bucket", S.WEIGHT_LABELS),
        }
    )
    if "prediction_abs_bucket" in df.columns:
        out = out.withColumn("prediction_abs_bucket_code", code("prediction_abs_bucket", S.ABS_LABELS))
    return out


# --------------------------------------------------------------------------- encoders


@dataclass(frozen=True)
class RankEncoder:
    """Centred rank codes in (-1, 1) from training quantile edges, missing values at the median."""

    edges: dict[str, list[float]]
    fill: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], bins: int = 255) -> RankEncoder:
        """Exact edges of all columns from one long value-count table.

        Only values next to one of the ``bins - 1`` wanted ranks leave Spark.
        """

        if bins < 4:
            raise ValueError("ranks are cut into 4 bins or more")
        finite = {c: F.when(S.is_finite(c), S.dbl(c)) for c in columns}
        sizes = df.agg(*[F.count(x).alias(c) for c, x in finite.items()]).first()
        long = unpivot(df, columns).where(S.is_finite("value"))
        counts = ordered_counts(long, ["feature"], "value")
        n = reduce(lambda acc, c: acc.when(F.col("feature") == c, F.lit(float(max(sizes[c] - 1, 1)))), columns, F.when(F.lit(False), F.lit(1.0)))
        spots = []
        for parts in (bins, 2):  # quantile edges and the median
            low, high = (F.col("cum") - F.col("n") - 1) * parts / n, F.col("cum") * parts / n
            spots.append(F.floor(high) >= F.ceil(low))
        near = counts.where(spots[0] | spots[1]).select("feature", "__v", "n", "cum").collect()
        edges, fill = {}, {}
        for c in columns:
            values = sorted((r["cum"], r["n"], r["__v"]) for r in near if r["feature"] == c)
            total = sizes[c]
            if total == 0:
                edges[c], fill[c] = [], 0.0
                continue

            def at(q: float) -> float:
                h = q * (total - 1)
                k = math.floor(h)
                lo, hi = (next(v for cum, m, v in values if cum - m <= j < cum) for j in (k, min(k + 1, total - 1)))
                return lo + (hi - lo) * (h - k)

            edges[c], fill[c] = sorted({at(i / bins) for i in range(1, bins)}), at(0.5)
        return cls(edges, fill)

    def transform(self, df: DataFrame, suffix: str = "__rank") -> DataFrame:
        """Add one code column per encoded column; edges are searched by bisection in the JVM."""

        out = df.withColumns({f"__fill_{c}": F.when(S.is_finite(c), S.dbl(c)).otherwise(self.fill[c]) for c in self.edges})
        coded = [c for c, e in self.edges.items() if e]
        if coded:
            bucketizer = Bucketizer(
                splitsArray=[[-math.inf, *self.edges[c], math.inf] for c in coded],
                inputCols=[f"__fill_{c}" for c in coded],
                outputCols=[f"__code_{c}" for c in coded],
            )
            out = bucketizer.transform(out)
        for c, e in self.edges.items():
            code = 2.0 * (F.col(f"__code_{c}") + 0.5) / float(len(e) + 1) - 1.0 if e else F.lit(0.0)
            out = out.withColumn(f"{c}{suffix}", code.cast("float"))
        return out.drop(*[f"__{k}_{c}" for k in ("fill", "code") for c in self.edges])


# --------------------------------------------------------------------------- linear experts


@dataclass(frozen=True)
class Ridge:
    """Linear model on standardised inputs; prediction is a plain column expression."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    intercept: float
    coefficients: tuple[float, ...]
    alpha: float

    def predict(self) -> Column:
        slopes = [b / s for b, s in zip(self.coefficients, self.scales)]
        shift = self.intercept - sum(m * k for m, k in zip(self.means, slopes))
        return F.lit(float(shift)) + linear_expr(self.features, slopes, fill=True)


@dataclass(frozen=True)
class RidgeData:
    """Sufficient statistics of one training range, shared by every alpha."""

    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    stats: Normal

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], *, target: str = TARGET, weight: str = WEIGHT, standardize: bool = True) -> RidgeData:
        """Moments, then the Gram matrix of the standardised design with an intercept column."""

        if not features:
            raise ValueError("feature columns must not be empty")
        if standardize:
            m, s = standardizer(df, features)
        else:
            m, s = dict.fromkeys(features, 0.0), dict.fromkeys(features, 1.0)
        z = {f"__z{i}": (S.filled(c) - F.lit(m[c])) / F.lit(s[c]) for i, c in enumerate(features)}
        design = df.select(F.lit(1.0).alias("__one"), *[e.alias(n) for n, e in z.items()], S.dbl(target).alias(target), S.dbl(weight).alias(weight))
        stats = normal_stats(design, ["__one", *z], target=target, weight=weight)
        return cls(tuple(features), np.array([m[c] for c in features]), np.array([s[c] for c in features]), stats)

    def solve(self, alpha: float) -> Ridge:
        """Penalise every coefficient but the intercept."""

        if alpha < 0.0:
            raise ValueError("a penalty is 0 or more")
        penalty = alpha * np.eye(len(self.features) + 1)
        penalty[0, 0] = 0.0
        beta = solve(self.stats.g + penalty, self.stats.r)
        return Ridge(self.features, tuple(map(float, self.means)), tuple(map(float, self.scales)), float(beta[0]), tuple(map(float, beta[1:])), alpha)


def ridge_fold_scores(df: DataFrame, folds: Sequence[Fold], features: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Alpha sweep over folds; one pair of passes per fold serves every alpha."""

    parts = []
    for fold in folds:
        data = RidgeData.fit(df.where(fold.train_filter()), features)
        models = {f"ridge_alpha{number_tag(a)}": data.solve(a) for a in alphas}
        valid = df.where(fold.valid_filter()).withColumns({f"{n}_prediction": m.predict() for n, m in models.items()})
        parts.append(candidate_scores(valid.withColumn(FOLD, F.lit(fold.name)), {n: f"{n}_prediction" for n in models}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rank_ridge(df: DataFrame, features: Sequence[str], *, alpha: float, bins: int = 255, target: str = TARGET, weight: str = WEIGHT) -> tuple[RankEncoder, Ridge]:
    """Ridge on rank codes (already centred, so they are not standardised again)."""

    encoder = RankEncoder.fit(df, features, bins)
    data = RidgeData.fit(encoder.transform(df), [f"{c}__rank" for c in features], target=target, weight=weight, standardize=False)
    return encoder, data.solve(alpha)


def pls_coefficients(xx: np.ndarray, xy: np.ndarray, components: int) -> np.ndarray:
    """One-response partial least squares from centred cross products only.

    In the Krylov space of (X'X, X'y) the PLS solution is the least-squares fit, so an orthonormal basis of
    that space is all it takes.
    """

    basis: list[np.ndarray] = []
    v = xy.astype(np.float64)
    for _ in range(min(components, len(xy))):
        for b in basis:
            v = v - (b @ v) * b
        for b in basis:  # second sweep against rounding
            v = v - (b @ v) * b
        norm = np.linalg.norm(v)
        if norm <= 1e-12 * max(1.0, np.linalg.norm(xy)):
            break
        basis.append(v / norm)
        v = xx @ basis[-1]
    if not basis:
        return np.zeros(len(xy))
    q = np.column_stack(basis)
    return q @ solve(q.T @ xx @ q, q.T @ xy)


def pls(df: DataFrame, features: Sequence[str], *, components: int, bins: int = 255, target: str = TARGET, encoder: RankEncoder | None = None) -> tuple[RankEncoder, Ridge]:
    """Unweighted PLS on rank codes from one Gram pass; ``encoder`` hands in codes that are already fitted."""

    encoder = encoder or RankEncoder.fit(df, features, bins)
    names = [f"{c}__rank" for c in features]
    coded = encoder.transform(df).select(*[S.dbl(c).alias(c) for c in names], S.dbl(target).alias(target), F.lit(1.0).alias(WEIGHT), F.lit(1.0).alias("__one"))
    stats = normal_stats(coded, ["__one", *names], target=target)
    n = stats.g[0, 0]
    mean, y_mean = stats.g[0, 1:] / n, stats.r[0] / n
    xx = stats.g[1:, 1:] - n * np.outer(mean, mean)
    xy = stats.r[1:] - n * mean * y_mean
    beta = pls_coefficients(xx, xy, max(1, min(components, len(names))))
    model = Ridge(tuple(names), (0.0,) * len(names), (1.0,) * len(names), float(y_mean - mean @ beta), tuple(map(float, beta)), 0.0)
    return encoder, model


def linear_stacker(df: DataFrame, predictions: Sequence[str], *, alpha: float, target: str = TARGET, weight: str = WEIGHT) -> dict[str, float]:
    """No-intercept ridge over model outputs."""

    stats = normal_stats(df, predictions, target=target, weight=weight)
    return dict(zip(predictions, map(float, solve(stats.g + alpha * np.eye(len(predictions)), stats.r))))


# --------------------------------------------------------------------------- composed experts


def expert_pipeline(
    df: DataFrame, folds: Sequence[Fold], features: Sequence[str], *, ridge_alpha: float = 10_000.0, pls_components: int = 8, stack_alpha: float = 1_000.0, bins: int = 255,
    residual_features: Sequence[str] = (), risk_strengths: Sequence[float] = (0.25,), regime_rows: int = 500, regime_prior: float = 1_000.0, time_bucket_size: int = 100,
) -> DataFrame:
    """Per fold: rank ridge and PLS, their stack, then residual, risk and regime layers on the stack.

    Everything is fitted on the fold's training rows. Returns validation rows with one column per candidate.
    """

    parts = []
    for fold in folds:
        train, valid = df.where(fold.train_filter()), df.where(fold.valid_filter())
        encoder, ridge = rank_ridge(train, features, alpha=ridge_alpha, bins=bins)
        _, latent = pls(train, features, components=pls_components, encoder=encoder)
        first = {f"ridge_rank_alpha{number_tag(ridge_alpha)}": ridge.predict(), f"pls_rank_k{pls_components}": latent.predict()}

        def score(rows: DataFrame) -> DataFrame:
            return encoder.transform(rows).withColumns(first).drop(*[f"{c}__rank" for c in features])

        train, valid = score(train), score(valid)
        stack = linear_stacker(train, list(first), alpha=stack_alpha)
        base = "latent_alpha_linear_stack"
        train, valid = (t.withColumn(base, linear_expr(list(stack), list(stack.values()))) for t in (train, valid))
        added: dict[str, Column] = {}
        for c in residual_features:
            added[f"{base}_residual_{c}"] = F.col(base) + fit_residual_rule(train, c, base).correction()
        # expected magnitude of the error as risk, itself a ridge on the raw features
        errors = train.withColumn("__abs_error", F.abs(S.dbl(TARGET) - F.col(base)))
        risk = RidgeData.fit(errors, features, target="__abs_error").solve(ridge_alpha).predict()
        mean = risk_mean(train, F.greatest(risk, F.lit(0.0)))
        for s in risk_strengths:
            added[f"{base}_risk_s{number_tag(s)}"] = S.risk_shrink(base, risk, mean, s, root=False)
        edges = exact_quantiles(train, {"w": S.dbl(WEIGHT), "p": F.abs(base), "r": risk}, [0.0, 1 / 3, 2 / 3, 1.0])[0]

        def regimes(rows: DataFrame) -> DataFrame:
            values = {"w": S.dbl(WEIGHT), "p": F.abs(base), "r": risk}
            codes = {f"__g{n}": S.tercile_code(v, *tercile_edges(edges[n][1:3], edges[n][0], edges[n][3])) for n, v in values.items()}
            return rows.withColumns({"__gt": S.int_bucket("time_id", time_bucket_size), **codes})

        groups = ["__gt", "__gw", "__gp", "__gr"]
        model = fit_grouped_scale(regimes(train), groups, prediction=base, min_rows=regime_rows, prior=regime_prior)
        scored = model.apply(regimes(valid), lambda a: a * F.col(base), f"{base}_regime_scaled").withColumns(added).drop(*groups)
        parts.append(scored.withColumn(FOLD, F.lit(fold.name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def pipeline_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("ridge_rank_", "pls_rank_", "latent_alpha_"))]


def oof_collect(df: DataFrame, fold: Fold, features: Sequence[str], *, n_folds: int, valid_window: int, alpha: float, output: str = "prediction") -> DataFrame:
    """Out-of-fold ridge predictions of inner folds at the end of the training range."""

    parts = []
    for inner in inner_folds(fold, n_folds=n_folds, valid_window=valid_window):
        model = RidgeData.fit(df.where(inner.train_filter()), features).solve(alpha)
        parts.append(df.where(inner.valid_filter()).withColumns({output: model.predict(), FOLD: F.lit(inner.name)}))
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Bins of a feature and, as in Spark's own trees, rows that their cut points come from.
BINS, CUT_ROWS = 32, 10_000


def gbt_expert(
    train: DataFrame, valid: DataFrame, features: Sequence[str], *, seeds: Sequence[int] = (17,), fraction: float = 1.0, residual_of: str | None = None,
    trees: int = 20, depth: int = 3, step: float = 0.1, output: str = "gbt_prediction",
) -> DataFrame:
    """Boosted trees on a hash sample, averaged over seeds; optionally on the residual of a base prediction.

    A tree sees a row's bins alone, so rows with equal bins are one row with their mean label and summed weight: splits
    and leaves of squared error are those of all rows, and each tree reads bins, not rows.
    """

    if not seeds:
        raise ValueError("seeds must not be empty")
    label = S.dbl(TARGET) - S.dbl(residual_of) if residual_of else S.dbl(TARGET)
    out, members = valid, []
    for seed in seeds:
        sample = hash_sample(train, fraction, seed) if fraction < 1.0 else train
        cuts = _cut_points(sample, features, label, seed)
        codes = [f"__f_{c}" for c in features]
        # a bucketizer's bins begin with their cut point, those of trees end with it; a feature of one value is one bin
        edges = {c: [-math.inf, *(np.nextafter(cuts[c], math.inf).tolist() or [0.0]), math.inf] for c in features}
        bins = Bucketizer(splitsArray=list(edges.values()), inputCols=[f"__v_{c}" for c in features], outputCols=codes)

        def coded(t: DataFrame) -> DataFrame:
            placed = bins.transform(t.withColumns({f"__v_{c}": S.filled(c) for c in features})).drop(*[f"__v_{c}" for c in features])
            return placed.withColumns({c: F.col(c) + 1.0 for c in codes})

        assembler = VectorAssembler(inputCols=codes, outputCol="__x")
        rows = coded(sample).select(*codes, label.alias("__y"), S.dbl(WEIGHT).alias("__w"))
        cells = rows.groupBy(*codes).agg(F.sum(F.col("__w") * F.col("__y")).alias("__wy"), F.sum("__w").alias("__w")).where("__w > 0")
        data = assembler.transform(stored(cells, "bins")).select("__x", (F.col("__wy") / F.col("__w")).alias("__y"), "__w")
        # codes are few: so many bins are allowed that each boundary of codes is a split
        model = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol=f"__m{seed}", maxIter=trees, maxDepth=depth, stepSize=step, maxBins=BINS * BINS, seed=seed).fit(data)
        out = model.transform(assembler.transform(coded(out))).drop("__x", *codes)
        members.append(F.col(f"__m{seed}"))
    mean = S.total(members) / float(len(members))
    base = S.dbl(residual_of) if residual_of else F.lit(0.0)
    return out.withColumn(output, base + mean).drop(*[f"__m{s}" for s in seeds])


def _cut_points(rows: DataFrame, features: Sequence[str], label: Column, seed: int) -> dict[str, list[float]]:
    """Cut points of about equal weight between the values of each feature, out of about ``CUT_ROWS`` rows (all, if fewer)."""

    bad = ~F.coalesce(S.is_finite(label) & S.is_finite(WEIGHT) & (S.dbl(WEIGHT) >= 0), F.lit(False))
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if n == 0 or n_bad:
        raise ValueError(f"training rows: {n}, of these without a finite target or weight: {n_bad}")
    some = rows if n <= CUT_ROWS else hash_sample(rows, CUT_ROWS / n, seed + 1)
    held = np.array(some.select(S.dbl(WEIGHT), *[S.filled(c) for c in features]).collect(), float)
    return {c: _weighted_cuts(held[:, i + 1], held[:, 0]) for i, c in enumerate(features)}


def _weighted_cuts(values: np.ndarray, weights: np.ndarray) -> list[float]:
    distinct, at = np.unique(values, return_inverse=True)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(distinct) <= BINS:
        return middle.tolist()
    total = np.cumsum(np.bincount(at, weights))
    cuts, stride = [], total[-1] / BINS
    target = stride
    # a cut before the value that would go further past the target than the values so far stay below it
    for i, m in enumerate(middle):
        if abs(total[i] - target) < abs(total[i + 1] - target):
            cuts.append(float(m))
            target += stride
    return cuts


def pca_geometry(df: DataFrame, features: Sequence[str], *, k: int = 3, fit_on: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """First ``k`` principal components of standardised null-filled features and their variance shares.

    Scales and components come from ``fit_on`` (a sample, say) if it is given; all rows of ``df`` are placed.
    """

    assembler = VectorAssembler(inputCols=[f"__f_{c}" for c in features], outputCol="__raw")
    placed, sample = (assembler.transform(t.withColumns({f"__f_{c}": S.filled(c) for c in features})) for t in (df, df if fit_on is None else fit_on))
    scaler = StandardScaler(inputCol="__raw", outputCol="__z", withMean=True, withStd=True).fit(sample)
    model = PCA(k=k, inputCol="__z", outputCol="__pc").fit(scaler.transform(sample))
    parts = vector_to_array("__pc")
    out = model.transform(scaler.transform(placed)).withColumns({f"pc{i + 1}": parts[i] for i in range(k)})
    return out.drop("__raw", "__z", "__pc", *[f"__f_{c}" for c in features]), model.explainedVariance.toArray().tolist()
