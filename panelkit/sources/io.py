"""Readers and writers of panel, prediction, score and state tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import scalar as S
from panelkit.operators.lags import lag_names, with_daily_last_lags, with_lags
from panelkit.plans.selection import REPORT_CATEGORIES
from panelkit.schema import DATE, FOLD, KEYS, RESPONDERS

# Fixed layout of a fold-score file.
SCORE_SCHEMA = (
    "fold string, candidate string, family string, rows long, weight_sum double, numerator double, denominator double, weighted_zero_mean_r2 double"
)
# Fixed columns of a candidate summary file.
SUMMARY_COLUMNS = {
    "candidate": "string",
    "family": "string",
    "rows": "long",
    "weight_sum": "double",
    "numerator": "double",
    "denominator": "double",
    "mean_fold_r2": "double",
    "min_fold_r2": "double",
    "std_fold_r2": "double",
    "global_r2": "double",
}


def _layout(files: Sequence[str], root: str) -> tuple[set[tuple[str, ...]], dict[str, str]]:
    """Partition keys of the folders that hold files, and of the plain folders above them one file each as an example."""

    base = urlsplit(root).path.rstrip("/").split("/")
    base = base[: next((i for i, part in enumerate(base) if set(part) & set("*?[{")), len(base))]
    keys, tops = set(), {}
    for file in files:
        whole = unquote(urlsplit(file).path).split("/")[:-1]
        inside = whole[len(base) :]
        first = next((i for i, part in enumerate(inside) if "=" in part), len(inside))
        keys.add(tuple(part.split("=", 1)[0] for part in inside if "=" in part))
        tops.setdefault("/".join(inside[:first]), file)
    return keys, tops


def scan_panel(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All Parquet files of trees of folders, however deep: plain folders, ``key=value`` folders, or these below plain ones.

    Partition columns come back and prune; filters on other columns and column choices reach the scan. Only names are
    listed to find the layout. Trees whose files differ in their partition keys have no one table and raise.
    """

    parts = []
    for root in [path] if isinstance(path, str) else path:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).inputFiles()
        if not listed:
            raise ValueError(f"no Parquet file is under {root}")
        keys, tops = _layout(listed, root)
        if len(keys) > 1:
            named = sorted("/".join(f"{k}=" for k in some) or "no key" for some in keys)
            raise ValueError(f"the files under {root} differ in their partition keys: {', '.join(named)}")
        reader = spark.read.option("pathGlobFilter", "*.parquet")
        if not next(iter(keys)):
            parts.append(reader.option("recursiveFileLookup", True).parquet(root))
        elif set(tops) == {""}:
            parts.append(reader.parquet(root))
        else:
            # one scan per plain folder above the keys
            parts += [reader.parquet(f"{root.rstrip('/')}/{top}" if top else root) for top in sorted(tops)]
    return parts[0] if len(parts) == 1 else union_widest(parts)


def scan_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Table written by date or fold: partition columns come back and prune."""

    return spark.read.parquet(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tag matrix from CSV: feature and its ``tag_*`` marks."""

    rows = spark.read.csv(path, header=True)
    if "feature" not in rows.columns or not any(c.startswith("tag_") for c in rows.columns):
        raise ValueError(f"{path} has no column feature, or no tags")
    return rows


def tag_map(tags: DataFrame, known: DataFrame, *, min_features: int = 1) -> DataFrame:
    """Tag matrix to one row per tag with its known features, by ``place`` if ``known`` has one, else by name."""

    if min_features <= 0:
        raise ValueError("min_features must be positive")
    columns = [c for c in tags.columns if c.startswith("tag_")]
    entries = F.array(*[F.when(F.col(c).cast("boolean"), F.lit(c.removeprefix("tag_"))) for c in columns])
    order = [c for c in ("place",) if c in known.columns]
    met = tags.join(known.select("feature", *order).dropDuplicates(["feature"]), "feature")
    marked = met.select("feature", *order, F.explode(F.filter(entries, lambda t: t.isNotNull())).alias("tag"))
    features = F.sort_array(F.collect_list(F.struct(*order, "feature")))
    return marked.groupBy("tag").agg(F.transform(features, lambda e: e["feature"]).alias("features")).where(F.size("features") >= min_features)


def scan_tags(spark: SparkSession, path: str, features: Sequence[str], *, min_features: int = 1) -> dict[str, tuple[str, ...]]:
    """Tags with at least ``min_features`` known features, in the order of these, from a CSV tag matrix."""

    known = spark.createDataFrame(list(enumerate(features)), "place int, feature string")
    rows = tag_map(read_tags(spark, path), known, min_features=min_features).orderBy("tag").collect()
    if not rows:
        raise ValueError(f"no tag of {path} marks {min_features} or more of the features")
    return {r["tag"]: tuple(r["features"]) for r in rows}


def name_scores(scores: DataFrame, source: str) -> DataFrame:
    """Scores with their source and namespaced candidate and family."""

    names = {"source": F.lit(source), "candidate_id": F.concat_ws("/", F.lit(source), "candidate"), "source_family": F.concat_ws("/", F.lit(source), "family")}
    return scores.withColumns(names)


def scan_fold_scores(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """Fold-score CSV files by source name."""

    if not sources:
        raise ValueError("there are no score files to read")
    wanted = [f.split()[0] for f in SCORE_SCHEMA.split(", ")]
    parts = []
    for name, path in sources.items():
        raw = spark.read.csv(path, header=True)
        missing = sorted(set(wanted) - set(raw.columns))
        if missing:
            raise ValueError(f"{path} is missing required columns: {missing}")
        typed = [F.col(c).cast(t).alias(c) for c, t in (f.split() for f in SCORE_SCHEMA.split(", "))]
        parts.append(name_scores(raw.select(*typed), name))
    return union_all(parts)


def scan_summaries(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, list[dict[str, str]]]:
    """Candidate summaries by report name; unreadable or incomplete files are listed, not fatal.

    Files are opened one by one for their heads only; the values of all fit files are checked in one scan.
    """

    parts, skipped = [], []
    for report, path in sorted(paths.items()):
        try:
            raw = spark.read.csv(path, header=True)
        except Exception as exc:  # noqa: BLE001 - any unreadable file is reported
            skipped.append({"report": report, "path": path, "reason": f"read_error: {type(exc).__name__}"})
            continue
        missing = [c for c in SUMMARY_COLUMNS if c not in raw.columns]
        if missing:
            skipped.append({"report": report, "path": path, "reason": "missing_columns:" + ",".join(missing)})
            continue
        parts.append(raw.select(*SUMMARY_COLUMNS, F.lit(report).alias("report")))
    if not parts:
        schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in {**SUMMARY_COLUMNS, "report": "string", "category": "string"}.items()])
        return spark.createDataFrame([], schema), skipped
    rows = union_all(parts)
    counts = [F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), 1)).alias(c) for c, t in SUMMARY_COLUMNS.items()]
    odd = {}
    for bad in rows.groupBy("report").agg(*counts).collect():
        if wrong := [c for c in SUMMARY_COLUMNS if bad[c]]:
            odd[bad["report"]] = wrong
    skipped += [{"report": r, "path": paths[r], "reason": "bad_values:" + ",".join(wrong)} for r, wrong in sorted(odd.items())]
    typed = rows.where(~F.col("report").isin(list(odd))).select(*[F.col(c).try_cast(t).alias(c) for c, t in SUMMARY_COLUMNS.items()], "report")
    return typed.withColumn("category", S.report_category("report", REPORT_CATEGORIES)), sorted(skipped, key=lambda s: s["report"])


def union_all(parts: Sequence[DataFrame], *, allow_missing: bool = False) -> DataFrame:
    """Vertical union by name; with ``allow_missing`` absent columns become NULL."""

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts)


def union_widest(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of drifting schemas: missing columns are NULL and numeric types widen to double on conflict."""

    kinds: dict[str, set[str]] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {c: "string" if "string" in k else "double" for c, k in kinds.items() if len(k) > 1}
    cast = [p.select(*[F.col(c).cast(mixed[c]).alias(c) if c in mixed else F.col(c) for c in p.columns]) for p in parts]
    return union_all(cast, allow_missing=True)


def scan_oof(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """Prediction tables that must hold the same folds."""

    tables = [spark.read.parquet(p) for p in paths]
    folds = [{r[0] for r in t.select(FOLD).distinct().collect()} for t in tables]
    if not folds or not folds[0]:
        raise ValueError("no folds found")
    odd = [sorted(folds[0] ^ f) for f in folds[1:] if f != folds[0]]
    if odd:
        raise ValueError(f"prediction tables must contain the same folds; mismatches={odd}")
    return tables


# --------------------------------------------------------------------------- sinks


def write_oof(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Predictions partitioned by fold, zstd-compressed.

    The rebalance hint gathers the rows of a fold into few files and lets AQE split a fold that is too
    large for one task.
    """

    df.hint("rebalance", FOLD).write.mode(mode).option("compression", "zstd").partitionBy(FOLD).parquet(path)


def write_lag_cache(df: DataFrame, path: str, columns: Sequence[str] = RESPONDERS, *, lag: int = 1, daily: bool = False, mode: str = "overwrite") -> None:
    """Materialised lag table partitioned by date: one join and one write instead of a loop over dates."""

    joined = with_daily_last_lags(df, columns, lag) if daily else with_lags(df, columns, lag)
    names = lag_names(columns, lag, daily=daily)
    joined.select(*KEYS, *names).hint("rebalance", DATE).write.mode(mode).option("compression", "zstd").partitionBy(DATE).parquet(path)


def write_report(df: DataFrame, path: str, *, kind: str = "csv", mode: str = "overwrite") -> None:
    """Score, slice or parameter table as CSV or JSON."""

    if kind == "csv":
        df.write.mode(mode).option("header", "true").csv(path)
    elif kind == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown report kind: {kind}")
