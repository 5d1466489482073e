"""Symbol-neighbour graph: profiles, nearest symbols and neighbour aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.core import ratio, zsum
from panelkit.schema import BATCH, DATE, KEYS, SYMBOL, WEIGHT

# Symbols of one block; two blocks meet in a task.
BLOCK_SYMBOLS = 4_000


def symbol_profiles(df: DataFrame, columns: Sequence[str], start: int, end: int) -> DataFrame:
    """Weighted mean profile of each symbol over a date range."""

    means = [F.coalesce(ratio(zsum(S.dbl(WEIGHT) * S.filled(c)), zsum(S.dbl(WEIGHT))), F.lit(0.0)).alias(c) for c in columns]
    return df.where(F.col(DATE).between(start, end)).groupBy(SYMBOL).agg(*means)


def nearest_symbols(
    df: DataFrame, columns: Sequence[str], *, start: int, end: int, n_neighbors: int = 5, block_size: int = BLOCK_SYMBOLS
) -> DataFrame:
    """Edges to the ``n_neighbors`` closest symbols by standardised profile.

    Profiles are dealt into blocks. Each pair of blocks is one group: the symbols of the first keep their nearest ones of
    the second, so a group holds two blocks and gives no more than ``n_neighbors`` rows per symbol; the nearest over all
    blocks follow from those. Equal distances are ordered by symbol.
    """

    if not columns:
        raise ValueError("profiles need one column or more")
    if n_neighbors < 1:
        raise ValueError("each symbol has one neighbour or more")
    profiles = symbol_profiles(df, columns, start, end)
    shape = profiles.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    if shape["n"] <= n_neighbors:
        raise ValueError(f"{shape['n']} symbols can't have {n_neighbors} neighbours each")
    blocks = max(1, -(-shape["n"] // block_size))
    scaled = [((F.col(c) - F.lit(shape[f"m_{c}"])) / F.lit(shape[f"s_{c}"] if shape[f"s_{c}"] > 1e-12 else 1.0)).alias(f"__z{i}") for i, c in enumerate(columns)]
    points = profiles.select(SYMBOL, *scaled, F.pmod(F.xxhash64(SYMBOL), F.lit(blocks)).cast("int").alias("__block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = points.select("*", every.alias("__other"), F.lit(True).alias("__asks")).withColumnsRenamed({"__block": "__from", "__other": "__to"})
    asked = points.select("*", every.alias("__other"), F.lit(False).alias("__asks")).withColumnsRenamed({"__block": "__to", "__other": "__from"})
    names = [f"__z{i}" for i in range(len(columns))]
    kind = df.schema[SYMBOL].dataType.simpleString()

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        own, others = group[group["__asks"]], group[~group["__asks"]]
        points, ids = others[names].to_numpy(np.float64), others[SYMBOL].to_numpy()
        out = []
        for symbol, at in zip(own[SYMBOL].to_numpy(), own[names].to_numpy(np.float64)):
            gap = ((points - at) ** 2).sum(axis=1)
            order = np.lexsort((ids, gap))
            order = order[ids[order] != symbol][:n_neighbors]
            out.append(pd.DataFrame({SYMBOL: symbol, "neighbor_id": ids[order], "distance": gap[order]}))
        return pd.concat(out) if out else pd.DataFrame({SYMBOL: [], "neighbor_id": [], "distance": []})

    close = asking.unionByName(asked).groupBy("__from", "__to").applyInPandas(nearest, f"{SYMBOL} {kind}, neighbor_id {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy(SYMBOL).orderBy("distance", "neighbor_id"))
    return close.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n_neighbors)


def edge_frame(spark: SparkSession, neighbors: dict[int, Sequence[int]]) -> DataFrame:
    """Edges from a fitted neighbour map."""

    if not neighbors:
        raise ValueError("the graph has no edges")
    return spark.createDataFrame([(s, n) for s, ns in neighbors.items() for n in ns], f"{SYMBOL} int, neighbor_id int")


def with_neighbor_features(df: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edge count, mean of the neighbours' current values and deviation from it.

    The edge list grows with the symbols only and AQE broadcasts it when small. Each row fans out to at
    most its number of neighbours and is aggregated back on the unique panel key.
    """

    source = df.select(*BATCH, F.col(SYMBOL).alias("neighbor_id"), *[S.filled(c).alias(f"__v_{c}") for c in columns])
    fan = df.select(*KEYS).join(edges.select(SYMBOL, "neighbor_id"), SYMBOL).join(source, [*BATCH, "neighbor_id"], "left")
    sums = [F.avg(f"__v_{c}").alias(f"__m_{c}") for c in columns]
    around = fan.groupBy(*KEYS).agg(F.count("neighbor_id").alias("__n"), *sums)
    out = df.join(around, list(KEYS), "left").withColumn("symbol_graph_neighbor_count", F.coalesce("__n", F.lit(0)).cast("int"))
    added = {}
    for c in columns:
        mean = F.coalesce(F.col(f"__m_{c}"), F.lit(0.0)).cast("float")
        added[f"{c}_sg_neighbor_mean"] = mean
        added[f"{c}_sg_deviation"] = S.filled(c).cast("float") - mean
    return out.withColumns(added).drop("__n", *[f"__m_{c}" for c in columns])
