"""Linear and logistic regression and k-means, each a series of aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomtable.functions.checks import dtype_of, need_columns, need_distinct, need_numeric, need_some
from loomtable.functions.values import is_blank, strip
from loomtable.registry import operator

SINGULAR = 1e-10


@operator("drop_incomplete_rows")
def drop_incomplete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    need_columns(df, columns)
    return df.filter(reduce(Column.__and__, [~is_blank(df, c) for c in columns]))


@operator("incomplete_row_counts")
def incomplete_row_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    need_columns(df, columns)
    whole = reduce(Column.__and__, [~is_blank(df, c) for c in columns])
    return df.agg(F.count(F.when(whole, 1)).alias("row_count_used"),
                  F.count(F.when(~whole, 1)).alias("dropped_rows"))


def solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Small dense solve; a pivot near zero means dependent features."""
    a = np.column_stack([matrix.astype(float), vector.astype(float)])
    size = len(vector)
    for i in range(size):
        pivot = i + int(np.argmax(np.abs(a[i:, i])))
        if abs(a[pivot, i]) <= SINGULAR:
            raise ValueError("the features are linearly dependent")
        a[[i, pivot]] = a[[pivot, i]]
        a[i] /= a[i, i]
        for j in range(size):
            if j != i:
                a[j] -= a[j, i] * a[i]
    return a[:, -1]


def _model_rows(df: DataFrame, features: list[str], target: str) -> DataFrame:
    need_some(features, "feature column")
    need_distinct([*features, target], "model column")
    need_numeric(df, features)
    need_columns(df, [target])
    return drop_incomplete_rows(df, [*features, target])


@operator("linear_regression")
def linear_regression(df: DataFrame, features: list[str], target: str, intercept: bool = True) -> DataFrame:
    """Least squares: one pass for the sums of products, a small solve on the
    driver, one pass for R².  Rows of (kind, name, value)."""
    need_numeric(df, [target])
    rows = _model_rows(df, features, target)
    terms = ([F.lit(1.0)] if intercept else []) + [F.col(f"`{f}`").cast("double") for f in features]
    y, p = F.col(f"`{target}`").cast("double"), len(features) + intercept
    sums = [F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
                 *sums, *[F.sum(t * y).alias(f"y{i}") for i, t in enumerate(terms)]).first()
    if s["n"] < max(p, 3):
        raise ValueError(f"{s['n']} rows are too few for {p} parameters")
    xtx = np.array([[s[f"x{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    beta = solve(xtx, np.array([s[f"y{i}"] for i in range(p)]))
    fitted = reduce(Column.__add__, [t * float(b) for t, b in zip(terms, beta)])
    fit = rows.agg(F.sum((y - s["mean"]) ** 2).alias("total"), F.sum((y - fitted) ** 2).alias("rest")).first()
    if abs(fit["total"]) <= SINGULAR:
        r2 = 1.0 if abs(fit["rest"]) <= SINGULAR else 0.0
    else:
        r2 = 1.0 - fit["rest"] / fit["total"]
    dropped = df.count() - s["n"]
    out = [("coefficient", f, float(b)) for f, b in zip(features, beta[int(intercept):])]
    out += [("metric", "intercept", float(beta[0]) if intercept else 0.0), ("metric", "r2", float(r2)),
            ("metric", "row_count_used", float(s["n"])), ("metric", "dropped_rows", float(dropped))]
    return df.sparkSession.createDataFrame(out, "kind string, name string, value double")


@operator("encode_binary_target")
def encode_binary_target(df: DataFrame, column: str, positive_label: str | None = None,
                         output_column: str = "target") -> DataFrame:
    """1.0 for the positive label, 0.0 for the other, null where missing.
    Booleans, 0/1 numbers, and texts with exactly two labels."""
    need_columns(df, [column])
    c, dt = F.col(f"`{column}`"), dtype_of(df, column)
    if isinstance(dt, T.BooleanType):
        label, positive = c.cast("string"), positive_label or "true"
        allowed = ("true", "false")
    elif isinstance(dt, T.StringType):
        label = F.when(~is_blank(df, column), strip(c))
        found = [r[0] for r in df.select(label.alias("v")).filter("v is not null").distinct().limit(3).collect()]
        if len(found) != 2:
            raise ValueError(f"column {column!r} does not have two classes")
        allowed = tuple(sorted(found, key=lambda s: s.encode()))
        positive = positive_label or allowed[1]
    else:
        need_numeric(df, [column])
        v = c.cast("double")
        odd = df.filter((F.abs(v) > 1e-9) & (F.abs(v - 1) > 1e-9)).limit(1).count()
        if odd:
            raise ValueError(f"column {column!r} has values other than 0 and 1")
        label, positive, allowed = F.when(v >= 0.5, "1").when(v < 0.5, "0"), positive_label or "1", ("0", "1")
    if positive not in allowed:
        raise ValueError(f"column {column!r} has no label {positive!r}")
    out = df.withColumn(output_column, F.when(label == positive, 1.0).when(label.isNotNull(), 0.0))
    ends = out.agg(F.min(output_column), F.max(output_column)).first()
    if ends[0] == ends[1]:
        raise ValueError(f"column {column!r} has a single class")
    return out


@operator("logistic_regression")
def logistic_regression(df: DataFrame, features: list[str], target: str, positive_label: str | None = None,
                        intercept: bool = True) -> DataFrame:
    """Unregularised maximum likelihood; rows of (kind, name, value)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = encode_binary_target(_model_rows(df, features, target), target, positive_label, "__y")
    numbers = rows.select(F.col("__y"), *[F.col(f"`{f}`").cast("double").alias(f"__x{i}")
                                          for i, f in enumerate(features)])
    data = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(features))], outputCol="__x").transform(numbers)
    data = data.select("__x", "__y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=0.0, standardization=False,
                                   fitIntercept=intercept, maxIter=500, tol=1e-10).fit(data)
        scored = model.transform(data)
        s = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("pos"),
                       F.avg((F.col("prediction") == F.col("__y")).cast("double")).alias("acc")).first()
    finally:
        data.unpersist()
    out = [("coefficient", f, float(b)) for f, b in zip(features, model.coefficients)]
    out += [("metric", "intercept", float(model.intercept)), ("metric", "training_accuracy", s["acc"]),
            ("metric", "row_count_used", float(s["n"])), ("metric", "dropped_rows", float(df.count() - s["n"])),
            ("metric", "positive_count", s["pos"]), ("metric", "negative_count", s["n"] - s["pos"]),
            ("metric", "positive_rate", s["pos"] / s["n"])]
    return df.sparkSession.createDataFrame(out, "kind string, name string, value double")


# ---- k-means ----

@dataclass
class Clusters:
    """Centres and sizes; ``assign`` labels any table that has the features."""

    features: list[str]
    centers: list[list[float]]
    sizes: list[int]
    inertia: float
    row_count_used: int

    def assign(self, df: DataFrame) -> DataFrame:
        x = [F.col(f"`{f}`").cast("double") for f in self.features]
        whole = reduce(Column.__and__, [c.isNotNull() for c in x])
        return (_with_nearest(df.filter(whole), x, self.centers).withColumnRenamed("__k", "cluster_id")
                .drop("__d"))


def _distance(x: list[Column], center: list[float]) -> Column:
    return reduce(Column.__add__, [(c - float(v)) * (c - float(v)) for c, v in zip(x, center)])


def _with_nearest(df: DataFrame, x: list[Column], centers: list[list[float]]) -> DataFrame:
    """Adds ``__d`` (distance) and ``__k`` (id) of the nearest centre; the lowest
    id wins a tie.  Distances are columns of their own, worked out once a row."""
    names = [f"__d{i}" for i in range(len(centers))]
    df = df.withColumns({n: _distance(x, c) for n, c in zip(names, centers)})
    df = df.withColumn("__d", F.least(*names) if len(names) > 1 else F.col(names[0]))
    k = F.lit(len(names) - 1)
    for i in reversed(range(len(names) - 1)):
        k = F.when(F.col(names[i]) == F.col("__d"), i).otherwise(k)
    return df.withColumn("__k", k).drop(*names)


def fit_clusters(df: DataFrame, features: list[str], cluster_count: int, row_id: str,
                 max_iterations: int = 100) -> Clusters:
    """Farthest-first start from the first row by ``row_id``, then Lloyd rounds.

    Equal points are folded into one point with their count and smallest id, combined before the shuffle, so a
    round costs the distinct points.  Every round is one grouped aggregate over them, cached.  Centres come
    back to the driver (clusters x features numbers) and enter the next round as
    literals, so the plan does not grow from round to round.
    """
    if cluster_count < 2:
        raise ValueError("at least two clusters are needed")
    need_some(features, "feature column")
    need_distinct(features, "feature column")
    need_numeric(df, [*features, row_id])
    names = [f"x{i}" for i in range(len(features))]
    x = [F.col(n) for n in names]
    data = df.select(F.col(f"`{row_id}`").alias("id"), *[F.col(f"`{f}`").cast("double").alias(n)
                                                         for f, n in zip(features, names)])
    data = (data.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    means = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in names]
    sizes_and_sums = [F.sum("n").alias("n"), F.sum(F.col("__d") * F.col("n")).alias("d")]
    try:
        first = data.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min_by(F.struct(*names), "id").alias("c")).first()
        if cluster_count > first["n"]:
            raise ValueError(f"{cluster_count} clusters need at least as many rows, not {first['n']}")
        centers = [list(first["c"])]
        while len(centers) < cluster_count:
            far = _with_nearest(data, x, centers).agg(
                F.max_by(F.struct("__d", *names), F.struct("__d", -F.col("id"))).alias("c")).first()["c"]
            if far["__d"] <= 1e-12:
                raise ValueError(f"only {len(centers)} distinct points for {cluster_count} clusters")
            centers.append([far[n] for n in names])
        for _ in range(max(1, max_iterations)):
            rows = (_with_nearest(data, x, centers).groupBy("__k")
                    .agg(*sizes_and_sums, *means).collect())
            moved = [list(c) for c in centers]
            for r in rows:
                moved[r["__k"]] = [r[n] for n in names]
            still = np.allclose(moved, centers, rtol=1e-12, atol=1e-12)
            centers = moved
            if still:
                break
        # the last round found the same centres again, so its sizes and distances hold
        final = rows if still else (_with_nearest(data, x, centers).groupBy("__k")
                                    .agg(*sizes_and_sums).collect())
        sizes = [0] * cluster_count
        for r in final:
            sizes[r["__k"]] = r["n"]
        if 0 in sizes:
            raise ValueError("a cluster is empty")
        return Clusters(list(features), centers, sizes, float(sum(r["d"] for r in final)), first["n"])
    finally:
        data.unpersist()


@operator("cluster_kmeans")
def cluster_kmeans(df: DataFrame, features: list[str], cluster_count: int, row_id: str,
                   max_iterations: int = 100) -> DataFrame:
    """One row per cluster: size, share, inertia of the whole and the centre."""
    m = fit_clusters(df, features, cluster_count, row_id, max_iterations)
    rows = [(i, n, n / m.row_count_used, m.inertia, max(m.sizes) / m.row_count_used, *map(float, c))
            for i, (n, c) in enumerate(zip(m.sizes, m.centers))]
    schema = T.StructType([T.StructField("cluster_id", T.IntegerType()), T.StructField("row_count", T.LongType()),
                           T.StructField("share", T.DoubleType()), T.StructField("inertia", T.DoubleType()),
                           T.StructField("largest_cluster_share", T.DoubleType()),
                           *[T.StructField(f"center_{f}", T.DoubleType()) for f in m.features]])
    return df.sparkSession.createDataFrame(rows, schema)
