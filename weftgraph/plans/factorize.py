"""Matrix factorisation of ratings: alternating least squares, predictions and errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vectors import dot, random_vector
from weftgraph.operators.sorting import rank_rows
from weftgraph.session import materialize

#: Fixed values of the factorisation: factors and regularisation per rating.
RANK, LAMBDA = 10, 0.065


def initial_factors(vertices: DataFrame, rank: int = RANK, seed: int = 7) -> DataFrame:
    """(id, factor): uniform random factors."""
    return vertices.select("id", random_vector(rank, seed).alias("factor"))


def normal_equations(ratings: DataFrame, factors: DataFrame, side: str = "src") -> DataFrame:
    """(id, n, a0.., b0..): sums of the outer products and of rating times factor of the other end.

    The upper triangle as plain sums, so the aggregation combines map-side and no
    vertex's edges are gathered.
    """
    other = "dst" if side == "src" else "src"
    joined = ratings.select(F.col(side).alias("id"), F.col(other).alias("_o"), F.col("rating").cast("double").alias("r")).join(factors.select(F.col("id").alias("_o"), "factor"), "_o")
    rank = RANK if not (first := factors.select(F.size("factor").alias("n")).first()) else first["n"]
    x = [F.get("factor", F.lit(i)) for i in range(rank)]
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(rank) for j in range(i, rank)]
    return joined.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(x[i] * F.col("r")).alias(f"b{i}") for i in range(rank)])


def als_step(ratings: DataFrame, factors: DataFrame, side: str = "src", regularisation: float = LAMBDA) -> DataFrame:
    """(id, factor): the exact least-squares factor of each vertex on one side, given the other side's.

    Solves (A + regularisation * n * I) w = b; where that matrix is not positive
    definite the vertex keeps its factor.
    """
    equations = normal_equations(ratings, factors, side).join(factors.select("id", F.col("factor").alias("old")), "id", "left")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rank = sum(c.startswith("b") for c in pdf.columns)
            a = np.zeros((len(pdf), rank, rank))
            for i in range(rank):
                for j in range(i, rank):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}_{j}"]
            a += (regularisation * pdf["n"].to_numpy(float))[:, None, None] * np.eye(rank)
            b = pdf[[f"b{i}" for i in range(rank)]].to_numpy(float)
            out = []
            for k in range(len(pdf)):
                try:
                    np.linalg.cholesky(a[k])
                    out.append(np.linalg.solve(a[k], b[k]).tolist())
                except np.linalg.LinAlgError:
                    out.append(pdf["old"].iloc[k])
            yield pd.DataFrame({"id": pdf["id"], "factor": out})

    return equations.mapInPandas(solve, "id bigint, factor array<double>")


def als(ratings: DataFrame, iterations: int = 5, rank: int = RANK, regularisation: float = LAMBDA, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((id, factor) of the src side, of the dst side), by the built-in factorisation with the same weighting."""
    from pyspark.ml.recommendation import ALS

    # the solver takes ids of 32 bits, so the vertices of each side are numbered first
    users, items = (materialize(rank_rows(ratings.select(F.col(side).alias("id")).filter("id is not null").distinct(), "id", "id", "number"), "numbers") for side in ("src", "dst"))
    numbered = ratings.join(users.select(F.col("id").alias("src"), F.col("number").cast("int").alias("user")), "src")
    numbered = numbered.join(items.select(F.col("id").alias("dst"), F.col("number").cast("int").alias("item")), "dst")
    checked = numbered.select("user", "item", F.col("rating").cast("float").alias("rating"))
    model = ALS(rank=rank, maxIter=iterations, regParam=regularisation, userCol="user", itemCol="item", ratingCol="rating", seed=seed).fit(checked)

    def given(df: DataFrame, numbers: DataFrame) -> DataFrame:
        named = df.select(F.col("id").cast("bigint").alias("number"), F.col("features").cast("array<double>").alias("factor"))
        return named.join(numbers, "number").select("id", "factor")

    return given(model.userFactors, users), given(model.itemFactors, items)


def predict(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(src, dst, rating, predicted)."""
    with_user = ratings.join(users.select(F.col("id").alias("src"), F.col("factor").alias("_u")), "src")
    with_both = with_user.join(items.select(F.col("id").alias("dst"), F.col("factor").alias("_i")), "dst")
    return with_both.select("src", "dst", "rating", dot(F.col("_u"), F.col("_i")).alias("predicted"))


def rmse(predicted: DataFrame) -> DataFrame:
    """(n, rmse): root of the mean squared error and the number of ratings."""
    error = F.col("rating").cast("double") - F.col("predicted")
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))
