"""Shapes of clusters and of neighbourhoods by singular values, a cluster or a neighbourhood to a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_geometry(vectors: DataFrame) -> DataFrame:
    """elongation (uncentred singular values 1 to 2, 1..100, from 5 members), volume (product of the first three), skew and kurtosis along the first two principal components (sign: largest loading positive)."""

    def moments(x: np.ndarray) -> tuple[float, float]:
        z = x - x.mean()
        s = z.std()
        return (0.0, 0.0) if s < 1e-12 else (float((z**3).mean() / s**3), float((z**4).mean() / s**4 - 3))

    def one(t: pa.Table) -> pa.Table:
        x = np.array(t.column("v").to_pylist(), np.float64)
        n = len(x)
        s = np.sqrt(np.maximum(0, np.linalg.eigvalsh(x.T @ x)[::-1]))
        elongation = float(np.clip(s[0] / max(s[1], 1e-12), 1, 100)) if n >= 5 and len(s) > 1 else None
        volume = float(max(np.prod(s[:3]), 1e-6))
        shape = [None] * 4
        if n >= 3:
            z = x - x.mean(0)
            _, axes = np.linalg.eigh(z.T @ z)
            for k in range(2):
                a = axes[:, -1 - k]
                a = a * np.sign(a[np.abs(a).argmax()])
                shape[2 * k : 2 * k + 2] = moments(z @ a)
        names = ["pc1_skew", "pc1_kurt", "pc2_skew", "pc2_kurt"]
        return pa.table({"c": pa.array([t.column("c")[0].as_py()], pa.int64()), "size": pa.array([n], pa.int64()), "elongation": pa.array([elongation], pa.float64()), "volume": pa.array([volume], pa.float64()), **{k: pa.array([v], pa.float64()) for k, v in zip(names, shape, strict=True)}})

    rows = vectors.filter("c is not null and v is not null").select(F.col("c").cast("long").alias("c"), "v")
    return rows.groupBy("c").applyInArrow(one, "c long, size long, elongation double, volume double, pc1_skew double, pc1_kurt double, pc2_skew double, pc2_kurt double")


def intrinsic_dim(edges: DataFrame, vectors: DataFrame, share: float = 0.9) -> DataFrame:
    """Components that hold 90 % of the variance of a node's neighbourhood; null under 3 neighbours. A node has k rows."""
    near = edges.join(vectors.toDF("dst", "v"), "dst").select("src", "v")

    def one(t: pa.Table) -> pa.Table:
        x = np.array(t.column("v").to_pylist(), np.float64)
        dim = None
        if len(x) >= 3:
            e = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
            dim = int(np.searchsorted(np.cumsum(e) / max(e.sum(), 1e-12), share) + 1)
        return pa.table({"id": t.column("src")[:1], "intrinsic_dim": pa.array([dim], pa.int64())})

    return near.groupBy("src").applyInArrow(one, "id long, intrinsic_dim long")
