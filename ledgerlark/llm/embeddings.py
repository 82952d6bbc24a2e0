"""Near-duplicate embeddings: int8 tile products with error bounds.

Vectors are quantised to int8; a tile of products and each vector's exact
quantisation error bound every cosine from above, and only pairs that may reach
the threshold are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

BLOCK = 8192                # distinct vectors in a block; a task holds two blocks
TILE = 1024
PAIRS = 65_536              # pairs recomputed at a time


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, norm of the quantised vector, norm of the error) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine may reach the threshold.

    With x = sx qx + ex: |x.y - sx sy qx.qy| <= |sx qx||ey| + |sy qy||ex| + |ex||ey|.
    The int8 products are whole numbers, exact in the float type chosen.
    """
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 2 ** 24 else np.float64
    products = qa.astype(kind) @ qb.astype(kind).T
    # a bound for the whole row first, then the pair's own
    slack = na * eb.max() + nb.max() * ea + ea * eb.max()
    row = (threshold - 1e-9 - slack) / (sa * sb.max())
    row = np.where(row > 0, row * (1 - 1e-6), -np.inf).astype(kind)
    i, j = np.nonzero(products >= row[:, None])
    bound = products[i, j] * sa[i] * sb[j] + na[i] * eb[j] + nb[j] * ea[i] + ea[i] * eb[j]
    maybe = bound >= threshold - 1e-9
    return i[maybe], j[maybe]


def join_labels(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label per component after linking a[i] with b[i]."""
    while True:
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            return lab
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while (lab != lab[lab]).any():
            lab = lab[lab]


def _block_links(threshold: float):
    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links of two blocks (or within one): per vector the number of rows it
        links with, and another vector of its component here."""
        i, j = key[1].as_py(), key[2].as_py()
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("block").to_numpy()
        col = table.column("v").combine_chunks()
        x = np.asarray(col.values, dtype=np.float64)[col.offsets[0].as_py():].reshape(len(node), -1)
        x = x / np.abs(x).max(axis=1)[:, None]              # no overflow in the norm
        x = x / np.linalg.norm(x, axis=1)[:, None]
        q = quantise(x)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        count, lab = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for s in range(0, len(left), TILE):
            for t in range(s if i == j else 0, len(right), TILE):
                l, r = left[s:s + TILE], right[t:t + TILE]
                a, b = tile_pairs(tuple(p[l] for p in q), tuple(p[r] for p in q), threshold)
                a, b = l[a], r[b]
                if i == j:
                    a, b = a[a < b], b[a < b]
                for k in range(0, len(a), PAIRS):
                    u, v = a[k:k + PAIRS], b[k:k + PAIRS]
                    near = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                    u, v = u[near], v[near]
                    np.add.at(count, u, copies[v])
                    np.add.at(count, v, copies[u])
                    lab = join_labels(lab, u, v)
        some = np.flatnonzero(count)
        return pa.table({"node": node[some], "links": count[some], "other": node[lab[some]]})
    return links


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Link every pair of vectors with a cosine of at least ``threshold``.

    Returns one row per input row: vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable) and kept.  A vector
    that is null, empty, zero or holds a null or non-finite component links
    with nothing and is its own component; vectors of different lengths do not
    link.  Other columns are ignored; an empty table gives no rows.

    Equal vectors become one node with a count.  Nodes are dealt into blocks
    of about ``block`` by hash; a task compares two blocks and returns counts
    and a spanning forest, never the pairs.  The work is that of all pairs.
    """
    v = F.col("v")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) \
        & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), v))
    nodes = rows.where("v is not null").groupBy("v").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    nodes = materialize(nodes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    blocks = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (nodes.join(F.broadcast(blocks), "dim")                 # one row per vector length
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "node", "copies", "v"))
    found = materialize(dealt.groupBy("dim", "i", "j").applyInArrow(
        _block_links(threshold), "node long, links long, other long"), "vector-links")
    parts = connected_components(found.select("node", "other")).withColumnRenamed("id", "node")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = F.coalesce("component", "node")
    joined = nodes.join(parts, "node", "left").join(counts, "node", "left").withColumn("part", part)
    lows = joined.groupBy("part").agg(F.min("low").alias("component_id"))
    told = joined.join(lows, "part").select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(told, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
