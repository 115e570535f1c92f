"""Entity resolution by exact keys or by vectors within blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.functions.vectors import dot, mean_vectors
from verisift.operators.components import connected_components
from verisift.operators.retrieve import ENTITY
from verisift.scratch import materialize

#: Vectors of a block that are compared with each other at once, and rows of one product of matrices.
TILE, STRIP = 4096, 256


def blocks(vectors: DataFrame, bits: int = 8, tables: int = 6, size: int = 64, seed: int = 3) -> DataFrame:
    """Random-hyperplane buckets: (id, source_id, embedding, block); near vectors meet in at least one table with high probability."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, size))
    keys = []
    for t in range(tables):
        signs = [F.when(dot(F.col("embedding"), F.array(*map(F.lit, p.tolist()))) >= 0, 1 << b).otherwise(0) for b, p in enumerate(planes[t])]
        keys.append(F.struct(F.lit(t).alias("table"), sum(signs[1:], signs[0]).alias("bucket")))
    return vectors.withColumn("block", F.explode(F.array(*keys)))


def similar_pairs(vectors: DataFrame, id_col: str = "id", least: float = ENTITY, **blocking) -> DataFrame:
    """Pairs of ids in a common block with inner product at ``least``; each pair once."""
    blocked = blocks(vectors.select(F.col(id_col).alias("id"), "embedding"), **blocking)
    a = blocked.select("block", F.col("id").alias("a"), F.col("embedding").alias("va"))
    b = blocked.select("block", F.col("id").alias("b"), F.col("embedding").alias("vb"))
    near = a.join(b, "block").filter("a < b").filter(dot(F.col("va"), F.col("vb")) >= least)
    return near.select("a", "b").distinct()


def _reaches(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the inner products reach ``least``, as :func:`dot` adds them up: what the order of a sum could turn is summed in its order."""
    score = x @ y.T
    near = ~(score < least)
    unsure = np.abs(score - least) <= 1e-15 * x.shape[1] * np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max()
    if x.shape[1] and unsure.any():
        i, j = np.nonzero(unsure)
        near[i, j] = ~(np.cumsum(x[i] * y[j], axis=1)[:, -1] < least)
    return near


def joining(least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of rows (id, embedding, known, side) the edges that join groups (``known``) by similar vectors, one for each two groups that meet; rows of side 1 or 3 are compared with those of 2 or 3."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, side = frame["id"].to_numpy(), frame["embedding"].to_numpy(), frame["side"].to_numpy()
        group, sizes = pd.factorize(frame["known"])[0], np.array([len(v) for v in vectors])
        a, b = [], []
        for size in np.unique(sizes):
            left, right = (np.flatnonzero((sizes == size) & (side & s > 0)) for s in (1, 2))
            if not len(left) or not len(right) or len(np.unique(group[np.concatenate([left, right])])) < 2:
                continue
            x, y = (np.stack(vectors[rows]).astype(float) for rows in (left, right))
            for at in range(0, len(left), STRIP):
                rows = left[at : at + STRIP]
                near = _reaches(x[at : at + STRIP], y, least) & (group[rows][:, None] != group[right])
                for k in np.flatnonzero(near.any(axis=1)):
                    i, met = rows[k], right[near[k]]
                    for other, first in zip(*np.unique(group[met], return_index=True), strict=True):
                        if other != group[i]:
                            a.append(ids[i])
                            b.append(ids[met[first]])
                            group[group == other] = group[i]
        return pd.DataFrame({"a": pd.Series(a, dtype=ids.dtype), "b": pd.Series(b, dtype=ids.dtype)})

    return run


def similar_groups(vectors: DataFrame, id_col: str = "id", least: float = ENTITY, **blocking) -> DataFrame:
    """``(node, component)`` of the pairs that :func:`similar_pairs` has, without the pairs: only edges that join groups leave a tile.

    The rows of a block are dealt to tiles.  First each tile is joined in itself,
    which is linear in the rows; then only tiles that aren't of one group are
    compared with the others.  Where vectors hardly meet that is all pairs of a
    block, two tiles at a time.
    """
    whole = vectors.select(F.col(id_col).alias("id"), "embedding").filter(F.col("id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False)))
    blocked = blocks(whole, **blocking)
    parts = F.ceil(F.col("n") / TILE)
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    sizes = materialize(blocked.groupBy("block").agg(F.count("*").alias("n")), "sizes")  # a row for each bucket
    dealt = blocked.join(F.broadcast(sizes.select("block", parts.alias("parts"))), "block").withColumn("part", part(F.col("parts")))
    kind = whole.schema["id"].dataType.simpleString()
    within = dealt.select("block", "part", "id", "embedding", F.col("id").alias("known"), F.lit(3).alias("side"))
    first = materialize(within.groupBy("block", "part").applyInPandas(joining(least), f"a {kind}, b {kind}"), "joined")
    found = connected_components(first, "a", "b")
    wide = sizes.filter(F.col("n") > TILE).select("block")
    if wide.isEmpty():
        return found
    known = whole.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("known"))
    rows = blocked.join(F.broadcast(wide), "block").join(known, "id")
    counted = materialize(rows.groupBy("block", "known").agg(F.count("*").alias("n")), "groups")
    large = counted.filter(F.col("n") >= TILE).select("block", F.col("known").alias("own"), parts.alias("parts"))
    rest = counted.filter(F.col("n") < TILE).groupBy("block").agg(F.sum("n").alias("n")).select("block", F.lit(None).cast(kind).alias("own"), parts.alias("parts"))
    tiles = materialize(large.union(rest).select("block", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")), "tiles")
    t = tiles.select("block", F.struct("own", "part").alias("t"))
    pairs = t.join(t.withColumnRenamed("t", "u"), "block").filter((F.col("t") <= F.col("u")) & ~F.coalesce(F.col("t.own") == F.col("u.own"), F.lit(False)))
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return found
    same = F.col("t") == F.col("u")
    sides = pairs.select("block", "t", "u", F.explode(F.when(same, F.array(F.struct(F.col("t").alias("tile"), F.lit(3).alias("side")))).otherwise(F.array(F.struct(F.col("t").alias("tile"), F.lit(1).alias("side")), F.struct(F.col("u").alias("tile"), F.lit(2).alias("side"))))).alias("at"))
    sides = sides.select("block", "t", "u", F.col("at.tile.own").alias("own"), F.col("at.tile.part").alias("part"), F.col("at.side").alias("side"))
    owned = rows.join(large.select("block", F.col("own").alias("known"), F.lit(True).alias("is_large")), ["block", "known"], "left").withColumn("own", F.when(F.col("is_large"), F.col("known")))
    many = tiles.filter("part = 0").select("block", F.col("own").alias("_own"), "parts")
    placed = owned.join(many.withColumnRenamed("block", "_block"), (F.col("block") == F.col("_block")) & F.col("own").eqNullSafe(F.col("_own"))).withColumn("part", part(F.col("parts")))
    placed = placed.select("block", "own", "part", "id", "embedding", "known")
    s = sides.select(F.col("block").alias("_block"), "t", "u", F.col("own").alias("_own"), F.col("part").alias("_part"), "side")
    met = placed.join(s, (F.col("block") == F.col("_block")) & (F.col("part") == F.col("_part")) & F.col("own").eqNullSafe(F.col("_own")))
    across = met.groupBy("block", "t", "u").applyInPandas(joining(least), f"a {kind}, b {kind}")
    return connected_components(first.union(across), "a", "b")


def clusters(vectors: DataFrame, id_col: str = "id", least: float = ENTITY, **blocking) -> DataFrame:
    """``(id_col, entity)``: connected groups of similar vectors, named by the smallest id; order plays no part."""
    found = similar_groups(vectors, id_col, least, **blocking).select(F.col("node").alias(id_col), "component")
    return vectors.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("component", id_col).alias("entity"))


def merge_across_sources(members: DataFrame, least: float = ENTITY, **blocking) -> DataFrame:
    """``members``: (id, source_id, entity, embedding) with entities per source; these are joined by their centroids."""
    centres = mean_vectors(members, ["entity"], "embedding", "embedding")
    merged = clusters(centres.withColumnRenamed("entity", "id"), "id", least, **blocking).withColumnRenamed("entity", "merged")
    return members.join(merged.withColumnRenamed("id", "entity"), "entity").select("id", "source_id", F.col("merged").alias("entity"))


def exact_entities(records: DataFrame, key: str) -> DataFrame:
    """Rows of a key in every source: key, number of sources and of rows."""
    return records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("source_id").alias("n_sources"), F.count("*").alias("n_rows"))
