"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, so that a cosine of at least t means a squared distance of at most 2 - 2t. A fixed
rotation spreads what they differ in; the rotated vectors are split into blocks of few dimensions, and each block gets
a share of the squared distance in proportion to its dimensions. Were a pair further apart than its share in every
block, the whole would exceed the sum of the shares; so each close pair is within the share in one block at least.
In each block a range join over grid cells finds the pairs within the share. A pair is decided in the first block that
finds it, there by the exact cosine in double precision, so the union of all blocks is verified once. No pair is lost and
none below the threshold is linked. Pairs never leave their task: of each cell's vectors go on their numbers of links and
one edge each to the least vector that they are joined with there, so a group of g close vectors gives about g rows.

Vectors are compared only when labels are equal and not null and the numbers of dimensions agree. Vectors that are
null, empty, zero, or hold null or non-finite components link with nothing. Equal vectors of a label are one class with one
representative in the join, and counted as linked. Every row counts as a vector: rows that share an id, and rows
without one, are compared each with its own components; a component without any id has null for its number. Very long
vectors only make a task's rows wider. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialise, own_keys, pair_blocks

#: Dimensions of a block and, of those, of its grid; members of a chunk of a grid cell.
WIDTH, GRID, CHUNK = 16, 2, 1000
#: Room for rounding in the squared distances of blocks.
SLACK = 1e-9


def rotation(dimensions: int) -> np.ndarray:
    """An orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_501).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks_of(dimensions: int) -> list[tuple[int, int]]:
    count = max(1, dimensions // WIDTH)
    ends = np.linspace(0, dimensions, count + 1).astype(int)
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; each is computed in a fixed order, the same whatever rows come with it."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite
    square = np.zeros(len(x))
    for j in range(x.shape[1]):
        square += x[:, j] * x[:, j]
    return x / np.sqrt(square)[:, None]


def turned(x: np.ndarray) -> np.ndarray:
    """Unit rows in rotated coordinates, also in a fixed order, so that every task sees the same distances."""
    out, turn = np.zeros_like(x), rotation(x.shape[1])
    for j in range(x.shape[1]):
        out += x[:, [j]] * turn[:, j]
    return out


def apart(x: np.ndarray, y: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Squared distances of rows within a block, in a fixed order."""
    total = np.zeros(len(x))
    for j in range(begin, end):
        d = x[:, j] - y[:, j]
        total += d * d
    return total


def _digested(batches):
    """(key, label, size, digest, vector): digest is null for vectors that link with nothing; vector in single precision where that is exact."""
    for batch in batches:
        sizes, digests, vectors = [], [], []
        for label, own in zip(batch["label"].to_pylist(), batch["vector"].to_pylist()):
            x = None if label is None or not own or None in own else np.array(own, float)
            if x is not None and np.isfinite(x).all() and x.any():
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype("<f4")
                sizes.append(len(x))
                vectors.append((short if (short.astype(float) == x).all() else x).tobytes())
                digests.append(xxhash.xxh128_digest((x + 0.0).tobytes()))
            else:
                sizes.append(None), vectors.append(None), digests.append(None)
        yield pa.RecordBatch.from_arrays([batch["key"], batch["label"].cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["key", "label", "size", "digest", "vector"])


def _matrix(vectors, size: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * size else "<f8").astype(float) for v in vectors])


def _celled(batches, distance: float, dimensions: int = GRID):
    """(cell, rep, home, block): for each block the cell that a vector lives in (home), and those in which it is compared (not home).

    Of two neighbouring cells, the vectors of the lower one, by their coordinates, are compared in the higher one.
    """
    for batch in batches:
        sizes = batch["size"].to_numpy()
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            reps, labels = part["rep"].to_pylist(), part["label"].to_pylist()
            y = turned(unit(_matrix(part["vector"].to_pylist(), size)))
            rows: list[tuple] = []
            for k, (a, b) in enumerate(blocks_of(size)):
                side = math.sqrt(distance * (b - a) / size + SLACK) * 1.001
                cells = np.floor(y[:, a : min(b, a + dimensions)] / side).astype(int)
                for step in product((-1, 0, 1), repeat=cells.shape[1]):
                    if step >= (0,) * cells.shape[1]:
                        rows += [(f"{label}/{size}/{k}/{'/'.join(map(str, own))}", rep, not any(step), k) for label, rep, own in zip(labels, reps, (cells + np.array(step)).tolist())]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int32()))], ["cell", "rep", "home", "block"])


def links_in_block(x: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, distance: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of x that this block finds first: one of `left` and one of `right`, of which one is at home."""
    x = unit(x)
    y, blocks = turned(x), blocks_of(x.shape[1])
    budget = [distance * (b - a) / x.shape[1] + SLACK for a, b in blocks]
    a, b = blocks[block]
    own = y[:, a:b]
    square = (own * own).sum(axis=1)
    ones, twos = [], []
    for at in range(0, len(left), 128):  # few rows at a time, as all pairs of a dense cell may be close
        part = left[at : at + 128]
        near = square[part][:, None] + square[right][None, :] - 2 * (own[part] @ own[right].T) <= budget[block] + SLACK
        near &= home[part][:, None] | home[right][None, :]
        if left is right:
            near &= np.arange(at, at + len(part))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        for begin in range(0, len(i), 20_000):
            u, v = part[i[begin : begin + 20_000]], right[j[begin : begin + 20_000]]
            mine = apart(y[u], y[v], a, b) <= budget[block]
            for k in range(block):
                mine &= apart(y[u], y[v], *blocks[k]) > budget[k]
            u, v = u[mine], v[mine]
            linked = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
            ones.append(u[linked].astype(np.int32)), twos.append(v[linked].astype(np.int32))
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *ones]), np.concatenate([none, *twos])


def _linked(frame, distance: float, threshold: float):
    """(rep, others, least) of a pair of chunks of a cell: how many vectors a representative links with, and the least of its group."""
    import pandas as pd

    frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
    i, j, chunk, rep, weight = frame["chunk_i"].iloc[0], frame["chunk_j"].iloc[0], frame["chunk"].to_numpy(), frame["rep"].to_numpy(), frame["members"].to_numpy()
    left = np.flatnonzero(chunk == i)
    right = left if i == j else np.flatnonzero(chunk == j)
    out = pd.DataFrame({"rep": [], "others": [], "least": []})
    if len(left) and len(right):
        a, b = links_in_block(_matrix(frame["vector"], int(frame["size"].iloc[0])), frame["home"].to_numpy(), left, right, int(frame["block"].iloc[0]), distance, threshold)
        if len(a):
            n = len(frame)
            others = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            root = np.arange(n)
            while True:
                new = root.copy()
                np.minimum.at(new, a, root[b])
                np.minimum.at(new, b, root[a])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            has = np.flatnonzero(others)
            out = pd.DataFrame({"rep": rep[has], "others": others[has], "least": rep[root[has]]})
    return out.astype("int64")


def similar(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept), one row a vector."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    distance = 2 - 2 * threshold + 1e-9
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    plain, names = own_keys(plain, "id", ["label", "vector"], "vector-rows")
    digested = materialise(plain.select("key", "label", "vector").mapInArrow(_digested, "key long, label string, size int, digest binary, vector binary"), "vectors")
    # all joins are merged: tables of numbers are small as files and in shuffles, and would be broadcast however many rows they have
    same = ["label", "size", "digest"]
    classes = digested.where("digest is not null").groupBy(*same).agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("members"))
    membership = materialise(digested.select("key", *same).join(classes.hint("merge"), same, "left").select("key", F.coalesce("rep", "key").alias("rep"), F.coalesce("members", F.lit(1)).alias("members")), "vector-classes")
    reps = digested.where("digest is not null").join(membership.where("key = rep").select("rep", "members").hint("merge"), F.col("key") == F.col("rep")).select("rep", "label", "size", "vector", "members")
    reps = materialise(reps, "vector-reps")
    celled = materialise(reps.select("rep", "label", "size", "vector").mapInArrow(lambda b: _celled(b, distance), "cell string, rep long, home boolean, block int"), "vector-cells")
    # the cell, not the chunks, has one size and block; a cell without a home row holds no pair
    dealt = pair_blocks(celled.hint("merge"), ["cell"], "rep", CHUNK, "max(home)").join(reps.select("rep", "size", "vector", "members").hint("merge"), "rep")
    found = dealt.repartition("cell", "chunk_i", "chunk_j").groupBy("cell", "chunk_i", "chunk_j").applyInPandas(lambda f: _linked(f, distance, threshold), "rep long, others long, least long")
    found = materialise(found, "vector-links")
    counted = found.groupBy("rep").agg(F.sum("others").alias("others"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), "vectors").select(F.col("v").alias("rep"), F.col("component").alias("first"))
    out = (
        membership.join(counted.hint("merge"), "rep", "left").join(joined.hint("merge"), "rep", "left")
        .select("key", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("first", "rep").alias("first"))
    )
    if names is None:
        out = out.withColumnsRenamed({"key": "id", "first": "component_id"})
    else:
        out = out.join(names.hint("merge"), "key").join(names.select(F.col("key").alias("first"), F.col("id").alias("component_id")).hint("merge"), "first").select("id", "n_links", "component_id")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
