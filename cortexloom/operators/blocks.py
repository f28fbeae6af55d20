"""Neighbourhood operators on sparse label volumes, in dense blocks with a halo.

The grid is cut into cubes. A voxel goes to its own cube and, if it lies within the halo, to the cubes next to it (1.2 rows a voxel for
cubes of 32 and a halo of one), in one shuffle. A cube with its halo becomes a boolean array for each of its labels, on which
neighbours and closings are shifts and bit operations. A cube holds a bounded number of voxels, so there are no large groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: Voxels along the side of a cube.
SIDE = 32


class Block:
    """A cube with a halo of one voxel: ``of[label]`` is True where the label is; ``inner`` cuts the halo off."""

    inner = (slice(1, -1),) * 3

    def __init__(self, t: pa.Table, side: int):
        self.corner = [t[f"b{a}"][0].as_py() * side - 1 for a in XYZ]
        at = [t[a].to_numpy().astype(np.int64) - c for a, c in zip(XYZ, self.corner)]
        labels, which = np.unique(t["label"].to_numpy(), return_inverse=True)
        self.of = {}
        for k, label in enumerate(labels.tolist()):
            mine = which == k
            self.of[label] = np.zeros((side + 2,) * 3, bool)
            self.of[label][tuple(a[mine] for a in at)] = True

    def positions(self, found: np.ndarray) -> list[np.ndarray]:
        """Grid positions of the True cells of an array without halo."""
        return [i + c + 1 for i, c in zip(np.nonzero(found), self.corner)]


def per_block(voxels: DataFrame, work: Callable[[Block], pa.Table], schema: str, side: int = SIDE) -> DataFrame:
    """``work`` on every cube that has a voxel in it or in its halo. ``voxels``: x, y, z, label; rows with a null are left out."""
    rows = voxels.select(*[F.col(a).cast("int").alias(a) for a in XYZ], "label").dropna()
    for a in XYZ:
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - 1) / side).cast("int"), F.floor((F.col(a) + 1) / side).cast("int"))))
    return rows.groupBy("bx", "by", "bz").applyInArrow(lambda t: work(Block(t, side)), schema)


def label_pairs(block: Block) -> pa.Table:
    """(label, neighbour): different labels one voxel apart along an axis, for the voxels of the cube itself."""
    found = set()
    for (a, one), (b, two) in itertools.permutations(block.of.items(), 2):
        for axis in range(3):
            for shift in (-1, 1):
                if (a, b) not in found and (one[block.inner] & np.roll(two, shift, axis)[block.inner]).any():
                    found.add((a, b))
    return pa.table({"label": pa.array([a for a, _ in found], pa.int64()), "neighbour": pa.array([b for _, b in found], pa.int64())})


def closed_holes(block: Block) -> pa.Table:
    """(x, y, z, label): empty voxels of the cube that a closing by a 2x2x2 block fills, with the smallest label that does."""
    taken = np.logical_or.reduce(list(block.of.values()))[block.inner]
    out = []
    for label in sorted(block.of):
        grown = block.of[label]
        for axis in range(3):
            grown = grown | np.roll(grown, 1, axis)  # what wraps around reaches the outermost layer only
        closed = grown
        for axis in range(3):
            closed = closed & np.roll(closed, -1, axis)
        new = closed[block.inner] & ~taken
        taken = taken | new
        out.append([*block.positions(new), np.full(int(new.sum()), label)])
    cols = [np.concatenate(c) for c in zip(*out)]
    return pa.table({**{a: pa.array(c, pa.int32()) for a, c in zip(XYZ, cols)}, "label": pa.array(cols[3], pa.int64())})
