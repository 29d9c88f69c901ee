"""Near-duplicate vectors through cells around pivots, with every link found.

Each vector lives in the cell of the pivot nearest to it.  Of two cells the members of the smaller
visit the larger, each only if the angle allows a link with a member there; pairs are compared at
home and between a member and a visitor.  A cell of any size is cut into blocks and pairs of blocks,
so a task holds two blocks at most; what leaves it is a number of links and one tree edge per
vector, never the pairs.  Pivots decide about the work, not about the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.common import components, stage

#: Pivots: one for CELL vectors, within these bounds, spread by distance over a sample of SAMPLED a pivot.
PIVOTS, CELL, SAMPLED = (16, 4096), 2048, 4
BLOCK = 4096
#: Room for rounding in the bounds that spare a comparison.
SLACK = 1e-6
#: Vectors and visits handled at once, also the rows of a block compared at once.
SLICE, VISITS = 512, 4096


def _pivots(classes: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of the sample, each the one farthest from those before; the sample is chosen by hash.

    At most SAMPLED * PIVOTS[1] rows come to the driver.
    """
    count = max(PIVOTS[0], min(PIVOTS[1], n // CELL))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLED * count).select("vector").collect()
    sample = _unit(np.array([r.vector for r in rows], "f8"))
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)) and nearest.min() < 1 - SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Divided by the largest component first: squares of very large or small ones leave the range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _units(bodies: list[bytes], kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1).astype("f8"))


def homes(classes: DataFrame, points: np.ndarray, kind: str) -> DataFrame:
    """(cell, rep, size, body, near): every vector with the pivot nearest to it and the cosine to that.

    The body is the vector as numbers of `kind`, which must hold them without loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                vector = np.array(part.column(2).to_pylist(), "f8")
                near = _unit(vector) @ points.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype("i4")), part.column(0), part.column(1),
                     pa.array([v.tobytes() for v in vector.astype(kind)], pa.binary()), pa.array(near[np.arange(len(cell)), cell])],
                    names=["cell", "rep", "size", "body", "near"])

    return classes.select("rep", "size", "vector").mapInArrow(run, "cell int, rep long, size long, body binary, near double")


def visits(cells: np.ndarray, near: np.ndarray, unit: np.ndarray, points: np.ndarray, rank: np.ndarray,
           radius: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the larger cells in which a vector may have a link.

    With y in cell q within the angle of x in cell p: x is no farther from q than the angle and the
    radius of q; and as y is on the side of q, x is no farther than the chord from the plane between.
    """
    angle, chord = math.acos(max(-1.0, min(1.0, threshold))), math.sqrt(max(0.0, 2 - 2 * threshold))
    to = unit @ points.T
    between = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))
    reached = np.arccos(np.clip(to, -1, 1)) <= angle + radius + SLACK
    sided = near[:, None] - to <= chord * between[cells] + SLACK
    return np.nonzero(reached & sided & (rank > rank[cells][:, None]))


def dealt_cells(home: DataFrame, points: np.ndarray, kind: str, threshold: float) -> DataFrame:
    """(cell, guest, rep, size, body): members of the cells and their visitors."""
    # At most one row per pivot comes to the driver: bounded by PIVOTS[1].
    found = home.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least")).toPandas()
    found = found.sort_values(["n", "cell"], kind="stable")
    rank, radius = np.full(len(points), -1), np.zeros(len(points))
    rank[found["cell"]] = np.arange(len(found))
    radius[found["cell"]] = np.arccos(np.clip(found["least"].to_numpy("f8"), -1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                cells, near = part.column(0).to_numpy(), part.column(4).to_numpy()
                unit = _units(part.column(3).to_pylist(), kind)
                row, cell = visits(cells, near, unit, points, rank, radius, threshold)
                row, cell = np.r_[np.arange(len(cells)), row], np.r_[cells, cell]
                for at in range(0, len(row), VISITS):
                    taken = pa.array(row[at:at + VISITS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at:at + VISITS].astype("i4")), pa.array(np.arange(at, at + len(taken)) >= len(cells)),
                         *(part.column(c).take(taken) for c in (1, 2, 3))], names=["cell", "guest", "rep", "size", "body"])

    return home.select("cell", "rep", "size", "body", "near").mapInArrow(
        run, "cell int, guest boolean, rep long, size long, body binary")


def _trees(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each by the pairs (i, j)."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(frame: pd.DataFrame, kind: str, threshold: float) -> pd.DataFrame:
    """(rep, others, root) of the links between two blocks of a cell, or within one."""
    frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
    a, b, visited = (frame[c].iloc[0] for c in ("low_block", "high_block", "visited"))
    unit = _units(frame["body"].tolist(), kind)
    block, guest = frame["block"].to_numpy(), frame["guest"].to_numpy(bool)
    left, right = np.flatnonzero((block == a) & ~guest), np.flatnonzero((block == b) & (guest == visited))
    size = frame["size"].to_numpy("int64")
    others, root, every = np.zeros(len(frame), "int64"), np.arange(len(frame)), np.arange(len(frame))
    facing = unit[right].T
    for at in range(0, len(left), SLICE):
        linked = unit[left[at:at + SLICE]] @ facing >= threshold
        if a == b and not visited:
            linked = np.triu(linked, at + 1)
        i, j = np.nonzero(linked)
        if len(i):
            i, j = left[at + i], right[j]
            np.add.at(others, i, size[j])
            np.add.at(others, j, size[i])
            root = _trees(len(frame), np.r_[i, every], np.r_[j, root])
    met = np.flatnonzero(others)
    rep = frame["rep"].to_numpy("int64")
    return pd.DataFrame({"rep": rep[met], "others": others[met], "root": rep[root[met]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by cosine >= threshold in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    rows with a null id.  Of vectors of several lengths the shorter count as filled up with zeros.  Equal
    vectors are one class, whose members all link; a repeated id is one more member.  Every pair is
    decided: what the bounds cannot rule out is compared.  An empty table gives no rows.
    """
    narrow = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    good = ("vec_id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) "
            "AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)")
    rows = stage(rows.withColumn("usable", F.coalesce(F.expr(good), F.lit(False))), "vectors")
    shape = rows.where("usable").agg(F.max(F.size("vector"))).first()[0] or 0
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(shape) - F.size("vector")))
    usable = rows.where("usable").select("vec_id", filled.alias("vector"))
    classes = stage(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")),
                    "vector-classes")
    n = classes.count()
    if n:
        points = _pivots(classes, n)
        kind = "<f4" if narrow else "<f8"
        # Visits are found twice rather than written: only their counts are needed before they are dealt.
        listed = dealt_cells(stage(homes(classes, points, kind), "vector-homes"), points, kind, threshold)
        # At most one row per pivot: bounded by PIVOTS[1].
        counts = [F.ceil(F.count(F.when(F.col("guest") == g, 1)) / BLOCK).cast("int").alias(name)
                  for g, name in ((False, "own_blocks"), (True, "guest_blocks"))]
        blocks = F.broadcast(listed.groupBy("cell").agg(*counts))
        dealt = listed.join(blocks, "cell").withColumn("block", F.pmod(
            F.xxhash64("rep"), F.when(F.col("guest"), F.col("guest_blocks")).otherwise(F.col("own_blocks"))).cast("int"))
        # Members meet members and visitors; visitors meet members only.
        own = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda k: F.when(
            F.col("guest"), F.struct(k.alias("low_block"), F.col("block").alias("high_block"), F.lit(True).alias("visited")))
            .otherwise(F.struct(F.least("block", k).alias("low_block"), F.greatest("block", k).alias("high_block"),
                                F.lit(False).alias("visited"))))
        foreign = F.when(F.col("guest") | (F.col("guest_blocks") == 0), F.array()).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.col("guest_blocks"), F.lit(1)) - 1), lambda k: F.struct(
                F.col("block").alias("low_block"), k.alias("high_block"), F.lit(True).alias("visited"))))
        dealt = dealt.withColumn("task", F.explode(F.concat(own, foreign)))
        found = dealt.select("cell", "task.*", "block", "guest", "rep", "size", "body").groupBy(
            "cell", "low_block", "high_block", "visited").applyInPandas(
            lambda frame: block_links(frame, kind, threshold), "rep long, others long, root long")
        found = stage(found, "vector-links")
    else:
        found = rows.sparkSession.createDataFrame([], "rep long, others long, root long")
    links = found.groupBy("rep").agg(F.sum("others").alias("others"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    known = classes.join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("vector").alias("class_vector"), F.coalesce("root", "rep").alias("root"),
        (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"))
    joined = rows.withColumn("class_vector", F.when(F.col("usable"), filled)).join(known, "class_vector", "left")
    component = F.coalesce("root", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
