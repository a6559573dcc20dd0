"""Classes of near-equal vectors: every link of an inner product of at least a threshold, between vectors of length 1.

Vectors travel as codes (a bit for each dimension, then the values that are not zero), and equal ones are one class from
the start, with one code. Classes stand in order of their number of such dimensions and are cut into blocks of SIZE, these
into groups. A task holds the codes of one row group and meets the column blocks of one group, one at a time, in tiles: its
memory does not grow with the table. What it gives is a row for each class with a link, not for each link.

Two bounds leave out pairs that cannot be linked, and none that can:

* x of d dimensions reaches no more of y than its d largest dimensions hold, so column blocks meet only row groups with as
  many dimensions as their least demanding vector needs.
* On orthonormal axes U, x . y <= (x U) . (y U) + |rest of x| |rest of y|. The AXES axes are the principal ones of SAMPLE
  classes; which they are decides the speed, not the result.

Pairs that remain are multiplied in full, and in double precision where single precision leaves doubt.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import components
from tessella.runtime import Scratch

#: Classes of a block, of a tile's rows, and of a group: a GROUPS-th of all within these limits.
SIZE, TILE, GROUPS, LEAST, MOST = 1024, 2048, 12, 4096, 32_768
#: Axes of the bound, and classes they are found on; fewer classes than these meet without it.
AXES, SAMPLE = 384, 4096
#: Classes of a range partition, and pairs multiplied in double precision at once.
DEALT, DOUBTS = 16_384, 512
#: More than single precision errs in a bound, and in the square of what is left of a vector.
SLACK, REST = 1e-3, 1e-5
_HEAD, _AFTER = ">IIH", struct.calcsize(">IIH")
BLOCK = "block long, classes int, most int, need int, nodes binary, counts binary, dims binary, sizes binary, codes binary"


def coded(m: np.ndarray) -> list[bytes]:
    """Each row's code: dimensions, how many are not zero, how many values (0: as they are), bits, values, which value."""
    m = np.ascontiguousarray(m, np.float32)
    on = m != 0
    bits = np.packbits(on, axis=1)
    out = []
    for row, has, b in zip(m, on, bits, strict=True):
        x = row[has]
        values, which = np.unique(x, return_inverse=True)
        few = len(values) <= 256
        body = values.tobytes() + which.astype(np.uint8).tobytes() if few else x.tobytes()
        out.append(struct.pack(_HEAD, m.shape[1], len(x), len(values) if few else 0) + b.tobytes() + body)
    return out


def decoded(codes: list[bytes]) -> np.ndarray:
    """The rows of codes of the same number of dimensions."""
    dim = struct.unpack_from(_HEAD, codes[0])[0]
    start = _AFTER + -(-dim // 8)
    bits = np.frombuffer(b"".join([c[_AFTER : start] for c in codes]), np.uint8).reshape(len(codes), -1)
    values = []
    for c in codes:
        _, n, k = struct.unpack_from(_HEAD, c)
        v = np.frombuffer(c, np.float32, k or n, start)
        values.append(v[np.frombuffer(c, np.uint8, n, start + 4 * k)] if k else v)
    out = np.zeros((len(codes), dim), np.float32)
    out[np.unpackbits(bits, axis=1, count=dim).view(bool)] = np.concatenate(values)
    return out


def _blocks(threshold: float, size: int):
    """Rows (node, n, dims, code) to blocks; a block holds consecutive classes of one range partition."""

    def block(rows):
        nodes, counts, dims, codes = (list(x) for x in zip(*rows, strict=True))
        energy = np.cumsum(-np.sort(-np.square(decoded(codes)), axis=1), axis=1)
        need = 1 + int((energy < threshold * threshold - SLACK).sum(axis=1).min())
        cells = [[nodes[0]], [len(rows)], [max(dims)], [need], [np.array(nodes, np.int64).tobytes()], [np.array(counts, np.int64).tobytes()], [np.array(dims, np.int32).tobytes()], [np.array([len(c) for c in codes], np.int32).tobytes()], [b"".join(codes)]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

    def run(batches):
        held = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (len(held) == size or row[0] != held[-1][0] + 1):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return run


def _axes(most: int):
    """The principal axes of all vectors, at most so many, as one row."""

    def run(batches):
        total = np.float64(0)
        for b in batches:
            codes = b.column(0).to_pylist()
            for at in range(0, len(codes), SIZE):
                m = decoded(codes[at : at + SIZE]).astype(np.float64)
                total = total + m.T @ m
        u = np.linalg.eigh(total)[1][:, : -most - 1 : -1]
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(u, np.float32).tobytes()], pa.binary())], ["u"])

    return run


class _Side:
    """Classes of one or more blocks: numbers, sizes, dimensions, codes, and their vectors on the axes."""

    def __init__(self, rows, u, whole: bool):
        self.nodes, self.counts, self.dims = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("nodes", np.int64), ("counts", np.int64), ("dims", np.int32)))
        self.codes, seen = [], []
        for r in rows:
            ends = np.cumsum(np.frombuffer(r["sizes"], np.int32)).tolist()
            codes = [r["codes"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
            self.codes += codes
            m = decoded(codes) if whole or u is not None else None
            if u is not None:
                p = m @ u
                rest = np.sqrt(np.maximum(np.square(m).sum(axis=1) - np.square(p).sum(axis=1), 0) + REST)
                seen.append(np.column_stack([p, rest.astype(np.float32)]))
        self.full = m if whole else None
        self.seen = np.concatenate(seen) if seen else None


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j: label has a smaller or equal place in the same set for each place, itself for the least."""
    while len(i):
        while (label[label] != label).any():
            label[:] = label[label]
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _met(threshold: float, u: np.ndarray | None):
    """Rows (rb, part, kind, BLOCK) sorted so: those of kind 0 are one row group, each of kind 1 a column block."""

    def pairs(rows: _Side, cols: _Side, lo: int, hi: int):
        """Places (i, j) of linked classes among rows lo to hi, rows before columns."""
        if cols.seen is not None:
            i, j = np.nonzero(rows.seen[lo:hi] @ cols.seen.T >= threshold - SLACK)
        else:
            i, j = (x.ravel() for x in np.indices((hi - lo, len(cols.nodes))))
        keep = rows.nodes[lo + i] < cols.nodes[j]
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
        some, x = np.unique(i, return_inverse=True)
        other, y = np.unique(j, return_inverse=True)
        a, b = decoded([rows.codes[lo + k] for k in some]), cols.full[other]
        s = (a @ b.T)[x, y]
        linked = s >= threshold
        doubt = np.flatnonzero(np.abs(s - threshold) < SLACK)
        for at in range(0, len(doubt), DOUBTS):
            d = doubt[at : at + DOUBTS]
            linked[d] = (a[x[d]].astype(np.float64) * b[y[d]]).sum(axis=1) >= threshold
        return lo + i[linked], j[linked]

    def found(group: list, columns):
        rows = _Side(group, u, False)
        nodes, label = [rows.nodes], np.arange(len(rows.nodes))
        links = [np.zeros(len(rows.nodes), np.int64)]
        for c in columns:
            cols = _Side([c], u, True)
            at, n = len(label), len(cols.nodes)
            own = np.searchsorted(rows.nodes, cols.nodes[0])  # of this group too: the same places
            inside = own < len(rows.nodes) and rows.nodes[own] == cols.nodes[0]
            if inside:
                at = own
            else:
                label = np.concatenate([label, np.arange(at, at + n)])
                nodes.append(cols.nodes)
                links.append(np.zeros(n, np.int64))
            of_cols = links[0][at : at + n] if inside else links[-1]
            first, last = np.searchsorted(rows.dims, c["need"]), np.searchsorted(rows.nodes, cols.nodes[-1])
            for lo in range(first, last, TILE):
                i, j = pairs(rows, cols, lo, min(lo + TILE, last))
                if len(i):
                    links[0] += np.bincount(i, cols.counts[j], len(rows.nodes)).astype(np.int64)
                    of_cols += np.bincount(j, rows.counts[i], n).astype(np.int64)
                    _joined(label, i, at + j)
        while (label[label] != label).any():
            label = label[label]
        nodes, links = np.concatenate(nodes), np.concatenate(links)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]]), pa.array(links[some])], ["a", "b", "links"])

    def run(batches):
        """One key's rows at a time: its row group first, then its column blocks as they come."""
        rows = (dict(zip(b.schema.names, (b.column(c)[i].as_py() for c in range(b.num_columns)), strict=True)) for b in batches for i in range(b.num_rows))
        now = next(rows, None)
        while now is not None:
            key, group = (now["rb"], now["part"]), []
            while now is not None and (now["rb"], now["part"]) == key and now["kind"] == 0:
                group.append(now)
                now = next(rows, None)

            def columns():
                nonlocal now
                while now is not None and (now["rb"], now["part"]) == key:  # noqa: B023
                    yield now
                    now = next(rows, None)

            yield found(group, columns())

    return run


def _plan(stats: list, n: int) -> list[tuple]:
    """(block, own, first, last): each block's group, the first group it meets as columns, the last that meets its own."""
    size, own, held = min(MOST, max(LEAST, -(-n // GROUPS))), [], 0
    for s in stats:
        held += s["classes"]
        if not own or held > size:
            own.append(own[-1] + 1 if own else 0)
            held = s["classes"]
        else:
            own.append(own[-1])
    most = np.zeros(own[-1] + 1, np.int64)
    for s, g in zip(stats, own, strict=True):
        most[g] = max(most[g], s["most"])
    first = [min(g, int(np.searchsorted(most, s["need"]))) for s, g in zip(stats, own, strict=True)]
    last = list(range(len(most)))
    for f, g in zip(first, own, strict=True):
        for k in range(f, g + 1):
            last[k] = max(last[k], g)
    return [(s["block"], g, f, last[g]) for s, g, f in zip(stats, own, first, strict=True)]


def classes(df: DataFrame, id_col: str, code_col: str, threshold: float) -> DataFrame:
    """(row, copy_of, class_id, n_links) for every row of df, whose codes are of vectors of length 1 or 0.

    n_links: other rows of inner product at least threshold, equal vectors among them; copy_of: the smallest row of an
    equal vector; class_id: the smallest row that links reach. A zero vector has no links and is in a class of its own.
    The driver gets a row for each block, and the axes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    code = F.col("code")
    dims = F.conv(F.hex(F.substring(code, 5, 4)), 16, 10).cast("int")
    rows = scratch.keep(df.select(F.col(id_col).cast("long").alias("row"), F.col(code_col).alias("code")).withColumn("key", F.unhex(F.sha2("code", 256))))
    parts = max(1, -(-rows.count() // DEALT))
    one = rows.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("n"), F.first("code").alias("code")).withColumn("dims", dims).filter("dims > 0")
    dealt = one.repartitionByRange(parts, "dims", "key").sortWithinPartitions("dims", "key").withColumn("node", F.monotonically_increasing_id())
    table = scratch.keep(dealt)
    n = table.count()

    ends = rows.select("row", "key")
    if not n:
        return ends.select("row", F.col("row").alias("copy_of"), F.col("row").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    blocks = scratch.keep(table.select("node", "n", "dims", "code").mapInArrow(_blocks(threshold, SIZE), BLOCK))
    u = None
    if n > SAMPLE:
        raw = table.orderBy("key").limit(SAMPLE).select("code").mapInArrow(_axes(AXES), "u binary").first()["u"]
        u = np.frombuffer(raw, np.float32)
        u = u.reshape(-1, min(AXES, round(len(u) ** 0.5)))
    plan = spark.createDataFrame(_plan(blocks.select("block", "classes", "most", "need").orderBy("block").collect(), n), "block long, own int, first int, last int")
    placed = blocks.join(F.broadcast(plan), "block")
    carried = [F.col(x.split()[0]) for x in BLOCK.split(", ")]
    left = placed.select(F.col("own").alias("rb"), F.explode(F.sequence("own", "last")).alias("part"), F.lit(0).alias("kind"), *carried)
    right = placed.select(F.explode(F.sequence("first", "own")).alias("rb"), F.col("own").alias("part"), F.lit(1).alias("kind"), *carried)
    tasks = plan.select("own", "last").distinct().agg(F.sum(F.col("last") - F.col("own") + 1)).first()[0]
    met = left.unionByName(right).repartition(min(2 * tasks, 100_000), "rb", "part").sortWithinPartitions("rb", "part", "kind", "block")
    found = scratch.keep(met.mapInArrow(_met(threshold, u), "a long, b long, links long"))

    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reached = components(found.select("a", "b"), scratch).select(F.col("doc").alias("node"), "component")
    joined = table.select("node", "key", "least", "n").join(counts, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = scratch.keep(joined)
    lowest = joined.groupBy("component").agg(F.min("least").alias("class_id"))
    each = joined.join(lowest, "component").select("key", F.col("least").alias("copy_of"), "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return ends.join(each, "key", "left").select("row", F.coalesce("copy_of", "row").alias("copy_of"), F.coalesce("class_id", "row").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
