"""Best-fit packing into sequences of several permitted lengths.

Lengths are whole numbers up to the largest permitted one, so best-fit-decreasing over all texts needs only how many
pieces have each length: the plan is made from that histogram (at most as many rows as the largest length, whatever the
corpus), handling equal bins and equal pieces together, and gives the same bins as placing the pieces one by one. The
rows then find their place in the plan by their rank, so no bin, length or text is ever gathered in one task.

All permitted lengths are optimised together: when no open bin takes a piece, every size that holds it is tried with the
lengths that occur, from this one down (as many of this one as fit, then the longest that still fits, and so on), and
the size that costs least for each token so put in is opened (``cost``: a fixed part, a linear part and attention's
square; equal ones go to the smaller). Pieces then go to the bin of least room that takes them, of equal ones to the
smaller size and the older bin. At the end each bin is downsized to the smallest permitted length that holds its
contents, as a bin opened for several pieces may not have got them. ``totals`` says what a packing costs.

Edge cases: a text longer than the largest length is split into pieces of it and a rest; a text without tokens (null,
empty, white space) gets one row of length 0 without a bin; equal ids are separate rows; an empty table gives no rows;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import texts
from tessella.llm.ranks import ranked

LENGTHS = (512, 1024, 2048, 4096)


def cost(length: int, fixed: float = 192.0, square: float = 16384.0) -> float:
    """Cost of one sequence of a length, in tokens: start-up, tokens, attention."""
    return fixed + length + length * length / square


class Plan(NamedTuple):
    """Places by global rank: pieces rank[i] and on go to bins base[i], base[i] + 1, ..., each[i] in a bin from at[i]."""

    rank: np.ndarray
    base: np.ndarray
    each: np.ndarray
    at: np.ndarray
    length: np.ndarray
    first_bin: np.ndarray  # ranges of bins and their final size
    size: np.ndarray


def opened(piece: int, lengths: list[int], sizes: list[int]) -> int:
    """The bin size to open for a piece; lengths: those that occur, sorted."""
    best = None
    for size in sizes:
        if size >= piece:
            room, low = size % piece, bisect_left(lengths, piece)
            while room and (low := bisect_right(lengths, room, 0, low)):
                room %= lengths[low - 1]
            share = cost(size) / (size - room)
            if best is None or share < best[0]:
                best = share, size
    return best[1]


def make_plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> Plan:
    """Best-fit-decreasing of counts[l] pieces of each length l > 0. Ranks are by length, ascending."""
    sizes, known = sorted(lengths), sorted(counts)
    start, total = {}, 0
    for l in known:
        start[l], total = total, total + counts[l]
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> sorted (size, first bin, bins)
    rooms: list[int] = []
    places, done, bins = [], [], 0

    def put(room: int, first: int, n: int, size: int) -> None:
        if not n:
            return
        if room == 0:
            done.append((first, n, size, 0))
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        insort(open_bins[room], (size, first, n))

    for l in sorted(counts, reverse=True):
        left, rank = counts[l], start[l]
        while left:
            i = bisect_left(rooms, l)
            if i < len(rooms):
                room = rooms[i]
                size, first, n = open_bins[room].pop(0)
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                size = opened(l, known, sizes)
                room, first, n = size, bins, -(-left // (size // l))
                bins += n
            each = room // l
            full = min(n, left // each)
            if full:
                places.append((rank, first, each, size - room, l))
                put(room - each * l, first, full, size)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:  # the last bin takes what is left
                places.append((rank, first + full, left, size - room, l))
                put(room - left * l, first + full, 1, size)
                left, full = 0, full + 1
            put(room, first + full, n - full, size)
    for room, groups in open_bins.items():
        done.extend((first, n, size, room) for size, first, n in groups)
    done.sort()
    places.sort()
    cols = np.array(places, np.int64).reshape(-1, 5)
    final = [(first, min(s for s in sizes if s >= size - room)) for first, _, size, room in done]
    ends = np.array(final, np.int64).reshape(-1, 2)
    return Plan(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], cols[:, 4], ends[:, 0], ends[:, 1])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``n_tokens``: words of the whole text."""

    def count(batches):
        for b in texts.sub_batches(batches):
            n = texts.word_counts(*texts.text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64))], ["id", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(texts.trimmed(count), f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def pack(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """id, piece, start, length, bin_id, capacity, bin_offset: where each piece of each text goes.

    sizes: one row per text with its number of tokens. start is the piece's first token in its text.
    """
    top = max(lengths)
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    whole = sizes.select(F.col(id_col).alias("id"), n.alias("n"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(n - 1) div {top}"), F.lit(0)).cast("int"))).alias("piece")
    pieces = whole.select("id", "n", piece).select("id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.col("n") - F.col("piece").cast("long") * top, F.lit(top)).cast("int").alias("length"))
    placed, _ = ranked(pieces, ["length", "id", "piece"], "rank")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most top + 1 rows
    empty = counts.pop(0, 0)
    plan = make_plan(counts, lengths)
    kind = dict(sizes.dtypes)[id_col]

    def place(batches):
        for b in batches:
            length = b.column(3).to_numpy()
            rank = b.column(4).to_numpy() - empty
            none = length == 0
            i = np.maximum(np.searchsorted(plan.rank, rank, "right") - 1, 0)
            if len(plan.rank):
                j = rank - plan.rank[i]
                bin_id = plan.base[i] + j // plan.each[i]
                offset = plan.at[i] + j % plan.each[i] * length
                size = plan.size[np.searchsorted(plan.first_bin, bin_id, "right") - 1]
            else:
                bin_id = offset = size = np.zeros(len(rank), np.int64)
            made = [pa.array(x.astype(t), mask=none) for x, t in ((bin_id, np.int64), (size, np.int32), (offset, np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], ["id", "piece", "start", "length", "bin_id", "capacity", "bin_offset"])

    out = placed.mapInArrow(texts.trimmed(place), f"id {kind}, piece int, start long, length int, bin_id long, capacity int, bin_offset int")
    return out.withColumnRenamed("id", id_col)


def totals(packed: DataFrame) -> DataFrame:
    """One row: bins, tokens, capacity, fill (tokens a place) and cost of a packing."""
    bins = packed.filter("bin_id IS NOT NULL").groupBy("bin_id", "capacity").agg(F.sum("length").alias("tokens"))
    each = cost(0) + F.col("capacity") + F.col("capacity").cast("double") * F.col("capacity") * (cost(1) - cost(0) - 1)
    out = bins.agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"), F.sum(each).alias("cost"))
    return out.select("bins", "tokens", "capacity", (F.col("tokens") / F.col("capacity")).alias("fill"), "cost")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, by words, in sequences of 512 to 4096 tokens."""
    return pack(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
