"""Exact substring de-duplication by suffix arrays, built in two stages.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller id, or the same text further left).

*Routing.* Every window of LENGTH bytes has a key: the least hash of its GRAM-byte substrings. Equal windows have equal
keys wherever they stand, so windows can be dealt out by key and judged apart; unlike windows that share a key by chance
only meet in vain. Consecutive windows of one key form a segment, which travels as (key, 128 bits of BLAKE2b of its bytes,
place). Of segments with equal bytes only the first can hold first occurrences; the rest is removed at once, already where
the texts are read, so a passage that a third of all texts share sends one row a slice of input. Keys left with one
segment, none of whose windows repeat in it, are done.

*Suffix arrays.* For the remaining segments the bytes are fetched and, key by key in blocks of about BLOCK bytes, a
suffix array is built in two stages: suffixes smaller than their successors are sorted directly (eight bytes at a time,
only those still tied, to DEPTH bytes, which suffices for windows), then one scan over the buckets of the first byte, from
the least up, puts the suffix before each scanned one at the end of its bucket's front part, which yields the order of all
others. Windows with a common prefix of LENGTH bytes are then neighbours; the first place of each run stays.

*Bounded blocks.* A segment is at most a piece of a text (texts.PIECE). One of over WIDE windows, as a line repeated over
and over makes, is first judged against itself, and only the windows that are new in it travel on. A key with more than
MANY segments, or MANY_BYTES bytes of them, is split by a hash of the whole window, so that no block outgrows a task;
windows that are equal stay together.

Edge cases: null text is empty; texts under LENGTH bytes lose nothing; null ids come last; rows that repeat an id with
the same text are one text and get the same result, with another text they are told apart by ``texts.digest``, which
also deals out rows without an id; an empty table gives no rows; other columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessella.llm import texts
from tessella.llm.member import members_filter
from tessella.runtime import Scratch

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
DEPTH = 104
BLOCK, WIDE, MANY, MANY_BYTES = 1 << 18, 4096, 8192, 1 << 22
#: Bytes of texts that are read, and of segments that are cut, before rows are handed on.
SLICE = 1 << 22
NULL_ID = (1 << 63) - 1
_LONG_RUN = re.compile(rb"(.)\1{%d,}" % (4 * LENGTH), re.DOTALL)


def _sliding(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``span`` neighbours: out[i] of x[i : i + span]."""
    done, out = 1, x
    while done * 2 <= span:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (span - done)], out[span - done :]) if span > done else out


def _segments(piece: np.ndarray, bounds: np.ndarray):
    """Segments of the windows of a piece of bytes; bounds: offsets of the texts in it.

    Returns (first window, number of windows, key, 128-bit digest of the bytes as two columns, whether the key's substring
    is in it twice).
    """
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none.reshape(0, 2), none.astype(bool)
    if len(piece) < LENGTH:
        return nothing
    values = texts._tables()["values"]
    up, down = texts._powers(len(piece))
    prefix = texts._prefix(values[piece], up)
    grams = texts.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(piece) - GRAM + 1])
    least = _sliding(grams, SPAN, np.minimum)  # by window
    text = np.zeros(len(piece) + 1, np.int32)
    np.add.at(text, bounds[1:-1], 1)
    text = np.cumsum(text)[:-1]
    valid = text[: len(least)] == text[LENGTH - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return nothing
    stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    number = stop - first + 1
    key = least[first]
    end = stop + LENGTH
    body = piece.tobytes()
    whole = np.frombuffer(b"".join([hashlib.blake2b(body[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    # places of substrings that are the least of some window; those of a segment's key, counted
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), np.where(valid, least, 0), np.zeros(SPAN - 1, np.uint64)])
    anchors = np.flatnonzero(_sliding(padded, SPAN, np.maximum)[: len(grams)] == grams)
    lo, hi = np.searchsorted(anchors, first), np.searchsorted(anchors, stop + SPAN)
    n = hi - lo
    owner = np.repeat(np.arange(len(first)), n)
    member = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    twice = np.bincount(owner[grams[anchors[member]] == key[owner]], minlength=len(first)) > 1
    return first, number, key.view(np.int64), whole, twice


def _pieces(offsets: np.ndarray):
    """(from, to) byte ranges of about texts.PIECE that hold whole texts, or overlapping parts of a longer one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + texts.PIECE, "right")) - 1)
        start, end = int(offsets[i]), int(offsets[j])
        while end - start > texts.PIECE + LENGTH:  # one long text: windows that start before the cut
            yield i, j, start, start + texts.PIECE + LENGTH - 1
            start += texts.PIECE
        yield i, j, start, end
        i = j


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Intervals sorted by (doc, start), with those that touch or overlap joined. doc: any numbers."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    wide = int(end.max()) + 2
    top = np.maximum.accumulate(end + group * wide)
    new = np.concatenate([[True], start[1:] + group[1:] * wide > top[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


SCHEMA = "kind int, key long, w1 long, w2 long, doc long, mark long, pos long, num int, twice boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(cols, names=NAMES) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "salt": pa.int32(), "num": pa.int32(), "twice": pa.bool_(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds["body"]) if n == "body" else pa.array(c).cast(kinds.get(n, pa.int64())) for c, n in zip(cols, names, strict=True)], names)


def _removed(doc, mark, pos, num) -> pa.RecordBatch:
    z = np.zeros(len(doc), np.int64)
    return _batch([z, z, z, z, doc, mark, pos, num, z.astype(bool)])


def _read(batches):
    """Kind 1: first segments of each content in a slice of rows. Kind 0: ranges [pos, pos + num) already removed."""
    for b in texts.sub_batches(batches, limit=SLICE):
        raw, offsets = texts.text_bytes(b.column(1))
        ids = b.column(0).fill_null(NULL_ID).to_numpy()
        marks = np.array([texts.digest(raw[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        found = []
        for i, j, start, end in _pieces(offsets):
            bounds = np.clip(offsets[i : j + 1], start, end) - start
            first, *rest = _segments(raw[start:end], bounds)
            row = np.searchsorted(offsets[i : j + 1], first + start, "right") - 1 + i
            found.append((row, first + start - offsets[row], *rest))
        row, pos, number, key, whole, twice = (np.concatenate(x) for x in zip(*found, strict=True))
        o = np.lexsort((pos, marks[row], ids[row], whole[:, 1], whole[:, 0], key))
        row, pos, number, key, whole, twice = (x[o] for x in (row, pos, number, key, whole, twice))
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (whole[1:] == whole[:-1]).all(axis=1)])[: len(key)]
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else same.astype(np.int64)
        twin = same & (ids[row] == ids[row[lead]]) & (marks[row] == marks[row[lead]]) & (pos == pos[lead])  # a repeated row
        gone = same & ~twin
        r, s, e = _merged(row[gone], pos[gone], pos[gone] + number[gone] + LENGTH - 1)
        yield _removed(ids[r], marks[r], s, e - s)
        k = ~same
        yield _batch([np.ones(k.sum(), np.int64), key[k], whole[k, 0], whole[k, 1], ids[row[k]], marks[row[k]], pos[k], number[k], twice[k]])


def _judge(batches):
    """Kind 1 rows of ``_read`` sorted by (key, w1, w2, doc, mark, pos). Kind 0: removed ranges. Kind 1: segments whose
    windows must be compared: keys with several contents, or with windows that repeat in one. Kind 0 rows pass."""
    held = False  # whether the key of the last first-of-its-content has another
    last = None
    for b in batches:
        kind, *cols = (b.column(i).to_numpy(zero_copy_only=False) for i in range(9))
        if (kind == 0).any():
            yield b.filter(pa.array(kind == 0))
        cols = [x[kind == 1] for x in cols]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([x, c]) for x, c in zip(last, cols, strict=True)]
        key, w1, w2, doc, mark, pos, num, twice = cols
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        gone = same & ~((doc == doc[lead]) & (mark == mark[lead]) & (pos == pos[lead]))
        yield _removed(doc[gone], mark[gone], pos[gone], num[gone] + LENGTH - 1)
        firsts = np.flatnonzero(~same)
        k = key[firsts]
        beside = np.concatenate([[False], k[1:] == k[:-1]]) | np.concatenate([k[1:] == k[:-1], [False]])
        beside[0] |= held
        beside |= twice[firsts]
        out = firsts[:-1][beside[:-1]]  # the last first waits: its key may go on
        yield _batch([np.ones(len(out), np.int64), *(x[out] for x in cols)])
        held = bool(beside[-1])
        last = [x[firsts[-1] : firsts[-1] + 1] for x in cols]
    if held:
        yield _batch([np.ones(1, np.int64), *last])


CUT = "key long, salt int, doc long, mark long, pos long, num int, body binary"
CUT_NAMES = [x.split()[0] for x in CUT.split(", ")]


def _cut(batches):
    """Rows (doc, mark, text, segments of it) to the segments' bytes; segments of a crowded key by window hash. Rows
    without a body are ranges [pos, pos + num) that a segment repeats in itself."""
    out, size = [[] for _ in CUT_NAMES], 0
    for b in batches:
        for i in range(b.num_rows):
            doc, mark, text, segments = (b.column(c)[i].as_py() for c in range(4))
            raw = (text or "").encode()
            for s in segments:
                a, n = s["pos"], s["num"]
                body = raw[a : a + n + LENGTH - 1]
                runs = [(0, n)]
                if n > WIDE:
                    runs, again = _new_in(body, n)
                    for x, y in again:
                        for col, v in zip(out, (doc ^ x, 0, doc, mark, a + x, y - x + LENGTH - 1, None), strict=True):
                            col.append(v)
                for x, y in runs:
                    part = body[x : y + LENGTH - 1]
                    for salt, u, v in [(0, 0, y - x)] if s["salts"] <= 1 else _salted(part, y - x, s["salts"]):
                        for col, value in zip(out, (s["key"], salt, doc, mark, a + x + u, v - u, part[u : v + LENGTH - 1]), strict=True):
                            col.append(value)
                        size += v - u + 2 * LENGTH
                if size > SLICE:
                    yield _batch(out, CUT_NAMES)
                    out, size = [[] for _ in CUT_NAMES], 0
    if out[0]:
        yield _batch(out, CUT_NAMES)


def _new_in(body: bytes, n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of a body's n windows that are new in it, and runs of those that are not."""
    again = np.zeros(n, bool)
    again[repeated_windows([body])[0]] = True
    at = np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1], [True]])).tolist()
    runs = list(zip(at, at[1:], strict=False))
    return [r for r in runs if not again[r[0]]], [r for r in runs if again[r[0]]]


def _salted(body: bytes, n: int, salts: int) -> list[tuple[int, int, int]]:
    """Runs (salt, from, to) of windows by a hash of all their bytes."""
    raw = np.frombuffer(body, np.uint8)
    up, down = texts._powers(len(raw))
    prefix = texts._prefix(texts._tables()["values"][raw], up)
    salt = (texts.mix((prefix[LENGTH:] - prefix[:-LENGTH]) * down[:n]) % np.uint64(salts)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], salt[1:] != salt[:-1]]))
    return [(int(salt[x]), int(x), int(y)) for x, y in zip(at, [*at[1:], n], strict=True)]


def _by_bytes(raw: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The places ``at`` in the order of the DEPTH bytes from each on, those beyond its room as 0.

    Eight bytes at a time, and only among places still tied: a few numbers a place, whatever ties.
    """
    if not len(at):
        return at
    eight = np.ndarray(len(raw) + 1, ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    at, room = at.copy(), room.copy()
    live, group = np.arange(len(at)), np.zeros(len(at), np.int32)  # sorted places in groups of more than one, and their group
    for k in range(0, DEPTH, 8):
        left = np.clip(room[live] - k, 0, 8).astype(np.uint64)
        word = eight[np.minimum(at[live] + k, len(raw))].astype(np.uint64)
        word = np.where(left > 0, word >> (np.uint64(64) - np.uint64(8) * left) << (np.uint64(64) - np.uint64(8) * left), 0)
        mixed = np.zeros(len(live) + 1, bool)  # groups that are not in order
        mixed[group[1:][(group[1:] == group[:-1]) & (word[1:] < word[:-1])]] = True
        if (some := np.flatnonzero(mixed[group])).size:
            o = some[np.lexsort((word[some], group[some]))]
            at[live[some]], room[live[some]], word[some] = at[live[o]], room[live[o]], word[o]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        group = np.cumsum(new, dtype=np.int32) - 1
        tied = np.bincount(group, minlength=1)[group] > 1
        live, group = live[tied], group[tied]
        if not len(live):
            break
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]), dtype=np.int32)
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted positions in the order of their suffixes, by at least DEPTH bytes.

    text: bytes + 1 as int16, 0 after each segment and at the end. wanted: boolean, never at a 0.
    """
    n = len(text)
    rise = np.sign(np.diff(text, append=np.int16(0))).astype(np.int8)
    place = np.arange(n, dtype=np.int32)
    nxt = np.minimum.accumulate(np.where(rise != 0, place, np.int32(n))[::-1])[::-1]
    small = rise[np.minimum(nxt, n - 1)] > 0  # smaller than its successor
    small |= text == 0  # ends of segments are the least of all and need no sorting among themselves
    stop = np.minimum.accumulate(np.where(small, place, np.int32(n))[::-1])[::-1]  # the next small suffix
    mark = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(stop[at], n - 1) + 1, -1)
    needed = np.cumsum(mark[:n]) > 0
    # stage one: sort the small suffixes
    direct = np.flatnonzero(needed & small & (text != 0))
    ends = np.flatnonzero(text == 0)
    direct = _by_bytes(np.maximum(text - 1, 0).astype(np.uint8), direct, ends[np.searchsorted(ends, direct)] - direct)
    # stage two: buckets from the least byte up; each scanned suffix puts its predecessor in its bucket's front part
    backs = np.searchsorted(text[direct], np.arange(258))
    fronts: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    large = needed & ~small
    for c in range(257):
        queue = [ends] if c == 0 else fronts[c]
        i = 0
        while i < len(queue) + 1:
            scanned = queue[i] if i < len(queue) else direct[backs[c] : backs[c + 1]]
            if c and len(scanned):
                order.append(scanned)
            before = scanned[scanned > 0] - 1
            before = before[large[before]]
            if len(before):
                chars = text[before]
                o = np.argsort(chars, kind="stable")
                before, chars = before[o], chars[o]
                cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
                for x, y in zip(cuts, [*cuts[1:], len(chars)], strict=True):
                    fronts[chars[x]].append(before[x:y])
            i += 1
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated_windows(bodies: list[bytes]) -> list[np.ndarray]:
    """For each body, its windows (positions) that also start earlier: in an earlier body, or further left.

    Of a long run of one byte only the ends are sorted: the windows between repeat the one before them.
    """
    parts, gone = [], []  # (body, from, bytes)
    for i, body in enumerate(bodies):
        start, mine = 0, np.zeros(len(body), bool)
        for m in _LONG_RUN.finditer(body):
            parts.append((i, start, body[start : m.start() + 2 * LENGTH]))
            mine[m.start() + LENGTH + 1 : m.end() - 2 * LENGTH] = True
            start = m.end() - 2 * LENGTH
        parts.append((i, start, body[start:]))
        gone.append(mine)
    for (i, start, _), found in zip(parts, _repeated([p[2] for p in parts]), strict=True):
        gone[i][start + found] = True
    return [np.flatnonzero(x) for x in gone]


def _repeated(bodies: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in bodies])
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
    text = raw.astype(np.int16) + 1
    text[start[1:] - 1] = 0
    wanted = np.zeros(len(text), bool)
    for a, n in zip(start[:-1], sizes, strict=True):
        wanted[a : a + max(n - LENGTH + 1, 0)] = True
    order = suffix_order(text, wanted)
    words = np.ndarray(len(raw), np.uint64, np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    equal = np.ones(max(len(order) - 1, 0), bool)  # common prefix of neighbours, eight bytes at a time
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        live = np.flatnonzero(equal)
        equal[live] = words[order[live] + k] == words[order[live + 1] + k]
    gone = np.zeros(len(text), bool)
    if len(order):
        runs = np.flatnonzero(np.concatenate([[True], ~equal]))
        gone[order] = True
        gone[np.minimum.reduceat(order, runs)] = False
    return [np.flatnonzero(gone[a : a + n]) for a, n in zip(start[:-1], sizes, strict=True)]


def _suffixes(batches):
    """Rows (key, salt, doc, mark, pos, num, body) sorted so: the ranges to remove."""

    def solve(rows):
        doc, start, end = [], [], []
        for i, (r, w) in enumerate(zip(rows, repeated_windows([r[6] for r in rows]), strict=True)):
            if len(w):
                doc.append(np.full(len(w), i))
                start.append(w + r[4])
                end.append(w + r[4] + LENGTH)
        if not doc:
            return
        d, s, e = _merged(np.concatenate(doc), np.concatenate(start), np.concatenate(end))
        yield _removed(np.array([r[2] for r in rows])[d], np.array([r[3] for r in rows])[d], s, e - s)

    rows, held, run, before = [], 0, None, None
    for b in batches:
        whole = b.column(6).is_valid().to_numpy(zero_copy_only=False)
        if not whole.all():
            yield _removed(*(b.column(c).to_numpy()[~whole] for c in (2, 3, 4, 5)))
        for i in np.flatnonzero(whole).tolist():
            r = tuple(b.column(c)[i].as_py() for c in range(7))
            if r[:5] == before:  # a repeated row
                continue
            before = r[:5]
            if r[:2] != run:
                if held > BLOCK:
                    yield from solve(rows)
                    rows, held = [], 0
                run = r[:2]
            rows.append(r)
            held += len(r[6])
    if rows:
        yield from solve(rows)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc, mark, pos, num): byte ranges to remove, in parts that may overlap; doc and mark as ``_marked`` has them."""
    scratch = scratch or Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = plain.mapInArrow(texts.trimmed(_read), SCHEMA)
    # removed ranges need no company, so they are spread
    dealt = read.repartition(F.when(F.col("kind") == 1, F.col("key")).otherwise(F.xxhash64("doc", "mark", "pos"))).sortWithinPartitions("kind", "key", "w1", "w2", "doc", "mark", "pos")
    judged = scratch.keep(dealt.mapInArrow(texts.trimmed(_judge), SCHEMA))
    open_ = judged.filter("kind = 1").select("key", "doc", "mark", "pos", "num")
    size = F.greatest(F.count("*") / F.lit(float(MANY)), F.sum(F.col("num").cast("long") + LENGTH) / F.lit(float(MANY_BYTES)))
    crowded = open_.groupBy("key").agg(size.alias("n")).filter("n > 1").select("key", F.expr("cast(least(ceil(n * 16), 2000000000) as int)").alias("salts"))
    crowded = scratch.keep(crowded)  # so that the join is of plain shuffles, which Spark splits where a key is hot
    wanted = open_.join(crowded, "key", "left").groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "pos", "num", F.coalesce("salts", F.lit(1)).alias("salts"))).alias("segments"))
    wanted = scratch.keep(wanted)  # a text's segments are about its own size at most
    marked = _marked(plain, "id", "text", wanted, "doc", "mark", True)
    fetched = marked.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "segments")
    cut = fetched.mapInArrow(texts.trimmed(_cut), CUT)
    more = scratch.keep(cut.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "mark", "pos").mapInArrow(texts.trimmed(_suffixes), SCHEMA))
    scratch.drop(wanted, crowded)
    return judged.filter("kind = 0").unionByName(more).select("doc", "mark", "pos", "num")


def _marked(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, doc: str, mark: str, inside: bool) -> DataFrame:
    """Rows of docs whose id may be in ids' ``doc`` (or, not inside, is not), with doc: the id, NULL_ID for null, and
    mark: the text's digest (0 where the row is not inside)."""
    distinct = ids.select("doc").distinct()
    admits = members_filter(distinct, distinct.count())
    i, j = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = S.StructType([*docs.schema.fields, S.StructField(doc, S.LongType()), S.StructField(mark, S.LongType())])

    def keep(batches):
        for b in texts.sub_batches(batches, text_col):
            ids = b.column(i).cast(pa.int64()).fill_null(NULL_ID)
            hit = admits(ids.to_numpy())
            take = pa.array(hit if inside else ~hit)
            b, ids = b.filter(take), ids.filter(take)
            raw, at = texts.text_bytes(b.column(j)) if inside else (b"", [0])
            marks = [texts.digest(raw[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)] if inside else [0] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(marks, pa.int64())], schema.names)

    return docs.mapInArrow(texts.trimmed(keep), schema)


def _left(raw: bytes, ranges) -> tuple[bytes, int]:
    """What the ranges (pos, num) leave of a text, and the number of maximal ones."""
    if not ranges:
        return raw, 0
    mine = np.array([(r["pos"], r["pos"] + r["num"]) for r in ranges], np.int64)
    left, at = [], 0
    _, starts, ends = _merged(np.zeros(len(mine), np.int64), mine[:, 0], mine[:, 1])
    for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
        left.append(raw[at:x])
        at = y
    return b"".join([*left, raw[at:]]), len(starts)


def _met(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch):
    """(rows of docs that may lose something, with their ranges as last column; the other rows), both with all columns of
    docs first. Only texts that lose something are shuffled to meet their ranges."""
    found = repeats(docs, id_col, text_col, scratch).groupBy("doc", "mark").agg(F.collect_list(F.struct("pos", "num")).alias("ranges"))
    found = scratch.keep(found)
    doc, mark, ranges = texts.fresh(docs.columns, "doc", "mark", "ranges")
    hit = _marked(docs, id_col, text_col, found, doc, mark, True)
    met = hit.join(found.toDF(doc, mark, ranges), [doc, mark], "left").select(*[F.col(f"`{c}`") for c in [*docs.columns, ranges]])
    return met, _marked(docs, id_col, text_col, found, doc, mark, False).drop(doc, mark)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) of every row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    met, rest = _met(plain, "id", "text", Scratch(docs.sparkSession))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * texts_out
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + texts_out]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + texts_out]

    def finish(batches):
        for b in texts.sub_batches(batches):
            out = [[] for _ in names]
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode()
                left, spans = _left(raw, b.column(2)[i].as_py() if b.num_columns > 2 else None)
                for col, v in zip(out, (doc, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left), strict=False):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    done = met.mapInArrow(texts.trimmed(finish), schema).unionByName(rest.mapInArrow(texts.trimmed(finish), schema))
    return done.withColumnRenamed("id", id_col)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same rows and columns, with the removed bytes gone from the texts; a character cut in two goes whole."""
    met, rest = _met(docs, id_col, text_col, Scratch(docs.sparkSession))
    j, names = docs.columns.index(text_col), docs.columns

    def strip(batches):
        for b in texts.sub_batches(batches, text_col):
            values = b.column(j).to_pylist()
            for i in np.flatnonzero(b.column(b.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)).tolist():
                values[i] = _left((values[i] or "").encode(), b.column(b.num_columns - 1)[i].as_py())[0].decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(values, b.column(c).type) if c == j else b.column(c) for c in range(len(names))], names)

    return met.mapInArrow(texts.trimmed(strip), docs.schema).unionByName(rest)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the bytes they lose to earlier occurrences of 100-byte strings."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
