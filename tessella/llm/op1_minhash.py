"""MinHash near-duplicates with tensored banding, every link confirmed on the full shingle sets.

A text's set is its distinct 5-word shingles (A-Z folded), each as a 64-bit hash; fewer words make one shingle of all of
them; no word, no shingle and no link. Texts are linked when 100 * intersection >= 75 * union, and a component is what
links reach.

*Tensored banding.* Two collections of HALVES half-keys of WIDTH min-hashes each are computed, 2 * HALVES * WIDTH
min-hashes in all; every pair of a left and a right half-key forms a table key, so HALVES ** 2 tables of 2 * WIDTH
hashes come from about the square root of the min-hashes that independent tables would need. A pair of similarity 0.75
meets in some table with probability (1 - (1 - 0.75 ** WIDTH) ** HALVES) ** 2: 0.9999 with the defaults.

*Work.* Equal sets are collapsed first (one class, one representative, a number of its own). Table keys are dealt out by
ranges of (key, class), so a bucket of any size is split. In a bucket each member is first paired with the bucket's
busiest member only, which joins a group of n copies in n checks. Buckets that then still hold more than one component
send the members outside their main one round their blocks, to meet all members of other components; pairs that set sizes
or a bit array of the set (BITS a shingle) prove too different are left out, no pair that could be a link. A pair that
meets in several buckets is named once, in that of its first common half-keys. Confirmation streams over (hub, block) runs
and holds one hub's set and one member's set at a time. Links, components and sets stay distributed.

*Hashes.* Shingles are compared by 64-bit hashes (``texts.word_hashes``): a link is wrong only where hashes of unlike
shingles meet within one pair of texts, one in 2 ** 64 for each pair of shingles.

Edge cases: null text has an empty set; rows without an id are kept, judged and linked like any other (their component is
the smallest id linked, null if there is none); rows that repeat an id are judged text by text; an empty table gives no
rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessella.llm import texts
from tessella.llm.components import components
from tessella.llm.member import members_filter
from tessella.runtime import Scratch

SHINGLE = 5
HALVES, WIDTH = 12, 2
LEAST, OF = 75, 100
#: Bits a shingle of a set's bit array; pairs of a hub that are confirmed in one run; bytes of the bit arrays of a block of
#: members, when buckets are paired up.
BITS, BLOCK, BLOCK_BYTES = 8, 256, 1 << 20
#: Tasks over which the pairs of a hub of more than BLOCK are spread while they are counted.
SPREAD = 64
_C = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's offset into them."""
    h, at = texts.word_hashes(raw, offsets)
    n = np.diff(at)
    sets, sizes = [], np.zeros(len(n), np.int64)
    m = max(len(h) - k + 1, 0)
    grams = np.zeros(m, np.uint64)
    for j in range(k):
        grams += h[j : j + m] * np.uint64(_C[j % len(_C)] + 2 * (j // len(_C)))
    grams = texts.mix(grams)
    for i in range(len(n)):
        if n[i] >= k:
            s = np.unique(grams[at[i] : at[i + 1] - k + 1])
        elif n[i]:
            w = h[at[i] : at[i + 1]]
            s = np.array([len(w)], np.uint64)
            for v in w:
                s = texts.mix(s * np.uint64(_C[1]) + v)
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _multipliers(halves: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(75))
    n = 2 * halves * width
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def half_keys(sets: np.ndarray, at: np.ndarray, halves: int = HALVES, width: int = WIDTH) -> np.ndarray:
    """(texts, 2 * halves) half-keys: first the left collection, then the right one."""
    mul, add = _multipliers(halves, width)
    low = np.full((len(at) - 1, len(mul)), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(np.diff(at))
    step = 1 << 16
    for start in range(0, len(sets), step):  # bounded memory, whole sets
        piece = sets[start : start + step]
        a, b = np.searchsorted(at[full], start, "right") - 1, np.searchsorted(at[full], start + len(piece), "left")
        rows = full[a:b]
        cuts = np.maximum(at[rows] - start, 0)
        for j in range(len(mul)):
            m = np.minimum.reduceat((piece ^ add[j]) * mul[j], cuts)
            low[rows, j] = np.minimum(low[rows, j], m)
    keys = np.zeros((len(low), 2 * halves), np.uint64)
    for w in range(width):
        keys = texts.mix(keys * np.uint64(_C[2]) + low[:, w::width])
    return keys


def _bit_array(s: np.ndarray) -> bytes:
    """A set's shingles by their low bits, in a power of two of at least BITS a shingle."""
    size = 1 << max(6, (BITS * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _marks(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 2) whole numbers that stand for each set, zeros for an empty one."""
    both = np.zeros((len(at) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        both[full, 0] = np.add.reduceat(texts.mix(sets ^ np.uint64(_C[0])), at[full])
        both[full, 1] = np.add.reduceat(texts.mix(sets ^ np.uint64(_C[3])), at[full])
        both[full, 1] = texts.mix(both[full, 0] * np.uint64(_C[4]) + both[full, 1])
    return both.view(np.int64)


def _slim(batches):
    """id, n, fingerprint, half-keys and sketch of every text."""
    for b in texts.sub_batches(batches):
        raw, offsets = texts.text_bytes(b.column(1))
        sets, at = shingle_sets(raw, offsets)
        marks = _marks(sets, at)
        cells = [_bit_array(sets[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(at)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([k.tobytes() for k in half_keys(sets, at)], pa.binary()), pa.array(cells, pa.binary())],
            ["id", "n", "f1", "f2", "keys", "cells"])


def _table(left: np.ndarray, right: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Keys of tables from their two half-keys; tag: HALVES * the left one's place + the right one's."""
    return texts.mix(left * np.uint64(_C[0]) + right * np.uint64(_C[1]) + tag * np.uint64(_C[3]))


def _table_keys(batches):
    """(key, doc) for every pair of half-keys of a class."""
    for b in batches:
        for start in range(0, b.num_rows, 1024):
            part = b.slice(start, 1024)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, 2 * HALVES)
            tag = np.arange(HALVES * HALVES, dtype=np.uint64).reshape(1, HALVES, HALVES)
            table = _table(keys[:, :HALVES, None], keys[:, None, HALVES:], tag)
            yield pa.RecordBatch.from_arrays([pa.array(table.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), HALVES * HALVES))], ["key", "doc"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    lo, hi = (a, b) if len(a) <= len(b) else (b, a)
    if OF * len(lo) < LEAST * len(hi):
        return False
    at = np.searchsorted(hi, lo)
    at[at == len(hi)] = 0
    both = int(np.count_nonzero(hi[at] == lo))
    return OF * both >= LEAST * (len(a) + len(b) - both)


def _confirm(batches):
    """Rows (hub, block, doc, set) sorted by hub, block, hub's own row first: the links (doc, hub)."""
    run, hub = None, None
    for batch in batches:
        hubs, blocks, docs, own = (batch.column(i).to_numpy() for i in range(4))
        sets, out = batch.column(4), ([], [])
        for i in range(batch.num_rows):
            s = np.frombuffer(sets[i].as_buffer(), np.uint64)
            if (hubs[i], blocks[i]) != run:
                run, hub = (hubs[i], blocks[i]), s.copy()
            elif own[i] and _linked(s, hub):
                out[0].append(docs[i])
                out[1].append(hubs[i])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (doc, hub). sets: doc, set (sorted hashes as bytes), each doc once.

    A hub's pairs are dealt in blocks, so a hub of any number of pairs spreads, and its set travels once a block. Hubs of
    more than BLOCK pairs meet them in SPREAD parts; there are at most as many of these rows as pairs * SPREAD / BLOCK.
    """
    busy = pairs.groupBy("hub").agg(F.count("*").alias("n_pairs")).filter(F.col("n_pairs") > BLOCK)
    busy = busy.select("hub", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), F.expr(f"cast(ceil(n_pairs / {BLOCK}.0) as bigint)").alias("blocks"))
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(SPREAD)).cast("int")).join(busy, ["hub", "part"], "left")
    dealt = parted.withColumn("block", F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1))))
    members = dealt.select("hub", "block", "doc", F.lit(1).alias("own"))
    hubs = dealt.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("doc"), F.lit(0).alias("own"))
    rows = members.unionByName(hubs).join(sets, "doc").select("hub", "block", "doc", "own", "set")
    return rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "own").mapInArrow(_confirm, "a long, b long")


def _shared(batches):
    """Rows (key, doc) in order: those whose key another row has too, or may have in another partition (that of its first
    and last key), with ``size``, the rows of the key in the batch."""
    held = None  # (key, doc) of the last row, and whether it is kept
    for b in batches:
        key, doc = (b.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        first = held is None
        if not first:
            key, doc = np.concatenate([held[0], key]), np.concatenate([held[1], doc])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        keep = ~new | np.concatenate([~new[1:], [False]])
        keep[0] |= first or held[2]
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        held = key[-1:], doc[-1:], bool(keep[-1])  # the last row waits for its successor
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, doc, size)], ["key", "doc", "size"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(np.ones(1, np.int64))], ["key", "doc", "size"])


def _folded(bits: bytes, words: int) -> np.ndarray:
    """A bit array as so many words, halves laid over each other where it is longer."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


class _Members:
    """Members of a block of a bucket, about BLOCK_BYTES of bit arrays, met by one probe at a time."""

    def __init__(self, rows):
        self.doc, self.n, self.comp = (np.array(c) for c in zip(*[r[:3] for r in rows], strict=True))
        self.bits = [r[3] for r in rows]
        self.halves = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), 2 * HALVES)
        self.size = np.array([len(x) // 8 for x in self.bits])
        self.folded = {}

    def words(self, size: int, to: int) -> np.ndarray:
        """Bit arrays of the members of a size, folded to so many words."""
        if (size, to) not in self.folded:
            self.folded[size, to] = np.stack([_folded(self.bits[m], to) for m in np.flatnonzero(self.size == size)])
        return self.folded[size, to]

    def partners(self, doc: int, n: int, comp: int, bits: bytes, halves: bytes, main: int, stands: np.ndarray) -> np.ndarray:
        """Members of other components that neither set sizes nor bit arrays prove unlinked to the probe.

        Two members may meet in many buckets: only the one of their first common left and right half-keys names the pair, if
        it is among those that this bucket stands for (``stands``). Of two probes the smaller names it.
        """
        out, own = [], len(bits) // 8
        ok = (self.comp != comp) & ((self.comp == main) | (self.doc > doc)) & (OF * np.minimum(n, self.n) >= LEAST * np.maximum(n, self.n))
        some = np.flatnonzero(ok)
        mine = np.frombuffer(halves, np.uint64)
        equal = self.halves[some] == mine
        i, j = equal[:, :HALVES].argmax(axis=1), equal[:, HALVES:].argmax(axis=1)
        ok[some] = np.isin(_table(mine[i], mine[HALVES + j], (HALVES * i + j).astype(np.uint64)), stands)
        for size in np.unique(self.size[ok]).tolist():
            members = np.flatnonzero(self.size == size)
            some = ok[members]
            to = min(own, size)
            mine, theirs, at = _folded(bits, to), self.words(size, to)[some], members[some]
            both = np.minimum(n - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), self.n[at] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            out.append(self.doc[at[OF * both >= LEAST * (n + self.n[at] - both)]])  # the intersection is no larger
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _probed(batches):
    """Rows (key, block, kind, doc, n, component, cells, keys, stands) sorted by the first three: the bucket's main component
    and the keys it stands for (kind 0), a block's members (1) and then the probes that meet them (2), to pairs (smaller doc,
    larger doc) that must be confirmed, each once."""
    run, rows, members = None, [], None
    for batch in batches:
        out = []
        for key, block, kind, *row, held in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if (key, block) != run:
                run, rows, members = (key, block), [], None
            if kind == 0:
                main, stands = row[2], np.array(held, np.int64).view(np.uint64)
                continue
            if kind == 1:
                rows.append(row)
                continue
            if members is None:
                if not rows:
                    continue
                members, rows = _Members(rows), []
            if len(found := members.partners(*row, main, stands)):
                out.append(np.stack([np.minimum(found, row[0]), np.maximum(found, row[0])]))
        if out:
            got = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["doc", "hub"])


def _sets(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, set) of the classes in ``wanted`` (doc, id, f1, f2, n), each once, from any text that has the set.

    Sets are made only for texts whose id may be that of a wanted class, or that have no id and may be in one without.
    """
    named, nameless = wanted.filter("id IS NOT NULL").select("id"), wanted.filter("id IS NULL").select("f1")
    admits, by_mark = members_filter(named, named.count()), members_filter(nameless, nameless.count())

    def run(batches):
        for b in texts.sub_batches(batches):
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(null | admits(b.column(0).fill_null(0).to_numpy())))
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            sets, at = shingle_sets(*texts.text_bytes(b.column(1)))
            n, marks = np.diff(at), _marks(sets, at)
            _, once = np.unique(marks, axis=0, return_index=True)  # copies in the batch count once
            once = once[(n[once] > 0) & (~null[once] | by_mark(np.ascontiguousarray(marks[once, 0])))]
            yield pa.RecordBatch.from_arrays([pa.array(marks[once, 0]), pa.array(marks[once, 1]), pa.array(n[once]), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in once], pa.binary())], ["f1", "f2", "n", "set"])

    made = plain.mapInArrow(texts.trimmed(run), "f1 long, f2 long, n long, set binary")
    return made.join(wanted.select("doc", "f1", "f2", "n"), ["f1", "f2", "n"]).select("doc", "set").dropDuplicates(["doc"])


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, component) of every row of docs; component: the smallest id linked."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slim = scratch.keep(plain.mapInArrow(texts.trimmed(_slim), "id long, n long, f1 long, f2 long, keys binary, cells binary"))
    grouped = slim.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("cells").alias("cells"))
    classes = scratch.keep(grouped.withColumn("doc", F.monotonically_increasing_id()))  # numbers are fixed by writing them

    tables = classes.select("doc", "keys").mapInArrow(_table_keys, "key long, doc long")
    shared = scratch.keep(tables.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc").mapInArrow(texts.trimmed(_shared), "key long, doc long, size long"))

    # a first link of every member to its bucket's busiest one
    weight = shared.groupBy("doc").agg(F.sum("size").alias("w"))
    hubs = shared.join(weight, "doc").groupBy("key").agg(F.max(F.struct("w", (-F.col("doc")).alias("d"))).alias("m"), F.count("*").alias("n")).filter("n > 1")
    hubs = scratch.keep(hubs.select("key", (-F.col("m.d")).alias("hub")))
    stars = scratch.keep(shared.join(hubs, "key").filter("doc <> hub").select("doc", "hub").distinct())
    involved = stars.select("doc").unionByName(stars.select(F.col("hub").alias("doc"))).distinct()
    wanted = scratch.keep(classes.select("doc", "id", "f1", "f2", "n").join(involved, "doc", "left_semi"))
    sets = scratch.keep(_sets(plain, wanted))
    links = scratch.keep(confirmed(stars, sets))
    found = components(links, scratch)

    # buckets that still hold several components
    sized = classes.select("doc", (F.col("n") * 2 * BITS / 8 + 64 + 16 * HALVES).cast("long").alias("bytes"))  # of a bit array and half-keys, at most
    placed = shared.join(found, "doc", "left").join(sized, "doc").select("key", "doc", F.coalesce("component", "doc").alias("component"), "bytes")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("s"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts"), F.sum("c").alias("size"), F.sum("b").alias("bytes"), F.sum("s").alias("sum")).filter("parts > 1")
    # buckets of the same members count once, and stand for the keys of all: HALVES ** 2 at most, as a member has no more
    once = mixed.groupBy("size", "bytes", "sum").agg(F.min(F.struct("key", F.col("m.component").alias("main"))).alias("k"), F.collect_list("key").alias("stands"))
    once = once.select("k.key", "k.main", F.expr(f"cast(ceil(bytes / {BLOCK_BYTES}.0) as int)").alias("blocks"), "stands")
    once = scratch.keep(once.withColumn("block", F.expr("explode(sequence(0, blocks - 1))")))
    members = placed.join(once.filter("block = 0").select("key", "main", "blocks"), "key")
    home = members.select("key", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "doc", "component")
    # two members of different components are not both in the bucket's main one: the others go round its blocks
    probes = members.filter("component <> main").select("key", F.expr("explode(sequence(0, blocks - 1))").alias("block"), F.lit(2).alias("kind"), "doc", "component")
    met = home.unionByName(probes).join(classes.select("doc", "n", "cells", "keys"), "doc").select("key", "block", "kind", "doc", "n", "component", "cells", "keys")
    heads = once.select("key", "block", F.lit(0).alias("kind"), F.col("main").alias("component"), "stands")
    met = heads.unionByName(met, allowMissingColumns=True).select("key", "block", "kind", "doc", "n", "component", "cells", "keys", "stands")
    crossed = met.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(texts.trimmed(_probed), "doc long, hub long")
    crossed = scratch.keep(crossed.join(stars.select(F.least("doc", "hub").alias("doc"), F.greatest("doc", "hub").alias("hub")), ["doc", "hub"], "left_anti"))
    if not crossed.isEmpty():
        more = scratch.keep(confirmed(crossed, sets))
        if not more.isEmpty():
            before, found = found, components(found.select(F.col("doc").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)
            scratch.drop(before)
        scratch.drop(more)
    scratch.drop(shared, hubs, stars, wanted, sets, links, once, crossed)

    least = scratch.keep(found.join(classes.select("doc", "id"), "doc").groupBy("component").agg(F.min("id").alias("least")))
    named = found.join(least, "component").select("doc", "least")
    reached = classes.select("f1", "f2", "n", "doc", "id").join(named, "doc", "left").select("f1", "f2", "n", F.coalesce("least", "id").alias("component"))
    out = slim.select("id", "n", "f1", "f2").join(reached, ["f1", "f2", "n"], "left")
    return out.select("id", "n", "f1", "f2", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept (id = component_id) of every row of docs."""
    out = _judged(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that a smaller id stands for. Rows without an id stay.

    Only rows whose id may be among the dropped ones are shuffled to meet them, by id and set.
    """
    scratch = Scratch(docs.sparkSession)
    names = texts.fresh(docs.columns, "id", "f1", "f2")
    gone = scratch.keep(_judged(docs, id_col, text_col).filter("id IS NOT NULL AND NOT id <=> component").select("id", "f1", "f2").distinct().toDF(*names))
    ids = gone.select(names[0]).distinct()
    admits = members_filter(ids, ids.count())
    i, j = docs.columns.index(id_col), docs.columns.index(text_col)
    marked = S.StructType([*docs.schema.fields, *(S.StructField(x, S.LongType()) for x in names)])

    def where(inside: bool):
        def keep(batches):
            for b in texts.sub_batches(batches, text_col):
                ids = b.column(i).cast(pa.int64())
                hit = pa.array((admits(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)) == inside)
                b = b.filter(hit)
                if inside:
                    marks = _marks(*shingle_sets(*texts.text_bytes(b.column(j))))
                    b = pa.RecordBatch.from_arrays([*b.columns, ids.filter(hit), pa.array(marks[:, 0]), pa.array(marks[:, 1])], marked.names)
                yield b

        return texts.trimmed(keep)

    hit = docs.mapInArrow(where(True), marked).join(gone, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return hit.unionByName(docs.mapInArrow(where(False), docs.schema))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the size of their set, their component and whether they stay."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows in DuckDB SQL: every pair that shares a shingle is compared, and components are reached link by link."""
    five = " || ' ' || ".join(f"ws[i + {j}]" for j in range(SHINGLE))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= {SHINGLE} THEN list_distinct([{five} FOR i IN range(1, len(ws) - {SHINGLE - 2})]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {OF} * c >= {LEAST} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM n WHERE doc_id NOT IN (SELECT b FROM l) UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(m) AS m FROM r GROUP BY d)
SELECT doc_id, n::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM n JOIN c ON d = doc_id"""
