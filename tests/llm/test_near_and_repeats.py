import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import components, op1_minhash, op10_suffixes, texts
from tessella.runtime import Scratch


def family(seed, words=160, copies=30, edits=12):
    """Near copies of one text at similarities around the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        x = list(base)
        for _ in range(r.randrange(edits)):
            x[r.randrange(len(x))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def test_near_duplicates(spark, table, docs, odd):
    rows = [*docs[:120], *odd] + [(1000 + i, t) for s in range(4) for i, t in enumerate(family(s), 100 * s)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1].upper().lower())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op1_minhash.near_duplicates(table(rows)).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute.near(rows).items()}
    assert got == want


def test_near_duplicates_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(op1_minhash, "BLOCK", 4)
    monkeypatch.setattr(op1_minhash, "BLOCK_BYTES", 2000)
    rows = [(i, t) for i, t in enumerate(family(9, copies=60, edits=20))]
    got = {r["doc_id"]: r["component_id"] for r in op1_minhash.near_duplicates(table(rows)).collect()}
    assert got == {d: c for d, (_, c) in brute.near(rows).items()}


def test_near_duplicates_odd_tables(spark, table):
    assert op1_minhash.near_duplicates(table([])).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in op1_minhash.near_duplicates(table([(5, text), (5, text), (3, text), (None, "other words in a row here")])).collect())
    assert got == [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 3, False), (True, None, None, True)]
    near, apart = text + " w99", "quite another text of just seven words"
    got = op1_minhash.near_duplicates(table([(5, text), (5, apart), (None, near), (None, "no one else has it at all"), (9, text + " w98 w97")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 3, 0, True), (0, 27, 5, False), (5, 3, 5, True), (5, 26, 5, True), (9, 28, 5, False)]
    kept = op1_minhash.without_near_duplicates(table([(3, text), (5, near), (5, apart), (None, near)])).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept) == [(0, near), (3, text), (5, apart)]
    kept = op1_minhash.without_near_duplicates(table([(5, text), (3, text), (None, text), (7, "x")])).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 3, 7] and kept[0]["size"] == "z"


def test_near_duplicates_of_few_words(spark, table):
    """Batches of one text, of fewer words than a shingle and around it."""
    text = "one two three four five six"
    for n in range(7):
        some = " ".join(text.split()[:n])
        sets, at = op1_minhash.shingle_sets(np.frombuffer(some.encode(), np.uint8), np.array([0, len(some)]))
        assert at.tolist() == [0, len(sets)] and len(sets) == len(brute.shingles(some))
    got = op1_minhash.near_duplicates(table([(3, "one two three")], 1)).collect()
    assert [tuple(r) for r in got] == [(3, 1, 3, True)]


def test_banding_meets_its_recall():
    """Pairs at the threshold meet in some table about as often as the formula says."""
    r, met = np.random.default_rng(3), 0
    for _ in range(300):
        common, a, b = (np.sort(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (180, 30, 30))
        x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
        k = op1_minhash.half_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        same = k[0] == k[1]
        met += same[: op1_minhash.HALVES].any() and same[op1_minhash.HALVES :].any()
    assert met >= 295


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 180)] + [(r.randrange(60), r.randrange(60)) for _ in range(50)] + [(500, x) for x in range(501, 700)]
    got = {x["doc"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    top = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {x: c for x, c in top.items() if any(x in p and p[0] != p[1] for p in links)}


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: "b", 98: "a"})
    return s


def test_unlike_texts_of_one_polynomial_hash(spark, table):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2 ** 64; they are unlike texts."""
    a = thue_morse(2048)
    b = a.translate({97: "b", 98: "a"})
    rows = [(1, a[:1024]), (2, b[:1024]), (3, a[:40]), (4, b[:40]), (5, f"x {a} y z w"), (6, f"x {b} y z w")]
    got = {r["doc_id"]: r["component_id"] for r in op1_minhash.near_duplicates(table(rows)).collect()}
    assert got == {d: d for d, _ in rows}
    want = brute.repeats(rows)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in op10_suffixes.without_repeats(table(rows)).collect()}
    assert got == {d: (x[1], brute.sha(x[3])) for d, x in want.items()}


def passages(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (99, 100, 101, 160, 400)]
    rows = [(i, word(r.randrange(200)) + r.choice(shared) + word(r.randrange(200)) + r.choice(shared)) for i in range(60)]
    rows += [(60, "a" * 500), (61, "ab" * 300), (62, shared[4][:250] + "zz" + shared[4][150:]), (63, shared[3]), (64, "line of text!\n" * 40)]
    return rows


@pytest.mark.parametrize(("many", "most", "wide"), [(8192, 1 << 22, 4096), (3, 1 << 22, 20), (8192, 2000, 50)])
def test_repeats(spark, table, docs, odd, monkeypatch, many, most, wide):
    monkeypatch.setattr(op10_suffixes, "MANY", many)
    monkeypatch.setattr(op10_suffixes, "MANY_BYTES", most)
    monkeypatch.setattr(op10_suffixes, "WIDE", wide)
    monkeypatch.setattr(op10_suffixes, "BLOCK", 2000)
    rows = [*docs[:100], *odd, *((2000 + d, t) for d, t in passages(many))]
    want = brute.repeats(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op10_suffixes.without_repeats(table(rows)).collect()}
    assert got == {d: (*x[:3], brute.sha(x[3])) for d, x in want.items()}
    stripped = {r["doc_id"]: r["text"] for r in op10_suffixes.strip_repeats(table(rows)).collect()}
    assert {d: t or "" for d, t in stripped.items()} == {d: x[3].decode("utf-8", "ignore") for d, x in want.items()}


def test_repeats_in_a_long_text(spark, table, monkeypatch):
    r = random.Random(1)
    long = "é" + "".join(r.choice("klmnop") for _ in range(3_000_000))
    rows = [(0, long), (1, long[1_000_000:1_100_000]), (2, long[:99])]
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in op10_suffixes.without_repeats(table(rows)).collect()}
    assert got == {0: (0, 0), 1: (100_000, 1), 2: (0 if len(long[:99].encode()) < 100 else 100, 0 if len(long[:99].encode()) < 100 else 1)}


def test_repeats_of_long_runs(spark, table):
    """Lines and single bytes repeated far beyond a piece of text, and runs of all lengths around LENGTH."""
    line = "a line of text that is printed over and over again\n"
    rows = [(1, line * 20_000), (2, "v" + "z" * 300_000 + "a"), (3, "v" + "z" * 700 + "!"), (4, "b" + "z" * 1000 + "c" * 500 + "z" * 450)]
    rows += [(10 + n, f"{n}-" + "q" * n + "e") for n in (99, 100, 101, 199, 200, 201, 399, 400, 401, 500)]
    want = brute.repeats(rows)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op10_suffixes.without_repeats(table(rows, 2)).collect()}
    assert got == {d: (x[1], x[2], brute.sha(x[3])) for d, x in want.items()}


def test_repeats_memory():
    """Eight MiB of a repeated line, in segments of a piece each, take a small multiple of a segment."""
    import tracemalloc

    body = b"the same line again and again\n" * (texts.PIECE // 30)
    tracemalloc.start()
    for _ in range(3):
        runs, again = op10_suffixes._new_in(body, len(body) - 99)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs == [(0, 30)] and again == [(30, len(body) - 99)] and peak < 128 * texts.PIECE


def test_repeats_odd_tables(spark, table):
    assert op10_suffixes.without_repeats(table([])).collect() == []
    text, other = "q" + "0123456789" * 11, "r" + "abcdefghij" * 11
    rows = [(None, "other nameless text " * 9), (None, "third nameless text " * 9)]
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in op10_suffixes.without_repeats(table(rows)).collect()]
    assert got == [brute.repeats([(1, rows[0][1])])[1][:3]] * 2
    stripped = op10_suffixes.strip_repeats(table([(1, text), (2, text)]).withColumnsRenamed({"id": "doc", "rank": "mark", "key": "ranges", "n": "_doc"})).collect()
    assert {r["doc_id"]: (r["text"], r["doc"], r["mark"], r["ranges"], r["_doc"]) for r in stripped} == {1: (brute.repeats([(1, text)])[1][3].decode(), 7, 8, "k", 9), 2: ("", 7, 8, "k", 9)}
    rows = [(1, text), (1, text), (2, other), (2, text + "!"), (None, text)]
    got = sorted((r["doc_id"] or 99, r["n_bytes"], r["n_removed"]) for r in op10_suffixes.without_repeats(table(rows)).collect())
    alone = brute.repeats([(1, text)])[1][1]
    assert got == [(1, 111, alone), (1, 111, alone), (2, 111, brute.repeats([(2, other)])[2][1]), (2, 112, 111), (99, 111, 111)]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\0", bytes(range(256))])
def test_two_stage_order(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(20):
        base = bytes(r.choice(alphabet) for _ in range(r.choice([120, 300, 900])))
        bodies = []
        for _ in range(r.randint(1, 6)):
            a = r.randint(0, len(base) - 100)
            bodies.append(base[a : r.randint(a + 100, len(base))] + bytes(r.choice(alphabet) for _ in range(r.randint(0, 40))))
        seen, want = set(), []
        for x in bodies:
            want.append([p for p in range(len(x) - 99) if x[p : p + 100] in seen or seen.add(x[p : p + 100])])
        assert [w.tolist() for w in op10_suffixes.repeated_windows(bodies)] == want


def test_pairs_of_many_buckets_are_named_once():
    """Every linked pair that shares a table is named, and no pair twice, however many buckets hold both."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, r.choice(60, r.integers(0, 12), replace=False)), r.integers(0, 1 << 63, r.integers(0, 9), dtype=np.uint64)])) for _ in range(40)]
    halves = op1_minhash.half_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    tables = pa.Table.from_batches(op1_minhash._table_keys([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([h.tobytes() for h in halves])], ["doc", "keys"])])).to_pandas()
    buckets = tables.groupby("key")["doc"].agg(tuple)
    buckets = buckets[buckets.map(len) > 1]
    rows = []
    for members, keys in buckets.groupby(buckets).groups.items():  # all in components of their own
        rows.append((keys[0], 0, 0, None, None, members[0], None, None, list(keys)))
        for kind in (1, 2):
            rows += [(keys[0], 0, kind, m, len(sets[m]), m, op1_minhash._bit_array(sets[m]), halves[m].tobytes(), None) for m in members[kind - 1 :]]
    names = ["key", "block", "kind", "doc", "n", "component", "cells", "keys", "stands"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows])
    named = [(a, b) for got in op1_minhash._probed([batch]) for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)]
    meet = {(a, b) for members in buckets for a in members for b in members if a < b}
    assert len(named) == len(set(named)) and set(named) <= meet
    linked = {(a, b) for a, b in meet if op1_minhash._linked(sets[a], sets[b])}
    assert linked and linked <= set(named)
    assert sum(len(members) * (len(members) - 1) // 2 for members in buckets) > 3 * len(meet)
