"""Operators against plain versions on small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import blocks, chunking, cluster, embed, search, similarity
from tessella.sources import readers


def unit(n, dim, seed):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "dim", "k", "size", "run"), [(53, 16, 4, 7, 2), (53, 16, 60, 64, 8), (12, 8, 3, 5, 1)])
def test_nearest_is_brute_force(spark, monkeypatch, n, dim, k, size, run):
    monkeypatch.setattr(blocks, "SIZE", size)
    monkeypatch.setattr(blocks, "RUN", run)
    m = unit(n, dim, n)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(m)], "id long, grp int, vec array<double>")
    for group in (None, "grp"):
        got = {(r["id"], r["rank"]): r["other"] for r in blocks.nearest(df, "id", "vec", k, group).collect()}
        want = {}
        for i in range(n):
            others = [j for j in range(n) if j != i and (group is None or j % 3 != i % 3)]
            for rank, j in enumerate(sorted(others, key=lambda j: (-(m[i] @ m[j]), j))[:k], 1):
                want[i, rank] = j
        assert got == want


def test_pairs_and_between(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 6)
    monkeypatch.setattr(blocks, "RUN", 2)
    m = unit(40, 5, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    got = {(r["a"], r["b"]) for r in blocks.pairs_above(df, "id", "vec", 0.3).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if m[i] @ m[j] >= 0.3}
    left, right = blocks.packed(df.filter("id < 15"), "id", "vec"), blocks.packed(df.filter("id >= 15"), "id", "vec")
    best = [(r["a"], r["b"]) for r in blocks.best_between(*left, *right, 4).collect()]
    assert best == sorted(((i, j) for i in range(15) for j in range(15, 40)), key=lambda p: (-(m[p[0]] @ m[p[1]]), p))[:4]


def chunk_rows(spark):
    m = unit(6, 4, 1)
    rows = [(i, f"c{i}", "a.md" if i < 4 else "b.md", "all", f"text {i}", 1 + i * 5, 9 + i * 5, None, i == 5, v.tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "row long, chunk_id string, path string, locator string, text string, start_line int, end_line int, heading string, deleted boolean, vec array<double>")


def test_items_and_errors(spark):
    c = chunk_rows(spark)
    assert search.resolve(c, "c2").rows == [2]
    assert search.resolve(c, "a.md:7").rows == [0]
    assert search.resolve(c, "a.md").kind == "file" and search.resolve(c, "a.md").rows == []
    for ref in ("a.md:900", "no.md:1", "no.md", "c5"):
        with pytest.raises(search.EngineError):
            search.resolve(c, ref)
    assert {r["path"] for r in search.similar(c, "a.md", k=9).collect()} == {"b.md"}
    assert search.similar(c, "c0", k=9).count() == 4
    for bad in (lambda: search.search(c, [1.0] * 4, k=0), lambda: similarity.outliers(c, neighbors=0), lambda: search.best_pairs(c, "a.md", "b.md", 0), lambda: similarity.neighbors(c.filter("row = 0"))):
        with pytest.raises(search.EngineError):
            bad()
    with pytest.raises(search.EngineError):
        similarity.nearest(c.filter("path = 'a.md'"), across_files_only=True)


@pytest.mark.parametrize("dim", [3, 64, 129, 400])
def test_search_is_brute_force(spark, monkeypatch, dim):
    """Order, ties of equal vectors and scores, at any number of dimensions, whether winners are named or joined."""
    m = unit(300, dim, dim)
    m[200:260] = m[7]  # ties go to the smaller row
    rows = [(i, f"c{i}", f"f{i % 9}", "all", f"t {i}", i % 10 == 3, v.astype(np.float32).tolist()) for i, v in enumerate(m)]
    c = spark.createDataFrame(rows, "row long, chunk_id string, path string, locator string, text string, deleted boolean, vec array<float>").repartition(5)
    q = m[7].tolist()
    exact = {i: float(np.float64(np.float32(m[i])) @ m[7]) for i in range(300) if i % 10 != 3}
    want = sorted(exact, key=lambda i: (-round(exact[i], 9), i))
    for most in (1000, 5):
        monkeypatch.setattr(search, "NAMED_ROWS", most)
        got = search.search(c, q, k=70).collect()
        assert [r["row"] for r in got] == want[:70] and [r["text"] for r in got] == [f"t {i}" for i in want[:70]]
        assert all(abs(r["score"] - exact[r["row"]]) < 1e-4 for r in got)
    least = exact[want[61]] - 1e-9
    assert [r["row"] for r in search.search(c, q, k=300, min_score=least).collect()] == want[:62]
    by_file = [r["row"] for r in search.search(c, q, k=4, group_by_file=True).collect()]
    assert by_file == sorted((next(i for i in want if i % 9 == f) for f in range(9)), key=want.index)[:4]
    assert [r["row"] for r in search.search(c.select("row", "path", "vec"), q, k=3).collect()] == sorted(range(300), key=lambda i: (-round(float(np.float64(np.float32(m[i])) @ m[7]), 9), i))[:3]


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(5)
    centers = np.eye(16)[:3]
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centers])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert cluster.choose_k(x)[0] == 3
    df = spark.createDataFrame([(i, f"f{i}", v.tolist()) for i, v in enumerate(x)], "row long, path string, vec array<double>")
    got, info = cluster.cluster(df)
    assert info["k"] == 3 and sorted(r["size"] for r in got.collect()) == [40, 40, 40]
    for r in got.collect():
        assert len({m["item"] // 40 for m in r["members"]}) == 1 and r["cohesion"] > 0.9 and len(r["representatives"]) == 3
    assert cluster.silhouette(x, np.zeros(len(x))) == -1.0
    with pytest.raises(search.EngineError):
        cluster.cluster(df, k=200)


def test_mean_silhouette(spark):
    """All of 2,500 items, one of them alone in its cluster, against every distance."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 8)) + 2 * np.eye(8)[rng.integers(4, size=2500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = x[:, :4].argmax(axis=1)
    labels[0] = 9
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, labels, strict=True)], "vec array<double>, label int")
    assert abs(cluster.mean_silhouette(df).first()[0] - cluster.silhouette(x, labels)) < 1e-9
    assert cluster.mean_silhouette(df.filter("label = 1")).first()[0] is None


def test_readers():
    md = "# T\n\n## A\n\none\n\n```\n# no heading\n```\n\n## B\ntwo\n"
    got = readers.read_markdown(md)
    assert [s.heading for s in got] == ["T > A", "T > B"]
    assert (got[0].units[0].first, got[0].units[-1].last) == (1, 9)
    assert readers.read_markdown("") == [] and readers.read_code("\n\n") == []
    assert readers.decode(b"a\0b") is None and readers.decode(b"\xef\xbb\xbfhi") == "hi" and readers.decode(b"caf\xe9") == "caf�"
    lines = '{"id": 1, "t": "a b"}\r\n\nbad\n{"_id": "x", "n": null, "l": [1, "é"]}\n[3]\n'
    got = readers.read_jsonl(lines, readers.Options())
    assert [(s.record, s.units[0].first, s.units[0].text) for s in got] == [("1", 1, "id: 1\nt: a b"), ("x", 4, '_id: x\nl: [1, "é"]'), ("3", 5, "[3]")]
    got = readers.read("x.json", b'[{"k": {"t": ["q", "deep"]}, "n": "7"}]', readers.Options("k.t.1", "n"))
    assert got[0] == "json" and (got[1][0].record, got[1][0].units[0].text) == ("7", "deep")
    assert readers.read("x.json", b"3")[0] == "code" and readers.read("x.py", b"\0") is None and readers.read("Makefile", b"a")[0] == "text"
    kind, got = readers.read("r.csv", b'id,title,note\nr1,Soup,"a, b"\n,Bread,\n', readers.Options(text_cols=("title", "note")))
    assert kind == "csv" and [(s.record, s.units[0].first, s.units[0].text) for s in got] == [("r1", 2, "title: Soup\nnote: a, b"), ("2", 3, "title: Bread")]
    with pytest.raises(ValueError, match="nope"):
        readers.read("r.csv", b"id\n1\n", readers.Options(text_cols=("nope",)))


def test_lines_and_paragraphs():
    assert [readers.lines_of(t) for t in ("a\r\nb\n", "", "x\n\n \ny\nz\n\n", "\n")] == [["a", "b"], [], ["x", "", " ", "y", "z", ""], [""]]
    got = [(u.first, u.last, u.text) for u in readers.paragraphs(readers.lines_of("x\n\n \ny\nz\n\n"))]
    assert got == [(1, 1, "x"), (4, 5, "y\nz")]


def test_pages(monkeypatch):
    """Pages by their number, blank and unreadable ones left out; the library is a stand-in."""
    import sys
    from types import SimpleNamespace

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "bad":
                raise KeyError("font")
            return self.text

    pages = SimpleNamespace(pages=[Page("one\ntwo\n\nthree"), Page(None), Page("bad"), Page(" \n"), Page("four")])
    monkeypatch.setitem(sys.modules, "pypdf", SimpleNamespace(PdfReader=lambda f: pages if f.read() == b"%PDF" else None))
    kind, got = readers.read("a/b.PDF", b"%PDF")
    assert kind == "pdf" and [(s.page, [(u.text, u.first) for u in s.units]) for s in got] == [(1, [("one\ntwo", None), ("three", None)]), (5, [("four", None)])]
    assert [c[0] for c in chunking.chunks_of(got, embed.HashedWords(), 120, 18)] == ["p1", "p5"]


def test_encoder_batches():
    """Rows come back in their order whatever their batch; the session is a stand-in that returns each text's token ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    e = object.__new__(embed.OnnxEncoder)
    e.model, e.dim, e.names = embed.MODELS["bge-small"], 2, {"input_ids", "attention_mask"}
    e.tokenizer = e.plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []

    class Session:
        def run(self, _, given):
            assert set(given) == e.names
            ids, mask = given["input_ids"], given["attention_mask"]
            seen.append(ids.shape)
            assert ((ids == 0) | (mask == 1)).all()
            return [np.stack([ids[:, 0], mask.sum(axis=1)], axis=1)[:, None, :].astype(np.float32)]

    e.session = Session()
    texts = [f"{'word ' * (i * 7 % 40)}x{i}" for i in range(50)]
    got = e.encode(texts, room=100)
    for t, v in zip(texts, got, strict=True):
        ids = e.plain.encode(t).ids
        want = np.array([ids[0], len(ids)], np.float64)
        assert v == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    assert len(seen) > 5 and all(n == 1 or n * w <= 100 for n, w in seen)
    assert e.encode([]).shape == (0, 2) and e.spans("ab cd") == [(0, 2), (2, 5)]
    query = e.model.query_prefix + "tide"
    assert e.encode(["tide"], "query")[0][1] / e.encode(["tide"], "query")[0][0] == pytest.approx(len(e.plain.encode(query).ids) / e.plain.encode(query).ids[0], rel=1e-5)


def test_chunks_keep_to_the_budget():
    e = embed.HashedWords()
    text = "\n\n".join(f"p{i} " + "word " * 21 for i in range(10))
    got = list(chunking.chunks_of(readers.read_code(text), e, 50, 22))
    assert all(e.count(c[1]) <= 50 for c in got) and len(got) == 9
    assert got[0][0] == "L1-3" and got[1][0] == "L3-5"  # one paragraph shared
    long = list(chunking.chunks_of([readers.Segment([readers.Unit("w " * 500, 4, 4)], "\n", record="r1")], e, 100, 10))
    assert [c[0] for c in long[:2]] == ["rec:r1#1", "rec:r1#2"] and len(long) == 6
    assert chunking.locate(None, None, 3, None, 0, 1) == "p3" and chunking.locate(None, None, None, None, 0, 1) == "all"
    with pytest.raises(ValueError):
        embed.chunk_limits(embed.MODELS["hash"], 8)
    assert embed.chunk_limits(embed.MODELS["hash"]) == (120, 18)


def test_hashed_words():
    e = embed.HashedWords()
    x = e.encode(["feeding the starter", "feed starters", "", "the of"])
    assert x[0] @ x[1] == pytest.approx(1) and not x[2].any() and not x[3].any()
    assert e.features("Walked dogs es") == ["walk", "dog", "es", "walk_dog", "dog_es"]


def test_half_precision(spark):
    df = spark.createDataFrame([([0.1, 1.0],)], "v array<float>")
    assert df.select(embed.half_precision(F.col("v")).alias("v")).first()["v"] == [np.float32(np.float16(0.1)), 1.0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30)), min_size=1, max_size=40), st.integers(30, 60), st.integers(0, 29))
def test_packing_loses_no_unit(sizes, budget, overlap):
    units = [chunking.Sized(str(i), None, None, n) for i, (n,) in enumerate(sizes)]
    groups = chunking.packed(units, budget, overlap)
    assert all(sum(u.tokens for u in g) <= budget for g in groups)
    seen = [u.text for g in groups for u in g]
    assert sorted(set(seen), key=int) == [u.text for u in units]


def test_text_expressions(spark):
    long = spark.createDataFrame([("ab  cd",)], "t string")
    assert long.select(T.snippet(F.col("t"), 4).alias("s")).first()["s"] == "ab …"
    ids = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, i string")
    assert len({r["i"] for r in T.unique_ids(ids, "i", ["n"]).collect()}) == 3
    paths = spark.createDataFrame([("a/b.md",), ("c.py",)], "p string")
    assert [r["p"] for r in paths.filter(T.matches_glob(F.col("p"), "[!c]*.md")).collect()] == ["a/b.md"]


def linked_plainly(m, threshold):
    """(copy_of, class_id, n_links) of each row, pair by pair."""
    n = len(m)
    links = [[j for j in range(n) if j != i and m[i].any() and (np.array_equal(m[i], m[j]) or m[i].astype(float) @ m[j].astype(float) >= threshold)] for i in range(n)]
    out = {}
    for i in range(n):
        reached, left = {i}, [i]
        while left:
            more = set(links[left.pop()]) - reached
            reached |= more
            left += more
        out[i] = (min([i, *(j for j in links[i] if np.array_equal(m[i], m[j]))]), min(reached), len(links[i]))
    return out


@pytest.mark.parametrize("bound", [True, False])
def test_classes_of_near_equal_vectors(spark, monkeypatch, bound):
    """Copies, chains, zero vectors, a group of near copies; many blocks and groups, with and without the bound on axes."""
    from tessella.operators import near

    for name, value in {"SIZE": 7, "GROUPS": 6, "LEAST": 12, "DEALT": 60, "AXES": 9, "SAMPLE": 50 if bound else 10_000}.items():
        monkeypatch.setattr(near, name, value)
    rng = np.random.default_rng(5)
    m = np.where(rng.random((300, 40)) < rng.uniform(0.05, 1, (300, 1)), rng.integers(-3, 4, (300, 40)), 0).astype(float)
    m[100:160] = m[40] + (rng.random((60, 40)) < 0.05)  # near copies
    m[200:220] = m[50]
    m[230] = 0
    for i in range(240, 270):  # a chain
        m[i] = m[i - 1] + 0.3 * np.abs(m[i - 1]).max() * rng.normal(size=40)
    m = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    assert np.array_equal(near.decoded(near.coded(m)), m)
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(near.coded(m))], "id long, code binary").repartition(5)
    got = {r["row"]: (r["copy_of"], r["class_id"], r["n_links"]) for r in near.classes(df, "id", "code", 0.9).collect()}
    want = linked_plainly(m, 0.9)
    assert got == want and len({x[1] for x in want.values()}) < 250 and want[230] == (230, 230, 0)
    assert near.classes(df.filter("id = 230"), "id", "code", 0.9).collect()[0]["n_links"] == 0
    with pytest.raises(ValueError, match="threshold"):
        near.classes(df, "id", "code", 0.0)


def test_codes_of_many_values():
    from tessella.operators import near

    m = np.random.default_rng(2).normal(size=(3, 700)).astype(np.float32)
    assert np.array_equal(near.decoded(near.coded(m)), m)


def test_a_batch_is_encoded_in_slices(spark):
    """A worker never makes the vectors of a whole Arrow batch at once."""

    class Sized:
        def encode(self, texts, kind):
            return np.full((len(texts), 2), float(len(texts)), np.float32)

    rows = spark.range(0, 3000, 1, 1).select(embed.embedded(F.col("id").cast("string"), Sized).alias("v")).collect()
    assert len(rows) == 3000 and max(r["v"][0] for r in rows) <= embed.ROWS
