"""Discovery and the life of an index, with files written for the purpose."""

import os

import pytest

from tessella.operators import embed, search, similarity
from tessella.operators.search import EngineError
from tessella.plans import index as plans
from tessella.sources import discover
from tessella.streaming import incremental


def write(path, text):
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_ignore_rules():
    rules = discover.ignore_rules("# c\n*.log\nbuild/\n/root.txt\ndocs/**/draft*.md\n!keep.log\n\\!odd\n[!a]z\n")
    layers = [("/r", rules)]
    want = {"a.log": True, "x/keep.log": False, "root.txt": True, "x/root.txt": False, "docs/draft1.md": True, "docs/a/b/draft2.md": True, "docs/a/final.md": False, "!odd": True, "bz": True, "az": False}
    assert {p: discover.is_ignored(f"/r/{p}", False, layers) for p in want} == want
    assert discover.is_ignored("/r/x/build", True, layers) and not discover.is_ignored("/r/build", False, layers)


def test_discover(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("a.md", "b.py", "c.png", "sub/d.txt", "sub/skip.log", "node_modules/e.js", "big.txt", ".gitignore"):
        write(name, "x" * (2000 if name == "big.txt" else 10))
    write(".gitignore", "*.log\n")
    os.symlink("a.md", "link.md")
    names = lambda **o: [f[0] for f in discover.discover(["."], **o).files]
    assert names() == [".gitignore", "a.md", "b.py", "big.txt", "sub/d.txt"]
    assert names(include=["*.md", "*.txt"], exclude=["sub"]) == ["a.md", "big.txt"]
    assert "sub/skip.log" in names(use_ignore=False)
    small = discover.discover(["."], most_bytes=1000)
    assert small.skipped == ["big.txt (over 0 MB)"]
    with pytest.raises(FileNotFoundError):
        discover.discover(["nowhere"])


def test_index_life(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    tide = "The moon pulls the sea and high tides come twice a day.\n"
    write("fx/a.md", f"# Sea\n\n## Tides\n\n{tide}\n## Waves\n\nWind makes waves.\n")
    write("fx/b.md", f"# Moon\n\n{tide}")
    write("fx/t.jsonl", '{"id": "T-1", "text": "card charged twice"}\n{"id": "T-2", "text": "parcel lost"}\n')
    root = f"file://{tmp_path}/ix"
    ix = plans.Index(spark, root, "t")
    with pytest.raises(EngineError):
        ix.chunks()
    made = ix.build(["fx"])
    assert (made["added"], made["chunks_embedded"], made["empty_files"]) == (3, 5, 0)
    assert sorted(map(tuple, made["statuses"].collect())) == [("fx/a.md", "added"), ("fx/b.md", "added"), ("fx/t.jsonl", "added")]
    assert [r["locator"] for r in ix.chunks().orderBy("row").collect()] == ["L1-5", "L7-9", "L1-3", "rec:T-1", "rec:T-2"]
    query = embed.HashedWords().encode(["two high tides a day"], "query")[0]
    assert search.search(ix.chunks(), query, k=1).first()["path"] in ("fx/a.md", "fx/b.md")
    best = {r["item"]: r["other"] for r in similarity.nearest(ix.chunks(), k=1).collect()}
    assert best[0] == 2 and best[2] == 0
    assert (ix.build(["fx"])["unchanged"], ix.current()) == (3, "g1")  # nothing differs, nothing is written
    os.utime("fx/a.md", (1, 1))
    again = ix.build(["fx"])
    assert (again["unchanged"], again["chunks_embedded"]) == (3, 0)
    assert (ix.current(), ix.folder.names("g2"), ix.manifest()["chunks_of"]) == ("g2", ["files", "manifest.json"], "g1")
    assert ix.files().filter("path = 'fx/a.md'").first()["mtime"] == 1 and ix.chunks().count() == 5 and ix.info()["size_bytes"] > ix.folder.bytes("g2")
    os.utime("fx/a.md", (2, 2))
    ix.build(["fx"])
    assert (ix.current(), ix.manifest()["chunks_of"], ix.chunks().count()) == ("g3", "g1", 5)
    assert ix.dupes(0.3).count() and not ix.dupes().count()  # by default from 0.9 on
    write("fx/t.jsonl", '{"id": "T-9", "text": "new"}\n')
    os.remove("fx/b.md")
    last = ix.build(["fx"])
    assert (last["changed"], last["removed"], last["chunks_embedded"], last["compacted"]) == (1, 1, 1, True)
    assert {tuple(r) for r in last["statuses"].collect()} == {("fx/t.jsonl", "changed"), ("fx/b.md", "removed"), ("fx/a.md", "unchanged")}
    info = ix.info()
    assert (info["files"], info["chunks"], info["tombstoned"]) == (2, 3, 0)
    assert sorted(r["row"] for r in ix.chunks().collect()) == [0, 1, 2]
    for bad in ({"chunk_tokens": 64}, {"model": "bge-small"}):
        with pytest.raises(EngineError):
            ix.build(["fx"], **bad)
    assert [x["index"] for x in plans.list_indexes(spark, root)] == ["t"]
    plans.drop_index(spark, root, "t")
    assert plans.list_indexes(spark, root) == []
    for name in ("", ".x", "a/b", "x" * 101):
        with pytest.raises(EngineError):
            plans.Index(spark, root, name)


def test_scoped_removal(spark, tmp_path, monkeypatch):
    """A file that is not listed goes if it lay under a given folder or is gone from disk, else it stays."""
    monkeypatch.chdir(tmp_path)
    for f in ("one/a.txt", "one/b.txt", "two/c.txt", "two/d.txt", "one-more/e.txt"):
        write(f, f"words of {f}")
    ix = plans.Index(spark, f"file://{tmp_path}/ix", "s")
    assert ix.build(["one", "two", "one-more"])["added"] == 5
    os.remove("two/d.txt")
    got = ix.build(["one"], exclude=["b.txt"])
    assert {tuple(r) for r in got["statuses"].collect()} == {("one/a.txt", "unchanged"), ("one/b.txt", "removed"), ("two/c.txt", "elsewhere"), ("two/d.txt", "removed"), ("one-more/e.txt", "elsewhere")}
    assert got["removed"] == 2 and sorted(r["path"] for r in ix.files().collect()) == ["one-more/e.txt", "one/a.txt", "two/c.txt"]


def test_a_run_that_is_cut_short(spark, tmp_path, monkeypatch):
    """Before the pointer moves the old generation is read; what is left over goes with the next run."""
    monkeypatch.chdir(tmp_path)
    write("fx/a.txt", "one two three")
    ix = plans.Index(spark, f"file://{tmp_path}/ix", "r")
    ix.build(["fx"])
    write("fx/b.txt", "four five six")
    real = plans.Folder.write

    def fails(folder, name, text):
        if name == at:
            raise RuntimeError("power is off")
        real(folder, name, text)

    for at in ("g2/manifest.json", "CURRENT"):
        with monkeypatch.context() as m:
            m.setattr(plans.Folder, "write", fails)
            with pytest.raises(RuntimeError, match="power"):
                ix.build(["fx"])
        assert ix.current() == "g1" and ix.chunks().count() == 1
        ix.folder.delete("g2")
    ix.build(["fx"])
    ix.folder.delete("CURRENT")  # lost within the swap: the last whole generation is taken
    assert ix.current() == "g2" and ix.chunks().count() == 2
    os.makedirs(f"{tmp_path}/ix/r/g9/chunks")
    write("fx/c.txt", "seven eight")
    ix.build(["fx"])
    assert ix.chunks().count() == 3 and "g9" not in ix.folder.names()


def test_stream(spark, tmp_path):
    schema = "path string, content binary"
    spark.createDataFrame([("a.txt", b"one two three"), ("b.txt", b"four five")], schema).write.parquet(f"{tmp_path}/in/1")
    files = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    incremental.index_stream(files, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a.txt", "b.txt"}
    incremental.index_stream(files, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert incremental.windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_sources_in_a_store(spark, tmp_path):
    text = "The moon pulls the sea and high tides come twice a day.\n"
    for name in ("src/a b.md", "src/day=1/c*.txt", "src/day=2/d.txt", "src/skip.log", "src/node_modules/e.js", "src/.env", "src/_f.txt", "src/p.png", "other/g.md"):
        write(str(tmp_path / name), f"{text}{name}\n")
    write(str(tmp_path / "src/.gitignore"), "*.log\n")
    ix = plans.Index(spark, f"file://{tmp_path}/ix", "store")
    src, other, disk = f"file://{tmp_path}/src", f"file://{tmp_path}/other/g.md", str(tmp_path / "other")
    base = f"file:{tmp_path}"
    shown = [f"{base}/src/a b.md", f"{base}/src/day=1/c*.txt", f"{base}/src/day=2/d.txt"]
    made = ix.build([src, other])
    assert sorted(r["path"] for r in ix.files().collect()) == sorted([*shown, f"{base}/other/g.md"])
    assert (made["added"], made["chunks_embedded"]) == (4, 4)
    assert {r["path"]: r["text"].split()[-1] for r in ix.chunks().collect()}[shown[1]] == "src/day=1/c*.txt"
    assert ix.manifest()["roots"] == sorted([f"{base}/src", f"{base}/other/g.md"])

    again = ix.build([src])  # the other root's file stays, though it is not listed
    assert (again["added"], again["changed"], again["removed"], again["unchanged"]) == (0, 0, 0, 3)
    write(shown[0][len("file:") :], text * 2 + "now two lines\n")
    os.utime(shown[1][len("file:") :], (1, 1))
    os.remove(shown[2][len("file:") :])
    made = ix.build([src, disk])  # folders on disk and in stores, together
    want = {shown[0]: "changed", shown[1]: "touched", shown[2]: "removed", f"{base}/other/g.md": "elsewhere", f"{tmp_path}/other/g.md": "added"}
    assert {r["path"]: r["status"] for r in made["statuses"].collect()} == want
    assert sorted(r["path"] for r in ix.files().collect()) == sorted(p for p, s in want.items() if s != "removed")
    with pytest.raises(FileNotFoundError):
        ix.build([f"file://{tmp_path}/nowhere"])
    assert ix.build([src], exclude=["*.md"])["removed"] == 1
