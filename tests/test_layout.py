"""Rules that the packages keep."""

import pathlib

import pytest

ROOT = pathlib.Path(__file__).parents[1]


def sources(*skip):
    return [p for p in (ROOT / "tessella").rglob("*.py") if not any(s in p.parts for s in skip)]


def test_nothing_imports_the_corpus_operators():
    assert not [p for p in sources("llm") if "tessella.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]


def test_lineage_is_cut_in_the_shared_folder():
    assert not [p for p in sources() if "localCheckpoint" in p.read_text()]


def test_shared_folder_is_the_one_named(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace

    from tessella import runtime

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: f"file://{tmp_path}/named/"))
    assert runtime.shared_dir(named) == f"file://{tmp_path}/named"
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(applicationId="test", master="local[3]", getConf=lambda: {}))
    assert runtime.shared_dir(unset).startswith("file:/") and runtime.shared_dir(unset) == runtime.shared_dir(unset)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        unset.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(unset)
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"file://{tmp_path}/named")
    kept = runtime.Scratch(spark).keep(spark.range(3))
    assert kept.count() == 3 and len(list((tmp_path / "named").iterdir())) == 1
    runtime.Scratch(spark).drop(kept)
    few = runtime.Scratch(spark).keep(spark.range(0, 3000, 1, 8), 3000)
    assert few.count() == 3000 and len(few.inputFiles()) == 1
    runtime.Scratch(spark).drop(few)
    assert not [p for p in (tmp_path / "named").iterdir() if p.is_dir()]
