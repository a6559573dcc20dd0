"""The pipeline against plain versions of its stages, each on what the one before kept."""

import brute
import corpus_pipeline as pipeline

from tessella.llm import op5_resampling, op6_packing, op8_secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        made[name] = rows
        if name == "packing":
            break
        docs = spark.createDataFrame(rows, docs.schema)
        after = {r["doc_id"]: r for r in rows}
        assert docs.columns == columns and len(after) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        plain = [(d, r["text"]) for d, r in before.items()]
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            drawn = op5_resampling.resample(spark.createDataFrame(list(before.values())), labels).filter("kept").collect()
            assert set(after) == {r["doc_id"] for r in drawn}
        elif name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in brute.near(plain).items() if c == d}
            assert all(after[d]["text"] == before[d]["text"] for d in after)
        elif name == "repeats":
            assert {d: r["text"] for d, r in after.items()} == {d: x[3].decode("utf-8", "ignore") for d, x in brute.repeats(plain).items()}
        else:
            assert {d: r["text"] for d, r in after.items()} == {d: op8_secrets.hide(t, "[SECRET]") for d, t in plain}
    words = {d: len(brute.WORD.findall(t)) for d, t in ((r["doc_id"], r["text"]) for r in made["secrets"])}
    placed = {d: 0 for d in words}
    for r in made["packing"]:
        placed[r["doc_id"]] += r["length"]
        assert r["capacity"] in (None, *op6_packing.LENGTHS)
    assert placed == words
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, made["packing"]))


def odd_rows(odd):
    secret = "the password: hunter2hunter2 and more words after it"
    passage = "a passage of well over one hundred bytes that stands in several of these documents, word for word, and is kept once"
    rows = [*odd, (None, None), (None, "rows without an id stay as they are"), (None, "rows without an id stay as they are"), (5, passage), (5, passage), (5, secret)]
    return [*rows, (6, f"{passage} -- seen in six"), (7, f"seen in seven -- {passage}"), (8, passage), (9, secret + " in nine")]


def test_stages_of_odd_rows(spark, table, odd, sf_dir):
    """Null ids and texts, repeats, ties, long texts and clashing columns go through every stage with the stated results."""
    docs = table(odd_rows(odd))
    columns, stages = docs.columns, dict(pipeline.STAGES)
    drawn = stages["quality"](spark, docs, sf_dir)
    assert drawn.columns == columns and {str(r) for r in drawn.collect()} <= {str(r) for r in docs.collect()}
    assert not drawn.filter("text IS NULL OR trim(text) = ''").count()
    kept = stages["near_duplicates"](spark, docs, sf_dir)
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.filter("doc_id < 100").collect()) == [5, 5, 5, 9]  # 6, 7 and 8 are near copies of 5
    assert kept.filter("doc_id IS NULL").count() == 3 and kept.filter("doc_id >= 900").count() == len(odd) - 1  # "one two" twice
    cut = stages["repeats"](spark, docs, sf_dir)
    got = sorted(((r["doc_id"] or 0), r["text"] or "", r["n_chars"], r["id"], r["key"], r["component"]) for r in cut.filter("doc_id < 100 OR doc_id IS NULL").collect())
    texts = [(0, ""), (0, "rows without an id stay as they are"), (0, "rows without an id stay as they are"), (6, " -- seen in six"), (7, "seen in seven -- "), (8, "")]
    assert cut.columns == columns and cut.count() == docs.count() and [g[:2] for g in got if g[0] != 5 and g[0] != 9] == texts
    assert all((g[2] in (None, len(g[1]))) and g[3:] == (7, "k", "c") for g in got)
    clean = stages["secrets"](spark, docs, sf_dir)
    assert clean.columns == columns and clean.count() == docs.count()
    assert [r["text"] for r in clean.filter("doc_id = 9").collect()] == ["the [SECRET] and more words after it in nine"]
    packed = stages["packing"](spark, docs, sf_dir)
    assert packed.filter("length > 0").agg({"length": "sum"}).first()[0] == sum(len(brute.WORD.findall(t or "")) for _, t in odd_rows(odd))
    assert packed.filter("doc_id IS NULL").count() == 3


def test_stages_of_no_rows(spark, table, sf_dir):
    for name, stage in pipeline.STAGES:
        docs = table([])
        made = stage(spark, docs, sf_dir)
        assert made.collect() == [] and (name == "packing" or made.columns == docs.columns)


def test_quality_is_the_plain_draw(spark, sf_dir):
    from test_text_operators import plain_draw

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want, _ = plain_draw([(r["doc_id"], r["text"]) for r in docs.collect()], labels)
    assert {r["doc_id"] for r in pipeline.quality(spark, docs, sf_dir).collect()} == {d for d, x in want.items() if x[2]}
