"""Commands over named indexes: ``python -m tessella.cli search "two high tides" --root file:///data/indexes``.

Every command prints one JSON document that begins with ok and command; an error has ok false and its message. Exit codes:
0 done, 1 a request that cannot be met, 2 a wrong command line, 3 something is missing on this machine, 130 interrupted.
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import __name__ as package
from tessella.operators import cluster, embed, search, similarity
from tessella.operators.search import EngineError
from tessella.plans.index import Index, drop_index, list_indexes
from tessella.sources import readers

DONE, REFUSED, USAGE, MISSING, INTERRUPTED = 0, 1, 2, 3, 130


def embedder(model: str):
    """The embedder of a model that needs no files."""
    if model not in embed.MODELS:
        raise EngineError(f"there is no model '{model}'")
    if model != "hash":
        raise EngineError(f"model '{model}' needs its files: use embed.OnnxEncoder with their paths")
    return embed.HashedWords(embed.MODELS[model].dim)


def embed_text(text: str, query: bool = False, model: str = "hash") -> dict:
    """One text's vector, rounded to six places."""
    kind = "query" if query else "document"
    vector = embedder(model).encode([text], kind)[0]
    return {"model": model, "dim": len(vector), "kind": kind, "vector": [round(float(x), 6) for x in vector]}


def health(spark: SparkSession | None = None) -> dict:
    """Versions and what cannot be done on this machine; ok if the parts that need no files of a model are there."""
    versions = {m: importlib.import_module(m).__version__ for m in ("pyspark", "pyarrow", "numpy", "pandas")}
    versions["python"] = sys.version.split()[0]
    missing = [m for m in ("onnxruntime", "tokenizers", "pypdf") if importlib.util.find_spec(m) is None]
    problems = []
    if spark is not None and spark.range(1).count() != 1:
        problems.append("Spark does not run jobs")
    return {"versions": versions, "models": {m.key: {"dim": m.dim, "ready": m.key == "hash"} for m in embed.MODELS.values()}, "problems": problems, "warnings": [f"{m} is not installed" for m in missing]}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _index(spark, a) -> dict:
    options = readers.Options(a.text_field, a.id_field, tuple(a.text_cols or ()))
    done = Index(spark, a.root, a.index).build(a.paths, a.model, a.include, a.exclude, options, a.chunk_tokens, a.overlap, a.rebuild, a.max_mb << 20, not a.no_gitignore)
    statuses = done.pop("statuses")
    return done | ({"files": _rows(statuses.orderBy("path"))} if a.files else {})


def _search(spark, a) -> dict:
    ix = Index(spark, a.root, a.index)
    model = ix.info()["model"]["key"]
    found = search.search(ix.chunks(), embedder(model).encode([a.query], "query")[0], k=a.k, min_score=a.min_score, path_glob=a.path_glob, group_by_file=a.group_by_file, snip=a.snippet)
    return {"index": a.index, "model": model, "query": a.query, "results": _rows(found.drop("row"))}


def _similar(spark, a) -> dict:
    chunks = Index(spark, a.root, a.index).chunks()
    item = search.resolve(chunks, a.item)
    return {"item": item.label, "item_kind": item.kind, "results": _rows(search.similar(chunks, a.item, a.k, a.group_by_file, a.path_glob, a.snippet).drop("row"))}


def _compare(spark, a) -> dict:
    if a.text:
        return {"a": a.a, "b": a.b, "score": search.compare_texts(embedder(a.model or "hash"), a.a, a.b)}
    chunks = Index(spark, a.root, a.index).chunks()
    out = search.compare(chunks, a.a, a.b)
    if "score_kind" in out:
        best = search.best_pairs(chunks, *(search.resolve(chunks, x).path for x in (a.a, a.b)), a.pairs)
        out["best_chunk_pairs"] = _rows(best.withColumn("score", F.round("score", 4)))
    return out


def _dupes(spark, a) -> dict:
    ix = Index(spark, a.root, a.index)
    rows = _rows(ix.dupes(a.threshold, a.across_files_only, a.limit, a.snippet))
    least = embed.MODELS[ix.info()["model"]["key"]].dupe_threshold if a.threshold is None else a.threshold
    pairs = [{"score": r["score"], "a": r["chunk_a"], "b": r["chunk_b"]} for r in rows]
    return {"threshold": least, "total_pairs": rows[0]["total_pairs"] if rows else 0, "shown": len(rows), "pairs": pairs}


def _cluster(spark, a) -> dict:
    found, info = cluster.cluster(Index(spark, a.root, a.index).chunks(), a.level, a.k if a.k == "auto" else int(a.k), a.seed, a.sample, a.max_members, a.reps)
    return info | {"clusters": _rows(found.drop("label").orderBy("cluster"))}


def _neighbors(spark, a) -> dict:
    chunks = Index(spark, a.root, a.index).chunks()
    items = _rows(similarity.neighbors(chunks, a.level, a.k, a.min_score, a.across_files_only).orderBy("item"))
    return {"level": a.level, "k": min(a.k, len(items) - 1), "items_total": len(items), "items": items}


def _outliers(spark, a) -> dict:
    rows = _rows(similarity.outliers(Index(spark, a.root, a.index).chunks(), a.level, a.neighbors, a.n))
    median = rows[0]["median_mean_neighbor_score"] if rows else None
    return {"level": a.level, "neighbors": a.neighbors, "median_mean_neighbor_score": median, "results": [{k: r[k] for k in ("item", "path", "mean_neighbor_score")} for r in rows]}


def _drop(spark, a) -> dict:
    drop_index(spark, a.root, a.name)
    return {"dropped": a.name}


#: Commands: what they do, and their arguments (name, options of the parser).
_FILTERS = [("-k", {"type": int, "default": 10}), ("--path-glob", {}), ("--group-by-file", {"action": "store_true"})]
_LEVEL = ("--level", {"choices": ["chunk", "file"], "default": "chunk"})
_ACROSS = ("--across-files-only", {"action": "store_true"})
COMMANDS = {
    "index": (_index, [("paths", {"nargs": "+"}), ("--include", {"action": "append", "default": []}), ("--exclude", {"action": "append", "default": []}), ("--text-field", {}), ("--text-cols", {"nargs": "+"}), ("--id-field", {}), ("--chunk-tokens", {"type": int}), ("--overlap", {"type": int}), ("--rebuild", {"action": "store_true"}), ("--max-mb", {"type": int, "default": 50}), ("--no-gitignore", {"action": "store_true"}), ("--files", {"action": "store_true"})]),
    "search": (_search, [("query", {}), ("--min-score", {"type": float}), *_FILTERS]),
    "similar": (_similar, [("item", {}), *_FILTERS]),
    "compare": (_compare, [("a", {}), ("b", {}), ("--text", {"action": "store_true"}), ("--pairs", {"type": int, "default": 5})]),
    "dupes": (_dupes, [("--threshold", {"type": float}), _ACROSS, ("--limit", {"type": int, "default": 50})]),
    "cluster": (_cluster, [_LEVEL, ("--k", {"default": "auto"}), ("--seed", {"type": int, "default": 0}), ("--sample", {"type": int, "default": cluster.SAMPLE}), ("--max-members", {"type": int, "default": 50}), ("--reps", {"type": int, "default": 3})]),
    "neighbors": (_neighbors, [_LEVEL, ("-k", {"type": int, "default": 10}), ("--min-score", {"type": float}), _ACROSS]),
    "outliers": (_outliers, [_LEVEL, ("--neighbors", {"type": int, "default": 5}), ("-n", {"type": int, "default": 10})]),
    "embed": (lambda spark, a: embed_text(a.text, a.query, a.model or "hash"), [("text", {}), ("--query", {"action": "store_true"})]),
    "info": (lambda spark, a: Index(spark, a.root, a.index).info(), []),
    "list": (lambda spark, a: {"indexes": list_indexes(spark, a.root)}, []),
    "drop": (_drop, [("name", {})]),
    "doctor": (lambda spark, a: health(spark if a.full else None), [("--full", {"action": "store_true"})]),
}
#: Commands that run without Spark.
PLAIN = ("embed",)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=package, description="Semantic search and similarity analysis over files.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, options in [("--root", {"default": os.environ.get("TESSELLA_ROOT", "indexes")}), ("--index", {"default": "default"}), ("--model", {}), ("--snippet", {"type": int, "default": 300}), *arguments]:
            sub.add_argument(flag, **options)
    return top


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[int, dict]:
    """(exit code, document) of a command line."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return (USAGE if e.code else DONE), {"ok": not e.code, "command": argv[0] if argv else None}
    try:
        needs = a.command not in PLAIN and not (a.command == "doctor" and not a.full) and not (a.command == "compare" and a.text)
        made = COMMANDS[a.command][0]((spark or SparkSession.builder.getOrCreate()) if needs else None, a)
        ok = not made.get("problems")
        return (DONE if ok else MISSING), {"ok": ok, "command": a.command, **made}
    except (EngineError, ValueError, FileNotFoundError) as e:
        return REFUSED, {"ok": False, "command": a.command, "error": str(e)}
    except ImportError as e:
        return MISSING, {"ok": False, "command": a.command, "error": str(e)}
    except KeyboardInterrupt:
        return INTERRUPTED, {"ok": False, "command": a.command, "error": "interrupted"}


def main() -> int:
    code, document = run(sys.argv[1:])
    print(json.dumps(document, ensure_ascii=False, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
