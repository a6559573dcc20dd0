"""Documents and exit codes of the commands."""

import json
import os

import numpy as np

from tessella import cli


def test_life_of_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    os.makedirs("fx")
    for name, text in {"a.md": "# Sea\n\nThe moon pulls the sea.\n", "b.md": "# Moon\n\nThe moon pulls the sea.\n", "c.txt": "Bread needs flour and a sour starter.\n", "d.txt": ""}.items():
        open(f"fx/{name}", "w").write(text)

    def run(*argv):
        code, out = cli.run([*argv, "--root", f"file://{tmp_path}/ix"], spark)
        json.dumps(out, default=str)
        assert list(out)[:2] == ["ok", "command"] and out["ok"] == (code == 0) and out["command"] == argv[0]
        return code, out

    assert run("info")[0] == cli.REFUSED
    code, out = run("index", "fx", "--files")
    assert code == cli.DONE and (out["added"], out["chunks_embedded"], out["empty_files"]) == (4, 3, 1) and {"path": "fx/d.txt", "status": "empty"} in out["files"]
    code, out = run("search", "sour bread", "-k", "1")
    assert [h["path"] for h in out["results"]] == ["fx/c.txt"] and out["model"] == "hash" and out["results"][0]["text"].startswith("Bread")
    assert [h["path"] for h in run("similar", "fx/a.md", "-k", "1")[1]["results"]] == ["fx/b.md"]
    code, out = run("compare", "fx/a.md", "fx/b.md")
    assert out["score_kind"] and out["best_chunk_pairs"][0]["score"] == out["score"]
    assert run("compare", "one tide", "one tide", "--text")[1]["score"] == 1.0
    code, out = run("dupes", "--threshold", "0.3")
    assert (out["total_pairs"], out["shown"], out["pairs"][0]["a"]["path"]) == (1, 1, "fx/a.md")
    assert run("dupes")[1]["threshold"] == 0.9
    code, out = run("neighbors", "-k", "5")
    assert (out["k"], out["items_total"]) == (2, 3)
    assert len(run("outliers", "-n", "2", "--neighbors", "1")[1]["results"]) == 2
    assert run("cluster", "--k", "2")[1]["k"] == 2
    assert run("info")[1]["chunks"] == 3 and [x["index"] for x in run("list")[1]["indexes"]] == ["default"]
    assert run("similar", "nowhere.md")[0] == cli.REFUSED and run("index", "nowhere")[0] == cli.REFUSED
    assert run("drop", "default")[1]["dropped"] == "default" and run("drop", "default")[0] == cli.REFUSED


def test_embed_and_usage(capsys, monkeypatch):
    code, out = cli.run(["embed", "feeding the starter", "--query"])
    assert code == 0 and (out["dim"], out["kind"], out["model"]) == (2048, "query", "hash")
    assert abs(np.linalg.norm(out["vector"]) - 1) < 1e-5 and all(round(x, 6) == x for x in out["vector"])
    assert cli.run(["embed", "x", "--model", "none"])[0] == cli.REFUSED and cli.run(["embed", "x", "--model", "bge-small"])[0] == cli.REFUSED
    assert cli.run([])[0] == cli.USAGE and cli.run(["nothing"])[0] == cli.USAGE and cli.run(["search"])[0] == cli.USAGE
    code, out = cli.run(["doctor"])
    assert code == 0 and out["versions"]["pyspark"] and out["models"]["hash"]["ready"] and not out["problems"]
    flags = cli.COMMANDS["doctor"][1]
    monkeypatch.setitem(cli.COMMANDS, "doctor", (lambda spark, a: {"problems": ["no disk"]}, flags))
    assert cli.run(["doctor"]) == (cli.MISSING, {"ok": False, "command": "doctor", "problems": ["no disk"]})
    for error, want in ((ImportError("no pypdf"), cli.MISSING), (KeyboardInterrupt(), cli.INTERRUPTED)):
        def fails(spark, a, error=error):
            raise error

        monkeypatch.setitem(cli.COMMANDS, "doctor", (fails, flags))
        assert cli.run(["doctor"])[0] == want
    monkeypatch.setattr("sys.argv", ["tessella", "embed", "tide"])
    assert cli.main() == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["ok"]
