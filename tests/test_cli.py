import json

from twinsieve import cli


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    tree, out = tmp_path / "tree", str(tmp_path / "out")
    for name, data in {"a/x": b"same" * 9, "b/x": b"same" * 9, "b/y": b"other", "c/x": b"same" * 9}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)

    def run(*args):
        code = cli.main([*args, "--out", out, "--config", str(tmp_path / "none.toml")])
        return code, capsys.readouterr().out.strip()

    assert run("analyze-directories") == (1, "")
    for _ in range(2):  # the second run takes the hashes from the cache
        code, said = run("process", str(tree))
        got = json.loads(said)
        assert code == 0 and (got["files_walked"], got["duplicate_groups"], got["wasted_bytes"]) == (4, 1, 72)
        assert set(got["seconds"]) == {"scan", "hash", "write", "analysis"}
        spark.catalog.clearCache()
    assert run("count-hash-cache") == (0, "3")
    code, said = run("analyze-directories")
    assert code == 0 and json.loads(said)["similar_pairs"] > 0
    assert json.loads(run("print-config", "/a")[1]) == {"root_paths": ["/a"], "ignore_patterns": []}
    assert run("truncate-db", "--yes") == (0, "") and run("count-hash-cache") == (0, "0")
