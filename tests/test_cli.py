import json

from declario import cli


def test_compare_prints_every_difference(spark, tmp_path, capsys):
    for name, shift in (("a", 0), ("b", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": i, "v": i + shift}) + "\n" for i in range(150)))
    assert cli.main(["compare", str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"), "--schema", "id long, v long", "--key", "id"]) == 0
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == ["id", "path", "index", "op", "old", "new"]
    assert lines[1:-1] == [[str(i), "v", "None", "changed", str(i), str(i + 1)] for i in range(150)]
