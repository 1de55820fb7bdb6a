"""The command line and the entry module."""

import builtins
import importlib
import json
import sys

import pytest

import __spark_entry__
from loresmith import __main__ as commands


def test_commands(spark, tmp_path, capsys):
    commands.main(["list"])
    assert "vec_topk_scenes" in capsys.readouterr().out.split()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("mission m\n\ton offer\n\t\tconversation\n\t\t\t`Two words.`\n\t\t\t\taccept\n")
    commands.main(["inventory", f"file://{tmp_path}/d", "--out", f"file://{tmp_path}/out"])
    assert {(r.part, r.metric): r.value for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}["ALL", "conversation_words"] == 2
    commands.main(["encounters", f"file://{tmp_path}/d"])
    assert "Two words." in capsys.readouterr().out
    (tmp_path / "train.jsonl").write_text("{\n")
    with pytest.raises(SystemExit):
        commands.main(["validate", f"file://{tmp_path}/train.jsonl", "--split", "train"])
    (tmp_path / "s.jsonl").write_text(json.dumps({"sample_id": "s-1", "text": "x"}) + "\n")
    commands.main(["view", f"file://{tmp_path}/s.jsonl", f"file://{tmp_path}/page.html"])
    assert "s-1" in (tmp_path / "page.html").read_text()


def test_core_queries_stay_where_the_training_data_part_cannot_be_imported(monkeypatch):
    real = builtins.__import__

    def without(name, *rest):
        if name == "zstandard":
            raise ModuleNotFoundError("no zstandard", name="zstandard")
        return real(name, *rest)

    held = {n: sys.modules.pop(n) for n in list(sys.modules) if n.startswith(("loresmith.llm", "corpus_pipeline", "zstandard"))}
    monkeypatch.setattr(builtins, "__import__", without)
    try:
        with pytest.warns(UserWarning, match="without"):
            names = __spark_entry__.queries()
    finally:
        monkeypatch.undo()
        for n in [n for n in sys.modules if n.startswith(("loresmith.llm", "corpus_pipeline"))]:
            del sys.modules[n]
        sys.modules.update(held)
    assert "vec_topk_scenes" in names and not any(n.startswith("op2") for n in names)
    assert importlib.import_module("loresmith.catalogue").QUERIES
