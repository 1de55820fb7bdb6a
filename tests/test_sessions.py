"""The passage index and the tools of an encounter, packs, reports and configuration."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loresmith.operators import assessment, prompts
from loresmith.operators import session as M
from loresmith.plans import report
from loresmith.sources import config, files, index


def embed(texts, kind):
    return [[1.0, 0.0] if "dragon" in t else [0.8, 0.6] if "wyrm" in t else [0.0, 1.0] for t in texts]


def scene(n, *texts, phase=None, roles=()):
    return ("m%d" % n, f"Scene {n}", "p.txt", phase, [(i + 1, t, roles[i] if i < len(roles) else "passage") for i, t in enumerate(texts)])


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = spark.createDataFrame([scene(0, "calm sea", "a dragon", "the dragon again"), scene(1, "a wyrm", phase="offer"), scene(2, "nothing", roles=["option"]), scene(3, "hidden dragon"), scene(2, "nothing", roles=["option"])], index.SCENE)
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    found = index.SceneIndex.create(rows, path, embed, "stub")
    names = {r.mission: r.scene_id for r in found.scenes.collect()}
    return found, names, rows, path


def pool(spark, names):
    return spark.createDataFrame([(names["m1"], "history", 1, 0), (names["m0"], "history", 3, 1), (names["m2"], "reference", None, 2)], "scene_id string, kind string, depth int, place int")


def test_index_is_created_once_and_checked(spark, made):
    found, names, rows, path = made
    assert len(names) == 4 and found.passages.count() == 6 and found.faults().count() == 0 and found.dimension == 2
    with pytest.raises(FileExistsError):
        index.SceneIndex.create(rows, path, embed, "stub")
    with pytest.raises(ValueError):
        index.SceneIndex(spark, path, "other")
    for bad in ([0.0, 0.0], [float("nan"), 1.0], []):
        with pytest.raises(Exception, match="vector|passage"):
            index.SceneIndex.create(rows, path + "x" + str(len(bad)) + str(bad[:1]).strip("[]"), lambda t, k, b=bad: [b] * len(t), "stub")


def test_tampered_index(spark, made):
    found, names, rows, path = made
    found = index.SceneIndex(spark, path, "stub")
    found.passages = found.passages.where("passage_index > 0").withColumn("text", F.concat("text", F.lit("!")))
    assert {r.fault for r in found.faults().collect()} == {"missing", "changed"}


def test_only_eligible_scenes_are_found(spark, made):
    found, names, *_ = made
    s = M.RetrievalSession(found, pool(spark, names), "dragon", embed)
    got = s.search_context(limit=2).collect()
    assert [(r.scene_id, r.score) for r in got] == [(names["m0"], 1.0), (names["m1"], 0.8)]
    assert s.trace[-1]["result_ids"] == [names["m0"], names["m1"]]
    assert [r.score for r in s.search_context(limit=3, expand_scenes=False).collect()] == [1.0, 1.0, 0.8]
    assert [r.scene_id for r in s.search_context(kind="reference").collect()] == [names["m2"]]
    s.selected.add(names["m0"])
    assert [r.scene_id for r in s.search_context(limit=1).collect()] == [names["m1"]]
    assert [r.scene_id for r in s.get_history(3).collect()] == [names["m1"], names["m0"]] and [r.scene_id for r in s.get_history(1).collect()] == [names["m1"]]
    assert [r.text for r in s.read_context([names["m2"], names["m1"]]).collect()] == ["Scene 2\nPlayer choice: nothing", "Scene 1 — on offer\na wyrm"]
    with pytest.raises(ValueError):
        s.read_context([names["m3"]])
    for call in (lambda: s.search_context(limit=0), lambda: s.search_context(" "), lambda: s.search_context(kind="x"), lambda: s.search_context(expand_scenes=1), lambda: s.get_history(-1), lambda: s.call_tool("drop", {}), lambda: s.call_tool("get_history", {"x": 1})):
        with pytest.raises(ValueError):
            call()
    assert [r.scene_id for r in s.call_tool("get_history", {"depth": 1}).collect()] == [names["m1"]]
    with pytest.raises(ValueError):
        M.RetrievalSession(found, spark.createDataFrame([("scene-none", "history", 1, 0)], "scene_id string, kind string, depth int, place int"), "x", embed)


def test_static_context_passes_over_what_does_not_fit(spark, made):
    found, names, *_ = made
    s = M.RetrievalSession(found, pool(spark, names), "dragon", embed)
    size = F.length("text")
    lengths = {r.scene_id: len(r.text) for r in s._documents().collect()}
    all_but_long = lengths[names["m1"]] + lengths[names["m2"]]
    assert [r.scene_id for r in s.static_context(size, sum(lengths.values()), 4).collect()] == [names["m1"], names["m0"], names["m2"]]
    assert [r.scene_id for r in s.static_context(size, all_but_long + 5, 4, fixed=5).collect()] == [names["m1"], names["m2"]]
    assert [r.scene_id for r in s.static_context(size, lengths[names["m0"]], 0).collect()] == [names["m0"]]
    with pytest.raises(ValueError):
        s.static_context(size, 10, 4, fixed=11)


def test_evidence_must_be_what_was_shown(spark, made):
    found, names, *_ = made
    s = M.RetrievalSession(found, pool(spark, names), "dragon", embed)
    shown = s._documents().select("scene_id", "kind", "text")
    assert M.evidence_faults(shown, s).count() == 0
    forged = shown.withColumn("text", F.when(F.col("kind") == "reference", "x").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(names["m3"], "history", "t")], "scene_id string, kind string, text string"))
    assert {(r.scene_id, r.fault) for r in M.evidence_faults(forged, s).collect()} == {(names["m2"], "text differs"), (names["m3"], "not eligible")}


    again = M.evidence_faults(shown, s, spark.createDataFrame([(names["m1"],), (names["m3"],)], "scene_id string"))
    assert Counter(r.fault for r in again.collect()) == {"selected, not returned": 1, "returned, not selected": 2}


def test_the_whole_prompt_is_measured(spark, made):
    found, names, *_ = made
    s = M.RetrievalSession(found, pool(spark, names), "dragon", embed)
    whole = s.messages_for([names["m2"], names["m0"], names["m1"]], "Begin.")
    assert whole == "Begin.\n\nEarlier passages:\nScene 1 — on offer\na wyrm\n\nScene 0\ncalm sea\n\na dragon\n\nthe dragon again\n\nOther game scenes (independent writing references):\nScene 2\nPlayer choice: nothing"
    count = lambda texts: [len(t) for t in texts]
    assert s.static_messages(count, len(whole) + 6, 4, "Begin.") == whole and s.trace[-1]["input_tokens"] == len(whole) + 6
    two = s.messages_for([names["m1"], names["m0"]], "Begin.")
    assert s.static_messages(count, len(whole) + 5, 4, "Begin.") == two
    assert s.static_messages(count, len(two) + 5, 4, "Begin.") == s.messages_for([names["m1"]], "Begin.") and s.trace[-1]["result_ids"] == [names["m1"]]
    with pytest.raises(ValueError, match="exceed"):
        s.static_messages(count, 5, 4, "Begin.")
    with pytest.raises(ValueError, match="eligible"):
        s.messages_for([names["m3"]])
    s.search_context(limit=2)
    assert len(s.trace[-1]["matched_passages"]) == 2


def test_tool_calls_are_played_again(spark, made):
    found, names, *_ = made
    s = M.RetrievalSession(found, pool(spark, names), "dragon", embed)
    told = M.replay(s, [[{"name": "search_context", "arguments": '{"limit": 1}'}, {"name": "search_context", "arguments": {"limit": 1}}], [{"name": "read_context", "arguments": {"ids": [names["m3"]]}}]], lambda turns: True)
    shown = [[d["scene_id"] for d in r.get("documents", [])] for t in told["turns"] for r in t["results"]]
    assert shown == [[names["m0"]], [names["m1"]], []] and "eligible" in told["turns"][1]["results"][0]["error"] and told["selected_scene_ids"] == sorted([names["m0"], names["m1"]])
    result = M.packed_results([{"n": 3}, {"n": 9}, {"n": 2}], lambda r: sum(d["n"] for d in r["documents"]) <= 5)
    assert result == {"documents": [{"n": 3}, {"n": 2}], "omitted_documents": 1}
    with pytest.raises(ValueError, match="budget"):
        M.replay(s, [], lambda turns: False)


def test_prompts_of_many_samples(spark):
    pools = spark.createDataFrame([("a", "P", "enc"), ("b", "", "")], "sample_id string, system_prefix string, encounter string")
    ranked = spark.createDataFrame([("a", "s1", "history", 2, 1, "x" * 30), ("a", "s2", "history", 1, 2, "y" * 200), ("a", "s3", "reference", 3, 3, "z")], "sample_id string, scene_id string, kind string, place int, rank int, text string")
    got = {r.sample_id: r for r in prompts.packed_prompts(pools, ranked, lambda ts: [len(t) for t in ts], 120).collect()}
    assert got["a"].scene_ids == ["s1", "s3"] and got["a"].input_tokens == len(got["a"].system) + 3 <= 120 and got["b"].scene_ids == [] and got["b"].system == ""
    with pytest.raises(Exception, match="exceed the budget"):
        prompts.packed_prompts(pools, ranked, lambda ts: [len(t) for t in ts], 3).collect()
    chunks = prompts.pool_prompts(pools, ranked).where("sample_id = 'a'").first().system
    assert chunks == prompts.rendered("P", [(r.kind, r.place, r.text) for r in ranked.collect()])


def test_packs_hide_keys(spark, tmp_path):
    rows = spark.createDataFrame([("x", k, "id", "ok", f"c{k}", f"target {k}", f"response {k}", None) for k in range(5)] + [("x", 0, "id", "failed", "c", "t", "r", None), ("x", 1, "id", "ok", "c1", "target 1", "target 1", "identical")], "condition string, sample_id long, identity string, status string, context string, target string, response string, control string")
    trials = assessment.assembled(rows).cache()
    cover = spark.createDataFrame([("x", 0, "ok")], "condition string, sample_id long, status string")
    report.write_pack(trials, cover, f"file://{tmp_path}/p")
    public = spark.read.json(f"file://{tmp_path}/p/public")
    assert set(public.columns) == {"trial_id", "context", "A", "B", "stage"} and public.count() == 6
    told = {r.trial_id: r for r in spark.read.json(f"file://{tmp_path}/p/private").collect()}
    for r in public.collect():
        key = told[r.trial_id]
        assert (r.A == r.B and key.original is None) if r.stage == "controls" else r[key.original] == f"target {key.sample_id}"
    assert abs(sum(k.original == "A" for k in told.values()) - sum(k.original == "B" for k in told.values())) == 1
    assert spark.read.json(f"file://{tmp_path}/p/templates").where("status = 'missing'").count() == 6 and (tmp_path / "p" / "review-primary.html").exists()
    responses = rows.where("status = 'ok' AND control IS NULL")
    assert assessment.trial_faults(public, spark.read.json(f"file://{tmp_path}/p/private"), responses).count() == 0
    forged = public.withColumn("A", F.when(F.col("context") == "c2", "forged").otherwise(F.col("A")))
    assert [r.fault for r in assessment.trial_faults(forged, spark.read.json(f"file://{tmp_path}/p/private"), responses).collect()] == ["hash differs"]
    with pytest.raises(Exception, match="exists"):
        report.write_pack(trials, cover, f"file://{tmp_path}/p")


def test_reports_and_pages(spark, tmp_path):
    rows = spark.createDataFrame([("a", "correct"), ("a", "failed"), ("b", "missing")], "k string, outcome string")
    as_json, table = report.outcome_report(rows, ["k"])
    assert json.loads(as_json)[0]["accuracy"] == 1.0 and "| b |" in table and "–" in table
    hostile = "</script><b>"
    assert hostile not in report.review_page([{"A": hostile}]) and hostile not in report.sample_page([{"sample_id": hostile}], [{"name": hostile, "responses": {}}])
    with pytest.raises(ValueError, match="group"):
        report.review_page([{}, {}], ["g", "g"])
    tallies = assessment.tally(rows.withColumnRenamed("k", "condition"), ["condition"])
    report.write_report(spark, f"file://{tmp_path}", {"results": tallies, "coverage": spark.createDataFrame([], "condition string, identity string")}, {"pack": "p"})
    told = json.loads((tmp_path / "report.json").read_text())
    assert [r["condition"] for r in told["results"]] == ["a", "b"] and told["coverage"] == [] and "## Generation coverage\n\nNone." in (tmp_path / "report.md").read_text()
    with pytest.raises(FileExistsError):
        report.write_report(spark, f"file://{tmp_path}", {})
    samples = spark.createDataFrame([("s2", "x"), ("s1", "y")], "sample_id string, evaluation string")
    assert report.write_sample_page(samples, f"file://{tmp_path}/v.html", {"r": spark.createDataFrame([("s1", "ok", "text", None)], files.RESPONSE.split(", finish")[0])}) == 2
    assert "evaluation" not in (tmp_path / "v.html").read_text()


def test_files_of_results(spark, tmp_path):
    here = f"file://{tmp_path}"
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.read_rows(spark, f"{here}/rows.jsonl", "a int").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="Malformed|MALFORMED|malformed"):
        files.read_rows(spark, f"{here}/bad.jsonl", "a int").collect()
    files.create_json(spark, f"{here}/one.json", {"a": 3})
    assert files.read_json(spark, f"{here}/one.json") == {"a": 3} and files.read_documents(spark, f"{here}/one.json", "a int").first().a == 3
    with pytest.raises(FileExistsError):
        files.create_json(spark, f"{here}/one.json", {})
    for k in range(3):
        files.replace_json(spark, f"{here}/progress.json", {"done": k})
    assert files.read_json(spark, f"{here}/progress.json") == {"done": 2} and not (tmp_path / "progress.json.tmp").exists()
    df = spark.createDataFrame([("é", None)], "b string, a string")
    for _ in range(2):
        files.append_rows(df, f"{here}/log")
    assert [r.value for r in spark.read.text(f"{here}/log").collect()] == ['{"a": null, "b": "é"}'] * 2


def test_runs_of_both_layouts(spark, tmp_path):
    here = f"file://{tmp_path}"
    samples = spark.createDataFrame([("s-1",), ("s-2",), ("s-3",)], "sample_id string")
    run = tmp_path / "run"
    run.mkdir()
    lines = '{"sample_id": "s-2", "status": "ok", "response": "text"}\n\n{"sample_id": "s-1", "status": "failed", "error": "e"}\n'
    (run / "responses.jsonl").write_text(lines)
    told = {"schema_version": 1, "status": "complete", "dataset": {"manifest_sha256": "m", "sample_ids": ["s-2", "s-3", "s-1"]}, "artifacts_sha256": {"responses.jsonl": hashlib.sha256(lines.encode()).hexdigest()}}
    (run / "run.json").write_text(json.dumps(told))
    info, rows = files.viewer_run(spark, f"{here}/run", "m", samples)
    assert info["status"] == "complete" and [(r.sample_id, r.status) for r in rows.orderBy("place").collect()] == [("s-2", "ok"), ("s-3", None), ("s-1", "failed")] and files.by_status(rows) == {"ok": 1, "failed": 1, "missing": 1}
    with pytest.raises(ValueError, match="another dataset"):
        files.viewer_run(spark, f"{here}/run", "other", samples)
    with pytest.raises(ValueError, match="unknown"):
        files.viewer_run(spark, f"{here}/run", "m", samples.limit(1))
    (run / "responses.jsonl").write_text(lines + lines)
    with pytest.raises(ValueError, match="recorded"):
        files.viewer_run(spark, f"{here}/run", "m", samples)
    (run / "run.json").write_text(json.dumps({**told, "artifacts_sha256": {}}))
    with pytest.raises(Exception, match="more than one response"):
        files.viewer_run(spark, f"{here}/run", "m", samples)[1].collect()
    (tmp_path / "bench" / "x").mkdir(parents=True)
    (tmp_path / "bench" / "selection.json").write_text(json.dumps({"manifest_sha256": "m", "ids": ["s-3", "s-1"]}))
    (tmp_path / "bench" / "x" / "s-1.result.json").write_text(json.dumps({"status": "ok", "response": "r"}))
    info, rows = files.viewer_run(spark, f"{here}/bench/x", "m", samples)
    assert info["name"] == "x" and [(r.sample_id, r.response) for r in rows.orderBy("place").collect()] == [("s-3", None), ("s-1", "r")]


def test_configuration(tmp_path):
    (tmp_path / "c.toml").write_text('[a]\nb = "x"\n')
    assert config.load_config(tmp_path / "c.toml") == {"a": {"b": "x"}}
    (tmp_path / "c.toml").write_text('[a]\nb = "<fill>"\n')
    with pytest.raises(ValueError, match="a.b"):
        config.load_config(tmp_path / "c.toml")
    (tmp_path / "env").write_text("X=1\nKEY = 'v'\n")
    assert config.load_key(tmp_path / "env", "KEY") == "v"
    with pytest.raises(KeyError):
        config.load_key(tmp_path / "env", "Z")
    assert config.allowed_models(["m-2", "m-1", "m-1-audio", "z"], ("m-",), ("audio",)) == ["m-1", "m-2"]
