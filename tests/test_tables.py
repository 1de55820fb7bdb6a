"""Every registered query against its SQL, and rules on small tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loresmith import catalogue
from loresmith.operators import assessment, contracts, datasets, graphs, ledger, prefix, retrieval, selection, shared

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    told = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(told.columns) == cols
    at = [told.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in told.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 25


def test_hidden_scene_is_never_ranked_and_ties_go_by_id(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.8, 0.6]), (4, 3, [0.0, 1.0])], "vec_id int, label int, embedding array<double>")
    assert [tuple(r) for r in retrieval.top_scenes(rows, [1.0, 0.0], 2).collect()] == [(1, 1, 1.0), (2, 3, 0.8)]
    assert [r.vec_id for r in retrieval.top_passages(rows, [1.0, 0.0], 3).collect()] == [1, 2, 3]
    for bad in (0, 101, True, 2.0):
        with pytest.raises(ValueError):
            retrieval.check_limit(bad)


def test_scores_of_unsound_vectors_are_null(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [4.0, 3.0]), (6, [float("nan"), 1.0])], "i int, v array<double>").coalesce(1)
    assert [r.s for r in rows.orderBy("i").select(retrieval.scores(F.col("v"), [[1.0, 0.0], [0.0, 2.0]]).alias("s")).collect()] == [[0.6, 0.8], None, None, None, [0.8, 0.6], None]
    assert [r.s for r in rows.where("i IN (1, 5)").select(retrieval.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("s")).collect()] == [0.6, 0.8]


def test_vectors_that_cannot_be_indexed(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, None)], "i int, v array<double>")
    got = {r.i: r.f for r in rows.select("i", retrieval.vector_fault(F.col("v"), 2).alias("f")).collect()}
    assert got == {1: None, 2: "zero norm", 3: "not finite", 4: "not finite", 5: "dimension", 6: "empty", 7: "empty"}


def test_conversation_rules(spark):
    def fault(*turns):
        df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")
        whole = contracts.turns(df).select(contracts.conversation_fault(F.col("messages")).alias("f")).first().f
        assert contracts.conversation_faults(df).first().fault == whole
        return whole

    u, a, s = ("user", "hi"), ("assistant", "yes"), ("system", "be")
    assert fault(u, a) is None and fault(s, u, a, u, a) is None
    assert fault(u) == "pairs" and fault(a, u) == "pairs" and fault(u, a, u) == "pairs" and fault(s) == "pairs"
    assert fault(u, s, a) == "system" and fault(("npc", "x"), a) == "role" and fault((None, "x"), a) == "role" and fault(("user", "  \n"), a) == "blank" and fault(("user", None), a) == "blank"


def test_slugs(spark):
    rows = spark.createDataFrame([("a-b_c1",), ("a--b",), ("A",), ("a\n",), ("",), ("-a",)], "s string")
    assert [r.ok for r in rows.select(F.col("s").rlike(contracts.SLUG).alias("ok")).collect()] == [True, False, False, False, False, False]


def test_tally_denominators(spark):
    rows = spark.createDataFrame([(x,) for x in ("correct", "incorrect", "abstained", "failed", "missing")], "outcome string")
    r = assessment.tally(rows).first()
    assert (r.accuracy, r.abstained_rate, r.scheduled) == (0.5, 0.2, 5)
    r = assessment.tally(rows.where("outcome = 'failed'")).first()
    assert r.accuracy is None and r.failed_rate == 1.0


def test_bootstrap_needs_two_groups(spark, monkeypatch):
    rows = spark.createDataFrame([("a", float(i % 2)) for i in range(20)], "g string, v double")
    one = assessment.cluster_bootstrap(rows, "g", "v", repetitions=200).first()
    assert (one.groups, one.low, one["mean"]) == (1, None, 0.5)
    more = rows.unionByName(spark.createDataFrame([("b", 1.0)] * 20 + [("c", None)], "g string, v double"))
    first, second = (assessment.cluster_bootstrap(more, "g", "v", repetitions=200).first() for _ in range(2))
    assert first == second and first.groups == 3 and first.contributing == 2 and 0.5 <= first.low <= first["mean"] <= first.high <= 1
    monkeypatch.setattr(assessment, "EXACT_GROUPS", 2)
    many = assessment.cluster_bootstrap(more, "g", "v", repetitions=200).first()
    assert many.groups == 3 and 0.5 <= many.low <= many.high <= 1
    exact = assessment.bootstrap_exact({"a": [0.0, 1.0], "b": [1.0], "c": [None]}, 200)
    assert exact["groups"] == 3 and exact["interval"][0] <= exact["interval"][1] and assessment.bootstrap_exact({"a": [1.0]}, 50)["interval"] is None


def test_known_bootstrap_interval_agrees_with_exact_draws(spark):
    groups = {f"g{i}": [float((i * 7 + j) % 3 == 0) for j in range(1 + i % 5)] for i in range(60)}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    ours = assessment.cluster_bootstrap(rows, "g", "v").first()
    low, high = assessment.bootstrap_exact(groups)["interval"]
    assert abs(ours.low - low) < 0.03 and abs(ours.high - high) < 0.03


def test_distances_in_a_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "a")], "source string, target string")
    got = {r.node: r.distance for r in graphs.distances(edges, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 3}


@pytest.mark.parametrize("seed", range(2))
def test_distances_from_all_and_some_starts_against_search(spark, monkeypatch, seed):
    import random

    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(50)) for _ in range(60)} | {(100 + i, 100 + (i + 1) % 12) for i in range(12)} | {(200, 201)}

    def search(start):
        found, frontier = {start: 0}, [start]
        for node in frontier:
            for a, b in edges:
                if a == node and b not in found:
                    found[b] = found[node] + 1
                    frontier.append(b)
        return found

    plans, dealt = [], graphs.dealt
    monkeypatch.setattr(graphs, "tasks_for", lambda spark, rows: 5)
    monkeypatch.setattr(graphs, "dealt", lambda df, *x: plans.append(df._jdf.queryExecution().executedPlan().toString()) or dealt(df, *x))
    links = spark.createDataFrame(sorted(edges), "source long, target long")
    for starts in ({a for a, _ in edges}, {100, 3, 999}):
        df = graphs.distances(links, spark.createDataFrame([(x,) for x in starts], "start long"))
        got = [(r.start, r.node, r.distance) for r in df.collect()]
        assert sorted(got) == sorted((x, n, d) for x in starts for n, d in search(x).items())
    assert len(plans) > 8 and max(p.count("Exchange ") for p in plans) == 1


def test_distance_band_shuffles_only_what_is_handed_over(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, k % 7) for k in range(70)] + [(99, 50)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    plans, dealt = [], graphs.dealt
    monkeypatch.setattr(graphs, "tasks_for", lambda spark, rows: 5)
    monkeypatch.setattr(graphs, "dealt", lambda df, *x: plans.append(df._jdf.queryExecution().executedPlan().toString()) or dealt(df, *x))
    got = {r.centre: r.systems for r in graphs.distance_band(spark, str(tmp_path)).collect()}
    assert got == {c: 10 for c in range(7)} | {(1 << 40) + k: 10 for k in range(70)} | {50: 1, (1 << 40) + 99: 1}
    # Links, starts and the pairs at 0 steps, then three rounds: nothing was left to compare with all that was seen.
    assert len(plans) == 6 and all(p.count("Exchange ") == 1 for p in plans[3:])


def test_ancestors_and_cycles(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    starts = spark.createDataFrame([("c",)], "start string")
    assert {(r.node, r.level) for r in graphs.ancestors(edges, starts).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(ValueError, match="cyclic"):
        graphs.ancestors(edges.unionByName(spark.createDataFrame([("a", "c")], "child string, parent string")), starts)


@pytest.mark.parametrize("seed", range(4))
def test_components_against_union_find(spark, seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(15)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_deal_rows_by_their_count_and_hot_nodes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graphs, "TASK_ROWS", 40)
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    edges = [(500, i) for i in range(100, 300)] + [(i, i + 1000) for i in range(100, 300)] + [(7, 100), (7, 900)] + [(3, 3), (2000, 2001)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame(edges, "a int, b int")
    parts = []
    dealing = graphs.dealing
    monkeypatch.setattr(graphs, "dealing", lambda s, n, **k: parts.append(n) or dealing(s, n, **k))
    got = {r.node: r.component for r in graphs.components(df).collect()}
    assert got == {x: 3 if x == 3 else 2000 if x >= 2000 else 7 for e in edges for x in e}
    assert set(parts) == {-(-len(edges) // 40)} and spark.conf.get("spark.sql.shuffle.partitions") == held
    assert {r.a for r in graphs.hot_keys(df, "a", 11).collect()} == {500} and graphs.hot_keys(df, "b", 11) is None


def test_greedy_packing_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", 1, 6), ("g", 2, 7), ("g", 3, 3), ("g", 4, 1), ("g", 5, 1), ("h", 6, 99), ("h", 7, 10)], "g string, i long, n long")
    got = {r.g: (r.used, r.ids) for r in selection.greedy_pack(rows, "g", ["i"], "n", "i", 10).collect()}
    assert got == {"g": (10, [1, 3, 4]), "h": (10, [7])}


@pytest.mark.parametrize("seed", range(5))
def test_greedy_packing_against_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [("g", i, rng.randint(1, 14)) for i in range(80)]
    used, ids = 0, []
    for _, i, n in rows:
        if used + n <= 40:
            used, ids = used + n, [*ids, i]
    got = selection.greedy_pack(spark.createDataFrame(rows, "g string, i long, n long"), "g", ["i"], "n", "i", 40).first()
    assert (got.used, got.ids) == (used, ids)


def test_greedy_packing_keeps_groups_and_takes_what_is_free(spark):
    rows = spark.createDataFrame([("g", 1, 0), ("g", 2, 7), ("g", 3, 5), ("g", 4, 0), ("h", 5, 99), ("n", 6, None), (None, 7, 0)], "g string, i long, n long")
    assert {r.g: (r.used, r.ids) for r in selection.greedy_pack(rows, "g", ["i"], "n", "i", 10).collect()} == {"g": (7, [1, 2, 4]), "h": (0, []), "n": (0, []), None: (0, [7])}
    with pytest.raises(Exception, match="below 0"):
        selection.greedy_pack(spark.createDataFrame([("g", 1, -1)], "g string, i long, n long"), "g", ["i"], "n", "i", 10).collect()


def test_a_run_stops_at_the_first_request_beyond_its_budget(spark):
    rows = [("u", 1, 1, 40, 10), ("u", 2, 1, 40, None), ("u", 3, 2, 60, 5), ("u", 4, 2, 1, 1), ("v", 5, 1, 100, 100), ("v", 6, 3, 1, None), ("w", 7, 1, 101, 0)]
    df = spark.createDataFrame(rows, "user string, request_id long, day long, reserved long, cost long")
    for part in (None, F.col("day")):
        got = {r.request_id: (r.spent_before, r.admitted) for r in ledger.admitted(df, ["user"], ["request_id"], 100, part).collect()}
        assert got == {1: (0, True), 2: (10, True), 3: (50, False), 4: (50, False), 5: (0, True), 6: (100, False), 7: (0, False)}
    with pytest.raises(ValueError, match="result"):
        ledger.with_results(df.select("request_id", "reserved"), spark.createDataFrame([(99, 1, "ok")], "request_id long, cost long, status string"))


@pytest.mark.parametrize("seed", range(2))
def test_running_totals_by_parts(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, i // 7, rng.choice([None, 1, 2, 5])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i long, p long, v long")
    for inclusive in (True, False):
        want, at = {}, {}
        for k, i, _, v in rows:
            want[i] = at.get(k, 0) + (v or 0) * inclusive
            at[k] = at.get(k, 0) + (v or 0)
        for part in (None, F.col("p")):
            assert {r.i: r.t for r in prefix.running_sums(df, ["k"], ["i"], {"t": F.col("v")}, part, inclusive).collect()} == want


def test_what_must_be_refused(spark):
    trials = spark.createDataFrame([("t1", "h1"), ("t2", "h2")], "trial_id string, trial_sha256 string")
    judged = lambda *rows: assessment.joined_judgments(spark.createDataFrame(rows, "reviewer string, trial_id string, trial_sha256 string"), trials, ["reviewer"]).collect()
    assert len(judged(("a", "t1", "h1"), ("b", "t1", "h1"))) == 2
    for rows, told in (([("a", "t9", "h1")], "unknown trial: t9"), ([("a", "t1", "h1")] * 2, "judged twice: t1"), ([("a", "t2", "h1")], "hash differs: t2")):
        with pytest.raises(Exception, match=told):
            judged(*rows)
    plan = spark.createDataFrame([(0, "q"), (1, "r")], "position int, query string")
    assert assessment.met_by_position(plan, plan, plan, ["query"]).count() == 2
    for other in (plan.limit(1), plan.withColumn("query", F.lit("z")), plan.unionByName(plan)):
        with pytest.raises(Exception, match="position"):
            assessment.met_by_position(plan, plan, other, ["query"]).collect()
    for ids in ([1, 1], [9]):
        with pytest.raises(ValueError):
            selection.selected(spark.range(3), ids, "id")
    files = lambda *rows: assessment.merged_reviews(spark.createDataFrame(rows, "reviewer string, file string, trial_id string, model string, prompt_sha256 string"), ["model", "prompt_sha256"]).count()
    assert files(("a", "1", "t1", "m", "p"), ("a", "2", "t2", "m", "q")) == 2
    for rows, told in (([("a", "1", "t1", "m", "p"), ("a", "2", "t2", "n", "p")], "differ"), ([("a", "1", "t1", "m", "p"), ("a", "2", "t1", "m", "p")], "twice")):
        with pytest.raises(Exception, match=told):
            files(*rows)
    samples = spark.createDataFrame([("c", 1, "i", "x", "t1"), ("c", 2, "i", "x", "t2")], "condition string, sample_id long, identity string, context string, target string")
    donors = lambda *rows: assessment.controls(samples, spark.createDataFrame(rows, "sample_id long, donor_id long")).collect()
    assert {(r.sample_id, r.control, r.response) for r in donors((1, 2), (2, 1))} == {(1, "identical", "t1"), (2, "identical", "t2"), (1, "wrong-context", "t2"), (2, "wrong-context", "t1")}
    for bad in ((1, 1), (1, 7)):
        with pytest.raises(Exception, match="donor"):
            donors(bad)
    one = spark.createDataFrame([(1, 0, "a")], "scene_id long, passage_index int, text string")
    with pytest.raises(Exception, match="do not meet"):
        retrieval.aligned(one, one.withColumn("passage_index", F.lit(1))).collect()


def test_judgments_may_not_say_what_the_organiser_says(spark):
    base = '{"trial_id": "t", "trial_sha256": "h", "status": "ok", "choice": "A", "confidence": 0.5, "reason": "r", "recognized_source": %s%s}'
    rows = [(base % ("true", ""), None), (base % ("1", ""), "recognition"), (base % ('"true"', ""), "recognition"), (base % ("false", ', "condition": "x"'), "field of the organiser")]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("p", F.from_json("raw", assessment.JUDGMENT)).select("raw", "want", "p.*")
    for r in df.select("want", assessment.judgment_fault(F.col("raw")).alias("fault")).collect():
        assert r.fault == r.want


def test_pairs_count_over_what_was_to_be_covered(spark):
    values = spark.createDataFrame([("r", 1, "a", 0), ("r", 1, "b", 1), ("r", 2, "a", 1), ("r", 2, "b", 1), ("r", 3, "a", 1), ("r", 9, "a", 1)], "reviewer string, sample_id long, condition string, value int")
    universe = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "sample_id long")
    r = assessment.paired_differences(values, universe, ("a", "b"), ["reviewer"]).first()
    assert (r.complete, r.incomplete, r.difference) == (2, 2, 0.5)


def test_eligible_references(spark):
    columns = "scene_id long, mission string, path string, line int, scenario_group string, conversation_id string, split string, owner_split string"
    rows = [(1, "n", "p", 5, None, "c", "train", None), (2, "n", "q", 5, None, "c", "train", None), (3, "m", "p", 1, None, "c", "train", None), (4, "up", "p", 9, None, "c", "train", None), (5, "n", "p", 7, "g", "c", "train", None), (6, "n", "p", 8, None, "c", "train", None), (7, "n", "p", 10, None, "c", "test", None), (8, "n", "p", 11, None, "c", None, "test")]
    target = spark.createDataFrame([("m", "p", 1, "g", "target"), ("up", "p", 2, None, "ancestor")], "mission string, path string, line int, scenario_group string, role string")
    seen = spark.createDataFrame([("p", 8)], "path string, line int")
    got = {r.scene_id: r.fault for r in contracts.eligible_references(spark.createDataFrame(rows, columns), target, seen, "validation").collect()}
    assert got == {1: None, 2: "other file", 3: "target", 4: "ancestor", 5: "same scenario", 6: "shown", 7: "later split", 8: "later split"}


def test_costs(spark):
    one = spark.range(1)
    cost = ledger.actual_cost(F.lit(1000), F.lit(100), F.lit(200), 2.0, 0.2, 10.0)
    assert abs(one.select(cost.alias("c")).first().c - 0.00382) < 1e-12
    assert one.select(ledger.actual_cost(F.lit(None).cast("int"), F.lit(1), F.lit(1), 1.0, 1.0, 1.0).alias("c")).first().c is None


def test_sides_differ_by_one_at_most(spark):
    rows = spark.range(101).select(F.col("id").alias("doc_id"), (F.col("id") < 70).cast("int").alias("k"))
    got = {(r.k, r.side): r["count"] for r in selection.balanced_sides(rows, ["k"]).groupBy("k", "side").count().collect()}
    assert got == {(1, "A"): 35, (1, "B"): 35, (0, "A"): 16, (0, "B"): 15}


def test_needles_in_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a stone lamp"), (2, None), (3, "lam"), (4, "")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "lamp"), (2, "stone"), (3, "lamp"), (4, "river"), (5, ""), (6, None)], "item_id long, text string")
    for _ in range(2):  # by an automaton, then by hashes of places and an automaton for the short ones
        got = {tuple(r) for r in contracts.contained(docs, needles).collect()}
        assert got == {(1, 1), (1, 2), (1, 3)} and contracts.contained(docs, needles.limit(0)).count() == 0
        monkeypatch.setattr(contracts, "NEEDLE_BYTES", 3)
        monkeypatch.setattr(contracts, "ANCHOR", 5)
    targets = spark.createDataFrame([(1, "one\n\n  two \n\n\n\n"), (2, None), (3, "\u00a0")], "item_id long, text string")
    assert {tuple(r) for r in contracts.paragraphs(targets, "item_id").collect()} == {(1, "one"), (1, "two")}


def test_faults_of_a_dataset(spark):
    columns = "id string, split string, mission string, conversation_id string, scenario_group string, location string"
    sound = [("a", "train", "m", "c", None, "f:1"), ("b", "train", "m", "c2", None, "f:2"), ("d", "test", "n", "c3", None, "g:1")]
    missions = spark.createDataFrame([("m", "train"), ("n", "test")], "mission string, split string")
    faults = lambda rows, names="abd": {(r.kind, r.name) for r in datasets.dataset_faults(spark.createDataFrame(rows, columns), spark.createDataFrame([(x,) for x in names], "id string"), missions).collect()}
    assert faults(sound) == set()
    assert faults([*sound, ("a", "train", "m", "c", None, "f:9")]) == {("duplicate id", "a")}
    assert faults([*sound[:2], ("d", "test", "n", "c", "g", "g:1")]) == {("conversation_id crosses splits", "c")}
    assert faults([*sound[:2], ("d", "train", "n", "c3", None, "g:1")]) == {("split differs from its mission's", "d")}
    assert faults(sound, "abx") == {("no provenance", "d"), ("provenance of no record", "x")}


def test_names_as_whole_words(spark):
    df = spark.createDataFrame([("to St. Ives (old)",), ("StxIves (old)",), ("éSt. Ives (old)",), ("St. Ives (old)!",)], "t string")
    assert [r.x for r in df.select(datasets.mentions(F.col("t"), "St. Ives (old)").alias("x")).collect()] == [True, False, False, True]


def test_conversations_of_two_splits(spark):
    users = spark.createDataFrame([("talk", ["a", "b"]), ("other", ["a"])], "conversation string, missions array<string>")
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "mission string, split string")
    assert [r.conversation for r in datasets.conversation_owner_faults(users, splits).collect()] == ["talk"]
    assert [r.group for r in datasets.repeated_groups(spark.createDataFrame([(1,), (1,), (2,)], "group int")).collect()] == [1]
    assert datasets.settings_differences({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}, ("a", "b")) == ["b"]


def _least_of_groups(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_graph_queries_over_all_rows(spark, duck):
    import hashlib

    lines = duck.sql("SELECT l_orderkey, l_partkey + (1::BIGINT << 40) FROM lineitem").fetchall()
    got = {r.node: r.component for r in catalogue.QUERIES["connected_groups"](spark, DATA).collect()}
    assert got == {k: v for k, v in _least_of_groups(lines).items() if k < 1 << 40}
    parts = [p for (p,) in duck.sql("SELECT p_partkey FROM part").fetchall()]
    want = {}
    for p, chain in _least_of_groups([(p, p + 7) for p in parts]).items():
        if p % 3:
            share = int(hashlib.sha256(str(p).encode()).hexdigest()[:8], 16) % 10
            want.setdefault(chain, set()).add("train" if share < 8 else "validation" if share == 8 else "test")
    got = {r.chain: r.splits for r in catalogue.QUERIES["chain_splits"](spark, DATA).collect()}
    assert got == {k: len(v) for k, v in want.items() if len(v) > 1}
    starts = {r.start for r in catalogue.QUERIES["bfs_distance"](spark, DATA).select("start").distinct().collect()}
    assert starts == set(parts)
    orders, customers = duck.sql("SELECT count(*), count(DISTINCT o_custkey) FROM orders").fetchall()[0]
    assert catalogue.QUERIES["distance_band"](spark, DATA).count() == orders + customers


@pytest.mark.parametrize("by_scene", [False, True])
def test_all_queries_are_answered_in_blocks(spark, monkeypatch, by_scene):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 4)
    draw = np.random.default_rng(3)
    vectors = [(i, int(draw.integers(5)), [float(x) for x in draw.integers(-2, 3, 3)]) for i in range(300)]
    rows = spark.createDataFrame([*vectors, (900, 1, None), (901, 1, [1.0])], "vec_id int, label int, embedding array<float>").repartition(5)
    got = {(r.query_id, r.place): (r.label, r.vec_id, r.score) for r in retrieval.top_by_query(rows.where("vec_id % 30 = 0"), rows, 4, by_scene, others_only=True).collect()}
    want = {}
    for q, _, a in vectors:
        if q % 30 == 0 and any(a):
            scored = sorted((-round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9) + 0.0, i, label) for i, label, b in vectors if i != q and any(b))
            firsts = [x for k, x in enumerate(scored) if not by_scene or x[2] not in {y[2] for y in scored[:k]}]
            want.update({(q, k + 1): (label, i, -s + 0.0) for k, (s, i, label) in enumerate(firsts[:4])})
    assert got == want
