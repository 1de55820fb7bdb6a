"""The retrieval tools of one encounter: only what its pool admits can be found or read."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.index import Embed, SceneIndex
from .prompts import Count, block_text, rendered
from .retrieval import check_limit, score
from .selection import greedy_pack
from .shared import staged

KINDS = ("all", "history", "reference")
NEED_NOT = "Independent writing reference; not current playthrough history."


def tool_schemas() -> list[dict]:
    """What a caller may ask for, as JSON schemas."""
    integer = {"type": "integer"}
    told = {
        "get_history": ({"depth": integer | {"minimum": 0}}, ["depth"]),
        "search_context": ({"query": {"type": "string"}, "kind": {"enum": list(KINDS)}, "limit": integer | {"minimum": 1, "maximum": 100}, "expand_scenes": {"type": "boolean"}}, []),
        "read_context": ({"ids": {"type": "array", "items": {"type": "string"}}}, ["ids"]),
    }
    return [{"name": n, "parameters": {"type": "object", "properties": p, "required": r, "additionalProperties": False}} for n, (p, r) in told.items()]


class RetrievalSession:
    """``pool``: (scene_id, kind, depth, place) of the scenes that the encounter may use; ``depth`` is null where it is not known.

    Eligibility is a semi-join below every ranking, so nothing else is ever
    scored.  Each call is kept in ``trace``.
    """

    def __init__(self, index: SceneIndex, pool: DataFrame, encounter: str, embed: Embed):
        self.index, self.encounter, self.embed = index, encounter, embed
        self.pool = pool.select("scene_id", "kind", "depth", "place")
        absent = self.pool.join(index.scenes, "scene_id", "left_anti").first()
        if absent:
            raise ValueError(f"an eligible scene is not in the index: {absent.scene_id}")
        self.selected: set[str] = set()
        self.trace: list[dict] = []

    def _documents(self) -> DataFrame:
        text = block_text(F.col("heading"), F.col("phase"), F.col("passages"))
        usage = F.when(F.col("kind") == "reference", NEED_NOT)
        return self.index.scenes.join(self.pool, "scene_id").select("scene_id", "kind", "mission", "heading", "path", F.transform("passages", lambda p: p["line"]).alias("lines"), F.when(F.col("kind") == "history", F.col("depth")).alias("depth"), usage.alias("usage"), "place", text.alias("text"))

    def _keep(self, tool: str, arguments: dict, result: DataFrame, name: str = "scene_id", order: Sequence[Column] = (), matched: str | None = None) -> DataFrame:
        """A call's result, written to the shared folder; to the driver come the ids that the trace names, in order, not the texts."""
        held = staged(result)
        told = held.orderBy(*order).select(name, *([matched] if matched else [])).collect()
        entry = {"tool": tool, "arguments": arguments, "result_ids": [r[name] for r in told]}
        if matched:
            entry["matched_passages"] = [r[matched] for r in told]
        self.trace.append(entry)
        return held.orderBy(*order) if order else held

    def get_history(self, depth: int) -> DataFrame:
        """Whole scenes of the history within a distance, in the pool's order."""
        if type(depth) is not int or depth < 0:
            raise ValueError("depth must be a whole number from 0")
        found = self._documents().where((F.col("kind") == "history") & (F.col("depth") <= depth))
        return self._keep("get_history", {"depth": depth}, found, order=[F.col("place")])

    def _scored(self, query: str | None, kind: str) -> DataFrame:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        query = self.encounter if query is None else query
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must be text")
        made = [list(map(float, v)) for v in self.embed([query], "query")]
        if len(made) != 1 or len(made[0]) != self.index.dimension or not any(made[0]):
            raise ValueError("the encoder's query vector is not sound")
        eligible = self.pool if kind == "all" else self.pool.where(F.col("kind") == kind)
        return self.index.passages.join(eligible, "scene_id").withColumn("score", score(F.col("vector"), made[0]))

    def search_context(self, query: str | None = None, kind: str = "all", limit: int = 5, expand_scenes: bool = True) -> DataFrame:
        """The best scenes by their best passage, or the best passages; scenes that were selected before do not use up the limit."""
        check_limit(limit)
        if type(expand_scenes) is not bool:
            raise ValueError("expand_scenes must be true or false")
        scored = self._scored(query, kind)
        if self.selected:
            scored = scored.where(~F.col("scene_id").isin(*self.selected))
        arguments = {"query": query, "kind": kind, "limit": limit, "expand_scenes": expand_scenes}
        if not expand_scenes:
            found = scored.select("passage_id", "scene_id", "kind", "passage_index", "line", F.col("text").alias("excerpt"), "score").orderBy(F.desc("score"), "passage_id").limit(limit)
            return self._keep("search_context", arguments, found, "passage_id", [F.desc("score"), F.col("passage_id")])
        best = scored.groupBy("scene_id").agg(F.min_by(F.struct("passage_id", "line", "passage_index", "score"), F.struct((-F.col("score")).alias("s"), "passage_id")).alias("matched"))
        top = best.orderBy(F.desc("matched.score"), "matched.passage_id").limit(limit)
        found = self._documents().join(top, "scene_id").select("*", F.col("matched.score").alias("score"), F.col("matched.passage_id").alias("matched_passage"))
        return self._keep("search_context", arguments, found, order=[F.desc("score"), F.col("matched_passage")], matched="matched_passage")

    def read_context(self, ids: list[str]) -> DataFrame:
        """Whole scenes or passages by name, in the order asked for; what is not eligible is refused."""
        if not isinstance(ids, list) or any(not isinstance(x, str) for x in ids):
            raise ValueError("ids must be a list of names")
        passages = self.index.passages.join(self.pool, "scene_id").select(F.col("passage_id").alias("id"), "scene_id", "kind", "text")
        there = self._documents().select(F.col("scene_id").alias("id"), "scene_id", "kind", "text").unionByName(passages).where(F.col("id").isin(*ids) if ids else F.lit(False))
        place = F.create_map(*(F.lit(x) for i, n in enumerate(dict.fromkeys(ids)) for x in (n, i))) if ids else None
        result = self._keep("read_context", {"ids": ids}, there, "id", [F.element_at(place, F.col("id"))] if ids else [])
        if set(ids) - set(self.trace[-1]["result_ids"]):
            self.trace.pop()
            raise ValueError("a scene is not eligible for this encounter")
        return result

    def static_context(self, cost, budget: int = 8192, depth: int = 4, fixed: int = 0) -> DataFrame:
        """Whole scenes that fit a budget: near history first by depth, then by score; what does not fit is passed over.

        ``cost`` is a column over ``text``; ``fixed`` is what the instructions
        and the encounter take already, and must itself fit.
        """
        if type(depth) is not int or depth < 0 or type(budget) is not int or budget <= 0:
            raise ValueError("depth and budget must be whole numbers")
        if fixed > budget:
            raise ValueError("the instructions and the encounter exceed the budget")
        ranked = self._by_priority(depth).withColumns({"cost": cost.cast("long"), "one": F.lit(1)})
        taken = greedy_pack(ranked, "one", ["far", "hops", "less", "scene_id"], "cost", "scene_id", budget - fixed).select(F.explode("ids").alias("scene_id"))
        found = ranked.join(taken, "scene_id", "left_semi").drop("one", "far", "hops", "less")
        return self._keep("static_context", {"depth": depth, "max_input_tokens": budget}, found, order=[F.col("place")])

    def _by_priority(self, depth: int) -> DataFrame:
        """All eligible scenes with what they are taken by: near history first (``far``), by distance (``hops``), then by score (``less`` is its negative)."""
        best = self._scored(None, "all").groupBy("scene_id").agg(F.max("score").alias("score"))
        near = F.coalesce((F.col("kind") == "history") & (F.col("depth") <= depth), F.lit(False))
        return self._documents().join(best, "scene_id").withColumns({"far": F.when(near, 0).otherwise(1), "hops": F.when(near, F.col("depth")).otherwise(0), "less": -F.col("score")})

    def messages_for(self, ids: Sequence[str], prefix: str = "") -> str:
        """The system message with the named scenes in the pool's order, references under their label; a scene that is not eligible is refused."""
        if not isinstance(ids, list) or any(not isinstance(x, str) for x in ids):
            raise ValueError("ids must be a list of names")
        found = self._documents().where(F.col("scene_id").isin(ids)).select("scene_id", "kind", "place", "text").collect() if ids else []  # what one prompt holds
        if set(ids) - {r["scene_id"] for r in found}:
            raise ValueError("a scene is not eligible for this encounter")
        return rendered(prefix, [(r["kind"], r["place"], r["text"]) for r in found])

    def static_messages(self, count: Count, max_input_tokens: int = 8192, depth: int = 4, prefix: str = "") -> str:
        """The system message with whole scenes by priority, each taken if the WHOLE prompt, encounter included, still fits; the trace tells its tokens.

        Scenes come to the driver one after another, in the order of a sort that
        the executors make; held are those that were taken.
        """
        if type(depth) is not int or depth < 0 or type(max_input_tokens) is not int or max_input_tokens <= 0:
            raise ValueError("depth must be a whole number from 0 and max_input_tokens one from 1")
        size = lambda scenes: int(count([rendered(prefix, scenes) + self.encounter])[0])
        taken, names, used = [], [], size([])
        if used > max_input_tokens:
            raise ValueError("the instructions and the encounter exceed the budget")
        ordered = self._by_priority(depth).orderBy("far", "hops", "less", "scene_id").select("scene_id", "kind", "place", "text")
        for r in ordered.toLocalIterator():
            more = size([*taken, (r["kind"], r["place"], r["text"])])
            if more <= max_input_tokens:
                taken, used = [*taken, (r["kind"], r["place"], r["text"])], more
                names.append(r["scene_id"])
        self.trace.append({"tool": "static_context", "arguments": {"depth": depth, "max_input_tokens": max_input_tokens}, "result_ids": names, "input_tokens": used})
        return rendered(prefix, taken)

    def call_tool(self, name: str, arguments: dict) -> DataFrame:
        schema = next((s for s in tool_schemas() if s["name"] == name), None)
        if schema is None or set(arguments) - set(schema["parameters"]["properties"]):
            raise ValueError(f"no such tool or argument: {name}")
        return getattr(self, name)(**arguments)


def packed_results(documents: Sequence[dict], fits: Callable[[dict], bool]) -> dict:
    """A tool's result with documents added in order while ``fits`` says so of it; one that does not is left out and the next is tried, and how many were is told."""
    result: dict = {"documents": [], "omitted_documents": len(documents)}
    for document in documents:
        result["documents"].append(document)
        result["omitted_documents"] -= 1
        if not fits(result):
            result["documents"].pop()
            result["omitted_documents"] += 1
    return result


def replay(session: RetrievalSession, turns: Sequence[Sequence[dict]], fits: Callable[[list], bool], selected: Sequence[str] = ()) -> dict:
    """The trace of a conversation's tool calls (turns of name and arguments), played again over a session: each turn's results, packed into what ``fits``, and the scenes selected so far.

    Arguments may be JSON text.  A call that is refused has its error as result
    and the conversation goes on; a conversation that does not fit to begin with
    is an error.
    """
    chosen, out = set(selected), []
    if not fits([]):
        raise ValueError("the conversation exceeds the input budget")
    for calls in turns:
        results: list[dict] = [{"error": "the result does not fit what is left of the budget"} for _ in calls]
        for k, call in enumerate(calls):
            try:
                arguments = call["arguments"]
                session.selected = set(chosen)
                found = session.call_tool(call["name"], json.loads(arguments) if isinstance(arguments, str) else arguments)
                documents = [r.asDict(recursive=True) for r in found.collect()]  # at most what a tool may return to a prompt

                def room(result: dict, k=k) -> bool:
                    return fits([*out, {"calls": list(calls), "results": [*results[:k], result, *results[k + 1 :]]}])

                results[k] = packed_results(documents, room)
                chosen |= {d["scene_id"] for d in results[k]["documents"]}
            except (ValueError, TypeError, KeyError) as e:
                results[k] = {"error": str(e)}
        out.append({"calls": list(calls), "results": results})
    return {"turns": out, "selected_scene_ids": sorted(chosen)}


def evidence_faults(returned: DataFrame, session: RetrievalSession, selected: DataFrame | None = None) -> DataFrame:
    """(scene_id, fault) of documents (scene_id, kind, text) that a run says it was shown: each must be eligible and word for word the same.

    With ``selected`` (scene_id) the scenes that the run says it selected must be
    those that were returned, no more and no fewer.
    """
    true = session._documents().select("scene_id", F.col("kind").alias("true_kind"), F.col("text").alias("true_text"))
    fault = F.when(F.col("true_text").isNull(), "not eligible").when(F.col("kind") != F.col("true_kind"), "kind differs").when(F.col("text") != F.col("true_text"), "text differs")
    found = returned.join(true, "scene_id", "left").select("scene_id", fault.alias("fault")).where("fault IS NOT NULL")
    if selected is None:
        return found
    a, b = returned.select("scene_id").distinct(), selected.select("scene_id").distinct()
    return found.unionByName(b.join(a, "scene_id", "left_anti").withColumn("fault", F.lit("selected, not returned"))).unionByName(a.join(b, "scene_id", "left_anti").withColumn("fault", F.lit("returned, not selected")))
