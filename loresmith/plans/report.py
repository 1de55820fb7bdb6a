"""Blinded packs, reports and pages made from small results."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assessment import tally
from ..sources.files import create_json, create_text

CAUTION = "The judges are not calibrated. Fewer detections are not better writing in themselves, and results at chance do not show that texts cannot be told apart."


def write_pack(trials: DataFrame, coverage: DataFrame, folder: str) -> None:
    """A pack of :func:`loresmith.operators.assessment.assembled` trials, in tables that are never joined.

    ``public``: stage, trial_id, context, A, B and nothing else.  ``private``:
    the keys, bound to what is public by hash.  ``coverage``: one row for each
    condition and sample.  ``templates``: an unanswered judgment for each trial
    by stage.  ``review``: a page for each stage.  A folder that is there is
    never written to.
    """
    spark = trials.sparkSession
    write = lambda df, name, *by: df.write.mode("errorifexists").partitionBy(*by).json(f"{folder}/{name}")
    write(trials.select("stage", "trial_id", "context", "A", "B"), "public", "stage")
    write(trials.select("trial_id", "sample_id", "condition", "identity", "stage", "control", "original", "trial_sha256"), "private")
    write(coverage, "coverage")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("choice", "string"), ("confidence", "double"), ("reason", "string"), ("recognized_source", "boolean"))]
    template = trials.select("stage", "trial_id", "trial_sha256", F.lit("missing").alias("status"), *blank)
    template.write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy("stage").json(f"{folder}/templates")
    for stage in sorted(r["stage"] for r in trials.select("stage").distinct().collect()):  # two stages
        shown = [r.asDict() for r in trials.where(F.col("stage") == stage).select("trial_id", "context", "A", "B", "trial_sha256").orderBy("trial_id").toLocalIterator()]
        create_text(spark, f"{folder}/review-{stage}.html", review_page(shown))


def _cell(v) -> str:
    return "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown(rows: Sequence[Mapping], head: Sequence[str]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r[h]) for h in head) + " |" for r in rows])


def outcome_report(outcomes: DataFrame, keys: list[str]) -> tuple[str, str]:
    """The tallies as JSON and as a Markdown table; one row for each combination of keys."""
    rows = [r.asDict() for r in tally(outcomes, keys).orderBy(*keys).collect()]
    return json.dumps(rows, ensure_ascii=False, sort_keys=True), markdown(rows, list(rows[0]) if rows else keys)


SECTIONS = (
    ("results", "Decisions", ("reviewer", "condition")), ("recognition", "By identity and recognition", ("reviewer", "condition", "part")), ("coverage", "Generation coverage", ("condition", "identity")),
    ("paired", "Paired differences", ("reviewer", "left_condition", "right_condition")), ("intervals", "Intervals over connected groups", ("reviewer", "condition")),
    ("controls", "Controls", ("reviewer", "control")), ("disagreements", "Disagreements between reviewers", ("trial_id",)),
)


def full_report(parts: Mapping[str, DataFrame], provenance: Mapping | None = None) -> tuple[dict, str]:
    """All parts of a report as one document and as Markdown, in the order of ``SECTIONS``; a part that is not given is left out.

    Every part is an aggregate of a few rows for each reviewer and condition, so
    it is read to the driver; disagreements alone are one row for each trial
    that reviewers differ on.
    """
    unknown = set(parts) - {name for name, *_ in SECTIONS}
    if unknown:
        raise ValueError(f"no such part of a report: {sorted(unknown)}")
    whole: dict = {"schema_version": 1, "status": "exploratory", "provenance": dict(provenance or {})}
    text = ["# Exploratory report", "", CAUTION]
    for name, title, keys in SECTIONS:
        if name in parts:
            df = parts[name]
            rows = [r.asDict(recursive=True) for r in df.orderBy(*(k for k in keys if k in df.columns)).collect()]
            whole[name] = rows
            text += ["", f"## {title}", "", markdown(rows, df.columns) if rows else "None."]
    return whole, "\n".join(text) + "\n"


def write_report(spark, folder: str, parts: Mapping[str, DataFrame], provenance: Mapping | None = None) -> None:
    """``report.json`` and ``report.md``, neither of which may be there."""
    whole, text = full_report(parts, provenance)
    create_json(spark, f"{folder}/report.json", whole)
    create_text(spark, f"{folder}/report.md", text)


def in_script(value) -> str:
    """A value as JSON inside a script: ``<`` is written as an escape, so no text can close the script."""
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c")


_STYLE = "<style>body{font:16px/1.5 serif;max-width:60rem;margin:2rem auto}pre{white-space:pre-wrap;border:1px solid #999;padding:1rem}fieldset{margin:2rem 0}</style>"


def review_page(trials: Sequence[Mapping], groups: Sequence | None = None) -> str:
    """A page for human review: each trial with a form, and a button that gives the answers as JSON lines.

    ``groups`` are the connected groups of the trials: a sheet that shows one
    twice is refused, since a reader would know it again.
    """
    if groups is not None and len(set(groups)) != len(groups):
        raise ValueError("a review sheet cannot repeat a source group")
    script = """
const main=document.querySelector('main');
for(const t of trials){const f=document.createElement('form');f.dataset.id=t.trial_id;f.dataset.hash=t.trial_sha256||'';
for(const k of ['context','A','B']){const h=document.createElement('h3');h.textContent=k;const p=document.createElement('pre');p.textContent=typeof t[k]==='string'?t[k]:JSON.stringify(t[k],null,1);f.append(h,p)}
const s=document.createElement('fieldset');
for(const c of ['A','B','abstain']){const l=document.createElement('label');const i=document.createElement('input');i.type='radio';i.name='choice';i.value=c;l.append(i,c);s.append(l)}
for(const [n,kind] of [['confidence','number'],['reason','text']]){const i=document.createElement('input');i.type=kind;i.name=n;i.placeholder=n;s.append(i)}
const r=document.createElement('label');const b=document.createElement('input');b.type='checkbox';b.name='recognized_source';r.append(b,'I know the source');s.append(r);f.append(s);main.append(f)}
document.querySelector('button').onclick=()=>{document.querySelector('output').textContent=[...document.forms].map(f=>{const d=new FormData(f),c=d.get('choice');
return JSON.stringify({trial_id:f.dataset.id,trial_sha256:f.dataset.hash,status:c?'ok':'missing',choice:c,confidence:c&&c!=='abstain'&&d.get('confidence')!==''?Number(d.get('confidence')):null,reason:d.get('reason')||null,recognized_source:c?d.has('recognized_source'):null})}).join('\\n')};
"""
    return f"<!doctype html><meta charset=utf-8><title>Review</title>{_STYLE}<main></main><button>Answers</button><pre><output></output></pre><script>const trials={in_script(list(trials))};{script}</script>"


def sample_page(samples: Sequence[Mapping], runs: Sequence[Mapping] = ()) -> str:
    """A page to browse samples, with the responses of runs beside each; everything is shown as text."""
    script = """
const list=document.querySelector('select'),main=document.querySelector('main');
data.samples.forEach((s,i)=>{const o=document.createElement('option');o.value=i;o.textContent=s.sample_id;list.append(o)});
const add=(tag,text)=>{const e=document.createElement(tag);e.textContent=text;main.append(e)};
list.onchange=()=>{main.replaceChildren();const s=data.samples[list.value];if(!s)return;for(const [k,v] of Object.entries(s)){add('h3',k);add('pre',typeof v==='string'?v:JSON.stringify(v,null,1))}
for(const r of data.runs){add('h2',r.name);const x=r.responses[s.sample_id];add('pre',x?(x.response??x.error??x.status):'missing')}};list.onchange();
"""
    return f"<!doctype html><meta charset=utf-8><title>Samples</title>{_STYLE}<select></select><main></main><script>const data={in_script({'samples': list(samples), 'runs': list(runs)})};{script}</script>"


def write_sample_page(samples: DataFrame, path: str, runs: Mapping[str, DataFrame] | None = None) -> int:
    """The page of :func:`sample_page` for samples (without their private column ``evaluation``) and runs (sample_id, status, response, error); returns how many samples it shows.

    A page holds what one reader can browse, so its rows are read to the driver.
    """
    spark = samples.sparkSession
    shown = [r.asDict(recursive=True) for r in samples.drop("evaluation").orderBy("sample_id").toLocalIterator()]
    found = [{"name": name, "responses": {r["sample_id"]: {k: r[k] for k in ("status", "response", "error")} for r in df.where("status IS NOT NULL").toLocalIterator()}} for name, df in (runs or {}).items()]
    create_text(spark, path, sample_page(shown, found))
    return len(shown)
