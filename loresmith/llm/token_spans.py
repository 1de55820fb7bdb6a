"""Token counts of sections: whole texts are encoded once, and token spans are joined to the spans of lines, or of fields that the caller gives."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import frugal, string_bytes

#: How a token that lies in more than one section is allocated.
RULES = ("first", "last", "largest")


@functools.lru_cache(2)
def encoder(path: str, pattern: str):
    """A byte-level encoder without special tokens, and the bytes of each of its ids."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        sizes[i] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte bounds of a text's lines; a line feed belongs to the line that it ends.  A text always has at least one section."""
    ends = np.flatnonzero(data == 10) + 1
    return np.unique(np.r_[0, ends, len(data)]) if len(data) else np.array([0, 0])


def field_sections(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the stretches that spans in characters cut a text into, and for each stretch its span's number (-1: in none).

    Spans may leave gaps and come in any order; they may not overlap, begin after
    they end, or lie beyond the text.
    """
    at = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    edges = np.array(spans, np.int64).reshape(-1, 2)
    order = np.argsort(edges[:, 0], kind="stable")
    held = edges[order]
    held = held[held[:, 0] < held[:, 1]]
    if (edges[:, 0] > edges[:, 1]).any() or (edges < 0).any() or (edges > len(at) - 1).any() or (held[1:, 0] < held[:-1, 1]).any():
        raise ValueError("spans must lie in their text and may not overlap")
    cuts = np.unique(np.r_[0, edges.ravel(), len(at) - 1])
    numbers = {int(a): int(k) for k, (a, b) in zip(order, edges[order], strict=True) if a < b}
    last = {int(a): int(b) for a, b in held}
    owner = np.full(max(0, len(cuts) - 1), -1)
    for k, a in enumerate(cuts[:-1].tolist()):
        if a in numbers and last[a] >= cuts[k + 1]:
            owner[k] = numbers[a]
    return at[cuts], owner


def allocate(token_bounds: np.ndarray, bounds: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """For spans [bounds[i], bounds[i+1]): how many tokens each gets, and how many tokens that touch it cross a bound.

    ``first`` gives a crossing token to the section of its first byte, ``last``
    to that of its last byte, ``largest`` to the section that holds most of its
    bytes (of equals the first).  Every token is counted once.
    """
    n = len(bounds) - 1
    if len(token_bounds) < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    start, end = token_bounds[:-1], token_bounds[1:]
    first = np.minimum(np.searchsorted(bounds, start, "right") - 1, n - 1)
    last = np.minimum(np.searchsorted(bounds, end - 1, "right") - 1, n - 1)
    owner = last if rule == "last" else first.copy()
    crossing = np.flatnonzero(first < last)
    touched = np.zeros(n + 1, np.int64)
    np.add.at(touched, first[crossing], 1)
    np.add.at(touched, last[crossing] + 1, -1)
    if rule == "largest":
        for k in crossing.tolist():
            spans = np.arange(first[k], last[k] + 1)
            held = np.minimum(end[k], bounds[spans + 1]) - np.maximum(start[k], bounds[spans])
            owner[k] = spans[held.argmax()]
    return np.bincount(owner, minlength=n), np.cumsum(touched)[:n]


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "largest", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """A row for each line of each text: the id, ``section`` (from 0), ``char_start``, ``char_end``, ``n_tokens`` and ``n_crossing``.

    With ``spans_col`` (an array of structs of ``start`` and ``end`` in
    characters, the fields of a record written as one text, say) sections are
    these spans, numbered as they come; what lies in none of them is section -1,
    from the first such character to the last, where there is any.  A null array
    has no spans; spans that overlap or leave their text are an error.

    The counts of a text's sections add up to the tokens of the whole text.
    Spans of sections are given in characters.  Null text counts as empty and
    has one empty section without tokens; null and repeated ids are carried
    through; nothing is shuffled, so ties and hot sources need no rule.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    @frugal
    def run(batches):
        coder, sizes = encoder(ranks_path, pattern)
        for batch in batches:
            data, at = string_bytes(batch.column(1))
            texts = batch.column(1).to_pylist()
            row, section, begin, finish, tokens, crossing = [], [], [], [], [], []
            given = batch.column(2).to_pylist() if spans_col else None
            for i, text in enumerate(texts):
                own = data[at[i] : at[i + 1]]
                spans = [(x["start"], x["end"]) for x in given[i] or ()] if given else None
                bounds, owner = (line_sections(own), None) if spans is None else field_sections(own, spans)
                ids = coder.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.int64)
                counts, crossed = allocate(np.r_[0, np.cumsum(sizes[ids])], bounds, rule)
                chars = np.r_[0, np.cumsum((own & 0xC0) != 0x80)][bounds]
                name, first, last = np.arange(len(bounds) - 1), chars[:-1], chars[1:]
                if spans is not None:
                    outside = np.flatnonzero(owner < 0)
                    name = np.r_[np.arange(len(spans)), np.full(min(1, len(outside)), -1)].astype(np.int64)
                    first = np.r_[[a for a, _ in spans], chars[outside[:1]]]
                    last = np.r_[[b for _, b in spans], chars[outside[-1:] + 1]]
                    place = np.where(owner < 0, len(spans), owner)
                    counts, crossed = (np.bincount(place, x, len(name)).astype(np.int64)[: len(name)] for x in (counts, crossed))
                row.append(np.full(len(name), i))
                section.append(name)
                begin.append(first)
                finish.append(last)
                tokens.append(counts)
                crossing.append(crossed)
            if row:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (section, begin, finish, tokens, crossing)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), *columns], ["id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(spans_col).cast("array<struct<start:bigint,end:bigint>>").alias("spans")] if spans_col else []))
    return rows.mapInArrow(run, "id long, section long, char_start long, char_end long, n_tokens long, n_crossing long").withColumnRenamed("id", id_col)
