"""Templates, inventories, ids and escapes on texts, as expressions that stay inside code generation."""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import query, table

MARKER = "<[^>]+>"
# Fixed pattern: a word is a run of anything but Unicode white space and the four separators 1C to 1F.
WORD = r"(?U)[^\s\x1C-\x1F]+"


def render(text: Column, values: Column) -> Column:
    """Markers replaced once by their values, unknown ones kept; a marker that a value brings in is not replaced again.

    The text is cut at its markers, and pieces and replacements are joined in
    turn, so nothing is read twice.
    """
    markers = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    between = F.split(text, MARKER, -1)
    shown = F.transform(markers, lambda m: F.coalesce(F.element_at(values, m), m))
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(shown, i), F.lit("")))), "")


def markers(text: Column) -> Column:
    """Sorted distinct markers of a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))))


def format_list(names: Column) -> Column:
    """"a", "a and b", "a, b and c"."""
    n = F.size(names)
    return F.when(n < 2, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def json_in_html(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))


def html_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


@F.pandas_udf(T.StringType())
def path_quote(path: pd.Series) -> pd.Series:
    """A source path for a URL; slashes stay."""
    return path.map(lambda x: None if x is None else quote(x))


def canonical(value) -> str:
    """JSON with sorted keys, raw characters and a blank after separators; no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def json_fingerprint(document: pd.Series) -> pd.Series:
    """The fingerprint of a JSON document given as text: missing keys stay missing, nulls stay nulls."""
    return document.map(lambda x: None if x is None else fingerprint(json.loads(x)))


def render_text(text: str, values: dict[str, str]) -> tuple[str, list[str]]:
    """The same replacement for one text, with the markers left in the result."""
    shown = re.sub(MARKER, lambda m: values.get(m[0], m[0]), text)
    return shown, sorted(set(re.findall(MARKER, shown)))


@query("""SELECT coalesce(source, 'ALL') AS part, count(*) AS files, sum(words)::BIGINT AS words, sum(lines)::BIGINT AS lines FROM
    (SELECT source, len(list_filter(regexp_split_to_array(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}]+'), lambda w: w <> '')) AS words, len(string_split(text, chr(10))) AS lines FROM documents)
    GROUP BY ROLLUP (source)""")
def text_word_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", word_count(F.col("text")).alias("words"), F.size(F.split("text", "\n", -1)).alias("lines"))
    found = docs.rollup("source").agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words"), F.sum("lines").alias("lines"))
    return found.select(F.coalesce("source", F.lit("ALL")).alias("part"), "files", "words", "lines")


@query("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<[^>]+>'))) AS markers FROM pages WHERE len(regexp_extract_all(html, '<[^>]+>')) > 0""")
def marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", markers(F.col("html")).alias("markers"))
    return rows.where(F.size("markers") > 0)


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '<p>', chr(1)), '</p>', '[/p]'), '<title>', '<p>'), chr(1), '[p]')) AS rendered FROM pages""")
def marker_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<title>`` becomes ``<p>`` and is not replaced again."""
    values = F.create_map(*map(F.lit, ("<p>", "[p]", "</p>", "[/p]", "<title>", "<p>")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(render(F.col("html"), values)).alias("rendered"))


@query("""WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS n FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN len(n) < 2 THEN array_to_string(n, '') ELSE array_to_string(n[:len(n) - 1], ', ') || ' and ' || n[len(n)] END AS names FROM g""")
def list_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("n"))
    return names.select("o_custkey", format_list(F.col("n")).alias("names"))


@query("""SELECT doc_id, 'scene-' || left(sha256(concat(source, chr(1), text)), 24) AS scene_id, 'conversation-' || left(sha256(source), 24) AS conversation_id FROM documents""")
def scene_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.concat(F.lit("scene-"), F.left(F.sha2(F.concat_ws("\x01", "source", "text"), 256), F.lit(24)))
    return table(spark, sf_dir, "documents").select("doc_id", scene.alias("scene_id"), F.concat(F.lit("conversation-"), F.left(F.sha2("source", 256), F.lit(24))).alias("conversation_id"))


@query("""SELECT page_id, md5(replace(html, '<', '\\u003c')) AS in_json, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(json_in_html(F.col("html"))).alias("in_json"), F.md5(html_escape(F.col("html"))).alias("escaped"))


@query("""WITH d AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents)
    SELECT doc_id, md5(source || ' — on ' || lang || chr(10) || array_to_string(list_transform(p, lambda x, i: CASE WHEN i = len(p) THEN 'Player choice: ' || x ELSE x END), chr(10) || chr(10))) AS block FROM d""")
def block_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the text as a passage, the last marked as the choice; the digest of the whole block."""
    lines = F.split("text", "\n", -1)
    passages = F.transform(lines, lambda x, i: F.when(i == F.size(lines) - 1, F.concat(F.lit("Player choice: "), x)).otherwise(x))
    block = F.concat(F.col("source"), F.lit(" — on "), F.col("lang"), F.lit("\n"), F.array_join(passages, "\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(block).alias("block"))


@query("""SELECT n_nationkey, sha256('{"key": ' || n_nationkey || ', "name": "' || n_name || '", "region": null}') AS fingerprint FROM nation""")
def json_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are sorted before hashing, whatever order they come in, and a null that is there counts."""
    told = F.format_string('{"region":null,"name":"%s","key":%d}', "n_name", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", json_fingerprint(told).alias("fingerprint"))


@query("""SELECT p_partkey, replace(p_brand || '/' || p_name, ' ', '%20').replace('#', '%23') AS path FROM part""")
def quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", path_quote(F.concat_ws("/", "p_brand", "p_name")).alias("path"))
