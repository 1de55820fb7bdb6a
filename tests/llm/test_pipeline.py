"""The corpus pipeline and the registered queries over the smallest tables, against brute force."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from loresmith.llm import queries, subword_classifier  # noqa: E402
from loresmith.llm.staging import stage  # noqa: E402
from loresmith.llm.word_ids import word_ids  # noqa: E402

from .test_operators import brute_classes, whole  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def ids_of(text, end):
    return [*word_ids(public_tokenizers.path(queries.WORD_BPE)).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stages_one_by_one(spark, rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(queries.id_remainder("doc_id", 4) != 2)
    model = subword_classifier.fit(docs, labels, "quality")
    scores = {r.doc_id: r.score for r in subword_classifier.score(docs, model).collect()}
    kept = {i for i in rows if scores[i] >= 0.7}
    after = []
    for name, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, DATA))
        after.append(docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert {r.doc_id for r in after[0]} == kept and len(kept) < len(rows)
    first = {}
    for i in sorted(kept):
        first.setdefault(rows[i], i)
    assert {r.doc_id for r in after[1]} == set(first.values()) and len(after[1]) < len(kept)
    classes = brute_classes([(i, rows[i]) for i in first.values()])
    left = set(classes.values())
    assert {r.doc_id for r in after[2]} == left and len(left) < len(first)
    assert all(r.text == rows[r.doc_id] for r in after[2])
    want = Counter((i, k // 4096, k, min(4096, n - k)) for i in left for n in [len(ids_of(rows[i], 1))] for k in range(0, n, 4096))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in after[3]) == want
    assert whole(after[3], 4096) <= -(-sum(r.length for r in after[3]) // 4096) + 1
    assert Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, DATA).collect()) == Counter((r.doc_id, r.piece, r.length) for r in after[3])


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, DATA))
    assert docs.count() == 0


def test_packed_ids_of_the_table(spark, rows):
    at = 0
    want = {}
    for i in sorted(rows):
        ids = ids_of(rows[i], 2)
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_bit_packed_ids(spark, DATA).collect()} == want


def test_pieces_of_the_table(spark, rows):
    found = queries.op7_configuration_packing(spark, DATA).collect()
    want = Counter((i, k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for i, t in rows.items() for ids in [ids_of(t, 1)] for k in range(0, len(ids), 4096))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    whole(found, 4096)


def test_media_of_the_table(spark, rows):
    for r in queries.op5_wav_fingerprints(spark, DATA).collect():
        data = rows[r.doc_id].encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload) + 44)


def test_archives_of_the_table(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    found = queries.op6_warc_salvage(spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        data = pages[r.page_id]
        again = first[data] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None)


def test_near_classes_of_the_table(spark, rows):
    found = queries.op9_bagminhash_classes(spark, DATA).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(list(rows.items()))


def test_held_out_scores_of_the_table(spark, rows):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = queries.op10_subword_quality(spark, DATA).collect()
    assert {r.doc_id for r in found} == set(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in found)
    out = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum((s >= 0.5) == y for s, y in out) / len(out) > 0.8


def test_model_beats_the_base_on_held_out_texts(spark):
    found = queries.op2_pitman_yor_scores(spark, DATA).collect()
    by = defaultdict(lambda: [0.0, 0.0, 0])
    for r in found:
        for k, x in enumerate((r.score, r.base_score, r.n_tokens)):
            by[r.held_out][k] += x
    assert by[True][0] > by[True][1] and by[False][0] > by[False][1]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
