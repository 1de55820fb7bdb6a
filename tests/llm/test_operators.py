"""Small tables with nulls, ties, repeated rows, long and empty texts; each operator against a brute-force version."""

import base64
import functools
import gzip
import hashlib
import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from loresmith.llm import bagminhash, bitpack, exact_dedup, hpylm, media_wav, nbest, near_dedup, packing, staging, subword_classifier, textkernel, token_spans, warc  # noqa: E402
from loresmith.llm.word_ids import WordIds, word_ids  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and river stone lamp quiet house under seven bright wolves carry north étoile größe market, day. Is it".split()


def prose(n, rng):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", str(rng.randrange(90))]) for _ in range(n))


@functools.cache
def documents():
    rng = random.Random(5)
    base = [prose(n, rng) for n in (60, 80, 120, 40, 9, 5, 3, 1, 300)]
    near = base[2].split()
    near[50] = "changed"
    texts = [*base, base[0], base[0], "", None, "  \n\t ", " ".join(near), base[3] + " ", "x" * 3000, base[0], "a\nb\n\nc", "<|endoftext|> lamp★ ▁ don't 12 ½ ﬁ", prose(5000, rng)]
    rows = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in enumerate(texts)]
    return [*rows, (3, base[3], "en", "src0", 0, None), (None, base[1], None, None, None, None), (None, None, None, None, None, None), (500, base[2], "en", "src1", 1, "z")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1 exact duplicates


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, keep, weak):
    hashed = (lambda t: F.unhex(F.lpad(F.conv((F.length(t) % 7).cast("string"), 10, 16), 2, "0"))) if weak else exact_dedup.md5_128
    found = exact_dedup.exact_groups(docs, keep=keep, content_hash=hashed).collect()
    by = defaultdict(list)
    for i, t, *_ in documents():
        by[t or ""].append(i)
    want = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter(map(tuple, found)) == Counter(want)


def test_exact_copies_go_and_other_columns_stay(docs, none):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert Counter(texts) == Counter({t or "" for _, t, *_ in documents()})
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_no_text_is_lost_where_ids_repeat(spark):
    a, b, c = ("alpha " * 9, "beta gamma " * 9, "delta " * 12)
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (None, c), (None, "alone"), (None, "alone"), (8, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = Counter((r.doc_id, r.text or "") for r in exact_dedup.drop_exact_copies(df).collect())
    assert exact == Counter([(3, a), (5, b), (7, c), (None, "alone"), (8, "")])
    near = Counter((r.doc_id, r.text or "") for r in near_dedup.drop_near_copies(df).collect())
    assert near == Counter([(3, a), (5, b), (7, c), (None, c), (None, "alone"), (None, "alone"), (8, "")])
    classes = near_dedup.near_classes(df).collect()
    # of the two texts of id 5 one may go by the id, the other by a number of its own
    assert {(r.doc_id, r.class_id if (r.class_id or 0) < near_dedup.FURTHER else 5) for r in classes} == {(3, 3), (5, 3), (5, 5), (7, 7), (None, None), (8, 8)}
    other = spark.createDataFrame([(5, a), (5, b), (9, b)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in near_dedup.drop_near_copies(other).collect()}
    assert {t for _, t in kept} == {a, b} and len(kept) == 2


# 2 language model


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low:
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, *([word] if word else []), None]


def test_scores_count_and_beat_the_base(spark, docs, none):
    rng = random.Random(3)
    many = [(1000 + i, " ".join(rng.choice(["the lamp", "of stone", "river runs", "wolves carry"]) + f" w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(60)), None, None, None, None) for i in range(300)]
    both = docs.unionByName(spark.createDataFrame(many, SCHEMA))
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = hpylm.score_texts(both, away).collect()
    rows = [*documents(), *many]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, x, *_ in rows if not held(i) for t in tokens_of(x))
    total, size = sum(counts.values()), len(counts)
    want = Counter()
    for i, x, *_ in rows:
        own = tokens_of(x)
        want[i, held(i), len(own), sum(counts[t] > 0 for t in own), total, round(sum(math.log10((counts[t] + 1) / (total + size + 1)) for t in own), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    out = [r for r in found if r.held_out and r.doc_id and r.doc_id >= 1000]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in found)
    assert hpylm.score_texts(none, away).count() == 0


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(1, 2**62, 40).astype(np.uint64))
    per = rng.integers(1, 4, 40)
    context = np.concatenate([np.sort(rng.choice(5, k, replace=False)) * 257 for k in per]).astype(np.uint16)
    train = rng.integers(1, 30, len(context)).astype(np.uint32)
    state = hpylm.build([hpylm.squeeze(words, per.astype(np.uint32), context, train)])
    rows = hpylm._totals(state, state.seatings[-1])
    t = hpylm.Totals([np.zeros(1), np.zeros(256), np.zeros(65536)], [np.zeros(1), np.zeros(256), np.zeros(65536)], tokens=int(train.sum()), vocabulary=40)

    def refill(rows):
        for level, c, customers, tables in rows:
            if level >= 0:
                t.customers[level][c], t.tables[level][c] = customers, tables

    refill(rows)
    for k in range(6):
        state.seatings = [hpylm.sweep(state, state.seatings[-1], t, np.random.default_rng(k))]
        refill(hpylm._totals(state, state.seatings[-1]))
        counts = [x for x in state.levels([y.astype(float) for y in state.seatings[-1]])]
        assert all((n >= np.minimum(c, 1)).all() and (n <= c).all() for c, n, _, _ in counts)
    assert len(state.trace) == 6 and min(state.trace[3:]) > state.trace[0] - 0.02 * abs(state.trace[0])
    every = np.full(41, 6, np.uint32)
    unknown = np.append(words, np.uint64(2**63))
    block = hpylm.squeeze(unknown, every, np.tile(np.array([0, 257, 514, 771, 1028, 9999], np.uint16), 41), np.zeros(41 * 6, np.uint32))
    _, logs = hpylm.expand(hpylm.answer(hpylm.State.load(state.dump()), [t], block))
    assert np.allclose((10.0 ** logs.astype(float)).reshape(41, 6).sum(axis=0), 1, atol=1e-4)


def test_tables_are_drawn_from_the_posterior_of_all_seatings(monkeypatch):
    """One restaurant of three dishes: a long chain of Gibbs draws against the weights of all partitions of each dish's customers, enumerated."""

    def partitions(n):
        if not n:
            yield ()
            return
        for rest in partitions(n - 1):
            for k in range(len(rest)):
                yield (*rest[:k], rest[k] + 1, *rest[k + 1 :])
            yield (*rest, 1)

    d, customers, parent = 0.4, np.array([4.0, 3.0, 1.0]), np.array([0.2, 0.05, 0.5])
    weights = Counter()
    ways = [[(len(x), math.prod(math.prod(j - d for j in range(1, n)) for n in x)) for x in partitions(int(c))] for c in customers]
    for picked in itertools.product(*ways):
        tables = tuple(t for t, _ in picked)
        opened = math.prod(hpylm.STRENGTH + d * k for k in range(sum(tables)))
        weights[tables] += opened * math.prod(w * p**t for (t, w), p in zip(picked, parent, strict=True))
    total = sum(weights.values())
    rng, state, seen = np.random.default_rng(1), np.ones(3, np.int64), Counter()
    for k in range(30000):
        for i in range(3):
            state[i] = hpylm.seat_exactly(customers[i : i + 1], np.array([float(state.sum() - state[i])]), parent[i : i + 1], d, rng)[0]
        seen[tuple(state.tolist())] += 1
    assert set(seen) <= set(weights)
    assert max(abs(seen[t] / 30000 - w / total) for t, w in weights.items()) < 0.012
    # the numbers themselves: all ways to sit at t tables
    for c in (1, 2, 5):
        by = Counter()
        for x in partitions(c):
            by[len(x)] += math.prod(math.prod(j - d for j in range(1, n)) for n in x)
        assert all(abs(math.exp(hpylm.stirling(d)[c, t]) - w) < 1e-9 * w for t, w in by.items())


def test_steps_on_many_customers_end_where_exact_draws_do(monkeypatch):
    n, d = 3000, 0.6
    customers, elsewhere, parent = np.full(n, 60.0), np.full(n, 300.0), np.full(n, 0.01)
    exact = hpylm.seat_exactly(customers, elsewhere, parent, d, np.random.default_rng(2))
    for first in (1.0, 40.0):
        steps = hpylm.seat_by_steps(customers, np.full(n, first), elsewhere, parent, d, np.random.default_rng(3), 120)
        assert abs(steps.mean() - exact.mean()) < 0.05 * exact.mean() and abs(steps.std() - exact.std()) < 0.1 * exact.std()
    few = hpylm.seat_by_steps(np.full(n, 60.0), np.full(n, 3.0), np.full(n, 5.0), np.full(n, 1e-4), 0.9, np.random.default_rng(4), 90)
    exact = hpylm.seat_exactly(np.full(n, 60.0), np.full(n, 5.0), np.full(n, 1e-4), 0.9, np.random.default_rng(5))
    assert abs(few.mean() - exact.mean()) < 0.05 * exact.mean()
    monkeypatch.setattr(hpylm, "EXACT", 400)
    hpylm.stirling.cache_clear()
    for c in (65, 400):
        for d in (0.2, 0.5, 0.7, 0.9):
            tables = np.arange(1.0, c - 4)
            off = hpylm.Ways(np.full(len(tables), float(c)), d)(tables) - hpylm.stirling(d)[c, 1 : c - 4]
            assert np.ptp(off) < 0.25 and np.ptp(off[: int(hpylm.FEW * c**d)]) < 1e-3
    hpylm.stirling.cache_clear()
    assert np.allclose(hpylm.log_gamma(np.array([0.5, 1.0, 7.3, 400.0])), [math.lgamma(x) for x in (0.5, 1.0, 7.3, 400.0)])


def test_contexts_are_the_whole_words_before(spark):
    """Words of the same ending predict different words, and so do two words before of which the last is the same."""
    texts = ["the lathe cat", "a bathe dog", "red mark stop", "blue mark start"] * 60
    asked = ["lathe cat", "lathe dog", "bathe dog", "bathe cat", "red mark stop", "red mark start", "blue mark start", "blue mark stop"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *asked])], "doc_id long, text string")
    found = {r.doc_id - len(texts): r.score for r in hpylm.score_texts(rows, F.col("doc_id") >= len(texts)).collect()}
    assert all(found[k] > found[k + 1] + 0.5 for k in range(0, len(asked), 2))


def test_contexts_of_tokens():
    texts = ["the lathe cat", "", "The\tlathe  CAT sat", "étoile été", "the lathe dog", " "]
    data, bounds = textkernel.string_bytes(pa.array(texts))
    token, each = hpylm.text_tokens(data, bounds)
    distinct, number = np.unique(token, return_inverse=True)
    end = int(np.searchsorted(distinct, hpylm.END))
    earlier, before = hpylm.contexts(number, each, end)
    tokens = [tokens_of(t) for t in texts]
    names = dict(zip(number.tolist(), [t for x in tokens for t in x], strict=True))
    want = [(*own[k : k + 2], own[k + 2]) for x in tokens for own in [[None, None, *x]] for k in range(len(x))]
    assert [tuple(names[int(x)] for x in y) for y in zip(earlier, before, number, strict=True)] == want


def test_buckets_that_share_the_root_hold_one_model():
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(1, 2**63, 13).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    train = (rng.random((3000, 3)) ** 2 * 12).astype(np.int64)
    asked = np.array(list(itertools.product(range(5), range(12), range(13))))
    blocks = []
    for b in range(2):
        own = [x[x[:, 1] % 2 == b] for x in (train, asked)]
        three = np.concatenate(own).astype(np.uint32).T
        blocks.append(hpylm.gather([(7, hpylm.squeeze(words, *three, np.arange(2, dtype=np.uint32), np.array([len(x) for x in own], np.uint32), np.array([0, 1], np.uint8)))]))
    states = [hpylm.build([data], shared=True) for data, _ in blocks]
    send = lambda first=False: {r: [(b, m["data"]) for b, s in enumerate(states) for m in hpylm.to_root(s, 3, first) if m["bucket"] == r] for r in range(3)}
    root = {r: hpylm.root_first(sent) for r, sent in send(True).items() if sent}

    def told():
        rows = {r: hpylm.root_row(r, data) for r, data in root.items()}
        for b, s in enumerate(states):
            hpylm.from_root(s, [(r, m["data"]) for r, x in rows.items() for m in x[3] if m["bucket"] == b])
        customers, tables, vocabulary, _, tokens, *_ = np.sum([x[4] for x in rows.values()], axis=0)
        return hpylm.Totals([np.array([customers])], [np.array([tables])], tokens=int(tokens), vocabulary=int(vocabulary))

    t = told()
    assert t.tokens == 3000 and t.vocabulary == len(np.unique(train[:, 2]))
    for k in range(6):
        for s in states:
            s.seatings = [hpylm.sweep(s, s.seatings[-1], s.within(s.seatings[-1], t), np.random.default_rng(k))]
        root = {r: hpylm.root_again(root[r], sent, t, np.random.default_rng(k)) for r, sent in send().items() if sent}
        t = told()
        assert t.customers[0][0] == sum(s.seatings[-1][hpylm.LAST].sum() for s in states) and t.tokens == 3000
    for s, (data, ask) in zip(states, blocks, strict=True):
        s = hpylm.State.load(s.dump())
        logs = hpylm.answer(s, [s.within(s.seatings[-1], t)], data)
        distinct, per_word, context, n, _ = hpylm.expand(data)
        count, score = hpylm.expand(logs)
        assert count.tolist() == [int((words[train[:, 2]] == w).sum()) for w in distinct]
        every = np.bincount(context, 10.0 ** score.astype(float))
        whole = np.bincount(context) == 13
        assert whole.sum() == 30 and np.allclose(every[whole], 1, atol=1e-4)
        (chunk, sums), = hpylm.sums_by_document(data, ask, logs, t)
        row, known, base, total = hpylm.expand(sums)
        assert chunk == 7 and row.tolist() == [0, 1] and known[0] == n.sum() and np.isclose(total[0], score.astype(float) @ n)
    with pytest.raises(ValueError, match="misses messages"):
        hpylm.root_again(next(iter(root.values())), [], t, rng)


def test_buckets_that_share_frequent_words_hold_one_model():
    """Contexts of a word that is half of all words before are dealt by both words; its dishes stand with the root's."""
    rng = np.random.default_rng(6)
    words = np.sort(rng.integers(1, 2**63, 13).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    train = (rng.random((3000, 3)) ** 2 * 12).astype(np.int64)
    train[rng.random(3000) < 0.5, 1] = 3
    asked = np.array(list(itertools.product(range(5), range(12), range(13))))
    none, split, likelihood = words[:0], words[[3, 7]], {}
    share = lambda split: np.bincount(hpylm.places(words, *train.T[:2], 4, split)).max() / len(train)
    assert share(none) > 0.5 and share(split) < 0.5
    for split in (none, split):
        blocks, n = [], len(split)
        for b in range(4):
            own = [x[hpylm.places(words, x[:, 0], x[:, 1], 4, split) == b] for x in (train, asked)]
            if sum(map(len, own)):
                three = np.concatenate(own).astype(np.uint32).T
                lengths = np.array([len(x) for x in own if len(x)], np.uint32)
                blocks.append(hpylm.gather([(7, hpylm.squeeze(words, *three, np.arange(len(lengths), dtype=np.uint32), lengths, np.array([0, 1], np.uint8)[[len(x) > 0 for x in own]]))], split))
        states = [hpylm.build([data], shared=True) for data, _ in blocks]
        send = lambda first=False: {r: [(b, m["data"]) for b, s in enumerate(states) for m in hpylm.to_root(s, 3, first) if m["bucket"] == r] for r in range(3)}  # noqa: B023, E731
        root = {r: hpylm.root_first(sent) for r, sent in send(True).items() if sent}

        def told():
            rows = {r: hpylm.root_row(r, data, n) for r, data in root.items()}  # noqa: B023
            for b, s in enumerate(states):  # noqa: B023
                hpylm.from_root(s, [(r, m["data"]) for r, x in rows.items() for m in x[3] if m["bucket"] == b])
            customers, tables, vocabulary, _, tokens, *more = np.sum([x[4] for x in rows.values()], axis=0)
            shared = np.array(more[4:]).reshape(2, -1)
            return hpylm.Totals([np.array([customers]), shared[0]], [np.array([tables]), shared[1]], tokens=int(tokens), vocabulary=int(vocabulary))

        t = told()
        assert t.tokens == 3000 and t.vocabulary == len(np.unique(train[:, 2]))
        for k in range(8):
            for i, s in enumerate(states):
                s.seatings = [hpylm.sweep(s, s.seatings[-1], s.within(s.seatings[-1], t), np.random.default_rng([k, i]))]
            root = {r: hpylm.root_again(root[r], sent, t, np.random.default_rng(k)) for r, sent in send().items() if sent}
            t = told()
            for j in range(n):
                mine = [(s, s.split[s.parent[s.context]] == j + 1) for s in states]
                assert len(mine) > 1 and t.customers[1][j] == sum(int(s.seatings[-1][hpylm.TWO][own].sum()) for s, own in mine) >= t.tables[1][j] > 0
        likelihood[n], whole = sum(s.trace[-1] for s in states), 0
        for s, (data, _) in zip(states, blocks, strict=True):
            s = hpylm.State.load(s.dump())
            count, score = hpylm.expand(hpylm.answer(s, [s.within(s.seatings[-1], t)], data))
            distinct, _, context = hpylm.expand(data)[:3]
            assert count.tolist() == [int((words[train[:, 2]] == w).sum()) for w in distinct]
            every = np.bincount(context) == 13
            assert np.allclose(np.bincount(context, 10.0 ** score.astype(float))[every], 1, atol=1e-4)
            whole += every.sum()
        assert whole == 60
    assert abs(likelihood[2] / likelihood[0] - 1) < 0.02


def test_frequent_words_are_found_and_buckets_have_partitions_of_their_own(spark):
    rows = spark.createDataFrame([(i, f"Lamp a{i} lamp b{i} the c{i}") for i in range(400)], "id long, text string")
    hashes = [int(textkernel.words(*textkernel.string_bytes(pa.array([x])))[3][0]) for x in ("lamp", "the")]
    assert hpylm.frequent_words(rows, 10000, 24).tolist() == sorted([*hashes, int(hpylm.END)])
    assert hpylm.frequent_words(rows, 10000, 2).tolist() == hashes[:1]
    for n in (1, 24, 53):
        keys = hpylm.labels(n)
        frame = spark.createDataFrame([(k,) for k in keys], "k long")
        assert keys == sorted(keys) and {r.p for r in frame.select(F.pmod(F.hash("k"), F.lit(n)).alias("p")).collect()} == set(range(n))


def test_a_bucket_takes_little_memory_beside_what_it_holds():
    rng, n = np.random.default_rng(5), 600_000
    words = np.sort(rng.integers(1, 2**63, 50_000).astype(np.uint64))
    three = np.stack([rng.integers(0, 50_000, n), rng.integers(0, 50_000, n), rng.integers(0, 50_000, n)]).astype(np.uint32)
    data, _ = hpylm.gather([(0, hpylm.squeeze(words, *three, np.zeros(1, np.uint32), np.array([n], np.uint32), np.zeros(1, np.uint8)))])
    state = hpylm.build([data], shared=True)
    root = {0: hpylm.root_first([(0, hpylm.to_root(state, 1, first=True)[0]["data"])])}
    row = hpylm.root_row(0, root[0])
    hpylm.from_root(state, [(0, row[3][0]["data"])])
    t = hpylm.Totals([np.array([row[4][0]])], [np.array([row[4][1]])], tokens=n, vocabulary=50_000)
    state.seatings = state.seatings * 3
    within = state.within(state.seatings[-1], t)

    def most(run):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak / n

    # bytes for each of the distinct trigrams, which are as many as bigrams and contexts here
    used = most(lambda: hpylm.sweep(state, state.seatings[-1], within, rng)), most(state.dump), most(lambda: hpylm.answer(state, [within] * 3, data))
    assert max(used) < 130


# 3 bit packing


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_fields_round_trip(bits):
    for n in (0, 1, 63, 64, 65, 1000):
        ids = np.random.default_rng(n).integers(0, 2**bits, n).astype(np.uint32)
        data = bitpack.pack(ids, bits)
        assert (bitpack.unpack(data, n, bits) == ids).all() and len(data) == -(-n // 64) * bits * 8
        assert all(bitpack.field(data, k, bits) == ids[k] for k in range(0, n, 17))
    with pytest.raises(ValueError):
        bitpack.pack(np.array([2**31], np.uint32), 31) if bits == 31 else bitpack.pack(np.array([1 << bits], np.uint64), bits) if bits < 31 else (_ for _ in ()).throw(ValueError)


def encoded(text):
    return word_ids(WORD_BPE).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_shards_hold_whole_texts_in_order(spark, docs, none):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)  # a session's settings do not break shards
    try:
        folder = bitpack.write_token_shards(docs, WORD_BPE, end_id=2, block_ids=500, shard_bytes=3000)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = bitpack.read_token_shards(spark, folder).collect()
    assert len({r.shard for r in found}) > len({r.shard[:9] for r in found})  # a task closes shards by bytes
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, Counter()
    for i, t, *_ in rows:
        ids = [*encoded(t), 2]
        want[i, at, len(ids), np.array(ids, "<u4").tobytes()] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in found) == want
    assert bitpack.width(49408) == 16
    assert bitpack.read_token_shards(spark, bitpack.write_token_shards(none, WORD_BPE, end_id=2)).count() == 0


def test_runs_give_the_ids_of_whole_texts():
    rng, coder = random.Random(5), WordIds(WORD_BPE)
    letters = [*"ab'st re ll★\n\t\x0b\x1c\x85\xa0éßİΣςσ0129.,!?<|>-_’́日本ﬁ½²", "<|endoftext|>", " ", " ", "x" * 70, "THE"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for part in (texts, texts[::-1]):
        got = [ids[a:b].tolist() for ids, bounds in coder.encode(pa.array(part), 7) for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in part]


def test_forgetting_changes_no_ids(monkeypatch):
    from loresmith.llm import word_ids as module

    monkeypatch.setattr(module, "REMEMBERED", 50)
    monkeypatch.setattr(module, "GROUP_BYTES", 400)
    rng, coder = random.Random(8), WordIds(WORD_BPE)
    texts = [prose(rng.randint(0, 80), rng) for _ in range(120)]
    got = [ids[a:b].tolist() for ids, bounds in coder.encode(pa.array(texts), 7) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert 0 < len(coder.keys) < 400


# 4 token counts


def test_section_tokens(docs, none):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coder, _ = token_spans.encoder(path, pattern)
    for rule in token_spans.RULES:
        found = token_spans.section_tokens(docs, path, pattern, rule).collect()
        by = Counter()
        want = Counter()
        for r in found:
            by[r.doc_id] += r.n_tokens
        for i, t, *_ in documents():
            want[i] += len(coder.encode_ordinary(t or ""))
        assert by == want
    for i, t, *_ in documents():
        if t and i not in (None, 3):
            own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
            assert "".join(t[r.char_start : r.char_end] for r in own) == t
            bounds = [0]
            spans = []
            for x in coder.encode_ordinary(t):
                n = len(coder.decode_single_token_bytes(x))
                spans.append((bounds[-1], bounds[-1] + n))
                bounds.append(bounds[-1] + n)
            cuts, at = [], 0
            for line in t.encode().split(b"\n"):
                cuts.append((at, at + len(line) + 1))
                at = cuts[-1][1]
            counts = Counter(max(range(len(cuts)), key=lambda k: (min(e, cuts[k][1]) - max(s, cuts[k][0]), -k)) for s, e in spans)
            assert [r.n_tokens for r in own] == [counts[k] for k in range(len(own))]
    assert token_spans.section_tokens(none, path, pattern).count() == 0


def test_allocation_rules():
    tokens, bounds = np.array([0, 4, 6, 12]), np.array([0, 5, 6, 12])
    assert token_spans.allocate(tokens, bounds, "first")[0].tolist() == [2, 0, 1]
    assert token_spans.allocate(tokens, bounds, "last")[0].tolist() == [1, 1, 1]
    counts, crossing = token_spans.allocate(tokens, bounds, "largest")
    assert counts.tolist() == [2, 0, 1] and crossing.tolist() == [1, 1, 0]


def test_tokens_of_given_fields(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coder, _ = token_spans.encoder(path, pattern)
    text = "Title: été à la lampe | body of words, 123456 | tail"
    first, second = text.index("été"), text.index("body")
    spans = [(second, text.index(" | tail")), (first, text.index(" | body")), (3, 3)]
    df = spark.createDataFrame([(1, text, spans), (2, text, None), (3, None, []), (4, "ab", [(0, 2)])], "doc_id long, text string, fields array<struct<start:int,end:int>>")
    bounds = np.r_[0, np.cumsum([len(coder.decode_single_token_bytes(x)) for x in coder.encode_ordinary(text)])]
    place = lambda k: len(text[:k].encode())
    for rule in token_spans.RULES:
        got = {(r.doc_id, r.section): (r.char_start, r.char_end, r.n_tokens) for r in token_spans.section_tokens(df, path, pattern, rule, spans_col="fields").collect()}
        want = Counter()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            held = {k: min(b, place(e)) - max(a, place(s)) for k, (s, e) in enumerate(spans) if min(b, place(e)) > max(a, place(s))}
            inside = lambda at: next((k for k, (s, e) in enumerate(spans) if place(s) <= at < place(e)), -1)
            rest = b - a - sum(held.values())
            best = max(held, key=held.get) if held and max(held.values()) > rest else -1 if rest else max(held, key=held.get)
            want[inside(a) if rule == "first" else inside(b - 1) if rule == "last" else best] += 1
        assert {k: got[1, k][2] for k in (0, 1, 2, -1)} == {k: want[k] for k in (0, 1, 2, -1)}
        assert got[1, 0][:2] == spans[0] and got[2, -1] == (0, len(text), len(coder.encode_ordinary(text))) and got[4, 0][:2] == (0, 2) and (4, -1) not in got and (3, 0) not in got
    for bad in ([(0, 3), (2, 4)], [(0, 99)], [(2, 1)]):
        with pytest.raises(ValueError):
            token_spans.field_sections(np.frombuffer(b"abcdef", np.uint8), bad)


# 5 media


def test_media_round_trip_and_fingerprints(docs, none):
    found = media_wav.wav_fingerprints(media_wav.to_wav_column(docs)).collect()
    by = {}
    for r in found:
        assert len(r.payload) % 576 == 0 and len(r.payload) >= 576 and len(r.codes) == len(r.times)
        assert media_wav.from_wav(bytes(r.media)) == bytes(r.payload) and list(r.times) == sorted(r.times)
        assert by.setdefault(bytes(r.payload), list(r.codes)) == list(r.codes)
    want = Counter((t or "").encode() for _, t, *_ in documents())
    assert Counter(bytes(r.payload)[: r.n_bytes] for r in found) == want
    assert media_wav.wav_fingerprints(media_wav.to_wav_column(none)).count() == 0


def test_media_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a" * 700, 5, "x"), (None, None, None, None)], "doc_id long, text string, codes int, Payload string")
    media = media_wav.to_wav_column(df).join(df.drop("text"), "doc_id", "left").unionByName(spark.createDataFrame([(2, 0, None, 1, "y")], "doc_id long, n_bytes long, media binary, codes int, Payload string"))
    found = {r.doc_id: r for r in media_wav.wav_fingerprints(media).collect()}
    assert bytes(found[1].payload) == b"a" * 700 + b"\xff" * 452 and found[2].payload is None and found[2].codes is None
    assert list(found[1].asDict()) == ["doc_id", "n_bytes", "media", "payload", "codes", "times"]


def test_pair_codes_against_a_plain_version():
    """Every pair of a peak with the next ones, worked out by loops over the peaks."""
    n = np.arange(576 * 9)
    samples = (128 + 50 * np.sin(2 * np.pi * 20 * n / 576) * (1 + 0.3 * np.sin(n / 900)) + 30 * np.sin(2 * np.pi * 90 * n / 576)).astype(np.uint8)
    frame, bins = media_wav.peaks(samples)
    order = sorted(zip(frame.tolist(), bins.tolist()))
    want = sorted((f, k, b << 14 | order[i + k][1] << 5 | order[i + k][0] - f) for i, (f, b) in enumerate(order) for k in range(1, media_wav.PAIRS + 1) if i + k < len(order) and order[i + k][0] - f <= media_wav.REACH)
    codes, times = media_wav.fingerprint(samples)
    assert [(t, c) for t, c in zip(times.tolist(), codes.tolist())] == [(f, c) for f, _, c in want] and len(want) > 10


def test_peaks_of_two_tones():
    n = np.arange(576 * 12)
    wave_ = 128 + 50 * np.sin(2 * np.pi * 20 * n / 576) * (1 + 0.3 * np.sin(n / 900)) + 30 * np.sin(2 * np.pi * 90 * n / 576) * (1 + 0.3 * np.cos(n / 700))
    _, bins = media_wav.peaks(wave_.astype(np.uint8))
    assert {20, 90} <= set(bins.tolist())


# 6 WARC


def pages(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, ""), (4, "http://a b\r\nX: 1", None), (5, "u", "WARC/1.1\r\n\r\nTRICK\r\n\r\n"), (6, "u", "é" * 4000), (None, "u", "same"), (None, "u", "lonely"), (1, "again", "same"), (9, "u", "last\r\n\r\n")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_read_back(spark):
    rows, df = pages(spark)
    folder = warc.write_warc(df.repartition(3))
    found = warc.read_warc(spark, folder).select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("r"), "payload").collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        of = first.get(h or "")
        again = of is not None and of != p
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", of if again else None, b"" if again else data] += 1
    assert Counter((r.p, r.payload_bytes, r.payload_digest, r.record_type, r.r, bytes(r.payload)) for r in found) == want
    assert warc.quarantine(spark, folder).count() == 0
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_salvage_goes_on_after_damage():
    made = [warc.record(i, "u", f"payload {i} ".encode() * 20, None) for i in range(12)]
    plain = b"".join(x + b"\r\n\r\n" for x in made)
    starts = [plain.index(x) for x in made]
    hurt = bytearray(plain)
    hurt[starts[3] + 5 : starts[3] + 8] = b"???"
    at = hurt.index(b"Content-Length: ", starts[7]) + 16
    hurt[at : at + 3] = b"999"
    hurt[starts[9] + len(made[9]) - 3] ^= 1
    out = list(warc.salvage(bytes(hurt)[: starts[11] + 40]))
    assert [r.offset for r in out if isinstance(r, warc.Record)] == [starts[k] for k in (0, 1, 2, 4, 5, 6, 8, 10)]
    assert [(g.start, g.end) for g in out if isinstance(g, warc.Gap)] == [(starts[3], starts[4]), (starts[7], starts[8]), (starts[9], starts[10]), (starts[11], starts[11] + 40)]
    members = [gzip.compress(x + b"\r\n\r\n") for x in made]
    packed = bytearray(b"".join(members))
    ends = np.cumsum([len(m) for m in members])
    packed[int(ends[4]) + 30] ^= 0xFF
    out = list(warc.salvage(bytes(packed)))
    assert sum(isinstance(r, warc.Record) for r in out) == 11
    assert [(g.start, g.end) for g in out if isinstance(g, warc.Gap)] == [(int(ends[4]), int(ends[5]))]


def test_members_of_several_records_are_salvaged_whole():
    records = [bytearray(warc.record(k, f"http://x/{k}", b"p" * k, None) + b"\r\n\r\n") for k in range(1, 5)]
    member = lambda rows: gzip.compress(b"".join(rows), mtime=0)
    names = lambda data: [x.headers["warc-record-id"] if isinstance(x, warc.Record) else "gap" for x in warc.salvage(data)]
    every = [warc.record_name(k) for k in range(1, 5)]
    assert names(member(records)) == every
    assert names(member(records[:2]) + member(records[2:])) == every
    for k in range(4):
        damaged = [bytearray(r) for r in records]
        damaged[k][-5] ^= 0xFF
        assert names(member(damaged)) == [*every[:k], "gap", *every[k + 1 :]]
    noise = np.random.default_rng(1)
    large = [warc.record(k, "u", noise.bytes(20000), None) + b"\r\n\r\n" for k in range(1, 5)]
    assert names(member(large)[:70000] + member(records[3:])) == [*every[:3], "gap", every[3]]


def test_salvage_takes_strange_headers():
    good = warc.record(1, "u", b"payload", None)
    base32 = warc.sha1_base32(b"payload")
    hexed = good.replace(f"WARC-Payload-Digest: sha1:{base32}".encode(), b"WARC-Payload-Digest: SHA1:" + hashlib.sha1(b"payload").hexdigest().upper().encode())
    assert hexed != good
    size = good[good.index(b"Content-Length: ") :].split(b"\r\n")[0]
    strange = [good.replace(size, b"Content-Length: " + x) for x in ("²68".encode(), b"9" * 5000, b"-1", b"", b"+5", "٣".encode())]
    data = b"\r\n\r\n".join([hexed, *strange, good, b"WARC/1.1\r\n" + b"x" * (2 << 20), good, b""])
    out = list(warc.salvage(data))
    assert sum(isinstance(r, warc.Record) for r in out) == 3 and sum(isinstance(r, warc.Gap) for r in out) == 2
    assert warc.whole_number("²") is None and warc.whole_number("12") == 12 and warc.whole_number(None) is None


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_of_random_damage(packed):
    rng = random.Random(4)
    made = [warc.record(i, "u", prose(rng.randint(1, 40), rng).encode(), None) + b"\r\n\r\n" for i in range(20)]
    parts = [gzip.compress(x, mtime=0) for x in made] if packed else made
    starts = np.r_[0, np.cumsum([len(x) for x in parts])]
    for _ in range(60):
        data, hit = bytearray(b"".join(parts)), set()
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hit.add(int(np.searchsorted(starts, at, "right")) - 1)
        cut = rng.randrange(len(data)) if rng.random() < 0.5 else len(data)
        out = list(warc.salvage(bytes(data[:cut])))
        names = {r.headers.get("warc-record-id") for r in out if isinstance(r, warc.Record)}
        # every record that was not touched is there, and what no record covers is in a gap
        assert {warc.record_name(k) for k in range(20) if k not in hit and starts[k + 1] <= cut} <= names
        spans = sorted((g.start, g.end) for g in out if isinstance(g, warc.Gap))
        found_at = {r.offset for r in out if isinstance(r, warc.Record)}
        lost = [k for k in hit if starts[k + 1] <= cut and starts[k] not in found_at]
        assert all(any(a <= starts[k] < b for a, b in spans) for k in lost) and all(b <= cut for _, b in spans)


def test_members_take_linear_time():
    one = gzip.compress(warc.record(1, "u", b"p" * 50, None) + b"\r\n\r\n")

    def seconds(n):
        began = time.perf_counter()
        assert sum(1 for _ in warc.salvage(one * n)) == n
        return time.perf_counter() - began

    seconds(200)
    assert seconds(4000) < 12 * max(seconds(1000), 0.02)


def test_files_are_cut_by_bytes(spark):
    rows = [(i, "u", "z" * 3000 + str(i)) for i in range(40)]
    folder = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), file_bytes=20000)
    files = spark.read.format("binaryFile").load(folder).select("length").collect()
    assert len(files) >= 6 and max(r.length for r in files) < 24000
    assert warc.read_warc(spark, folder).count() == 40


# 7 packing


def whole(pieces, capacity):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
    return len(by)


def test_packing_of_texts(docs, none):
    pieces = packing.pack_pieces(packing.token_pieces(docs, WORD_BPE, 1, 256).withColumn("offset_like", F.lit(1)), "length", 256).collect()
    want = Counter()
    for i, t, *_ in documents():
        ids = [*encoded(t), 1]
        for k in range(0, len(ids), 256):
            want[i, k // 256, k, np.array(ids[k : k + 256], "<u4").tobytes()] += 1
    assert Counter((p.doc_id, p.piece, p.start, bytes(p.ids)) for p in pieces) == want
    n = whole(pieces, 256)
    assert n <= -(-sum(p.length for p in pieces) // 256) + 1
    assert packing.pack_pieces(packing.token_pieces(none, WORD_BPE, 1), "length").count() == 0


def test_rows_without_length_take_no_room(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (2, 0, None), (3, 0, 0), (None, None, 4)], "doc_id long, piece int, length long")
    found = packing.pack_pieces(df, "length", 10).collect()
    assert len(found) == 5 and sum(r.sequence_id is None for r in found) == 2
    whole([r for r in found if r.sequence_id is not None], 10)
    with pytest.raises(ValueError):
        packing.pack_pieces(df, "length", 4)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_histogram_and_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1024, np.maximum(1, rng.lognormal(4 + seed / 3, 1, 4000).astype(int)))
    histogram = Counter(lengths.tolist())
    plan = packing.packing_plan(histogram.items(), 1024)
    held = Counter()
    for pattern, times in plan.patterns:
        assert sum(x * n for x, n in pattern) <= 1024
        for x, n in pattern:
            held[x] += n * times
    assert held == histogram
    bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert bound <= plan.bound <= plan.sequences <= plan.bound * 1.01 + 1


@pytest.mark.parametrize(("histogram", "capacity", "optimum"), [
    ({50: 100, 30: 100, 20: 100}, 100, 100), ({2040: 600, 1080: 600, 1040: 600, 920: 1200}, 4096, 900), ({51: 600, 27: 600, 26: 600, 23: 1200}, 100, 900),
    # prices of 1/2 for 2055 and 1/4 for the others are feasible in the dual: no pattern is worth more than 1
    ({2055: 6000, 1030: 6000, 1035: 6000, 1010: 12000}, 4096, 9000),
])
def test_the_program_decides_where_best_fit_misses(histogram, capacity, optimum):
    plan = packing.packing_plan(histogram.items(), capacity)
    held = Counter()
    for pattern, times in plan.patterns:
        assert sum(x * n for x, n in pattern) <= capacity
        for x, n in pattern:
            held[x] += n * times
    assert held == histogram and plan.sequences == plan.bound == optimum
    assert capacity == 100 and 50 in histogram or sum(n for _, n in packing.best_fit(dict(histogram), capacity)) > optimum


def test_plans_of_small_instances_against_exact_optima():
    def optimum(items, capacity):
        best = [len(items)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i, room in enumerate(rooms):
                if room >= items[k] and room not in rooms[:i]:
                    go(k + 1, [*rooms[:i], room - items[k], *rooms[i + 1 :]])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return best[0]

    rng = np.random.default_rng(3)
    over = Counter()
    for _ in range(80):
        items = sorted(rng.integers(8, 60, int(rng.integers(1, 12))).tolist(), reverse=True)
        plan, least = packing.packing_plan(Counter(items).items(), 100), optimum(items, 100)
        assert plan.bound <= least <= plan.sequences <= least + 1
        over[plan.sequences - least] += 1
    assert over[0] >= 78


def test_many_lengths_stay_small_on_the_driver(monkeypatch):
    monkeypatch.setattr(packing, "column_generation", None)
    rng = np.random.default_rng(6)
    lengths = rng.integers(30, 2000, 3000)
    plan = packing.packing_plan(Counter((lengths * 2 + 1).tolist()).items(), 4096)
    assert plan.bound <= plan.sequences <= plan.bound * 1.01 + 1


def test_parts_of_a_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_PART", 10)
    df = spark.createDataFrame([(k, 0, 5 if k % 3 else 2, 9, 9) for k in range(120)], "doc_id long, piece int, length long, offset long, sequence_id long")
    found = packing.pack_pieces(df, "length", 10).collect()
    assert len(found) == 120 and whole(found, 10) == 48 and found[0].__fields__ == ["doc_id", "piece", "length", "sequence_id", "offset"]


# 8 n-best


def test_segmentations_against_all_paths():
    model = nbest.pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def paths(s):
        if not s:
            yield 0.0, ()
        for j in range(1, min(len(s), model.longest) + 1):
            if (x := model.score(s[:j])) is not None:
                for r, p in paths(s[j:]):
                    yield x + r, (s[:j], *p)

    rng = random.Random(2)
    long = "".join(rng.choice("abthe日本é😀") for _ in range(300))
    (first, ids, told), *_ = next(model.segment(pa.array([long]), 2))
    best = [0.0] + [-math.inf] * (len(long) + 1)
    for i in range(len(long) + 1):
        for j in range(i + 1, min(len(long) + 1, i + model.longest) + 1):
            if (x := model.score((nbest.BLANK + long)[i:j])) is not None:
                best[j] = max(best[j], best[i] + x)
    assert told and abs(first - best[-1]) < 1e-6 and model.decode(np.frombuffer(ids, "<u4").tolist()) == long
    cases = ["", "ab cd", "the\nxy", "  é z", "😀a b", " \n", "a\n\nb "] + ["".join(rng.choice("abthe \né😀") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    for text, found in zip(cases, model.segment(pa.array(cases), 5), strict=True):
        every = sorted((s for s, _ in paths((" " + text).replace(" ", nbest.BLANK))), reverse=True)[:5]
        assert np.allclose(every, [s for s, _, _ in found])
        assert len({ids for _, ids, _ in found}) == len(found)
        for _, ids, told in found:
            assert told and model.decode(np.frombuffer(ids, "<u4").tolist()) == text


def test_segmentations_of_a_table(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = nbest.n_best_segmentations(docs, path, 3).collect()
    assert {r.doc_id for r in found} == {i for i, *_ in documents()}
    assert all(r.decodes for r in found if r.doc_id != 19) and not any(r.decodes for r in found if r.doc_id == 19)
    by = defaultdict(list)
    for r in found:
        if r.doc_id not in (None, 3):
            by[r.doc_id].append((r["rank"], r.score))
    assert all([s for _, s in sorted(x)] == sorted((s for _, s in x), reverse=True) for x in by.values())
    assert nbest.n_best_segmentations(none, path).count() == 0


# 9 near duplicates


def brute_classes(rows, similarity=0.8):
    bags, root = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            w = [x for x in "".join(c if c not in "\x09\x0a\x0b\x0c\x0d" else " " for c in t or "").split(" ") if x]
            bags.setdefault(i, []).append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
            root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and any(x == y or (x and y and sum((x & y).values()) >= similarity * sum((x | y).values()) - 1e-9) for x in bags[a] for y in bags[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(text, rng, share):
    w = text.split()
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_classes(spark, docs, none, monkeypatch):
    rng = random.Random(11)
    base = [prose(150, rng) for _ in range(6)]
    rows = documents() + [(2000 + k, edited(base[k % 6], rng, rng.choice([0, 0.005, 0.02, 0.04, 0.08])), None, None, None, None) for k in range(240)]
    want = brute_classes(rows)
    sizes = Counter(want[i] for i, *_ in rows if i is not None)
    for block in (near_dedup.BLOCK, 4):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        found = near_dedup.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(found) == len(rows)
        assert all(want[r.doc_id] == r.class_id and sizes[r.class_id] == r.class_size and r.kept == (r.doc_id == r.class_id) for r in found if r.doc_id is not None)
        assert sum(r.doc_id is None and r.class_id is None and r.kept for r in found) == 2
    assert max(sizes.values()) > 10 and len(sizes) > 60
    assert near_dedup.near_classes(none).count() == 0
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id for r in left.collect()} == {None, *want.values()}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    w1 = rng.integers(1, 12, 120)
    w2 = np.where(rng.random(120) < 0.3, rng.integers(0, 12, 120), w1)
    rows, values, times = [], [], []
    for t in range(200):
        element = textkernel.mix(base ^ np.uint64(rng.integers(1, 2**62)))
        for k, w in ((0, w1), (1, w2)):
            some = np.flatnonzero(w)
            rows.append(np.full(len(some), 2 * t + k))
            values.append(element[some])
            times.append(w[some])
    s, any_ = bagminhash.signatures(np.concatenate(rows), np.concatenate(values), np.concatenate(times), 400)
    same = (s[0::2] == s[1::2]).mean(axis=1)
    assert any_.all() and abs(same.mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 4 * same.std() / len(same) ** 0.5


# 10 quality


def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        text = prose(rng.randint(8, 60), rng)
        if bad:
            text = " ".join(x + "***" for x in text.split()) if i % 8 else " ".join(x for x in text.split()[:6] for _ in range(6))
        rows.append((i, text, None, None, None, None))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame([*rows, *documents()[-5:]], SCHEMA), spark.createDataFrame([*labels, (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_held_out_quality(spark, none):
    docs, labels, truth = labelled(spark)
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = subword_classifier.fit(docs, labels.where(~away))
    found = subword_classifier.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    out = [(r.score >= 0.7, truth[r.doc_id], r.doc_id) for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    # every eighth text repeats words: where training never met them, an average of n-gram vectors cannot see that (README);
    # the first round's hand-built feature for it is gone, and with it the 0.95 over all rows that this test asked for then
    seen = [(p, y) for p, y, i in out if i % 8]
    assert sum(p == bool(y) for p, y in seen) / len(seen) > 0.95 and sum(p == bool(y) for p, y, _ in out) / len(out) > 0.88
    kept = subword_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.7 for r in found)
    assert subword_classifier.score(none, model).count() == 0


def test_one_class_and_no_labels(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in subword_classifier.score(docs, subword_classifier.fit(docs, labels)).collect())
    assert all(r.score == 0.5 for r in subword_classifier.score(docs, subword_classifier.fit(docs, labels.limit(0))).collect())


def test_margin_is_the_mean_over_features():
    rng = np.random.default_rng(0)
    table = rng.normal(size=subword_classifier.BUCKETS)
    texts = ["", "a", "ab ab ab", "été lamp  lamp", "x" * 50]
    data, bounds = textkernel.string_bytes(pa.array(texts))
    together = subword_classifier.margin(data, bounds, table)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        found = np.concatenate([b for b, _ in subword_classifier.features(raw, np.array([0, len(raw)]))]) if len(raw) else np.zeros(0, int)
        assert abs(together[k] - (table[found].mean() if len(found) else 0)) < 1e-9


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    own, output, bias = rng.normal(size=(5, subword_classifier.DIM)), rng.normal(size=(2, subword_classifier.DIM)), rng.normal(size=2)
    part = rng.dirichlet(np.ones(5))

    def loss(label):
        odds = output @ (part @ own) + bias
        return np.log(np.exp(odds).sum()) - odds[label]

    for label in (0, 1):
        for x, g in zip((own, output, bias), subword_classifier.gradients(own, part, output, bias, label), strict=True):
            for at in np.ndindex(x.shape):
                kept = x[at]
                x[at] = kept + 1e-6
                more = loss(label)
                x[at] = kept - 1e-6
                less = loss(label)
                x[at] = kept
                assert abs((more - less) / 2e-6 - g[at]) < 1e-6


def test_features_are_of_characters():
    texts = ["", "ab", "été", "日本語 x", "ab", "😀é"]
    data, bounds = textkernel.string_bytes(pa.array(texts))
    codes, at = subword_classifier.characters(data, bounds)
    assert [at[k + 1] - at[k] for k in range(len(texts))] == [len(t) for t in texts]
    number = {}
    assert all(number.setdefault(int(c), ch) == ch for c, ch in zip(codes, "".join(texts), strict=True)) and len(number) == len(set("".join(texts)))
    sizes = [[int(b - a) for a, b in where] for _, where in subword_classifier.features(data, bounds)]
    grams = lambda length, sizes: [[max(0, length(t) - n + 1) for t in texts] for n in sizes]
    assert sizes == grams(lambda t: len(t.split()), subword_classifier.WORD_GRAMS) + grams(len, subword_classifier.GRAMS)


# shared parts


def test_words_and_shingles():
    texts = [t for _, t, *_ in documents()]
    data, bounds = textkernel.string_bytes(pa.array(texts))
    row, start, end, value = textkernel.words(data, bounds)
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    assert [(int(r), bytes(data[s:e])) for r, s, e in zip(row, start, end)] == want
    assert len(set(value.tolist())) == len({w for _, w in want})
    rows, hashes = textkernel.shingles(row, value)
    runs = [(i, tuple(w[k : k + 5])) for i in range(len(texts)) for w in [[x for r, x in want if r == i]] if w for k in range(max(1, len(w) - 4))]
    assert rows.tolist() == [i for i, _ in runs]
    assert len(set(hashes.tolist())) == len({s for _, s in runs})


def test_sides_are_broadcast_only_within_a_bound(spark, monkeypatch):
    df = staging.stage(spark.range(100))
    assert "broadcast" in staging.small(df)._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 64 * 50)
    assert "broadcast" not in staging.small(df)._jdf.queryExecution().analyzed().toString().lower()
