"""Near duplicates: BagMinHash bands find candidates, exact multiset overlap of whole texts decides, and links join into classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import BANDS, ROWS, band_keys, multiset, signatures
from .exact_dedup import md5_128, one_of_each, without
from .staging import small, stage, text_or_empty
from .textkernel import U, frugal, mix, shingles, slices, string_bytes, words

#: Members of a bucket that are compared with others at a time.
BLOCK = 512
SIMILARITY = 0.8


#: Nodes that stand for a further text of a repeated id are numbered from here, above any id.
FURTHER = 1 << 62


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``name`` (the id), ``hash`` of the text, ``id`` (the row's node) and the text; and whether ids repeat.

    A node is the id itself; where an id stands beside several texts, only the
    text of the least hash has it, the others get numbers of their own made from
    id and hash.  So rows of one id and different texts are never one node.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("name"), md5_128(text_or_empty(text_col)).alias("hash"), text_or_empty(text_col).alias("text"))
    per = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("hash").alias("least"), F.count(F.lit(1)).alias("n"))
    twice = stage(per.where("n > 1").drop("n"))
    if twice.isEmpty():
        return rows.select("name", "hash", F.col("name").alias("id"), "text"), False
    own = F.xxhash64("name", "hash").bitwiseAND(F.lit(FURTHER - 1)).bitwiseOR(F.lit(FURTHER))
    return rows.join(small(twice, 40), "name", "left").select("name", "hash", F.when(F.col("least") != F.col("hash"), own).otherwise(F.col("name")).alias("id"), "text"), True


def _shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int):
    """(first row, rows, row, value, times) of slices of the texts."""
    for i, j in slices(bounds):
        at = bounds[i : j + 1] - bounds[i]
        row, _, _, value = words(data[bounds[i] : bounds[j]], at)
        yield (i, j - i, *multiset(*shingles(row, value, size)))


def _signed(size: int, bands: int, rows: int):
    @frugal
    def run(batches):
        for batch in batches:
            data, bounds = string_bytes(batch.column(3))
            for i, n, row, value, times in _shingle_sets(data, bounds, size):
                signature, any_word = signatures(row, value, times, n, bands * rows)
                keys = band_keys(signature, bands, rows).astype(np.int64)[any_word]
                # a multiset's print: two sums of mixed elements with their counts
                code = mix(value + times.astype(U) * U(0x9E6C63D0876A9A47))
                sums = np.zeros((n, 2), U)
                np.add.at(sums[:, 0], row, code)
                np.add.at(sums[:, 1], row, mix(code + U(1)))
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(any_word * bands)].astype(np.int32)), pa.array(keys.ravel()))
                counts = np.bincount(row, times, n).astype(np.int64)
                given = [batch.column(k).slice(i, n) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*given, pa.array([x.tobytes() for x in sums], pa.binary()), pa.array(counts), listed], ["name", "hash", "id", "print", "n_shingles", "keys"])

    return run


def _sets(size: int):
    """Each text's shingles with their occurrence numbers, as sorted 64-bit values: set overlap of these is multiset overlap."""

    @frugal
    def run(batches):
        for batch in batches:
            data, bounds = string_bytes(batch.column(1))
            for i, n, row, value, times in _shingle_sets(data, bounds, size):
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                row, value = np.repeat(row, times), mix(np.repeat(value, times) + nth.astype(U) * U(0xD1B54A32D192ED03))
                order = np.lexsort((value, row))
                ends = np.searchsorted(row[order], np.arange(n + 1))
                value = value[order]
                out = [value[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(out, pa.binary())], ["id", "shingles"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], similarity: float):
    """(left, right) positions of all pairs whose multiset Jaccard similarity reaches the bound, by counting over the right side's postings."""
    sizes = np.array([len(x) for x in right])
    value, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    for i, own in enumerate(left):
        a, b = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
        n = b - a
        if not n.any():
            continue
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(right))
        # in whole numbers, so that a similarity just at the bound counts
        for j in np.flatnonzero(shared >= similarity * (len(own) + sizes - shared) - 1e-9).tolist():
            yield i, j


def _compare(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        out = []
        if len(left) and len(right):
            a, b = ([np.frombuffer(x, U) for x in side["shingles"]] for side in (left, right))
            la, lb = left["class"].tolist(), right["class"].tolist()
            root: dict[int, int] = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in overlaps(a, b, similarity):
                x, y = find(la[i]), find(lb[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(la[i], lb[j]), max(la[i], lb[j])))
            del a, b
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def linked(tasks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between classes, of the comparisons that ``tasks`` lists (group columns g1, g2, g3; side 0 or 1; id; class): a forest for each group."""
    rows = tasks.join(sets, "id")
    return rows.groupBy("g1", "g2", "g3").applyInPandas(_compare(similarity), "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each node of the links ``a, b`` hangs together with; by large and small stars, staged each round."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    held = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.sum("v")).first()
        if state == held or not state[0]:
            break
        held = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        down = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = stage(down.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def _relabel(nodes: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``nodes`` with the class that ``found`` gives in place of the value of ``column``."""
    hint = small(stage(found.withColumnRenamed("node", "__n").withColumnRenamed("class", "__c")), 32)
    return nodes.join(hint, F.col(column) == F.col("__n"), "left").withColumn(column, F.coalesce("__c", F.col(column))).drop("__n", "__c")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: the id, ``class_id`` (the id of the row that stays), ``class_size``, ``n_shingles``, ``kept`` and ``text_md5``.

    Two texts are linked if the multisets of their runs of ``size`` words
    overlap by ``similarity`` or more (weighted Jaccard); classes are what links
    join.  Bands of BagMinHash signatures give the candidates: a pair at 0.8
    shares a band but for about 5 in 100,000.

    1. Texts with the same multiset are one node, their smallest id.
    2. In each bucket the member that meets most others over all its buckets is
       the centre, and every other member is compared with it, exactly.
    3. Where a bucket still holds more than one class, all its members outside
       its largest class are compared with all members of other classes,
       exactly, block by block.  No link inside a bucket is lost, and no pairs
       are listed: a block gives back only links that join classes.

    Words are runs of anything but ASCII white space; a text of fewer words is
    one shingle.  Texts without words are one class; null text counts as empty.
    Rows with a null id stay apart (null class, size 1, kept).  Of each class
    the row with the smallest id stays.  An id that stands beside different
    texts is decided on for each of them: only its text of the least hash goes
    by the id in a class, its others go by numbers from 2**62 on, which come
    after all ids and show as ``class_id`` where such a row stays.  Rows equal in id
    and text are one node and get one decision.  Other columns are ignored.  An
    empty table gives no rows.
    """
    source, repeated = _numbered(docs, id_col, text_col)
    signed = stage(source.mapInArrow(_signed(size, bands, rows), "name long, hash binary, id long, print binary, n_shingles long, keys array<long>"))
    known = signed.where("id IS NOT NULL")
    same = stage(known.groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    nodes = known.select("name", "hash", "id", "print", "n_shingles").join(small(same, 48), "print", "left").select("name", "hash", "id", F.coalesce("first", "id").alias("node"), "n_shingles")
    nodes = stage(nodes)

    # buckets of distinct multisets; those that several bands give in the same members are taken once
    firsts = known.join(small(same.select("print", "first"), 48), "print", "left").where("first IS NULL OR first = id").select("id", "keys")
    member = stage(firsts.select("id", F.posexplode("keys").alias("band", "key")).distinct())
    seeds = [F.expr(f"bit_xor(xxhash64(id, {k}))").alias(f"x{k}") for k in (1, 2)]
    buckets = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *seeds).where("n > 1")
    buckets = stage(buckets.groupBy("n", "x1", "x2").agg(F.min_by(F.struct("band", "key"), F.struct("band", "key")).alias("b"), F.count(F.lit(1)).alias("bands")).select("b.band", "b.key", "n", "bands"))
    inside = stage(member.join(small(buckets, 48), ["band", "key"]).select("band", "key", "id", "n", "bands"))
    degree = inside.groupBy("id").agg(F.sum(F.col("n") * F.col("bands")).alias("degree"))
    ranked = inside.join(small(stage(degree), 32), "id")
    centre = stage(ranked.groupBy("band", "key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("centre")))
    pairs = inside.join(small(centre, 48), ["band", "key"]).where("id <> centre").select("id", "centre").distinct()
    pairs = stage(pairs.withColumn("g2", F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    pairs = pairs.join(small(stage(sizes), 32), "centre").select("id", "centre", F.pmod("g2", "blocks").alias("g2"))
    pairs = stage(pairs)

    needed = inside.select("id").distinct().withColumnRenamed("id", "__id")
    wanted = source.join(small(stage(needed), 16), F.col("id") == F.col("__id"), "left_semi").select("id", "text")
    wanted = wanted.dropDuplicates(["id"]) if repeated else wanted
    sets = stage(wanted.mapInArrow(_sets(size), "id long, shingles binary"), codec="none")
    group = [F.col("centre").alias("g1"), F.col("g2").cast("long").alias("g2"), F.lit(0).cast("long").alias("g3")]
    tasks = pairs.select(*group, F.lit(1).alias("side"), "id", F.col("id").alias("class"))
    tasks = tasks.unionByName(pairs.select(*group, F.lit(0).alias("side"), F.col("centre").alias("id"), F.col("centre").alias("class")).distinct())
    by_centre = stage(classes(linked(tasks, sets, similarity)))

    # what the centres left apart
    now = _relabel(inside.select("band", "key", "id", F.col("id").alias("class")), "class", by_centre)
    counts = now.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("n", "class")).alias("largest"), F.sum("n").alias("members"), F.max("n").alias("most")).where("classes > 1")
    mixed = stage(mixed.withColumn("far", F.ceil((F.col("members") - F.col("most")) / BLOCK)).withColumn("all", F.ceil(F.col("members") / BLOCK)))
    spread = now.join(small(mixed, 64), ["band", "key"]).withColumn("stray", F.col("class") != F.col("largest"))
    name = F.xxhash64("band", "key")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n))
    left = spread.where("stray").select(name.alias("g1"), own("far").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("g3"), F.lit(0).alias("side"), "id", "class")
    right = spread.select(name.alias("g1"), F.explode(F.sequence(F.lit(0), F.col("far") - 1)).alias("g2"), own("all").alias("g3"), F.lit(1).alias("side"), "id", "class")
    longs = lambda df: df.select(*(F.col(c).cast("long") for c in ("g1", "g2", "g3")), "side", "id", "class")
    joined = stage(classes(linked(longs(left).unionByName(longs(right)), sets, similarity)))

    out = _relabel(_relabel(nodes.withColumnRenamed("node", "class"), "class", by_centre), "class", joined)
    return _with_sizes(out, id_col, signed)


def _with_sizes(out: DataFrame, id_col: str, signed: DataFrame) -> DataFrame:
    out = stage(out)
    per = small(stage(out.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("class", "__c")), 32)
    sized = out.join(per, F.col("class") == F.col("__c"), "left")
    result = sized.select(F.col("name").alias(id_col), F.col("class").alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), "n_shingles", (F.col("id") == F.col("class")).alias("kept"), F.hex("hash").alias("text_md5"))
    nameless = signed.where("id IS NULL").select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_shingles", F.lit(True).alias("kept"), F.hex("hash").alias("text_md5"))
    return result.unionByName(nameless)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which :func:`near_classes` says ``kept``, in all their columns, each (id, text) once; all rows without an id stay."""
    gone = near_classes(docs, id_col, text_col).where("NOT kept").select(id_col, F.unhex("text_md5"))
    named = without(docs, gone, id_col, text_col, md5_128)
    return one_of_each(named.where(F.col(id_col).isNotNull()), id_col, text_col, md5_128).unionByName(named.where(F.col(id_col).isNull()))
