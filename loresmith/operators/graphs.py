"""Prerequisite and link graphs: distances, closures and connected groups, by rounds over staged frontiers."""

from __future__ import annotations

import functools
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalogue import query, table
from .shared import TASK_ROWS, checked, dealing, shared_folder, staged, staged_and_told, tasks_for, until_exit


#: Written parts of one size that are put together to one.
MERGED = 4
#: Rows that a search is expected to find for each link, for which its parts are sized.
ROWS_A_LINK = 10


class Parts:
    """A growing table in few written parts: of each size at most ``MERGED`` - 1, so each row is written again only as often as its part grows fourfold."""

    def __init__(self, first: DataFrame):
        self.held: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, part: DataFrame) -> None:
        self.held.append((0, part))
        while len(self.held) >= MERGED and len({size for size, _ in self.held[-MERGED:]}) == 1:
            size = self.held[-1][0] + 1
            last, self.held = self.held[-MERGED:], self.held[:-MERGED]
            self.held.append((size, staged(functools.reduce(DataFrame.unionByName, (df for _, df in last)))))

    def whole(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, (df for _, df in self.held))


def distances(edges: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(start, node, distance): fewest steps from each start along ``edges`` (source, target); cycles end, what is not reached has no row.

    Where every source is a start, each takes over what its targets have found
    (:func:`distances_of_all`); for fewer starts, or nodes with more links than
    a task should hold, frontiers are joined with the edges.
    """
    spark = edges.sparkSession
    parts = tasks_for(spark, ROWS_A_LINK * edges.count())
    links, _, _ = dealt(edges.select("source", "target").repartition(parts, "target").distinct(), "target", parts)
    firsts, _, _ = dealt(starts.select("start").repartition(parts, "start").distinct(), "start", parts)
    if hot_keys(links, "source", parts) is None and hot_keys(links, "target", parts) is None and links.join(firsts, F.col("source") == F.col("start"), "left_anti").isEmpty():
        return distances_of_all(links, firsts, parts, limit)
    return distances_of_some(links, firsts, limit)


def dealt(df: DataFrame, by: str, parts: int) -> tuple[DataFrame, int, DataFrame]:
    """``df``, which stands dealt by ``by`` into ``parts``, staged so that it still is when it is read (its name leaves the catalogue again); its rows; and the same table read without regard to how it is dealt."""
    spark, name = df.sparkSession, f"stage_{uuid.uuid4().hex}"
    path = until_exit(spark, shared_folder(spark))
    df.write.bucketBy(parts, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    rows = out.count()
    spark.sql(f"DROP TABLE {name}")
    return out, rows, spark.read.schema(out.schema).parquet(path)


def distances_of_all(links: DataFrame, firsts: DataFrame, parts: int, limit: int | None) -> DataFrame:
    """:func:`distances` from every source: what a target found at its distance k - 1 is k from the source, unless that has it nearer.

    Everything stays dealt by start, so only what is handed over is shuffled. It
    is compared with the two rounds before, beyond which undirected links never
    lead back; with all that was seen only where as many rows have come since the
    last time. So nothing is read in every round, and what goes round in between
    is dropped by then.
    """
    whole = functools.partial(functools.reduce, DataFrame.unionByName)
    # The filter takes rows one by one: Spark 4.1 lays columnar scans of a union end to end, though it counts on their being dealt alike.
    nearest = lambda parted: whole(df.where("distance >= 0") for df in parted).groupBy("start", "node").agg(F.min("distance").alias("distance"))
    first = dealt(firsts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")), "start", parts)
    # What :func:`dealt` gives, by age; no pair is in two of ``seen``, which goes as ``far`` as that distance, while ``loose`` may have it again later.
    seen, loose, last, k, far = [first], [], [first[0]], 0, 0
    while limit is None or k < limit:
        k += 1
        if k == 1:
            step = links.select(F.col("source").alias("start"), F.col("target").alias("node"))
        else:
            found = last[-1].select(F.col("start").alias("target"), "node")
            step = links.hint("merge").join(found.hint("merge"), "target").select(F.col("source").alias("start"), "node")
        step = step.repartition(parts, "start").withColumn("distance", F.lit(k))
        check = loose and sum(x[1] for x in loose) >= sum(x[1] for x in seen)
        if check:
            kept = dealt(nearest([step, *(x[0] for x in seen + loose)]).where(F.col("distance") > far), "start", parts)
            seen, loose, far = [*seen, kept], [], k
            last = [kept[0].where(F.col("distance") == k - 1), kept[0].where(F.col("distance") == k)]
            if last[-1].isEmpty():
                break
            continue
        exact = not loose and len(seen) == len(last)
        new = dealt(nearest([step, *last]).where(F.col("distance") == k), "start", parts)
        if not new[1]:
            break
        (seen if exact else loose).append(new)
        far = k if exact else far
        last = [*last, new[0]][-2:]
    if loose:
        seen.append(dealt(nearest([x[0] for x in seen + loose]).where(F.col("distance") > far), "start", parts))
    return whole([x[2] for x in seen])


def distances_of_some(links: DataFrame, firsts: DataFrame, limit: int | None) -> DataFrame:
    """:func:`distances` by rounds: each joins only the frontier with the edges, keeps what was not seen before, and is written; what was seen is held in few parts."""
    frontier = staged(firsts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")))
    seen, k = Parts(frontier), 0
    while limit is None or k < limit:
        k += 1
        step = frontier.select("start", F.col("node").alias("source")).join(links, "source").select("start", F.col("target").alias("node")).distinct()
        frontier, told = staged_and_told(step.join(seen.whole(), ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("distance")), F.count(F.lit(1)).alias("rows"))
        if not told["rows"]:
            break
        seen.add(frontier)
    return seen.whole()


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, level): all prerequisites of each start with the length of the longest way to it; a cycle is an error.

    ``edges`` are (child, parent).  Sorting by level descending, then name, puts every prerequisite before what needs it.
    """
    edges = edges.select(F.col("child").alias("source"), F.col("parent").alias("target")).distinct()
    most = edges.select("target").distinct().count() + 1
    frontier = staged(starts.select("start", F.col("start").alias("node")).distinct())
    levels, k = None, 0
    while True:
        k += 1
        step = frontier.select("start", F.col("node").alias("source")).join(edges, "source").select("start", F.col("target").alias("node")).distinct()
        frontier, told = staged_and_told(step, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("start") == F.col("node")).alias("circles"))
        if not told["rows"]:
            break
        if k > most or told["circles"]:
            raise ValueError("cyclic prerequisites")
        part = frontier.select("start", "node", F.lit(k).alias("level"))
        levels = part if levels is None else levels.unionByName(part)
    if levels is None:
        return starts.sparkSession.createDataFrame([], "start string, node string, level int")
    return levels.groupBy("start", "node").agg(F.max("level").alias("level"))


def hot_keys(rows: DataFrame, key: str, parts: int) -> DataFrame | None:
    """The values of ``key`` on more than ``TASK_ROWS`` of the staged ``rows`` (and some of more than half as many), to be broadcast; none where there are none.

    Each task tells only what is frequent in it, so next to nothing is shuffled:
    what ``parts`` tasks leave out of one value is half of ``TASK_ROWS`` at most.
    """
    least = max(TASK_ROWS // (2 * parts), 1)

    def frequent(batches):
        held = [batch.column(0) for batch in batches if batch.num_rows]
        if held:
            counts = pa.chunked_array(held).value_counts()
            counts = counts.filter(pc.greater_equal(pc.struct_field(counts, "counts"), least))
            yield pa.RecordBatch.from_arrays([pc.struct_field(counts, "values"), pc.struct_field(counts, "counts")], names=["key", "n"])

    told = rows.select(F.col(key).alias("key")).mapInArrow(frequent, T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("n", T.LongType())]))
    hot = staged(told.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > TASK_ROWS // 2).select(F.col("key").alias(key)))
    return None if hot.isEmpty() else F.broadcast(hot)


def with_lower(found: DataFrame, parts: int) -> DataFrame:
    """(u, v, m): ``m`` is the least neighbour below ``v``, null where there is none.

    Rows of a hot ``v`` meet theirs by broadcast.  The rest is merged, since a
    broadcast by size of files would hold many more narrow rows than it seems.
    """
    lower, hot = found.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), hot_keys(found, "v", parts)
    cold = found if hot is None else found.join(hot, "v", "left_anti")
    out = cold.hint("merge").join(lower.hint("merge"), "v", "left").select("u", "v", "m")
    return out if hot is None else out.unionByName(found.join(hot, "v", "left_semi").join(F.broadcast(lower.join(hot, "v", "left_semi")), "v", "left").select("u", "v", "m"))


def with_least(large: DataFrame, parts: int) -> DataFrame:
    """(u, v, m): ``m`` is the least ``v`` of each ``u``; dealt by ``u`` once for both the aggregate and its join, but for hot ones."""
    hot = hot_keys(large, "u", parts)
    cold = (large if hot is None else large.join(hot, "u", "left_anti")).repartition(parts, "u")
    out = cold.hint("merge").join(cold.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u").select("u", "v", "m")
    if hot is None:
        return out
    many = large.join(hot, "u", "left_semi")
    return out.unionByName(many.join(F.broadcast(many.groupBy("u").agg(F.min("v").alias("m"))), "u").select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected group of the undirected edges ``a, b``; by large and small stars.

    Tasks are as many as the edges need at ``TASK_ROWS`` rows each, and no task
    holds all rows of a hot node; rounds grow with the logarithm of the longest
    way, not with it.
    """
    marks = F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("mark")
    spark, held = edges.sparkSession, None
    parts = tasks_for(spark, edges.count())
    # Rows of the input are dealt before they meet a hash table, since its splits hold any number of narrow rows.
    with dealing(spark, parts):
        loops, alone = staged_and_told(edges.where("(a <> b) IS NOT TRUE").select(F.explode(F.array("a", "b")).alias("node")).repartition(parts, "node").distinct(), F.count(F.lit(1)).alias("rows"))
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        found, told = staged_and_told(pairs.repartition(parts, "u", "v").distinct(), *marks)
    while told != held:
        held = told
        with dealing(spark, parts, whole_files=True):
            large = staged(with_lower(found, parts).select("u", F.coalesce("m", "v").alias("v")).distinct())
            star = with_least(large, parts)
            both = star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
            found, told = staged_and_told(both.where("u <> v").distinct(), *marks)
    labels = found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    with dealing(spark, parts, whole_files=True):
        roots = staged(found.select(F.col("v").alias("node")).distinct())
        labels = labels.unionByName(roots.select("node", F.col("node").alias("component")))
        if alone["rows"]:
            labels = labels.unionByName(staged(loops.join(labels.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))))
    return labels


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part),
    w AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS distance FROM part UNION SELECT w.start, e.target, w.distance + 1 FROM w JOIN e ON e.source = w.node WHERE w.node <> 0)
    SELECT start::BIGINT AS start, node::BIGINT AS node, min(distance)::INT AS distance FROM w GROUP BY ALL""")
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps along prerequisite links from every node, in as many rounds as it takes."""
    p = F.col("p_partkey").cast("long")
    part = table(spark, sf_dir, "part")
    edges = part.select(p.alias("source"), F.explode(F.array(F.floor(p / 2), F.floor(p / 3))).alias("target"))
    return distances(edges, part.select(p.alias("start"))).select("start", "node", "distance")


@query()
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of all lines that share a part, directly or through others; held to a union-find in the tests, since recursion in SQL is too slow."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + (1 << 40)).alias("b"))
    return components(edges).where(F.col("node") < 1 << 40)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey::BIGINT AS a, o_orderkey + {1 << 40} AS b FROM orders), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    w AS (SELECT DISTINCT a AS source, a AS node, 0 AS d FROM l UNION SELECT w.source, l.b, w.d + 1 FROM w JOIN l ON l.a = w.node WHERE w.d < 3),
    m AS (SELECT source, node, min(d) AS d FROM w GROUP BY ALL)
    SELECT source AS centre, count(*) AS systems FROM m WHERE d BETWEEN 1 AND 3 GROUP BY source""")
def distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of one to three jumps around each customer and each order, over all orders and without folding their keys."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") + (1 << 40)).alias("b")).distinct()
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("source", "target")
    found = distances(links, links.select(F.col("source").alias("start")).distinct(), limit=3)
    return found.where("distance BETWEEN 1 AND 3").groupBy(F.col("start").alias("centre")).agg(F.count(F.lit(1)).alias("systems"))


@query("""WITH d AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 AND p_size > 10),
    f AS (SELECT p.child, count(*) AS producers FROM d p JOIN part x ON x.p_partkey = p.parent WHERE x.p_size > 5 GROUP BY p.child)
    SELECT child, producers FROM f""")
def flag_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required flags meet the missions that set them; those without a known producer give no link."""
    need = table(spark, sf_dir, "part").where("p_partkey > 0 AND p_size > 10").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    producers = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("parent"))
    return need.join(checked(producers), "parent").groupBy("child").agg(F.count(F.lit(1)).alias("producers"))


@query("""SELECT c_nationkey AS system, count(*) AS planets FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = (c.c_nationkey + 1) % 25 AND s.s_acctbal > 5000)
    AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey""")
def neighbour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with a neighbour that passes a filter: a semi-join on links."""
    good = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n")).distinct()
    places = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return places.join(checked(good), (F.col("c_nationkey") + 1) % 25 == F.col("n"), "left_semi").groupBy(F.col("c_nationkey").alias("system")).agg(F.count(F.lit(1)).alias("planets"))
