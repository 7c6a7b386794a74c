"""Links inside buckets, without all pairs of a bucket.

A bucket is a key with members that may be alike.  First each member meets leaders of its
buckets, which links almost every group; only members that share a bucket but are still
in different components are then compared, block by block.  Every link between different
components is found, however large a bucket is.  Contents travel one a row, and both a
leader's members and the blocks are dealt out by their sizes, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save, small

#: targets -> a function that gives the positions of those that a query is linked with.
Prepare = Callable[[list[bytes]], Callable[[bytes], list[int]]]

#: Members that meet one copy of their leader's contents, rows that Python holds at once, and bytes of a block.
MEMBERS, ROWS, BLOCK = 4096, 512, 4_000_000
#: Members of a bucket from which on random leaders help the first one.
LARGE = 8


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that little is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])


def _met(batches: Iterator[pa.RecordBatch], prepare: Prepare) -> Iterator[pa.RecordBatch]:
    """Links of leaders and members; rows (a, salt, b, blob) come sorted, a leader's own, with
    a null b, before its members."""
    leader, targets, compare = None, [], None
    for batch in slices(batches):
        found = []
        for a, salt, b, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b is None:
                if leader != (a, salt):
                    leader, targets = (a, salt), []
                targets.append(blob)
                compare = prepare(targets)
            elif compare(blob):
                found.append((a, b))
        if found:
            yield _pairs(found)


def confirm(blobs: DataFrame, pairs: DataFrame, prepare: Prepare) -> DataFrame:
    """Those of the saved pairs (a, b) whose contents are linked; a is the leader."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")).where("salts > 1")
    hot = small(save(hot.withColumnRenamed("a", "hot"), "hot"))
    salted = pairs.join(hot, F.col("a") == F.col("hot"), "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"), F.lit(0)).alias("salt"), "b")
    leaders = pairs.select("a").distinct().join(hot, F.col("a") == F.col("hot"), "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    contents = lambda side: blobs.select(F.col("id").alias(side), "blob")
    rows = salted.join(contents("b"), "b").select("a", "salt", "b", "blob")
    rows = rows.union(leaders.join(contents("a"), "a").select("a", "salt", F.lit(None).cast("long"), "blob"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return save(rows.mapInArrow(lambda x: _met(x, prepare), "a long, b long").distinct(), "links")


def _compared(batches: Iterator[pa.RecordBatch], prepare: Prepare) -> Iterator[pa.RecordBatch]:
    """Parts that are linked, task by task; rows (task, query, part, blob) come sorted by task."""

    def linked(rows: list[tuple]) -> set[tuple[int, int]]:
        targets, queries = [r for r in rows if not r[1]], [r for r in rows if r[1]]
        if not targets or not queries:
            return set()
        compare = prepare([t[3] for t in targets])
        return {(min(q[2], targets[i][2]), max(q[2], targets[i][2])) for q in queries for i in compare(q[3]) if targets[i][2] != q[2]}

    held: list[tuple] = []
    for batch in slices(batches):
        found: set[tuple[int, int]] = set()
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and held[0][0] != row[0]:
                found |= linked(held)
                held = []
            held.append(row)
        if found:
            yield _pairs(sorted(found))
    if held and (found := linked(held)):
        yield _pairs(sorted(found))


def _across(blobs: DataFrame, rest: DataFrame, prepare: Prepare) -> DataFrame:
    """Links between different parts of a bucket, from saved rows (key, rep, part).  Members
    outside the bucket's largest part are its queries, all members its targets; blocks of
    queries meet blocks of targets, of about BLOCK bytes and MEMBERS members at most, so a large
    linked group costs rows in proportion to its size."""
    sized = save(rest.join(blobs.select(F.col("id").alias("rep"), F.length("blob").alias("size")).groupBy("rep").agg(F.sum("size").alias("size")), "rep"), "sized")
    share = F.count("*") / MEMBERS, F.sum("size") / BLOCK  # of a block, by number and by bytes
    parts = sized.groupBy("key", "part").agg(share[0].alias("by_n"), share[1].alias("by_size")).groupBy("key")
    major = lambda c: F.max_by(c, F.struct("by_n", "part"))
    parts = parts.agg(major("part").alias("major"), *[f(c) for c in ("by_n", "by_size") for f in (lambda c: F.sum(c).alias(f"all_{c}"), lambda c: (F.sum(c) - major(c)).alias(f"minor_{c}"))])
    parts = save(parts, "shares")
    rows = sized.join(parts, "key")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(f"{n}_by_n", f"{n}_by_size"))).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    queries = rows.where("part <> major").select("key", mine("minor").alias("q"), each("all").alias("t"), F.lit(True).alias("query"), "rep", "part")
    targets = rows.select("key", each("minor").alias("q"), mine("all").alias("t"), F.lit(False).alias("query"), "rep", "part")
    task = F.concat_ws(" ", "key", "q", "t").alias("task")
    dealt = queries.union(targets).select(task, "query", "rep", "part").join(blobs.select(F.col("id").alias("rep"), "blob"), "rep")
    dealt = dealt.select("task", "query", "part", "blob").repartition("task").sortWithinPartitions("task")
    return save(dealt.mapInArrow(lambda b: _compared(b, prepare), "a long, b long").distinct(), "parts")


def grouped(met: DataFrame, blobs: DataFrame, prepare: Prepare, known: DataFrame | None = None) -> DataFrame:
    """Components (id, component) of the members of buckets, under the links of any two
    members that share a bucket and are linked, and the known links (a, b).

    met has saved rows (key, rep), blobs saved rows (id, blob), an id's contents, of which
    there may be several versions."""
    order = lambda i: F.xxhash64("rep", F.lit(i))
    leads = met.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lead"), *[F.min(F.struct(order(i).alias("h"), "rep")).alias(f"lead{i}") for i in (1, 2)])
    leads = save(leads, "leads")  # a table, here and below, so that the join can split a hot bucket
    random = lambda i: F.min(F.when(F.col("n") > LARGE, F.col(f"lead{i}")))
    stars = met.join(leads, "key").groupBy("rep").agg(F.min("lead").alias("lead"), random(1).alias("lead1"), random(2).alias("lead2"))
    stars = stars.select(F.explode(F.array("lead", "lead1.rep", "lead2.rep")).alias("a"), F.col("rep").alias("b")).where("a <> b")
    links = confirm(blobs, save(stars.distinct(), "stars"), prepare)
    found = components(links.union(known) if known is not None else links)
    named = met.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    split = named.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    split = save(split, "split")
    rest = save(named.join(split, "key"), "rest")
    if rest.isEmpty():
        return found
    more = components(_across(blobs, rest, prepare))
    over = more.select(F.col("id").alias("component"), F.col("component").alias("over"))
    out = found.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
    return save(out.union(more.join(found, "id", "left_anti").select("id", "component")), "groups")
