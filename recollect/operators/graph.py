"""Directed graphs of sessions and merge pointers: closures by rounds of joins, with lineage cut between rounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recall import is_small, small
from .tables import Steps, by_range, dropped, shared_dir, written

#: Rows that are followed inside of a task at once.
HERE = 1 << 17


def _ranked(pointing: DataFrame, steps: Steps) -> tuple[DataFrame, int]:
    """(n, p, hops, done) where pointers (n, p) lead, and how many lead nowhere: list ranking by pointer doubling.

    A round composes what is open with what everything has reached, so that the ways done double and their lengths add up.
    As long as something open ends at all, a round finishes some of it: when a round finishes nothing, the rest runs in circles.
    """
    at = steps.keep(pointing.select("n", "p", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done")), "at")
    left, before = at.count(), -1
    while left not in (0, before):
        far = at.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("hops").alias("more"), F.col("done").alias("end"))
        new = at.filter("not done").join(far, "p", "left").select("n", F.coalesce("pp", "p").alias("p"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("end", F.lit(True)).alias("done"))
        at = steps.keep(new.union(at.filter("done")), "at")
        before, left = left, at.filter("not done").count()
    return at, left


def _rings(pointing: DataFrame, steps: Steps) -> DataFrame:
    """(node) on the circles of pointers (n, p) that never end: the images of all nodes under ever more steps shrink to them."""
    at, before = pointing.select("n", "p"), pointing.count()
    while True:
        size = at.select("p").distinct().count()
        if size == before:
            return at.select(F.col("p").alias("node")).distinct()
        before = size
        at = steps.keep(at.join(at.select(F.col("n").alias("p"), F.col("p").alias("q")), "p").select("n", F.col("q").alias("p")), "image")


def resolved(nodes: DataFrame, key: str, pointer: str) -> DataFrame:
    """(key, survivor, hops, circular): where pointers lead, and after how many hops.

    A pointer to a missing node ends there, a node without a pointer or with one to itself is its own survivor. A way that runs
    into a circle ends at the first node that it would meet twice: the one where it enters the circle, which for a node of the circle is
    the node itself. As many rounds as the logarithm of the longest way.
    """
    steps, of = Steps(), nodes.select(F.col(key).alias("n"), F.col(pointer).alias("p"))
    pointing = of.filter("p is not null and p <> n")
    at, left = _ranked(pointing, steps)
    ends = at.filter("done").select("n", "p", "hops", F.lit(False).alias("circular"))
    inner = Steps()
    if left:
        stuck = inner.keep(pointing.join(at.filter("not done").select("n"), "n", "left_semi"), "stuck")
        ring = inner.keep(_rings(stuck, inner), "ring")
        enters = Steps()
        tails, _ = _ranked(stuck.join(ring.withColumnRenamed("node", "n"), "n", "left_anti"), enters)
        inner.now["tails"] = enters.now.pop("at")
        ends = ends.union(tails.select("n", "p", "hops", F.lit(True))).union(ring.select("node", "node", F.lit(0).cast("long"), F.lit(True)))
    alone = of.filter("p is null or p = n").select("n", F.col("n").alias("p"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("circular"))
    out = written(ends.union(alone).select(F.col("n").alias(key), F.col("p").alias("survivor"), "hops", "circular"), "resolved")
    steps.done()
    inner.done()
    return out


def survivors(nodes: DataFrame, key: str, pointer: str) -> DataFrame:
    """(key, survivor): where merge pointers lead; see `resolved`."""
    return resolved(nodes, key, pointer).select(key, "survivor")


def threads(sessions: DataFrame) -> DataFrame:
    """(id, kind, head, hops, position) of sessions (id, status, started_at, replaced_by).

    A session that isn't replaced is `live` and its own head. A replaced one is `earlier` than the live session that its replacements lead
    to, with its place among the head's earlier ones by start, and `orphan` without a head where they lead to none: to a missing session,
    to a replaced one without a replacement, or round in a circle. Places come from a scan over ranges, as one head may have most of all.
    """
    old = F.col("status") == "replaced"
    ways = resolved(sessions.select("id", F.when(old, F.col("replaced_by")).alias("to")), "id", "to")
    live = sessions.filter(~F.coalesce(old, F.lit(False))).select(F.col("id").alias("survivor"), F.lit(True).alias("alive"))
    rows = sessions.select("id", "status", "started_at").join(ways, "id").join(live, "survivor", "left")
    headed = F.col("alive") & ~F.col("circular")
    kind = F.when(~F.coalesce(old, F.lit(False)), "live").when(headed, "earlier").otherwise("orphan")
    rows = rows.select("id", "started_at", kind.alias("kind"), F.when(headed, F.col("survivor")).alias("head"), F.when(headed, F.col("hops")).alias("hops"))
    placed = numbered(rows.filter("kind = 'earlier'"), "head", ["started_at", "id"]).select("id", "kind", "head", "hops", "position")
    return placed.union(rows.filter("kind <> 'earlier'").select("id", "kind", "head", "hops", F.lit(None).cast("long")))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `position`, from 1 in the order of each key; a key with most of the rows is numbered by many tasks."""
    dealt = by_range(rows, key, *order)
    inside = F.row_number().over(Window.partitionBy("part_", key).orderBy(*order))
    before = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(key, "part_").agg(F.count(F.lit(1)).alias("n_")).select(key, "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n_"))
    return dealt.withColumn("position", inside).join(counts, [key, "part_"]).withColumn("position", F.col("position") + F.col("n_")).drop("n_", "part_")


def reachable(edges: DataFrame, starts: DataFrame, src: str, dst: str, depth: int = 100) -> DataFrame:
    """(start, node, hops): what each start reaches, by the frontier; circles end, as only new pairs go on."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("at"), F.col(dst).alias("to")).distinct()
    seen = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        new = front.join(e, front["node"] == e["at"]).select("start", F.col("to").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = written(new.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "front")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen.filter("hops > 0")


def on_cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node) of true cycles, of any length; a diamond is none, nor is an edge from a node to itself.

    Nodes without an edge in or out go first. Then each node takes the least node that reaches it as its colour; what
    reaches its own colour's node inside the colour is strongly connected with it. Such nodes are done; those that are
    alone were on no cycle; the rest starts again. A row for each edge and node, never for pairs; as many rounds as the
    longest way.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct().checkpoint()
    found = []
    while True:
        left = e.count()
        while left:
            e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").checkpoint()
            now = e.count()
            if now == left:
                break
            left = now
        if not left:
            break
        colour = _spread(e.select(F.col("a").alias("n")).distinct().withColumn("c", F.col("n")), e)
        of = lambda k, colour=colour: colour.select(F.col("n").alias(k), F.col("c").alias(f"c{k}"))
        inside = e.join(of("a"), "a").join(of("b"), "b").filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")).checkpoint()
        # Backwards from the colour's own node; others have a colour that is larger than any until they are reached.
        start = colour.select("n", F.when(F.col("n") == F.col("c"), F.col("c")).alias("c"))
        reached = _spread(start, inside).filter("c is not null").checkpoint()
        found.append(reached.join(reached.groupBy("c").count().filter("count > 1").select("c"), "c", "left_semi").select(F.col("n").alias("node")))
        e = e.join(reached.select(F.col("n").alias("a")), "a", "left_anti").join(reached.select(F.col("n").alias("b")), "b", "left_anti").checkpoint()
    out = edges.select(F.col(src).alias("node")).limit(0)
    for f in found:
        out = out.union(f)
    return out


def _spread(values: DataFrame, e: DataFrame) -> DataFrame:
    """(n, c): the least c along edges (a, b), from values (n, c) where c may be null."""
    before = None
    while True:
        for _ in range(2):  # a step reads the values twice, so that more of them would multiply the plan
            come = e.join(values.filter("c is not null").withColumnRenamed("n", "a"), "a").groupBy(F.col("b").alias("n")).agg(F.min("c").alias("new"))
            values = values.join(come, "n", "left").select("n", F.least("c", "new").alias("c"))
        values = values.checkpoint()
        now = values.agg(F.count("c"), F.sum(F.xxhash64("n", "c").cast("decimal(38,0)"))).first()
        if now == before:
            return values
        before = now


def _here(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of `HERE` rows at most, or of one batch."""
    held, n = [], 0
    for t in tables:
        if held and n + len(t) > HERE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
        held.append(t)
        n += len(t)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _after(to: np.ndarray) -> np.ndarray:
    """Where ways (places of the next one, or -1) have come to after more steps than there are places."""
    at = np.where(to < 0, np.arange(len(to)), to)
    for _ in range(len(to).bit_length()):
        at = at[at]
    return at


def _pieces(pointing: DataFrame) -> DataFrame:
    """(piece, n, to, e, ring): pointers (n, p) as they lie, by pieces of bounded size: nodes whose way leaves the piece, the place of the next
    node in it (or -1), and the node outside that the way comes to first; and the nodes of circles inside of the piece."""
    kind = pointing.schema["n"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _here(batches):
            n, p = t["n"].combine_chunks(), t["p"].combine_chunks()
            to = pc.fill_null(pc.index_in(p, value_set=n), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            at = _after(to)
            leaves = np.flatnonzero(to[at] < 0)
            place = np.full(len(to) + 1, -1, np.int32)  # -1 stays -1
            place[leaves] = np.arange(len(leaves))
            ring = np.unique(at[to[at] >= 0])
            cells = [[uuid.uuid4().hex], [n.take(pa.array(leaves))], [place[to[leaves]]], [p.take(pa.array(at[leaves]))], [n.take(pa.array(ring))]]
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x[0])], pa.int32()), x[0] if isinstance(x[0], pa.Array) else pa.array(x[0]))
            yield pa.RecordBatch.from_arrays([pa.array(cells[0]), *map(whole, cells[1:])], ["piece", "n", "to", "e", "ring"])

    return pointing.select("n", "p").mapInArrow(run, f"piece string, n array<{kind}>, to array<int>, e array<{kind}>, ring array<{kind}>")


def _passed(pieces: DataFrame) -> DataFrame:
    """(node): the nodes of pieces (n, to) that ways from the places `first` pass."""
    kind = pieces.schema["n"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(len(t)):
                n, to, first = (t[c].slice(k, 1).flatten() for c in ("n", "to", "first"))
                jump = np.append(to.to_numpy(zero_copy_only=False), -1)  # the last place is outside, and is -1 too
                seen = np.zeros(len(jump), bool)
                seen[first.to_numpy(zero_copy_only=False)] = True
                for _ in range(len(jump).bit_length()):
                    seen[jump[seen]] = True
                    jump = jump[jump]
                yield pa.RecordBatch.from_arrays([n.filter(pa.array(seen[:-1]))], ["node"])

    return pieces.select("n", "to", "first").mapInArrow(run, f"node {kind}")


def pointer_cycles(nodes: DataFrame, key: str, pointer: str) -> DataFrame:
    """(node) on cycles of a graph where each node points to one other at most: where ways that never end run round. A node that points to
    itself is on none.

    Rows that lie side by side often point to each other, as versions do in the order of a window. So pieces of the rows, as they lie, are
    followed inside of the tasks first: circles inside of a piece are found, and ways that leave it lead straight to where they enter another one.
    Only nodes that are entered from outside go through the rounds of joins; the ways that these take inside their pieces are on the cycle
    with them. Rows in no order at all stay right, but nearly all of them go through the rounds.
    """
    of = nodes.select(F.col(key).alias("n"), F.col(pointer).alias("p")).filter("n is not null and p is not null and p <> n")
    pieces = written(_pieces(of), "pieces")
    left = pieces.select("piece", F.posexplode(F.arrays_zip("n", "e")).alias("at", "x"))
    left = left.select("piece", "at", F.col("x.n").alias("n"), F.col("x.e").alias("e"))
    entered = written(pieces.select(F.explode(F.array_distinct("e")).alias("n")).distinct(), "entered")
    inner = written(left.join(small(entered), "n", "left_semi"), "inner")
    ways = resolved(inner.select("n", "e"), "n", "e")
    met = written(inner.join(ways.filter(F.col("circular") & (F.col("hops") == 0)).select("n"), "n", "left_semi").select("piece", "at"), "met")
    firsts = met.groupBy("piece").agg(F.collect_list("at").alias("first"))  # of a piece's rows
    on = pieces.join(F.broadcast(firsts) if is_small(met) else firsts, "piece")
    out = written(_passed(on).union(pieces.select(F.explode("ring").alias("node"))), "cycles")
    dropped(pieces, entered, inner, ways, met)
    return out


def marked_superseded(edges: DataFrame, wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """(predecessor, successor, verdict) of wanted markings: self, missing, cycle, or ok.

    A marking closes a cycle if its predecessor supersedes its successor already.
    """
    ids = sessions.select("id")
    known = wanted.join(ids.select(F.col("id").alias("predecessor"), F.lit(True).alias("p")), "predecessor", "left").join(ids.select(F.col("id").alias("successor"), F.lit(True).alias("s")), "successor", "left")
    chain = edges.filter(F.col("kind").isin("supersedes", "replaces"))
    reach = reachable(chain, wanted.select(F.col("predecessor").alias("start")).distinct(), "from_session", "to_session")
    hit = reach.select(F.col("start").alias("predecessor"), F.col("node").alias("successor"), F.lit(True).alias("cycle"))
    rows = known.join(hit, ["predecessor", "successor"], "left")
    verdict = F.when(F.col("predecessor") == F.col("successor"), "self").when(F.col("p").isNull() | F.col("s").isNull(), "missing").when(F.col("cycle"), "cycle").otherwise("ok")
    return rows.select("predecessor", "successor", verdict.alias("verdict"))
