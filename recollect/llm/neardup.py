"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives each document's number of shingles, a 128-bit name of its set, and its band keys.
   Documents with the same set are one from here on (`rep`, the smallest id).
2. Each bucket's smallest rep is the centre of a star; its members are candidates with the centre only, so that a bucket
   of n gives n - 1 pairs. Pairs whose sizes allow a link are confirmed on full shingle sets; links give components.
3. A bucket that still spans several components may hide links between members that the centre isn't linked with. Small
   ones are compared as pairs (at most `small` a row). In larger ones, members outside the bucket's largest component are
   compared with all members, in blocks, inside tasks, that return stars of links; buckets of one component are joined first
   where that is less work.
4. Components over all links.

Texts never go through a shuffle: members of buckets are told on the scan by a bitmap of their ids, of at most
`bitmap_bits`, and only their sets go on. A bit that several ids share only adds sets that no pair asks for.

With 24 bands of 6 rows a pair at similarity 0.85 shares no bucket with probability 1e-5; so does one at 0.8 with 32 bands
of 5 (`LOOSE`). Sets that are too small for two different ones to be linked have no band keys. All members of every bucket
are handled, whatever its size.

Cases: null and empty texts have no shingles and link with nothing; very long texts are hashed block by block; repeated
ids are one node, and get a row for each of their rows; null ids link with nothing, and have a null component and kept =
true; other columns, whatever their names, are left behind. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from . import textbuf as tb
from .bitmap import id_bitmap, place
from .components import components
from .tables import dropped, written


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 85
    bands: int = 24
    rows: int = 6
    #: Members up to which a bucket's remaining pairs are joined; beyond it, they are compared in blocks of `block`.
    small: int = 24
    block: int = 128
    #: Shingles of a block, about; long sets make for blocks of fewer members.
    block_shingles: int = 500_000
    #: Bound of the bitmap of candidates (32 MB), which is copied to all executors.
    bitmap_bits: int = 1 << 28


#: Similarity 0.8.
LOOSE = NearDupParams(percent=80, bands=32, rows=5)


def signatures(docs: DataFrame, p: NearDupParams, key: str) -> DataFrame:
    """(doc_id, n, f1, f2, keys) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, least = sh.Sketcher(p.bands, p.rows), -(-p.percent // (100 - p.percent))
        for b in batches:
            for lo, hi, data, offs in tb.text_blocks(b.column("_text")):
                n, f1, f2, keys = [], [], [], []
                for s in sh.shingle_sets(data, offs, p.words):
                    x, y = sh.fingerprint(s)
                    n.append(len(s))
                    f1.append(x)
                    f2.append(y)
                    keys.append(sketcher.keys(s).astype(np.int64) if len(s) >= least else np.zeros(0, np.int64))
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = pa.array(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "n", "f1", "f2", "keys"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, p: NearDupParams, key: str) -> DataFrame:
    """(id, n, s): the sorted shingle sets of the documents in `ids`, and of a few others whose bit in the bitmap is set."""
    bitmap, bits = id_bitmap(ids, "id", p.bitmap_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("_place").to_numpy()
            b = b.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for lo, hi, data, offs in tb.text_blocks(b.column("_text")):
                found = [x.view(np.int64) for x in sh.shingle_sets(data, offs, p.words)]
                n = np.array([len(x) for x in found])
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(np.concatenate(found)))], ["id", "n", "s"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col("text").alias("_text")).filter("id is not null").withColumn("_place", place("id", bits))
    return rows.mapInArrow(run, "id long, n long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A member's set goes to its centre's once for each pair."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.filter(f"100 * both >= {p.percent} * (na + nb - both)").select("a", "b")


def _fits(a: str, b: str, p: NearDupParams) -> str:
    return f"100 * least({a}, {b}) >= {p.percent} * greatest({a}, {b})"


def _blocks(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between rows that are `asked` and others, in different components, as a star for each group that they form."""
    empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    pdf = pdf.sort_values(["id", "asked"]).reset_index(drop=True)
    left, right = (np.flatnonzero(pdf["asked"].to_numpy() == x) for x in (True, False))
    if not len(left) or not len(right):
        return empty
    n, comp = pdf["n"].to_numpy(), pdf["component"].to_numpy()
    flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["s"]])
    names, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(pdf)), n)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((len(left), len(right)), np.float64)
    for c in range(0, len(names), 4096):
        s, e = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(pdf), 4096), np.float32)
        m[row[s:e], col[s:e] - c] = 1
        both += m[left] @ m[right].T
    union = n[left][:, None] + n[right][None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
    label = np.arange(len(pdf))
    changed = True
    while changed:  # smallest row that each reaches
        least = np.minimum(label[left[x]], label[right[y]])
        before = label.copy()
        np.minimum.at(label, left[x], least)
        np.minimum.at(label, right[y], least)
        label = label[label]
        changed = bool((before != label).any())
    ids = pdf["id"].to_numpy()
    star = np.flatnonzero(label != np.arange(len(pdf)))
    return pd.DataFrame({"a": ids[label[star]], "b": ids[star]}) if len(star) else empty


def hidden_links(buckets: DataFrame, comp: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Links inside buckets between different components; `buckets` has (key, id, n), of buckets with several members."""
    named = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    shares = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    mixed = shares.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("c").alias("most"), F.sum("c").alias("m"), F.sum("t").alias("total")).filter("lo != hi")
    largest = shares.join(mixed, ["key"]).filter("c = most").groupBy("key", "m", "total").agg(F.min("component").alias("main"))
    rows = written(named.join(largest, "key"), "mixed")
    few = rows.filter(F.col("m") <= p.small).select("key", "id", "n", "component")
    other = few.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = few.join(other, "key").filter("id < b and component != cb").filter(_fits("n", "nb", p)).select(F.col("id").alias("a"), "b").distinct()
    found = confirmed(pairs, sets, p)
    # Buckets with the same largest component are one group where that is less work, as the same members meet in many of
    # them; a group compares its distinct askers, those outside that component, with all of its distinct members.
    large = rows.filter(F.col("m") > p.small).select("key", "main", "id", "n", "component")
    blocks = lambda count, size: F.greatest(F.ceil(count / p.block), F.ceil(size / p.block_shingles), F.lit(1)).cast("int")
    out = F.col("component") != F.col("main")

    def sizes(of: DataFrame, *by: str) -> DataFrame:
        return of.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.count_if(out).alias("ck"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("sk"))

    cost = F.col("c") * blocks(F.col("ck"), F.col("sk")) + F.col("ck") * blocks(F.col("c"), F.col("s"))
    apart = sizes(large, "main", "key").groupBy("main").agg(F.sum(cost).alias("apart"))
    joined = sizes(large.select("main", "id", "n", "component").distinct(), "main").select("main", cost.alias("joined"))
    group = large.join(apart.join(joined, "main"), "main").select("main", F.when(F.col("joined") > F.col("apart"), F.col("key")).alias("part"), "id", "n", "component").distinct()
    group = written(group.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("whole", F.col("part") == 0), "groups")
    by = ["main", "part", "whole"]
    placed = group.join(sizes(group, *by), by).withColumn("bm", blocks(F.col("c"), F.col("s"))).withColumn("bk", blocks(F.col("ck"), F.col("sk")))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.filter(out).select(*by, "id", "component", mine("bk").alias("i"), spread("bm").alias("j"), F.lit(True).alias("asked"))
    asked = placed.select(*by, "id", "component", spread("bk").alias("i"), mine("bm").alias("j"), F.lit(False).alias("asked"))
    both = asking.unionByName(asked).join(sets, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return _blocks(pdf, p.percent)

    links = written(found.union(both.groupBy(*by, "i", "j").applyInPandas(compare, "a long, b long")), "links")
    dropped(rows, group)
    return links


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams(), key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`, which has columns `key` and text."""
    sig = written(signatures(docs, p, key), "signatures")
    classes = sig.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "f1", "f2")
    lone = sig.select("doc_id", "n", "f1", "f2", "keys").filter("size(keys) > 0").join(reps, ["doc_id", "n", "f1", "f2"], "left_semi")
    rows = lone.select(F.col("doc_id").alias("id"), "n", F.explode("keys").alias("key"))
    centres = rows.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("most")).filter("centre != most")
    buckets = written(rows.join(centres.select("key", "centre"), "key").select("key", "id", "n", "centre").distinct(), "buckets")
    members = buckets.select("id", "n").distinct()
    sets = written(sets_of(docs, members.select("id").distinct(), p, key), "sets")
    pairs = buckets.filter("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), "n").distinct()
    pairs = pairs.join(members.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").filter(_fits("n", "na", p)).select("a", "b").distinct()
    links = written(confirmed(pairs, sets, p), "links")
    first = components(links, "a", "b")
    more = hidden_links(buckets.select("key", "id", "n"), first, sets, p)
    dropped(sets, buckets)
    comp = components(links.union(more), "a", "b") if more.take(1) else first
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).alias("c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
