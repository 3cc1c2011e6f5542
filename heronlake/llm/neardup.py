"""Embedding near-dedup by NN-descent.

Equal vectors of a label are one node. A first neighbour graph joins nodes that stand near each other in several orders of
random hyperplane signs; it is then refined by comparing the neighbours of each node with each other (NN-descent, Dong et
al., 2011) until few lists change. The graph's edges are checked in double precision and those from the threshold on are
kept. A node whose list is full and wholly reaches the threshold is saturated: its list may lack links, so it is enlarged to
all members of its component, in blocks, of which only counts are kept. It may also hide links to other components. So
saturated nodes are led by one of their nearest, within an angle r, and the leaders alone get a graph, with lists of twice
the length: two nodes that link have leaders within their own angle plus 2 r. The components of leaders that near meet in
blocks, too. Leaders that are saturated again are led again, up to three times. Recall is audited by nodes and by links
against brute force, on nodes of all degrees, and the graph refined further, with longer lists, while it falls short; it is
logged, and a recall below :attr:`Settings.least` is an error.

Refinement works on bytes for components. Those of a unit vector of d components are off by e = sqrt(d) / 254 at most, so by
an angle of asin(e), and a cosine of t or more isn't seen as less than cos(acos(t) + 2 asin(e)): edges from there on are
checked.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.llm.common import components, discard, stored


LOG = logging.getLogger(__name__)


@dataclass
class Settings:
    """asked is about how many nodes' links are counted for recall; block the members of a component that are met at once;
    tight is the least cosine of a node and its leader, and levels how often leaders are led again."""

    threshold: float = 0.93
    neighbours: int = 12
    orders: int = 6
    reach: int = 12
    rounds: int = 2
    settled: float = 0.02
    asked: int = 400
    tight: float = 0.995
    levels: int = 3
    recall: float = 0.97
    least: float = 0.9
    retries: int = 3
    block: int = 1024
    seed: int = 11


def binary(array: pa.Array, dtype: str) -> np.ndarray:
    """The values of a binary column, all of one length, as the rows of a matrix."""
    if not len(array):
        return np.zeros((0, 0), dtype)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(array), -1)


def named(label: str, embedding: str, seed: int) -> F.Column:
    """A vector's 64-bit name."""
    return F.xxhash64(F.lit(seed), label, embedding)


def nodes_of(vectors: DataFrame, key: str, embedding: str, label: str, s: Settings) -> tuple[DataFrame, int]:
    """(node, label, vec, n, k0, k1, ...) and the seed of the names: distinct usable vectors by label, as unit vectors of
    doubles in bytes, their rows, and their signs in each order.

    Vectors are told apart by 128 bits; if two have one name, all get names by another seed.
    """
    usable = vectors.where(usable_vector(embedding, label))
    kind = vectors.schema[label].dataType.simpleString()
    names = [f"k{i}" for i in range(s.orders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e = b.column(2)
            flat = np.asarray(e.flatten().to_numpy(zero_copy_only=False), np.float64)
            sizes = np.array(e.value_lengths().to_pylist())
            cuts = np.cumsum([0, *sizes])
            vec: list = [None] * b.num_rows
            keys = np.zeros((s.orders, b.num_rows), np.int64)
            for size in set(sizes.tolist()):
                on = np.flatnonzero(sizes == size)
                x = flat[cuts[on, None] + np.arange(size)]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for i, row in zip(on.tolist(), x, strict=True):
                    vec[i] = row.tobytes()
                for k in range(s.orders):
                    keys[k, on] = ((x @ _planes(s.seed + k, size)) > 0) @ (1 << np.arange(32, dtype=np.int64)[::-1])
            columns = [b.column(0), b.column(1), pa.array(vec, pa.binary()), b.column(3), *map(pa.array, keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "vec", "n", *names])

    for seed in range(s.seed, s.seed + 5):
        found = usable.select(named(label, embedding, seed).alias("node"), named(label, embedding, -seed).alias("other"), F.col(label).alias("label"), F.col(embedding).alias("e"))
        classes = found.groupBy("node", "other", "label").agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("n"))
        schema = f"node bigint, label {kind}, vec binary, n bigint, " + ", ".join(f"{k} bigint" for k in names)
        nodes = stored(classes.select("node", "label", "e", "n").mapInArrow(run, schema), "nodes")
        if not nodes.groupBy("node").count().where("count > 1").limit(1).count():
            return nodes, seed
        discard(nodes)
    raise RuntimeError("vectors share their names under each of five seeds")


def usable_vector(embedding: str, label: str) -> F.Column:
    """Labelled, without null or non-finite components, and not zero."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        F.col(label).isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: F.coalesce(x, F.lit(0)) != 0), F.lit(False)
    )


def _planes(seed: int, dim: int, bits: int = 32) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, bits))


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], names=["u", "v", "s"])


EDGE = "u bigint, v bigint, s float"


def first_graph(nodes: DataFrame, s: Settings) -> DataFrame:
    """Edges between nodes of a label within ``reach`` places of each other, in each of several orders.

    An order is dealt out by ranges of (label, signs, node), so a label or a bucket of any size is spread over tasks.
    """
    out = None
    for k in range(s.orders):

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, vecs = [], [], []
            for b in batches:
                ids += b.column(0).to_pylist()
                labels += b.column(1).to_pylist()
                vecs += b.column(2).to_pylist()
                if len(ids) >= 20_000:
                    yield from compared(ids, labels, vecs)
                    ids, labels, vecs = ids[-s.reach :], labels[-s.reach :], vecs[-s.reach :]
            if ids:
                yield from compared(ids, labels, vecs)

        def compared(ids: list, labels: list, vecs: list) -> Iterator[pa.RecordBatch]:
            node = np.array(ids)
            kind = {x: i for i, x in enumerate(dict.fromkeys(labels))}
            group = np.array([kind[x] for x in labels])
            size = np.array([len(x) for x in vecs])
            wide = size.max()
            x = np.frombuffer(b"".join(v.ljust(wide, b"\0") for v in vecs), "<f8").reshape(len(ids), -1).astype(np.float32)
            for j in range(1, min(s.reach, len(ids) - 1) + 1):
                on = np.flatnonzero((group[j:] == group[:-j]) & (size[j:] == size[:-j]))
                if len(on):
                    sim = np.einsum("ij,ij->i", x[on], x[on + j])
                    yield _edges(np.r_[node[on], node[on + j]], np.r_[node[on + j], node[on]], np.r_[sim, sim])

        keyed = nodes.select("node", "label", "vec", F.col(f"k{k}").alias("key"))
        parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = keyed.repartitionByRange(parts, "label", "key", "node").sortWithinPartitions("label", "key", "node")
        edges = best(order.drop("key").mapInArrow(near, EDGE), s.neighbours)
        out = edges if out is None else out.unionByName(edges)
    return stored(best(out.groupBy("u", "v").agg(F.max("s").alias("s")), s.neighbours).withColumn("new", F.lit(True)), "graph")


def best(edges: DataFrame, k: int, by: str = "u") -> DataFrame:
    order = W.partitionBy(by).orderBy(F.desc("s"), "v" if by == "u" else "u")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def refine(nodes: DataFrame, graph: DataFrame, k: int, s: Settings) -> DataFrame:
    """One round: each node's neighbours, in both directions, are compared with each other.

    Pairs of which neither is new to the node's list were compared before. A pair is kept if it betters one of the two
    lists.
    """
    full = graph.groupBy("u").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(-9.0).cast("float").alias("least")
    )
    both = graph.select(F.col("u").alias("w"), F.col("v").alias("m"), "s", "new").unionByName(
        graph.select(F.col("v").alias("w"), F.col("u").alias("m"), "s", "new")
    )
    both = both.groupBy("w", "m").agg(F.max("s").alias("s"), F.max("new").alias("new"))
    order = W.partitionBy("w").orderBy(F.desc("s"), "m")
    both = both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * k).drop("_r", "s")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a byte for each component is enough here
        for b in batches:
            small = [np.rint(np.frombuffer(v, "<f8") * 127).astype(np.int8).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary()), b.column(2)], names=["m", "q", "least"])

    small = nodes.join(full, nodes["node"] == full["u"], "left").select(
        F.col("node").alias("m"), "vec", F.coalesce("least", F.lit(-9.0).cast("float")).alias("least")
    )
    small = small.mapInArrow(pack, "m bigint, q binary, least float")
    met = both.join(small, "m").groupBy("w").agg(F.collect_list(F.struct("m", "new", "least", "q")).alias("x"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            cuts = np.cumsum([0, *col.value_lengths().to_pylist()])
            x = col.flatten()
            m, new, least = (np.asarray(x.field(i).to_numpy(zero_copy_only=False)) for i in range(3))
            raw = x.field(3).to_pylist()
            us, vs, ss = [], [], []
            for a, e in zip(cuts, cuts[1:]):  # noqa: B905
                if e - a < 2 or not new[a:e].any():
                    continue
                q = np.frombuffer(b"".join(raw[a:e]), np.int8).reshape(e - a, -1).astype(np.float32)
                norm = np.sqrt((q * q).sum(1))
                sim = (q @ q.T) / np.outer(norm, norm)
                fresh = new[a:e, None] | new[None, a:e]
                i, j = np.nonzero(fresh & (sim > least[a:e, None]))
                on = i != j
                us.append(m[a:e][i[on]])
                vs.append(m[a:e][j[on]])
                ss.append(sim[i[on], j[on]])
            if us:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    found = met.mapInArrow(compare, EDGE).groupBy("u", "v").agg(F.max("s").alias("s"))
    old = graph.select("u", "v", "s", F.lit(False).alias("new"))
    merged = old.unionByName(found.withColumn("new", F.lit(True)))
    merged = merged.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    return stored(best(merged, k), "graph")


def loosest(nodes: DataFrame, threshold: float, level: int = 0, tight: float = 1.0) -> float:
    """What a cosine of the threshold may look like in bytes for components, between leaders of a level; see the module."""
    size = (nodes.agg(F.max(F.octet_length("vec"))).first()[0] or 8) // 8
    off = 2 * np.arcsin(min(1.0, size**0.5 / 254))
    return float(np.cos(min(np.pi, np.arccos(threshold) + off + 2 * level * (np.arccos(tight) + off))))


def saturated(graph: DataFrame, k: int, least: float) -> DataFrame:
    """(u): nodes whose list of k is full and wholly at ``least`` or above."""
    full = graph.groupBy("u").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("c"))
    return full.where((F.col("s") >= least) & (F.col("c") >= k)).select("u")


def meeting(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a below b: components (p) of which two of some leaders reach a cosine; at most a block of leaders."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    kinds: dict = {}
    for p, label, vec in rows:
        kinds.setdefault((label, len(vec)), []).append((p, vec))
    found: set = set()
    for some in kinds.values():
        p = np.array([x for x, _ in some])
        x = np.frombuffer(b"".join(v for _, v in some), "<f8").reshape(len(some), -1)
        i, j = np.nonzero((x @ x.T >= least) & (p[:, None] < p[None]))
        found |= set(zip(p[i].tolist(), p[j].tolist(), strict=True))
    a, b = zip(*sorted(found), strict=True) if found else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def across(nodes: DataFrame, graph: DataFrame, parts: DataFrame, k: int, s: Settings) -> DataFrame:
    """(a, b), a below b: components whose saturated nodes can link, by the graphs of their leaders."""
    pairs, least = nodes.sparkSession.createDataFrame([], "a bigint, b bigint"), loosest(nodes, s.threshold)
    part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias("p" + c))
    for level in range(1, s.levels + 1):
        full = stored(saturated(graph, k, least), "saturated")
        if full.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("v"))
        near = graph.where(F.col("s") >= s.tight).select("u", order("v").alias("x")).unionByName(full.select("u", order("u").alias("x")))
        led = near.join(full, "u", "left_semi").groupBy("u").agg(F.min("x").alias("x"))
        leaders = stored(nodes.join(led.select(F.col("x.v").alias("node")).distinct(), "node", "left_semi"), "leaders")
        k, least = 2 * k, loosest(nodes, s.threshold, level, s.tight)
        if leaders.count() <= s.block:  # few enough to meet each other at once
            met = leaders.join(part("node"), "node", "left").select(F.coalesce("pnode", "node").alias("p"), "label", "vec")
            return stored(pairs.unionByName(met.coalesce(1).mapInArrow(partial(meeting, least), "a bigint, b bigint")).distinct(), "across")
        graph = first_graph(leaders, replace(s, neighbours=k))
        for _ in range(s.rounds):
            graph = refine(leaders, graph, k, s)
        met = graph.where(F.col("s") >= least).join(part("u"), "u", "left").join(part("v"), "v", "left")
        a, b = F.coalesce("pu", "u"), F.coalesce("pv", "v")
        met = met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
        pairs = stored(pairs.unionByName(met).distinct(), "across")
    return pairs


def links_of(nodes: DataFrame, graph: DataFrame, s: Settings, loose: float) -> DataFrame:
    """The graph's pairs (a, b), a below b, whose cosine in double precision reaches the threshold."""
    near = graph.where(F.col("s") >= loose)
    pairs = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("vec").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("vec").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = [
                    len(x) == len(y) and float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) >= s.threshold
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good))

    return stored(
        pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "links"
    )


def counted(nodes: DataFrame, graph: DataFrame, k: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, links, rows) and (node, component): linked nodes and their rows, after saturated lists are enlarged."""
    loose = loosest(nodes, s.threshold)
    links = links_of(nodes, graph, s, loose)
    parts = stored(components(links), "parts")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = nodes.select(F.col("node").alias("b"), "n")
    direct = both.join(weight, "b").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"), F.sum("n").alias("rows"))
    pairs = across(nodes, graph, parts, k, s)
    full = stored(saturated(graph, k, loose).select(F.col("u").alias("node")), "full")
    # nodes without a link may be saturated as well: they are components of their own
    placed = parts.unionByName(full.join(parts, "node", "left_anti").select("node", F.col("node").alias("component")))
    met = pairs.select("a").union(pairs.select("b")).toDF("component")
    dense = placed.join(full, "node", "left_semi").select("component").unionByName(met).distinct()
    # a component may be met by leaders alone: its single node
    alone = dense.join(placed.select("component"), "component", "left_anti").select(F.col("component").alias("node"), "component")
    held = placed.join(dense, "component", "left_semi").select("node", "component").unionByName(alone)
    large = stored(held.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / s.block).alias("many")), "large")
    members = held.join(large, "component").join(nodes, "node")
    members = stored(members.select("component", "node", "vec", "n", "many", F.pmod(F.xxhash64("node", F.lit(1)), "many").alias("own")), "members")
    every = pairs.unionByName(large.select(F.col("component").alias("a"), F.col("component").alias("b")))
    size = lambda c: large.select(F.col("component").alias(c), F.col("many").alias("n" + c))
    every = stored(every.join(size("a"), "a").join(size("b"), "b"), "meetings")
    left = members.join(every.withColumnRenamed("a", "component"), "component").withColumnRenamed("component", "a")
    left = left.select("a", "b", F.col("own").alias("i"), F.explode(F.expr("sequence(0L, nb - 1)")).alias("j"), F.lit(True).alias("left"), "node", "vec", "n")
    right = members.join(every.withColumnRenamed("b", "component"), "component").withColumnRenamed("component", "b")
    right = right.select("a", "b", F.explode(F.expr("sequence(0L, na - 1)")).alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), "node", "vec", "n")
    blocks = left.unionByName(right).groupBy("a", "b", "i", "j").agg(F.collect_list(F.struct("left", "node", "n", "vec")).alias("x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "links", "rows", "a", "b"]
        for b in batches:
            for k in range(b.num_rows):
                one, other = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                x = b.column(0).slice(k, 1).flatten()
                side, node, n = (np.asarray(x.field(i).to_numpy(zero_copy_only=False)) for i in range(3))
                raw = x.field(3).to_pylist()
                side = side.astype(bool)
                # vectors of components that meet may differ in length
                wide = max(map(len, raw))
                sizes = np.array([len(v) for v in raw])
                vec = np.frombuffer(b"".join(v.ljust(wide, b"\0") for v in raw), "<f8").reshape(len(node), -1)
                linked = (vec[side] @ vec[~side].T >= s.threshold) & (node[side][:, None] != node[~side][None]) & (sizes[side][:, None] == sizes[~side][None])
                sides = [(side, linked, ~side)] if one == other else [(side, linked, ~side), (~side, linked.T, side)]
                for own, m, them in sides:
                    kind = [pa.array(np.full(int(own.sum()), v), pa.int64()) for v in (one, other)]
                    yield pa.RecordBatch.from_arrays([pa.array(node[own], pa.int64()), pa.array(m.sum(1), pa.int64()), pa.array(m @ n[them], pa.int64()), *kind], names=names)

    exact = blocks.select("x", "a", "b").mapInArrow(count, "node bigint, links bigint, rows bigint, a bigint, b bigint")
    exact = exact.groupBy("node", "a", "b").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    exact = stored(exact, "exact")
    joined = components(exact.where("a != b AND links > 0").select("a", "b").distinct())
    joined = stored(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "joined")
    exact = stored(exact.groupBy("node").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows")), "exact")
    found = placed.unionByName(alone).join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    direct = direct.join(exact.select("node"), "node", "left_anti")
    return stored(exact.unionByName(direct), "counts"), stored(found, "parts")


def audit(nodes: DataFrame, counts: DataFrame, s: Settings) -> tuple[float, int]:
    """The share of true links found, and the nodes that it was measured on: the lesser of the mean over nodes and the share of
    all links of a bounded sample.

    The sample has nodes of all numbers of links found, none too, alike many of each power of two; their links are counted
    against all rows. Without a node with links the share is 1, on none.
    """
    own = nodes.select("node").join(counts.select("node", "links"), "node", "left").fillna(0, ["links"])
    own = stored(own.withColumn("power", F.floor(F.log2(F.col("links") + 1))), "degrees")
    powers = own.select("power").distinct().count()
    place = F.row_number().over(W.partitionBy("power").orderBy("h", "node"))
    some = max(1, s.asked // max(1, powers))
    few = own.withColumn("h", F.xxhash64("node", F.lit(s.seed))).withColumn("r", place).where(F.col("r") <= some)
    rows = nodes.join(few.select("node"), "node").select("node", "label", "vec").collect()  # asked, about
    if not rows:
        return 1.0, 0
    found = stored(true_links(nodes, rows, s), "true").where("t > 0").join(counts, "node", "left")
    each = F.coalesce("links", F.lit(0))
    r = found.agg(F.avg(each / F.col("t")).alias("mean"), (F.sum(each) / F.sum("t")).alias("share"), F.count(F.lit(1)).alias("n")).first()
    return (min(r.mean, r["share"]), r.n) if r.n else (1.0, 0)


def true_links(nodes: DataFrame, rows: list, s: Settings) -> DataFrame:
    """(node, t): the links of some nodes, by brute force."""
    held = nodes.sparkSession.sparkContext.broadcast([(r.node, r.label, bytes(r.vec)) for r in rows])

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}
        for node, label, vec in held.value:
            by.setdefault((label, len(vec)), []).append((node, np.frombuffer(vec, "<f8")))
        found = dict.fromkeys((n for n, _, _ in held.value), 0)
        for b in batches:
            groups: dict = {}
            for node, label, vec in zip(*(c.to_pylist() for c in b.columns), strict=True):
                groups.setdefault((label, len(vec)), []).append((node, vec))
            for g, some in groups.items():
                if own := by.get(g):
                    x = np.frombuffer(b"".join(v for _, v in some), "<f8").reshape(len(some), -1)
                    ids = np.array([n for n, _ in some])
                    for node, q in own:
                        found[node] += int(((x @ q >= s.threshold) & (ids != node)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["node", "links"])

    return nodes.select("node", "label", "vec").mapInArrow(true, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("t"))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", settings: Settings | None = None
) -> DataFrame:
    """(key, n_links, component_id, kept): one row for each input row.

    Rows link when their labels are equal and not null and their cosine reaches the threshold. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are their own component, as are those of a
    length of their own. Repeated rows are vectors of their own and link with each other. A null id never is a component's
    id; other columns are ignored; no rows give no rows. Recall, and on how many vectors it was measured, are logged; where it
    stays below :attr:`Settings.least`, that is an error.
    """
    s = settings or Settings()
    nodes, seed = nodes_of(vectors, key, embedding, label, s)
    graph, k = first_graph(nodes, s), s.neighbours
    for attempt in range(1 + s.retries):
        for _ in range(s.rounds):
            graph = refine(nodes, graph, k, s)
            fresh, total = graph.agg(F.count_if("new"), F.count(F.lit(1))).first()
            if fresh <= s.settled * total:
                break
        counts, parts = counted(nodes, graph, k, s)
        recall, measured = audit(nodes, counts, s)
        LOG.info("recall %.4f on %d vectors with links, lists of %d", recall, measured, k)
        if recall >= s.recall:
            break
        if attempt < s.retries:  # longer lists, all of whose neighbours are met again
            k, graph = 2 * k, graph.withColumn("new", F.lit(True))
    if recall < s.least:
        raise RuntimeError(f"recall {recall:.4f} on {measured} vectors with links")
    rows = stored(
        vectors.select(
            F.col(key).alias("k"), F.when(usable_vector(embedding, label), named(label, embedding, seed)).alias("node")
        ),
        "rows",
    )
    own = nodes.join(counts, "node", "left").join(parts, "node", "left")
    own = stored(own.select("node", (F.coalesce("rows", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("part")), "own")
    placed = stored(rows.join(own, "node", "left"), "placed")
    least = stored(placed.where("part IS NOT NULL").groupBy("part").agg(F.min("k").alias("least")), "least")
    found = placed.join(least, "part", "left")
    part = F.coalesce("least", "k")
    return found.select(
        F.col("k").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        part.cast("long").alias("component_id"),
        F.coalesce(F.col("k") == part, F.lit(False)).alias("kept"),
    )
