"""N-gram Jaccard join with token-combination prefixes.

A text is the set of its word shingles, as 64-bit hashes; equal sets are one node. Tokens (shingles) have classes by how
many texts hold them, from a count sketch over all texts, and a global order: rarer classes first, then by hash. A text
indexes a prefix of its tokens in that order: a token of the rarest class alone, tokens of class k in runs of k that are
neighbours within their class.

Why no pair is lost. Let J(x, y) >= t, D = (1 - t)/t |x|, and let the prefix of x end first. At most D tokens are in one
set only. One that y lacks breaks at most k of x's combinations of class k, one that x lacks breaks at most k - 1, and a
single token of the rarest class is lost only with itself. So a prefix whose singles, pairs/2 and triples/3 sum to more than
D keeps a combination that both index; (1 - t)|x| + 1 singles do so as well. Sets that can't have that many combinations
index singles too.

Where two sets first meet, little of what stands before is shared: no single, and of class k at most k - 1 tokens in a row,
so of c_x and c_y tokens of class k before that place at least (c_x + c_y - 2(k - 1))/(2k - 1) are in one set only. Similar
sets differ in at most (1 - t)/(1 + t)(|x| + |y|) tokens. So each place in the index has a slack, its share of the second
number less that of the first, and two places whose slacks sum below zero needn't be compared: if the sets are similar, they
have met before.

Texts with a common combination are compared by their whole sets: first each with the node of the greatest slack in its
combination, which is likest to the others, then, where a combination still holds several components, across those
components, if slacks and parities allow. What is already connected needs no comparison, so a group of copies costs about
one comparison a text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from heronlake.llm.common import components, ddl, discard, map_rows, release, slices, stored

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Least and most counters of each of the sketch's two rows, and bytes of text for one; pieces in which a task sends them;
#: bits of the filter for texts to verify; buckets of a set's parities.
WIDTHS, COUNTED, PIECES, FILTER, BITS = (1 << 20, 1 << 23), 512, 32, 1 << 24, 2048
FOLDS = 8
FOLD = [f"f{i}" for i in range(FOLDS)]
#: Bytes of text that are cut at once.
RUN = 1 << 20
#: Sets below this size index singles beside combinations.
SMALL = 40
#: Nodes that a task remembers, not to index copies twice.
SEEN = 200_000
#: The columns of the index.
INDEX, KINDS = ("sig", "less", "node", "n", "at"), ("bigint", "bigint", "bigint", "int", "int")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted shingle hashes of texts; hashes of words are kept, up to a bound."""

    def __init__(self, k: int) -> None:
        self.k = k
        self._reset()

    def _reset(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.ids) > 150_000:
            self._reset()
        known, parts, sizes = len(self.ids), [], []
        for t in texts:
            words = t.encode().translate(LOWER).split() if t else []
            parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
        if len(self.ids) > known:
            new = list(self.ids)[known:]
            self.hashes = np.concatenate([self.hashes, np.array([xxh3_64_intdigest(w) for w in new], np.uint64)])
        h = self.hashes[np.concatenate(parts)] if parts else np.zeros(0, np.uint64)
        rolled = np.zeros(max(0, len(h) - self.k + 1), np.uint64)
        for j in range(self.k):
            rolled = rolled * _MIX[0] + h[j : j + len(rolled)]
        rolled = mixed(rolled)
        out, at = [], 0
        for n in sizes:
            if n >= self.k:
                out.append(np.unique(rolled[at : at + n - self.k + 1]))
            elif n:
                short = np.array([n], np.uint64)
                for x in h[at : at + n]:
                    short = short * _MIX[0] + x
                out.append(mixed(short ^ _MIX[2]))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def node_of(tokens: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def places(tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of tokens in the two rows of the sketch."""
    return (tokens % np.uint64(width)).astype(np.int64), (mixed(tokens ^ _MIX[1]) % np.uint64(width)).astype(np.int64)


class Sketch:
    """Two rows of counters; their number grows with the corpus up to a bound, and a token's excess over the median counter
    tells if it is frequent."""

    def __init__(self, rows: np.ndarray) -> None:
        self.median = np.median(rows, axis=1)
        self.rows = rows.astype(np.float32)  # half as much to send; classes need no more digits
        self.low = max(64.0, 6 * float(np.sqrt(self.median.max())))

    def classes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """1 for rare tokens, 2 and 3 for ever more frequent ones; and a finer rank of frequency within the classes."""
        a, b = places(tokens, self.rows.shape[1])
        excess = np.minimum(self.rows[0][a] - self.median[0], self.rows[1][b] - self.median[1])
        noise = np.sqrt(self.median.max()) + 1
        finer = np.where(excess < 2 * noise, 0, excess / noise).astype(np.int64)
        return 1 + (excess > self.low).astype(np.int64) + (excess > 16 * self.low), finer


def signatures(tokens: np.ndarray, classes: np.ndarray, finer: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes that a set is indexed by, their places and slacks; any order of tokens that all sets share is right, rarer
    ones first is fast. Slacks are whole numbers: 15 times the denominator's and numerator's sum of the threshold is 1."""
    n = len(tokens)
    lost, differ = int((1 - t) * n), int((1 - t) / t * n)
    if not differ:  # only an equal set is as similar
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((tokens, finer, classes))
    ranked, kinds = tokens[order], classes[order]
    count = [int((kinds == k).sum()) for k in (1, 2, 3)]
    singles = min(count[0], lost + 1)
    out, before = [ranked[:singles]], [15 * np.arange(singles)]  # 15 times the least number of tokens in one set only
    weight = 6 * singles
    if singles <= lost:
        at, least = count[0], 15 * count[0]
        for k in (2, 3):
            have, worth, share = max(0, count[k - 1] - k + 1), 6 // k, 15 // (2 * k - 1)
            need = min(have, max(0, -(-(6 * differ + 1 - weight) // worth)))
            own = ranked[at : at + need + k - 1] if need else ranked[:0]
            combined = np.full(need, k, np.uint64)
            for j in range(k):
                combined = combined * _MIX[0] + own[j : j + need]
            out.append(mixed(combined))
            before.append(least + share * np.maximum(0, np.arange(need) - (k - 1)))
            weight += worth * need
            at += count[k - 1]
            least += share * have
    if n < SMALL / float(t) or (singles <= lost and weight <= 6 * differ):
        out.append(mixed(ranked[: lost + 1] ^ _MIX[0]))
        before.append(15 * np.arange(len(out[-1])))
    sigs, slack = np.concatenate(out), 15 * (t.denominator - t.numerator) * n - (t.denominator + t.numerator) * np.concatenate(before)
    sigs, first = np.unique(sigs, return_index=True)
    return sigs, first, slack[first]


def parity(tokens: np.ndarray) -> bytes:
    """Whether each of BITS buckets holds an odd number of a set's tokens."""
    return np.packbits((np.bincount((tokens >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


def folded(bits: bytes) -> list[int]:
    """The parities of FOLDS * 64 buckets, each of which unites some of the finer ones."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<i8").reshape(-1, FOLDS), axis=0).tolist()


def described(docs: DataFrame, key: str, text: str, k: int) -> tuple[DataFrame, Sketch]:
    """(key, rk, n, node, bits, f0, f1, ...) of each row, stored, and the sketch over all of them."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    width = min(max(WIDTHS[0], 1 << (size // COUNTED).bit_length()), WIDTHS[1])

    def make() -> Callable:
        shingler = Shingler(k)
        rows = np.zeros((2, width), np.int32)  # a task has fewer tokens than that
        held: list[np.ndarray] = []

        def count() -> None:
            for r, at in zip(rows, places(np.concatenate(held), width), strict=True):
                r += np.bincount(at, minlength=width)
            held.clear()

        def some(keys: list, rks: list, texts: list):
            sets = shingler.sets(texts)
            held.extend(sets)
            if sum(map(len, held)) > width // 4:
                count()
            for x, rk, s in zip(keys, rks, sets, strict=True):
                bits = parity(s)
                node = (node_of(s), bits, *folded(bits)) if len(s) else (None,) * (2 + FOLDS)
                yield x, rk, len(s), *node, None, None

        def done() -> list:
            if held:
                count()
            parts = np.split(rows.ravel().astype("<i8"), PIECES)
            return [(None, 0, 0, *(None,) * (2 + FOLDS), i, packed(p)) for i, p in enumerate(parts)] if rows.any() else []

        some.done = done
        return some

    kind, folds = ddl(docs, key), " bigint, ".join(FOLD)
    schema = f"{kind}, rk bigint, n bigint, node bigint, bits binary, {folds} bigint, piece int, counts binary"
    both = stored(map_rows(keyed(docs, key, text), [key, "_rk", text], schema, make), "described")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[piece] = total.get(piece, 0) + unpacked(counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(c) for c in total.values()], pa.binary())], names=["piece", "counts"])

    parts = both.where("piece IS NOT NULL").select("piece", "counts").mapInArrow(add, "piece int, counts binary")
    # first some of the tasks' sketches, then all: a task adds up few of them, however many there are
    parts = parts.repartition("piece", F.pmod(F.monotonically_increasing_id(), F.lit(64))).mapInArrow(add, "piece int, counts binary")
    parts = parts.repartition(PIECES, "piece").mapInArrow(add, "piece int, counts binary")
    rows = np.zeros((2, width), np.int64)
    flat = rows.ravel()
    size = len(flat) // PIECES
    for r in parts.collect():  # the sketch, whose size is bounded
        flat[r.piece * size : (r.piece + 1) * size] += unpacked(bytes(r.counts))
    return both.where("piece IS NULL").drop("piece", "counts"), Sketch(rows)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, text).withColumn("_rk", F.xxhash64(key, text))


def indexed(docs: DataFrame, key: str, text: str, k: int, t: Fraction, sketch: Sketch) -> DataFrame:
    """(sig, less, node, n, at): the index, stored; less is minus the slack, at the place; copies within a task are left out."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, classes, seen = Shingler(k), held.value.classes, set()
        for b in batches:
            for part in slices(b, RUN):
                found = []
                for s in shingler.sets(part.column(0).to_pylist()):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        own, at, slack = signatures(s, *classes(s), t)
                        size = len(own)
                        found.append((own.view(np.int64), -slack, np.full(size, node), np.full(size, len(s), np.int32), at.astype(np.int32)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=INDEX)
        del shingler, seen
        release()

    return stored(docs.select(text).mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in zip(INDEX, KINDS, strict=True))), "index")


def shared(index: DataFrame) -> DataFrame:
    """The rows of the index whose combination several nodes have, with the node of the greatest slack as pivot and its pn.

    Rows whose slack doesn't make up for even the pivot's are left out. The index is dealt out by ranges of (sig, less, node),
    so a combination of any frequency is spread over tasks, and read as a stream. Where a combination crosses to another task,
    the first node of each task is handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        first = True

        def out(rows: list[np.ndarray], end: bool):
            """Whole runs; a task's first and last run may go on elsewhere, so they are given out even if they are single."""
            nonlocal first
            sig, less, node, n, _ = rows
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            edge = np.zeros(len(start), bool)
            edge[0] |= first
            edge[-1] |= end
            first = False
            several = np.repeat(node[start] != node[np.r_[start[1:], len(sig)] - 1], size)
            pivot, pn, most, at_edge = (np.repeat(x, size) for x in (node[start], n[start], less[start], edge))
            keep = at_edge | (several & (less + most <= 0))
            columns = [*(c[keep] for c in rows), pivot[keep], pn[keep], at_edge[keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*INDEX, "pivot", "pn", "edge"])

        for b in batches:
            x = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in b.columns]
            if held is not None:
                x = [np.concatenate(c) for c in zip(held, x, strict=True)]
            if not len(x[0]):
                continue
            last = int(np.searchsorted(x[0], x[0][-1]))  # the last run may go on in the next batch
            if last:
                yield out([c[:last] for c in x], end=False)
            held = [c[last:] for c in x]
            if len(held[0]) > 200_000:  # a run longer than that goes out in pieces that share its first node
                head = [c[:1] for c in held]
                piece = out(held, end=True)
                yield piece
                held = head
        if held is not None and len(held[0]):
            yield out(held, end=True)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = index.repartitionByRange(parts, "sig", "less", "node").sortWithinPartitions("sig", "less", "node")
    kinds = ", ".join(f"{n} {kind}" for n, kind in zip(INDEX, KINDS, strict=True))
    found = stored(order.mapInArrow(run, f"{kinds}, pivot bigint, pn int, edge boolean"), "shared")
    # a few runs for each task are at an edge; those of one combination get a common node and stay if they have several
    ends = found.where("edge").groupBy("sig").agg(F.min(F.struct("less", "node", "n")).alias("p"), F.min("node").alias("least"), F.max("node").alias("most"))
    ends = stored(ends.where("least != most").select("sig", F.col("p.node").alias("p"), F.col("p.n").alias("q"), F.col("p.less").alias("less0")), "ends")
    at_edge = found.where("edge").join(ends, "sig").where("less + less0 <= 0")
    at_edge = at_edge.select(*INDEX, F.col("p").alias("pivot"), F.col("q").alias("pn"))
    return found.where("NOT edge").drop("edge").unionByName(at_edge)


def profiles(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Columns of one row of each node, stored."""
    found = rows.join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*columns)).alias("p"))
    return stored(found.select("node", "p.*"), "profile")


def crossing(open_: DataFrame, rows: DataFrame, t: Fraction) -> DataFrame:
    """(a, b): nodes of different components that share a combination and that sizes, slacks and coarse parities allow.

    A node's combinations are in the order of their places. Where two nodes also have the same one before this one, they have
    met there, so the pair isn't made again here; where they first meet, it is made.
    """
    folds = profiles(rows, open_.select("node").distinct(), *FOLD)
    before = F.lag("sig").over(W.partitionBy("node").orderBy("at"))
    known = stored(open_.distinct().withColumn("before", before).join(folds.hint("merge"), "node"), "open")
    names = ("node", "n", "part", "less", "before", *FOLD)
    a, b = (known.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
    apart = " + ".join(f"bit_count({f}_a ^ {f}_b)" for f in FOLD)
    near = f"{t.denominator + t.numerator}L * ({apart}) <= {t.denominator - t.numerator}L * (n_a + n_b)"
    first = "(before_a IS NULL OR before_b IS NULL OR before_a != before_b)"
    met = f"node_a < node_b AND part_a != part_b AND less_a + less_b <= 0 AND {first} AND {similar_sizes('n_a', 'n_b', t)} AND {near}"
    found = a.join(b.hint("merge"), "sig").where(met)
    found = stored(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    discard(known)
    return found


def plausible(pairs: DataFrame, rows: DataFrame, t: Fraction) -> DataFrame:
    """The pairs that their sizes and parities allow, with a row key of each node's: (a, b, ra, rb), stored.

    Buckets of different parity hold at least one token of one set only, and similar sets differ by no more than
    (1 - t)/(1 + t) of their sizes' sum, so no similar pair is lost.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    profile = profiles(rows, wanted, "rk", "n", "bits")
    left, right = (profile.toDF(x, f"r{x}", f"n{x}", f"bits{x}") for x in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (6, 7))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                total = b.column(4).to_numpy() + b.column(5).to_numpy()
                good = (t.denominator + t.numerator) * apart <= (t.denominator - t.numerator) * total
                yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "ra", "rb"]).filter(pa.array(good))

    both = both.where(similar_sizes("na", "nb", t)).select("a", "b", "ra", "rb", "na", "nb", "bitsa", "bitsb")
    return stored(both.mapInArrow(check, "a bigint, b bigint, ra bigint, rb bigint"), "plausible")


def similar_sizes(a: str, b: str, t: Fraction) -> str:
    return f"{t.denominator}L * least({a}, {b}) >= {t.numerator}L * greatest({a}, {b})"


def verified(docs: DataFrame, pairs: DataFrame, rows: DataFrame, key: str, text: str, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar, stored."""
    spark = docs.sparkSession
    pairs = plausible(pairs, rows, t)
    ends = pairs.select(F.explode(F.array("ra", "rb")).alias("rk")).distinct()
    slot = F.pmod("rk", F.lit(FILTER))
    bits = ends.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m")
    )
    words = np.zeros(FILTER // 64, np.uint64)
    for r in bits.toLocalIterator():  # FILTER / 64 rows at most; it loses none, it only keeps texts from being cut again
        words[r.w] = np.int64(r.m).view(np.uint64)
    held = spark.sparkContext.broadcast(words)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, wanted = Shingler(k), set(), held.value
        for b in batches:
            at = np.mod(b.column(0).to_numpy(), FILTER)
            b = b.filter(pa.array((wanted[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in slices(b, RUN):
                names, values = [], []
                for s in shingler.sets(part.column(1).to_pylist()):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        names.append(node)
                        values.append(s.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], names=["x", "tokens"])

    known = keyed(docs, key, text).select("_rk", text).mapInArrow(sets, "x bigint, tokens binary")
    known = stored(known.groupBy("x").agg(F.first("tokens").alias("tokens")), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                good.append(t.denominator * same >= t.numerator * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    right = pairs.select("a", "b").join(known.toDF("b", "y").hint("merge"), "b")
    both = right.join(known.toDF("a", "x").hint("merge"), "a")
    links = stored(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "links")
    discard(known)
    return links


def link(
    docs: DataFrame, k: int = 4, threshold: str = "0.85", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id): one row for each input row, over whole texts.

    Two texts link when the Jaccard similarity of their sets of ``k``-word shingles is ``threshold`` or more; a text of
    fewer words is one shingle, and one that is null or without words is empty and links with nothing. component_id is the
    smallest key that links reach, the row's own included; null keys are passed over, and a component of them alone has
    none. Repeated rows have one component; other columns are ignored; no rows give no rows. Words are cut at ASCII white
    space and lower-cased in A to Z. Shingles are told apart by 64-bit hashes.
    """
    t = Fraction(threshold)
    rows, sketch = described(docs, key, text, k)
    index = indexed(docs, key, text, k, t, sketch)
    common = shared(index)
    discard(index)  # what is left of it is stored in common

    star = common.where(f"node != pivot AND {similar_sizes('n', 'pn', t)}")
    star = stored(star.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "pairs")
    links = verified(docs, star, rows, key, text, k, t)
    parts = stored(components(links), "parts")
    placed = common.select(*INDEX).join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node"))
    placed = stored(placed.select(*INDEX, "part"), "placed")
    several = placed.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("sig")
    open_ = stored(placed.join(stored(several, "several").hint("merge"), "sig"), "open")
    discard(placed)
    rest = crossing(open_, rows, t)
    discard(open_)
    rest = stored(rest.join(star.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        more = verified(docs, rest, rows, key, text, k, t)
        parts = stored(components(links.unionByName(more)), "parts")
    named = stored(rows.select(key, "n", "node").join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")), "named")
    least = stored(named.where("part IS NOT NULL").groupBy("part").agg(F.min(key).alias("least")), "least")
    return named.join(least.hint("merge"), "part", "left").select(
        key, F.col("n").alias("n_shingles"), F.coalesce("least", key).alias("component_id")
    )
