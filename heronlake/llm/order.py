"""Training-order materialisation: fixed-stride token shards in a keyed pseudo-random order.

Texts become sequences of a fixed number of token ids. Sequence i of N goes to slot p(i), where p is a keyed Feistel
permutation on the next even number of bits, walked until it falls below N; it needs no shuffle buffer and no table. Slots
are range-partitioned into shards, so slot s is at byte (s mod per_shard) * stride of shard s div per_shard, and a reader
resumes by seeking. Sequences travel to their shard in compressed blocks, and a shard is put together in one buffer of its
fixed size, so nothing is sorted. A shard that is already whole is left as it is, so a run that was cut off carries on; a
header file in the folder says which corpus, key and stride the shards are of, and shards of any other are deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm import bpe
from heronlake.llm.common import release, scratch, slices, stored
from heronlake.llm.flat import kind, opened
from heronlake.llm.neardup import binary

LENGTH, PER_SHARD, ROUNDS = 256, 8192, 6
#: Bytes of tokens that a task gathers before it deals them out; bytes of shards that one task writes, about.
HELD, WRITTEN = 48 << 20, 64 << 20
#: Level of zstd: ids take 0.55 of their size at level 6, and 0.65 at level 1.
LEVEL = 6


def round_keys(key: bytes) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(key + bytes([r]), digest_size=8).digest(), "little") for r in range(ROUNDS)]


def permute(values: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """The slots of sequence numbers below n: a bijection of 0..n-1 that the key selects."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(k) for k in round_keys(key)]
    out = values.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> half, x & mask
        for k in keys:
            y = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((y >> np.uint64(32)) & mask)
        out[walk] = left << half | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def column(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def sequences(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, part, n_tokens, tokens, task, nth): each text, with an end-of-document id, in rows of ``length`` ids, stored.

    The last row of a text is filled up with end-of-document ids, which n_tokens doesn't count. A null or empty text is one
    row with its end alone. Rows are numbered within the task that made them, so the stored table tells their order.
    """
    held = docs.sparkSession.sparkContext.broadcast(bpe.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.loaded(held.value, plain=True)
        width = kind(len(tok.names))
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch):
                ids, sizes = tok.encode_flat(b.column(1).to_pylist())
                many = -(-(sizes + 1) // length)
                of = np.repeat(np.arange(len(sizes)), many)
                part = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                n = np.minimum(length, sizes[of] + 1 - part * length)
                rows = np.full((len(of), length), tok.end, width)
                first = (np.cumsum(many) - many) * length - (np.cumsum(sizes) - sizes)
                kind_ = np.int32 if rows.size < 1 << 31 else np.int64
                rows.ravel()[np.arange(len(ids), dtype=kind_) + np.repeat(first.astype(kind_), sizes)] = ids
                tokens = column(rows)
                place = pa.array(np.arange(nth, nth + len(of)))
                nth += len(of)
                columns = [b.column(0).take(pa.array(of)), pa.array(part), pa.array(n), tokens, pa.array(np.full(len(of), task, np.int32)), place]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "n_tokens", "tokens", "task", "nth"])

    out = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    for f in T.StructType.fromDDL("part bigint, n_tokens bigint, tokens binary, task int, nth bigint"):
        out.add(f)
    return stored(docs.select(F.col(key), F.col(text)).mapInArrow(run, out), "sequences", LEVEL)


def prepared(folder: str, header: dict) -> None:
    """The folder, without the shards of another corpus, key or stride than those of the header."""
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    at, text = f"{base}/order.json", json.dumps(header, sort_keys=True)
    if fs.get_file_info(at).is_file:
        with fs.open_input_file(at) as f:
            if f.read().decode() == text:
                return
    for info in fs.get_file_info(shards_of(base)):  # the header goes first, so a run that is cut off here starts anew
        if info.path == at or info.base_name.startswith(("shard-", "_shard-")):
            fs.delete_file(info.path)
    with fs.open_output_stream(at) as f:
        f.write(text.encode())


def shards_of(path: str):
    """What lists a folder of shards."""
    from pyarrow.fs import FileSelector

    return FileSelector(path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(
    rows: DataFrame, vocabulary: str, folder: str, secret: bytes = b"epoch-0", per_shard: int = PER_SHARD, length: int = LENGTH, key: str = "doc_id"
) -> DataFrame:
    """Write the sequences to shards; (key, part, n_tokens, slot, shard, offset, token_sha256), a row for each sequence.

    ``rows`` is the table of :func:`sequences`; ``secret`` selects the order. Each shard is written by one task under another name and renamed when it is whole; whole shards of
    an earlier run over the same table, key and stride stay. Without rows there are no shards.
    """
    spark = rows.sparkSession
    width = np.dtype(kind(len(bpe.WordBpe(bpe.load(vocabulary), plain=True).names)))
    stride = length * width.itemsize
    # a row for each task that made sequences
    tasks = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("nth", key, "part", "tokens")).alias("x"))
    first, total, corpus = {}, 0, hashlib.sha256(secret)
    for r in tasks.orderBy("task").collect():
        first[r.task], total = total, total + r.n
        corpus.update(f"{r.task},{r.n},{r.x};".encode())
    prepared(folder, {"corpus": corpus.hexdigest(), "sequences": total, "length": length, "width": width.str, "per_shard": per_shard})
    held = spark.sparkContext.broadcast(first)
    shards = max(1, -(-total // per_shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # the sequences are stored, and a worker may have made some
        rows: list[pa.RecordBatch] = []
        size, codec = 0, pa.Codec("zstd", LEVEL)

        def out() -> pa.RecordBatch:
            b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            rows.clear()
            start = np.array([held.value[t] for t in b.column(4).to_pylist()], np.int64)
            slot = permute(start + b.column(5).to_numpy(), total, secret)
            order = np.argsort(slot, kind="stable")
            b, slot = b.take(pa.array(order)), slot[order]
            shard = slot // per_shard
            cuts = np.concatenate([np.flatnonzero(np.diff(shard, prepend=-1)), [len(shard)]]).astype(np.int32)
            ids = binary(b.column(3), "u1")
            tokens = [codec.compress(ids[x:y].tobytes(), asbytes=True) for x, y in zip(cuts, cuts[1:])]  # noqa: B905
            lists = [pa.ListArray.from_arrays(pa.array(cuts), c) for c in (pa.array((slot % per_shard).astype(np.int32)), b.column(0), b.column(1), b.column(2).cast(pa.int32()))]
            columns = [pa.array(shard[cuts[:-1]]), *lists, pa.array(tokens, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "slots", "keys", "parts", "sizes", "tokens"])

        for batch in batches:
            for b in slices(batch):
                rows.append(b)
                size += b.nbytes
                if size > HELD:
                    yield out()
                    size = 0
        if size:
            yield out()
        release()

    kept = T.ArrayType(rows.schema[key].dataType)
    block = T.StructType.fromDDL("shard bigint, slots array<int>, parts array<bigint>, sizes array<int>, tokens binary")
    block = T.StructType([*block.fields[:2], T.StructField("keys", kept), *block.fields[2:]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        fs, base = opened(folder)
        shard, parts = None, []

        def out() -> pa.RecordBatch:
            slots, keys, parts_, sizes = (pa.concat_arrays([p[i] for p in parts]) for i in range(4))
            whole = np.zeros((min(per_shard, total - shard * per_shard), stride), np.uint8)
            whole[slots.to_numpy()] = np.frombuffer(b"".join([p[4] for p in parts]), np.uint8).reshape(-1, stride)
            data = whole.tobytes()
            there = fs.get_file_info(f"{base}/{shard_name(shard)}")
            if not (there.is_file and there.size == len(data)):
                name = f"{base}/_{shard_name(shard)}-{uuid.uuid4().hex}"
                with fs.open_output_stream(name) as f:
                    f.write(data)
                fs.move(name, f"{base}/{shard_name(shard)}")
            order = pa.array(np.argsort(slots.to_numpy()))  # columns in the order of slots take little space
            keys, parts_, sizes, slots = (x.take(order) for x in (keys, parts_, sizes, slots))
            local = slots.to_numpy().astype(np.int64)
            digests = [hashlib.sha256(data[x * stride : (x + 1) * stride]).digest() for x in local.tolist()]
            columns = [keys, parts_, sizes.cast(pa.int64()), pa.array(local + shard * per_shard), pa.array(np.full(len(local), shard)), pa.array(local * stride), pa.array(digests, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "part", "n_tokens", "slot", "shard", "offset", "digest"])

        for b in batches:
            for i, s in enumerate(b.column(0).to_pylist()):
                if s != shard and parts:
                    yield out()
                    parts = []
                shard = s
                lists = [b.column(k)[i].values for k in (1, 2, 3, 4)]
                parts.append((*lists, pa.decompress(b.column(5)[i].as_py(), len(lists[0]) * stride, "zstd", asbytes=True)))
        if parts:
            yield out()
        del parts
        release()

    # shards are dense and even, and each is one task's: neighbours go to one task, by number
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * stride // WRITTEN))
    dealt = rows.select(key, "part", "n_tokens", "tokens", "task", "nth").mapInArrow(deal, block)
    dealt = dealt.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("shard")
    out = T.StructType([T.StructField(key, rows.schema[key].dataType)])
    for f in T.StructType.fromDDL("part bigint, n_tokens bigint, slot bigint, shard bigint, offset bigint, digest binary"):
        out.add(f)
    found = stored(dealt.mapInArrow(write, out), "order", LEVEL)
    return found.select(*found.columns[:-1], F.lower(F.hex("digest")).alias("token_sha256"))


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, width: str = "<u2", per_shard: int = PER_SHARD):
    """Sequences from a slot on, read by seeking: what a training job does when it resumes."""
    fs, base = opened(folder)
    stride, slot = length * np.dtype(width).itemsize, first
    while slot < first + count:
        shard, at = divmod(slot, per_shard)
        n = min(per_shard - at, first + count - slot)
        with fs.open_input_file(f"{base}/{shard_name(shard)}") as f:
            data = f.read_at(n * stride, at * stride)
        if not data:
            return
        yield from np.frombuffer(data, width).reshape(-1, length)
        slot += n


def training_order(docs: DataFrame, vocabulary: str, folder: str | None = None, secret: bytes = b"epoch-0") -> DataFrame:
    """Tokenise documents and write them in training order; see :func:`materialise` for the rows.

    Repeated rows are sequences of their own, ids may be null, other columns are ignored.
    """
    rows = sequences(docs, vocabulary)
    return materialise(rows, vocabulary, folder or scratch(docs.sparkSession, "shards"), secret)
