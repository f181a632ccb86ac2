"""Packing of documents into containers of fixed capacity along a space-filling curve.

Every document gets a size (tokens of a public tokenizer) and a vector: the
sum of hashed random signs of its token ids, projected to a few dimensions
and scaled by the square root of its length. The vectors are quantised and
turned into a Hilbert key. One range sort by (key, id) puts alike documents
next to each other; every partition is then packed in runs of neighbours, best
fit first by falling size. Containers of a run that are not full enough are
dissolved and their items join the next run, so only a partition's last run
can leave part-filled containers, and a partition has at least
``per_task`` containers' worth of tokens.

A document above the capacity is split, and no other: its full pieces fill a
container each, the rest is packed like an item. Documents without tokens
(null, empty) have size 0 and still get a container and a position.

Ties of the key are ordered by id, so copies that make up a third of all rows
spread over partitions too. Every input row gives at least one output row;
repeated ids are separate items. An empty table gives no rows. Containers are
numbered by partition, not densely.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np

from quaero.llm.bpe import FOLDER, VOCABULARY, vocabulary
from quaero.session import written

DIMENSIONS, BITS = 4, 8
#: Share of the capacity from which a container counts as full.
FULL = 0.995
#: Containers' worth of tokens packed together.
RUN = 48
#: Containers' worth of tokens in a partition, at least (but for the whole input).
PER_TASK = 400
PACKED = "doc_id {t}, piece int, container bigint, position int, start_token int, n_tokens int"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows, dims); the transposed-axes method of Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def signs(n_tokens: int, dims: int = DIMENSIONS) -> np.ndarray:
    """A row of +-1 for each token id, from a multiplicative hash."""
    h = (np.arange(1, n_tokens + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return ((h >> np.arange(7, 7 + 5 * dims, 5, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


def pack(items: list[tuple], capacity: int) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Best fit by falling size of (size, ...) items: full containers, and the rest."""
    bins: list[list[tuple]] = []
    rooms: list[tuple[int, int]] = []
    for it in sorted(items, key=lambda x: -x[0]):
        at = bisect_left(rooms, (it[0], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(it)
        insort(rooms, (room - it[0], b))
    least = capacity * (1 - FULL)
    open_ = {b for room, b in rooms if room > least}
    return [x for b, x in enumerate(bins) if b not in open_], [x for b, x in enumerate(bins) if b in open_]


def pack_documents(df, capacity: int = 2048, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY, per_task: int = PER_TASK):
    """(doc_id, piece, container, position, start_token, n_tokens) of every document or piece of one."""
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    kind = df.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        table = signs(v.n)
        for b in batches:
            lists = [v.encode(t) for t in b.column(1).to_pylist()]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            vec = np.zeros((len(lists), DIMENSIONS), np.float32)
            for i, ids in enumerate(lists):
                if ids:
                    vec[i] = table[ids].sum(0) / math.sqrt(len(ids))
            grid = np.clip((np.tanh(vec / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(hilbert_keys(grid))], names=[key, "size", "curve"])

    sized = written(df.select(key, text).mapInArrow(measure, f"`{key}` {kind}, size bigint, curve bigint"), "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(1, int(total // (capacity * per_task)))
    sorted_ = sized.repartitionByRange(parts, "curve", key, "size").sortWithinPartitions("curve", key, "size")

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        carried: list[tuple] = []
        held, out = 0, []

        def emit(bins: list[list[tuple]]) -> None:
            nonlocal number
            for items in bins:
                for place, (size, k, piece, start, _) in enumerate(sorted(items, key=lambda x: x[4])):
                    out.append((k, piece, number, place, start, size))
                number += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 6
            out.clear()
            types = [kinds[0], pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "piece", "container", "position", "start_token", "n_tokens"])

        kinds, order = [pa.null()], 0
        for b in batches:
            kinds[0] = b.schema.field(0).type
            for k, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                order += 1
                whole = size // capacity if size > capacity else 0
                for p in range(whole):
                    emit([[(capacity, k, p, p * capacity, order)]])
                rest = size - whole * capacity
                if rest or not whole:
                    carried.append((rest, k, whole, whole * capacity, order))
                    held += rest
                if held >= RUN * capacity:
                    full, part = pack(carried, capacity)
                    emit(full)
                    carried = [x for items in part for x in items]
                    held = sum(x[0] for x in carried)
            if out:
                yield flush()
        for part in pack(carried, capacity):
            emit(part)
        if out:
            yield flush()

    schema = PACKED.format(t=kind).replace("doc_id", f"`{key}`", 1)
    return sorted_.select(key, "size").mapInArrow(containers, schema)
