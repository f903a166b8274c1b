"""Problem 8: items are packed into containers by variable-capacity best fit.

Each task packs the items it holds, longest first, by best fit. All permitted capacities are weighed together: where no open container
has room, the item is tried in a new one of each capacity, filled from the sizes that are still to come, and the one with the least
cost for each token it would hold is opened. At the end each container shrinks to the smallest permitted capacity of its contents. Only
the last containers of a task are not nearly full, so the unused share falls as tasks grow; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokenizer import BYTE_BPE, VOCABULARIES, load

#: Permitted capacities, and what a container costs besides its capacity, in tokens.
CAPACITIES = (256, 512, 768, 1024, 1536, 2048)
OVERHEAD = 4
#: Items a task packs together, a bound of its memory; the next ones open containers of their own.
WINDOW = 400_000


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(offset, size) of the pieces of an item; only one that exceeds the capacity has several."""
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)]


def filled(size: int, capacity: int, left: list[int], present: int) -> int:
    """Tokens a new container would hold: an item of ``size`` and, again and again, the longest item still left that goes in.

    left: how many items of each size are left; present: bit s is set where there are some of size s.
    """
    room = capacity - size
    taken: dict[int, int] = {}
    while room > 0:
        some = present & ((1 << (room + 1)) - 1)
        while some:
            longest = some.bit_length() - 1
            count = min(left[longest] - taken.get(longest, 0), room // longest)
            if count > 0:
                break
            some ^= 1 << longest
        if not some:
            break
        taken[longest] = taken.get(longest, 0) + count
        room -= count * longest
    return capacity - room


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, list[int]]:
    """The container of each item, and the final capacity of each container. No item may exceed the largest capacity; an empty item goes where there is room.

    A look ahead by one container may lose in the long run, so that opening only the largest is tried, too, and the packing that needs less is kept.
    """
    capacities = tuple(sorted(capacities))
    tried = [_packed(sizes, capacities, openers, overhead) for openers in dict.fromkeys((capacities, capacities[-1:]))]
    return min(tried, key=lambda packing: sum(packing[1]) + overhead * len(packing[1]))


def _packed(sizes: np.ndarray, capacities: tuple[int, ...], openers: tuple[int, ...], overhead: int) -> tuple[np.ndarray, list[int]]:
    """Best fit, longest item first, in containers opened with one of ``openers`` and shrunk to one of ``capacities``."""
    largest = capacities[-1]
    order = np.argsort(-sizes, kind="stable")
    place = np.zeros(len(sizes), dtype=np.int64)
    left = np.bincount(sizes, minlength=largest + 1).tolist() if len(sizes) else [0] * (largest + 1)
    present = sum(1 << s for s, n in enumerate(left) if n and s)
    free: list[list[int]] = [[] for _ in range(largest + 1)]  # containers by the room they have left
    open_rooms = 0  # bit r: some container has room r
    content: list[int] = []
    for at in order:
        size = int(sizes[at])
        left[size] -= 1
        if size and not left[size]:
            present ^= 1 << size
        fitting = open_rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            bin_no = free[room].pop()
            if not free[room]:
                open_rooms ^= 1 << room
        else:
            bin_no, room = len(content), min((c for c in openers if c >= size), key=lambda c: ((c + overhead) / max(1, filled(size, c, left, present)), -c))
            content.append(0)
        content[bin_no] += size
        place[at] = bin_no
        room -= size
        if room:
            free[room].append(bin_no)
            open_rooms |= 1 << room
    return place, [next(c for c in capacities if c >= used) for used in content]


def containers(df: DataFrame, id_col: str, text_col: str, *, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, window: int = WINDOW, folder: str = VOCABULARIES, name: str = BYTE_BPE) -> DataFrame:
    """(id, piece_no, token_start, n_tokens, container_id, container_capacity, container_tokens) of each item.

    Sizes are tokens of the vocabulary. An item over the largest capacity is cut into full pieces and a rest, any other
    has one piece. container_tokens of container_capacity are used; ``fill`` sums them up. Null and empty texts give no row; a null id is kept; repeated rows are items of their own; other
    columns are not read. container_id is unique over the whole result.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("piece_no", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("container_id", pa.string()), ("container_capacity", pa.int64()), ("container_tokens", pa.int64())])

    def packed(ids: list, sizes: list[int], prefix: str) -> Iterator[pa.RecordBatch]:
        keys, numbers, starts, lengths = [], [], [], []
        for key, size in zip(ids, sizes, strict=True):
            for number, (at, length) in enumerate(cut(size, largest)):
                keys.append(key)
                numbers.append(number)
                starts.append(at)
                lengths.append(length)
        if not keys:
            return
        tokens = np.array(lengths, dtype=np.int64)
        place, final = best_fit(tokens, capacities, overhead)
        used = np.bincount(place, weights=tokens, minlength=len(final)).astype(np.int64)
        names = pa.array([f"{prefix}-{k}" for k in range(len(final))])
        yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(tokens), names.take(pa.array(place)), pa.array(np.array(final, dtype=np.int64)[place]), pa.array(used[place])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, _ = load(folder, name)
        ids, sizes, turn = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                sizes.append(len(encoder.encode_ordinary(text)))
            if len(ids) >= window:
                yield from packed(ids, sizes, f"{task}-{turn}")
                ids, sizes, turn = [], [], turn + 1
        yield from packed(ids, sizes, f"{task}-{turn}")

    lean = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    return lean.mapInArrow(run, f"id {kind.simpleString()}, piece_no int, token_start long, n_tokens long, container_id string, container_capacity long, container_tokens long").withColumnRenamed("id", id_col)


def fill(packed: DataFrame) -> DataFrame:
    """(container_capacity, n_containers, n_tokens, fill) of each capacity: how full its containers are."""
    each = packed.groupBy("container_id").agg(F.first("container_capacity").alias("container_capacity"), F.first("container_tokens").alias("tokens"))
    return each.groupBy("container_capacity").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens")).select("*", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("container_capacity")), 6).alias("fill"))
