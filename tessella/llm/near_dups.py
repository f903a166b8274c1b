"""Problem 5: near-duplicate texts by the similarity of their sets of word runs, without loss.

1. One pass gives each text's digest (equal sets make one class) and counts in a histogram, sized by the characters of the input,
   how frequent runs are. Any common order of runs makes what follows lossless; the counts make it selective.
2. Each class is sent, once for each part its rarest runs fall into, with the places of those runs and a parity sketch: bit h of
   a sketch is the parity of the runs that hash to h, so two sketches differ in at most as many bits as the sets in runs.
3. In each part, classes that share a rare run are compared exactly tile by tile: tile pairs whose ranges of sizes or of population counts
   are beyond the radius are skipped as a whole, for the rest the exclusive-or of the sketches is counted.
4. The few pairs left are verified on their sets of runs.

There are as many parts as the runs need at PART_BYTES each. Runs so frequent that a part would hold too many texts are split into tiles of a grid
over several parts, so that no part grows with the input.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import may_be_in, salted_join, settle, union_all
from tessella.llm.shingles import mixed, run_sets

#: Least and most counters of the histogram of runs (4 bytes each in a task that counts, 1 byte where it is read) and the slices it is summed in. There is one
#: counter for CHARS_A_COUNTER characters of the input; where that is more than the most, counters are shared by more runs and select less, but lose nothing.
FEWEST, MOST, SLICES, CHARS_A_COUNTER = 1 << 16, 1 << 24, 64, 8
#: A run in more texts than this is split into a grid of tiles.
TILE = 20_000
#: Bytes a part should have, and those of a run with its share of the sketch.
PART_BYTES, RUN_BYTES = 1 << 26, 48
#: Rows of a tile in a part; runs with no more rows are one tile each and compared together.
TILE_ROWS = 64
#: Digests a task remembers and pairs it holds before it forgets or sorts them: bounds of its memory, without effect on the result.
REMEMBERED, HELD = 500_000, 2_000_000
#: Tasks over which the rows of one class or node are spread.
SALTS = 8
#: Bits of the smallest and the largest sketch.
SMALLEST, LARGEST = 256, 8192


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 5_000, chars: int = 8_000_000) -> Iterator[tuple[list, list, list[str]]]:
    """Kinds, ids and texts of stretches of the input."""
    kinds, ids, texts, held = [], [], [], 0
    for batch in batches:
        for kind, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            kinds.append(kind)
            ids.append(key)
            texts.append(text)
            held += len(text)
            if len(ids) >= rows or held >= chars:
                yield kinds, ids, texts
                kinds, ids, texts, held = [], [], [], 0
    if ids:
        yield kinds, ids, texts


@lru_cache(maxsize=64)
def _person(kind: str | None) -> bytes:
    return hashlib.blake2b((kind or "").encode(), digest_size=16).digest()


@lru_cache(maxsize=64)
def _code(kind: str | None) -> int:
    return int.from_bytes(_person(kind)[:8], "little")


def _cells(runs: np.ndarray, owner: np.ndarray, kinds: list, counters: int) -> np.ndarray:
    """The counter of each run among the texts of its kind; owner: of each run the place of its text's kind."""
    codes = np.array([_code(kind) for kind in kinds], dtype=np.uint64)
    return ((runs ^ codes[owner]) & np.uint64(counters - 1)).astype(np.int64)


def _digests(kinds: list, values: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> list[bytes]:
    """A digest of kind and set of runs of each chosen text."""
    raw = memoryview(values.tobytes())
    return [hashlib.blake2b(raw[8 * bounds[k] : 8 * bounds[k + 1]], digest_size=16, person=_person(kinds[k])).digest() for k in chosen.tolist()]


def _unseen(digests: list[bytes], seen: set[bytes]) -> np.ndarray:
    """Which digests occur for the first time in a task, as far as it remembers; they are added to seen."""
    if len(seen) > REMEMBERED:
        seen.clear()
    fresh = np.zeros(len(digests), dtype=bool)
    for k, digest in enumerate(digests):
        if digest not in seen:
            seen.add(digest)
            fresh[k] = True
    return fresh


def _of(values: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the chosen texts, one after another, and of each value the place of its text among the chosen."""
    lengths = np.diff(bounds)[chosen]
    owner = np.repeat(np.arange(len(chosen)), lengths)
    starts = np.cumsum(lengths) - lengths
    return values[np.arange(len(owner)) - starts[owner] + bounds[chosen][owner]], owner


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a slice, mostly zeros and small ones, in few bytes."""
    over = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(np.int32(len(over)).tobytes() + over.astype(np.int32).tobytes() + counts[over].tobytes() + small.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    data = zlib.decompress(raw)
    over = int(np.frombuffer(data, np.int32, 1)[0])
    counts = np.frombuffer(data, np.uint8, offset=4 + 8 * over).astype(np.int32)
    counts[np.frombuffer(data, np.int32, over, 4)] = np.frombuffer(data, np.int32, over, 4 + 4 * over)
    return counts


def _survey(length: int, least: int, counters: int):  # noqa: ANN202
    """Rows (kind, id, digest, size) of the texts with enough runs; one row (null, null, null, runs, slice, counts) for each slice of the histogram, with the runs counted in slice 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, dtype=np.int32)
        seen: set[bytes] = set()
        total = 0
        for kinds, ids, texts in _blocks(batches):
            values, bounds = run_sets(texts, length)
            chosen = np.flatnonzero(np.diff(bounds) >= least)
            if not len(chosen):
                continue
            digests = _digests(kinds, values, bounds, chosen)
            fresh = chosen[_unseen(digests, seen)]
            new, owner = _of(values, bounds, fresh)
            total += len(new)
            counts += np.bincount(_cells(new, owner, [kinds[k] for k in fresh], counters), minlength=counters).astype(np.int32)
            size = len(chosen)
            yield pa.RecordBatch.from_pydict({"kind": [kinds[k] for k in chosen], "id": [ids[k] for k in chosen], "digest": digests, "runs": [None] * size, "slice": [None] * size, "counts": [None] * size}, schema=_SURVEY)
        if total:
            width = counters // SLICES
            yield pa.RecordBatch.from_pydict({"kind": [None] * SLICES, "id": [None] * SLICES, "digest": [None] * SLICES, "runs": [total] + [0] * (SLICES - 1), "slice": list(range(SLICES)), "counts": [_packed(counts[k * width : (k + 1) * width]) for k in range(SLICES)]}, schema=_SURVEY)

    return run


_SURVEY = pa.schema([("kind", pa.string()), ("id", pa.string()), ("digest", pa.binary()), ("runs", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
_SURVEY_DDL = "kind string, id string, digest binary, runs long, slice int, counts binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the slices that reach a task, one running sum for each; out come logarithms of one byte: 0, 1 and 2 for counts of as much, beyond that eight steps for each doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if number in sums:
                sums[number] += _unpacked(raw)
            else:
                sums[number] = _unpacked(raw)
    yield pa.RecordBatch.from_pydict({"slice": list(sums), "counts": [_logarithms(s).tobytes() for s in sums.values()]}, schema=pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))


def _logarithms(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 2, np.ceil(8.0 * np.log2(np.maximum(counts, 1))) - 6.0, counts).astype(np.uint8)


#: The largest count each byte of the histogram stands for.
_COUNTS = np.array([0, 1, 2, *(int(2.0 ** ((k + 6) / 8.0)) for k in range(3, 250)), *([2**31 - 1] * 6)], dtype=np.int64)


def parity_sketches(runs: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The sketches of sets: runs[k] belongs to set owner[k], whose sketch has bits[owner[k]] bits."""
    starts = np.cumsum(bits) - bits
    places = (mixed(runs) >> np.uint64(20)) & (bits[owner] - 1).astype(np.uint64)
    odd = np.bincount(starts[owner] + places.astype(np.int64), minlength=int(bits.sum())) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[a : a + n] for a, n in zip((starts // 8).tolist(), (bits // 8).tolist(), strict=True)]


_PART = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("digest", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("runs", pa.binary()), ("places", pa.binary())])
_PART_DDL = "kind string, part int, digest binary, size int, sketch binary, runs binary, places binary"


def _parts(length: int, least: int, similarity: float, parts: int, tile: int, histogram):  # noqa: ANN001, ANN202
    """For each class and part: size, sketch, and its rare runs in that part with their places in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.frombuffer(histogram.value, dtype=np.uint8)
        mean = float((np.bincount(logs, minlength=256) * _COUNTS).sum() / len(logs))  # what a counter holds of other runs
        seen: set[bytes] = set()
        for kinds, _, texts in _blocks(batches):
            values, bounds = run_sets(texts, length)
            chosen = np.flatnonzero(np.diff(bounds) >= least)
            digests = _digests(kinds, values, bounds, chosen)
            fresh = _unseen(digests, seen)
            chosen, digests = chosen[fresh], [d for d, f in zip(digests, fresh, strict=True) if f]
            if not len(chosen):
                continue
            runs, owner = _of(values, bounds, chosen)
            sizes = np.bincount(owner, minlength=len(chosen))
            bits = np.minimum(LARGEST, np.maximum(SMALLEST, 1 << np.ceil(np.log2(1.5 * sizes)).astype(np.int64)))
            sketches = parity_sketches(runs, owner, bits)
            often = logs[_cells(runs, owner, [kinds[k] for k in chosen], len(logs))]
            # by text, then count; runs of equal count stay in order of their hashes, the same for all texts
            order = np.argsort((owner.astype(np.uint64) << np.uint64(32)) | often.astype(np.uint64), kind="stable")
            runs, owner, often = runs[order], owner[order], often[order]
            places = np.arange(len(runs)) - (np.cumsum(sizes) - sizes)[owner]
            first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
            kept = (places < first[owner]) & (often > 1)  # a counter of one is of a run that no other class has
            runs, owner, often, places = runs[kept], owner[kept], often[kept], places[kept].astype(np.int32)
            often = np.maximum(_COUNTS[often] - int(mean), 0)
            if (often > tile).any():
                runs, owner, places = _gridded(runs, owner, often, places, digests, tile)
            if not len(runs):
                continue
            part = (mixed(runs) % np.uint64(parts)).astype(np.int64)
            group = owner * parts + part
            order = np.argsort(group, kind="stable")
            group, runs, places = group[order], runs[order], places[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            of, part = group[cuts[:-1]] // parts, group[cuts[:-1]] % parts
            kind_of = pa.array([kinds[k] for k in chosen], pa.string())
            take = pa.array(of)

            def cells(data: np.ndarray, width: int, cuts: np.ndarray = cuts) -> pa.Array:
                return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data.tobytes())])

            yield pa.RecordBatch.from_arrays([kind_of.take(take), pa.array(part, pa.int32()), pa.array(digests, pa.binary()).take(take), pa.array(sizes[of], pa.int32()), pa.array(sketches, pa.binary()).take(take), cells(runs, 8), cells(places, 4)], schema=_PART)

    return run


def _gridded(runs: np.ndarray, owner: np.ndarray, often: np.ndarray, places: np.ndarray, digests: list[bytes], tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaces runs in more than ``tile`` texts by the tiles of a grid: of any two texts, both are in one of its tiles."""
    hot = np.flatnonzero(often > tile)
    new_runs, new_owner, new_places = [np.delete(runs, hot)], [np.delete(owner, hot)], [np.delete(places, hot)]
    for at in hot.tolist():
        side = -(-int(often[at]) // tile) + 1
        own = np.uint64(int.from_bytes(digests[owner[at]][:8], "little") % side)
        other = np.arange(side, dtype=np.uint64)
        cell = (np.minimum(own, other) << np.uint64(24)) + np.maximum(own, other) + np.uint64(1)
        new_runs.append((mixed(np.full(side, runs[at] + np.uint64(1))) ^ mixed(cell)) & np.uint64((1 << 48) - 1))
        new_owner.append(np.full(side, owner[at]))
        new_places.append(np.full(side, places[at], dtype=np.int32))
    return np.concatenate(new_runs), np.concatenate(new_owner), np.concatenate(new_places)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one after another, and where each row's begin (one more entry: the end)."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.chunk(0)
    whole = whole.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rows(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, kind: type, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the kept rows, their values of ``width`` bytes and how many each has."""
    values = np.frombuffer(data.tobytes(), dtype=kind)
    lengths = np.diff(offsets)[keep] // width
    owner = np.repeat(np.arange(len(keep)), lengths)
    starts = np.cumsum(lengths) - lengths
    return values[np.arange(len(owner)) - starts[owner] + (offsets[keep] // width)[owner]], lengths


def _compared(similarity: float):  # noqa: ANN202
    """Pairs of classes of one part that share a run and whose sketches differ within the radius."""
    one_kind = _compared_kind(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            for kind in table.column("kind").unique().to_pylist():
                own = pc.is_null(table.column("kind")) if kind is None else pc.fill_null(pc.equal(table.column("kind"), kind), False)
                yield from one_kind(table.filter(own)).to_batches()

    return run


def _compared_kind(similarity: float):  # noqa: ANN202
    share = similarity / (1.0 + similarity)  # least common runs, as part of both sizes together

    def run(table: pa.Table) -> pa.Table:
        halves = np.frombuffer(_binary(table.column("digest"))[0].tobytes(), dtype=np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        again = (np.diff(halves[order], axis=0) == 0).all(axis=1)
        keep = np.sort(order[np.r_[True, ~again]]) if len(order) else order
        halves = halves[keep]
        sizes = table.column("size").to_numpy()[keep].astype(np.int64)
        words, widths = _rows(*_binary(table.column("sketch")), keep, np.uint64, 8)
        offsets = np.r_[0, np.cumsum(widths)]
        bits = np.add.reduceat(np.bitwise_count(words).astype(np.int64), offsets[:-1]) if len(keep) else np.zeros(0, np.int64)
        runs, counts = _rows(*_binary(table.column("runs")), keep, np.uint64, 8)
        places, _ = _rows(*_binary(table.column("places")), keep, np.int32, 4)
        owner = np.repeat(np.arange(len(keep)), counts)
        order = np.lexsort((sizes[owner], runs))
        runs, owner, places = runs[order], owner[order], places[order].astype(np.int64)
        left = sizes[owner] - places  # runs from this one on: no more can be in common if it is the first one
        facts = (similarity, share, sizes, bits, widths, offsets, words)
        edges = np.r_[0, np.flatnonzero(np.diff(runs)) + 1, len(runs)] if len(runs) else np.zeros(1, np.int64)
        many = np.diff(edges) > TILE_ROWS
        small = np.repeat(~many, np.diff(edges))
        found = [_side_by_side(runs[small], owner[small], left[small], facts)]
        held = len(found[0])
        for low, high in zip(edges[:-1][many].tolist(), edges[1:][many].tolist(), strict=True):
            found.append(_tile_by_tile(owner[low:high], left[low:high], facts))
            held += len(found[-1])
            if held > HELD:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0]) // 2
        pairs = np.unique(np.concatenate(found))
        names = [halves[k].tobytes() for k in range(len(halves))] if len(pairs) else []
        low = [names[k] for k in (pairs >> 32)]
        high = [names[k] for k in (pairs & 0xFFFFFFFF)]
        kind = table.column("kind")[0].as_py()
        swap = [(min(x, y), max(x, y)) for x, y in zip(low, high, strict=True)]
        return pa.table({"kind": pa.array([kind] * len(swap), pa.string()), "low": pa.array([x for x, _ in swap], pa.binary()), "high": pa.array([y for _, y in swap], pa.binary())})

    return run


def _side_by_side(runs: np.ndarray, owner: np.ndarray, left: np.ndarray, facts: tuple) -> np.ndarray:
    """Pairs within the radius among rows of the same run, for runs of few rows, each run one tile: rows 1, 2, 3, … apart, of all runs together."""
    similarity, share, sizes, bits, widths, offsets, words = facts
    size = sizes[owner]
    alive = np.arange(len(runs))
    found: list[np.ndarray] = [np.zeros(0, np.int64)]
    step = 1
    while len(alive):
        alive = alive[alive + step < len(runs)]
        alive = alive[runs[alive] == runs[alive + step]]
        a, b = alive, alive + step
        # rows of a run are in order of size: beyond this, sizes differ by more than the radius
        near = size[a] >= similarity * size[b] - 1e-9
        alive = alive[near]
        a, b = a[near], b[near]
        fits = np.minimum(left[a], left[b]) >= share * (size[a] + size[b]) - 1e-9
        a, b = owner[a[fits]], owner[b[fits]]
        if len(a):
            pairs = np.unique((np.minimum(a, b) << 32) | np.maximum(a, b))
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            radius = (1.0 - 2.0 * share) * (sizes[a] + sizes[b]) + 1e-9
            possible = (widths[a] != widths[b]) | (np.abs(bits[a] - bits[b]) <= radius)
            found.append(_within(a[possible], b[possible], radius[possible], widths, offsets, words))
        step += 1
    return np.unique(np.concatenate(found))


def apart(one: tuple[int, int, int, int], two: tuple[int, int, int, int], similarity: float, share: float, same_width: bool) -> bool:
    """Whether two tiles, each by its least and largest size and population count, can hold no pair within the radius."""
    low_one, high_one, few_one, many_one = one
    low_two, high_two, few_two, many_two = two
    if high_one < similarity * low_two - 1e-9 or high_two < similarity * low_one - 1e-9:
        return True
    return same_width and max(few_two - many_one, few_one - many_two) > (1.0 - 2.0 * share) * (high_one + high_two) + 1e-9


def _tile_by_tile(owner: np.ndarray, left: np.ndarray, facts: tuple) -> np.ndarray:
    """Pairs within the radius among the rows of one run, tile against tile; tiles are in order of width and population count."""
    similarity, share, sizes, bits, widths, offsets, words = facts
    order = np.lexsort((bits[owner], widths[owner]))
    owner, left = owner[order], left[order]
    tiles = []
    for width in np.unique(widths[owner]):
        rows = np.flatnonzero(widths[owner] == width)
        for low in range(0, len(rows), TILE_ROWS):
            at = rows[low : low + TILE_ROWS]
            of = owner[at]
            tiles.append((int(width), of, left[at], words[offsets[of][:, None] + np.arange(width)], (int(sizes[of].min()), int(sizes[of].max()), int(bits[of].min()), int(bits[of].max()))))
    found: list[np.ndarray] = [np.zeros(0, np.int64)]
    for k, (width, of, rest, sketch, bound) in enumerate(tiles):
        for other_width, other, other_rest, other_sketch, other_bound in tiles[k:]:
            if apart(bound, other_bound, similarity, share, width == other_width):
                continue
            least = min(width, other_width)
            x, y = (np.bitwise_xor.reduce(z.reshape(len(z), -1, least), axis=1) if z.shape[1] > least else z for z in (sketch, other_sketch))
            total = sizes[of][:, None] + sizes[other][None, :]
            possible = np.minimum(rest[:, None], other_rest[None, :]) >= share * total - 1e-9
            possible &= np.minimum(sizes[of][:, None], sizes[other][None, :]) >= similarity * np.maximum(sizes[of][:, None], sizes[other][None, :]) - 1e-9
            possible &= of[:, None] != other[None, :]
            if not possible.any():
                continue
            differ = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = np.nonzero(possible & (differ <= (1.0 - 2.0 * share) * total + 1e-9))
            a, b = of[a], other[b]
            found.append((np.minimum(a, b) << 32) | np.maximum(a, b))
    return np.unique(np.concatenate(found))


def _within(a: np.ndarray, b: np.ndarray, radius: np.ndarray, widths: np.ndarray, offsets: np.ndarray, words: np.ndarray, block: int = 65_536) -> np.ndarray:
    """The pairs whose sketches, the wider folded to the narrower, differ in no more bits than the radius."""
    out = []
    shape = widths[a] * 1024 + widths[b]
    for value in np.unique(shape):
        chosen = np.flatnonzero(shape == value)
        wide, slim = int(value // 1024), int(value % 1024)
        least = min(wide, slim)
        for low in range(0, len(chosen), block):
            rows = chosen[low : low + block]

            def folded(of: np.ndarray, width: int, least: int = least) -> np.ndarray:
                found = words[offsets[of][:, None] + np.arange(width)]
                return np.bitwise_xor.reduce(found.reshape(len(of), width // least, least), axis=1) if width > least else found

            differ = np.bitwise_count(folded(a[rows], wide) ^ folded(b[rows], slim)).sum(axis=1, dtype=np.int64)
            kept = rows[differ <= radius[rows]]
            out.append((a[kept] << 32) | b[kept])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sets(length: int):  # noqa: ANN202
    schema = pa.schema([("kind", pa.string()), ("id", pa.string()), ("runs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, ids, texts in _blocks(batches):
            values, bounds = run_sets(texts, length)
            yield pa.RecordBatch.from_pydict({"kind": kinds, "id": ids, "runs": [values[bounds[k] : bounds[k + 1]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for k in range(len(ids))]}, schema=schema)

    return run


def near_duplicates(df: DataFrame, kind_col: str, id_col: str, text_col: str, *, similarity: float = 0.8, length: int = 5, least: int = 1, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Members (kind, id, class_id) and links (kind, class_a, class_b, similarity) of near-duplicate texts.

    Texts of one kind with equal sets of runs of ``length`` words are one class, named by its smallest id. Classes are linked if
    their common runs are at least ``similarity`` of all their different runs, class_a < class_b. Texts with fewer than
    ``least`` runs take no part, nor do null texts and ids; a null kind is a kind of its own; a repeated id counts
    once and must have one text. Ids are taken as strings; other columns are not read. No cap on partners.
    """
    if not 0.0 < similarity <= 1.0 or min(length, least, tile) < 1:
        raise ValueError("similarity must be in (0, 1], length, least and tile at least 1")
    session = df.sparkSession
    texts = df.select(F.col(kind_col).cast("string").alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    counters = min(MOST, max(FEWEST, 1 << int(chars // CHARS_A_COUNTER).bit_length()))
    survey = settle(texts.mapInArrow(_survey(length, least, counters), _SURVEY_DDL))
    slices = survey.where(F.col("slice").isNotNull()).select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary")
    logs = np.zeros(counters, dtype=np.uint8)
    width = counters // SLICES
    for row in slices.collect():  # always so many bytes as counters
        logs[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.counts, dtype=np.uint8)
    histogram = session.sparkContext.broadcast(logs.tobytes())
    listed = survey.where(F.col("slice").isNull()).select("kind", "id", "digest")
    heads = listed.groupBy("kind", "digest").agg(F.min("id").alias("class_id"))
    runs = survey.agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]
    # two tasks a core at least, so that uneven parts balance
    parts = int(max(2 * session.sparkContext.defaultParallelism, runs * (1.0 - similarity) * RUN_BYTES // PART_BYTES + 1))
    sent = texts.mapInArrow(_parts(length, least, similarity, parts, tile, histogram), _PART_DDL).repartitionById(parts, "part")
    near = sent.mapInArrow(_compared(similarity), "kind string, low binary, high binary").distinct()
    a = heads.select(F.col("kind").alias("kind_a"), F.col("digest").alias("low"), F.col("class_id").alias("first"))
    b = heads.select(F.col("kind").alias("kind_b"), F.col("digest").alias("high"), F.col("class_id").alias("second"))
    named = near.join(a, near["kind"].eqNullSafe(a["kind_a"]) & (near["low"] == a["low"])).drop(a["low"]).join(b, near["kind"].eqNullSafe(b["kind_b"]) & (near["high"] == b["high"]))
    pairs = settle(named.select("kind", F.least("first", "second").alias("class_a"), F.greatest("first", "second").alias("class_b")))
    asked = pairs.select("kind", F.explode(F.array("class_a", "class_b")).alias("id")).distinct()
    wanted = asked.select(F.col("kind").alias("k"), F.col("id").alias("i"))
    texts = may_be_in(texts, ["kind", "id"], asked)  # only texts that may be asked for are shuffled
    sets = texts.join(wanted, texts["kind"].eqNullSafe(wanted["k"]) & (texts["id"] == wanted["i"]), "left_semi").mapInArrow(_sets(length), "kind string, id string, runs binary").dropDuplicates(["kind", "id"])
    left = sets.select(F.col("kind").alias("k"), F.col("id").alias("class_a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("kind").alias("k"), F.col("id").alias("class_b"), F.col("runs").alias("runs_b"))
    both = pairs.join(left, pairs["kind"].eqNullSafe(left["k"]) & (pairs["class_a"] == left["class_a"])).drop("k").drop(left["class_a"])
    both = both.join(right, both["kind"].eqNullSafe(right["k"]) & (both["class_b"] == right["class_b"])).drop("k").drop(right["class_b"])
    verified = both.mapInArrow(_verified, "kind string, class_a string, class_b string, common long, total long")
    links = verified.where(F.col("common") >= F.col("total") * similarity - 1e-9).select("kind", "class_a", "class_b", (F.col("common") / F.col("total")).alias("similarity"))
    members = listed.join(heads.withColumnRenamed("kind", "k").withColumnRenamed("digest", "d"), listed["kind"].eqNullSafe(F.col("k")) & (listed["digest"] == F.col("d"))).select("kind", "id", "class_id").distinct()
    return members, links


def _wide(raw: pa.Scalar) -> np.ndarray:
    """Runs of 6 bytes each as numbers."""
    packed = np.frombuffer(raw.as_buffer(), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(packed), 8), dtype=np.uint8)
    out[:, :6] = packed
    return out.view(np.uint64).ravel()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("class_a", pa.string()), ("class_b", pa.string()), ("common", pa.int64()), ("total", pa.int64())])
    for batch in batches:
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("kind", "class_a", "class_b", "runs_a", "runs_b")}
        common, total = [], []
        for a, b in zip(columns["runs_a"], columns["runs_b"], strict=True):
            x, y = _wide(a), _wide(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            common.append(both)
            total.append(len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([columns["kind"], columns["class_a"], columns["class_b"], pa.array(common, pa.int64()), pa.array(total, pa.int64())], schema=schema)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, class_id, group_id, n_links): one row for each member with the connected component of its class.

    group_id is the smallest class of the component, n_links the number of other classes the class is linked with. Components are
    found by alternating large-star and small-star steps on the links until nothing changes; the links are never collected, and
    the links of a class with many are spread over tasks.
    """
    edges = settle(links.select(F.struct("kind", F.col("class_a").alias("c")).alias("u"), F.struct("kind", F.col("class_b").alias("c")).alias("v")))
    degree = edges.select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    labels = edges
    before = None
    while True:
        both = union_all(labels.select("u", "v"), labels.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both, least, ["u"], F.col("v"), salts=SALTS).where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct()
        heavy = large.groupBy("v").agg(F.min("u").alias("m"))
        small = salted_join(large, heavy, ["v"], F.col("u"), salts=SALTS)
        small = union_all(small.select(F.col("m").alias("u"), "v"), small.where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v")))
        labels = settle(small.distinct())
        now = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    # one row a class, so that a class of many equal texts is joined spread over tasks
    facts = degree.join(labels.select(F.col("v").alias("class"), F.col("u.c").alias("root")), "class", "left")
    named = salted_join(members.withColumn("class", F.struct("kind", F.col("class_id").alias("c"))), facts, ["class"], F.col("id"), "left", salts=SALTS)
    return named.select("kind", "id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id_a, id_b) of all linked members, id_a < id_b, those of one class included; the members of a class are spread over tasks."""
    keyed = members.select(F.struct("kind", F.col("class_id").alias("c")).alias("class"), "id")
    across = links.select("kind", F.struct("kind", F.col("class_a").alias("c")).alias("class"), F.struct("kind", F.col("class_b").alias("c")).alias("other"))
    across = salted_join(keyed, across, ["class"], F.col("id"), salts=SALTS).select("kind", F.col("id").alias("x"), F.col("other").alias("class"))
    across = salted_join(keyed.withColumnRenamed("id", "y"), across, ["class"], F.col("y"), salts=SALTS).select("kind", "x", "y")
    several = members.where(F.col("id") != F.col("class_id")).select(F.struct("kind", F.col("class_id").alias("c")).alias("class")).distinct()
    held = salted_join(keyed, several, ["class"], F.col("id"), "left_semi", salts=SALTS)
    inside = salted_join(held, held.withColumnRenamed("id", "y"), ["class"], F.col("id"), salts=SALTS).where(F.col("id") < F.col("y")).select(F.col("class.kind").alias("kind"), F.col("id").alias("x"), "y")
    return union_all(across, inside).select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
