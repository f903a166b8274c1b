"""Problem 4: items over a size limit are cut into overlapping pieces at natural boundaries.

Workers find boundaries in ranges with halos, the boundary tables are stitched, and pieces are emitted
by offset. Items in tables (``pieces``) and giant files (``split_files``) share the same steps, and a file's pieces are those
of its whole text, however it is cut into ranges: where a piece begins in one range decides where the first one begins in the next, so that
each range gives a table from every possible first piece to the next range's, tables are composed (an associative operation, done in two
levels), and prefix sums of characters and pieces give the offsets. No worker ever reads more than its range with its halos.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, settle

SIZE, OVERLAP = 800, 100
#: Characters of a range in which boundaries are found at once.
RANGE = 1 << 16
#: Characters before a range that are looked at, too; more where all of them are white space or closing marks.
HALO = 64

#: Strength of a cut before a character.
NEVER, ANYWHERE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_SPACE, _NEWLINE, _CLOSER, _STOP, _WIDE_STOP, _CLAUSE, _WIDE_CLAUSE, _MARK = (1 << k for k in range(8))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point of the basic plane, bits of what it may be."""
    out = np.zeros(0x10000, dtype=np.uint8)
    for point in range(0x10000):
        char, kind = chr(point), unicodedata.category(chr(point))
        out[point] = _SPACE * char.isspace() | _NEWLINE * (char in "\n\r\x0b\x0c  ") | _CLOSER * (kind in ("Pe", "Pf") or char in "\"'”’」』") | _MARK * (kind in ("Mn", "Mc", "Me") or char in "‍️")
    for chars, bit in ((".!?…؟۔।॥", _STOP), ("。！？｡", _WIDE_STOP), (",;:،؛—–", _CLAUSE), ("，；：、", _WIDE_CLAUSE)):
        for char in chars:
            out[ord(char)] |= bit
    return out


def strengths(text: str, start: int, end: int) -> np.ndarray:
    """The strength of a cut before each character of text[start:end], as the whole text would give it."""
    low = max(0, start - HALO)
    classes = _classes()
    while True:
        points = np.frombuffer(text[low:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = classes[np.minimum(points, 0xFFFF)]
        kinds[points > 0xFFFF] = 0
        if low == 0 or (kinds[: start - low] & (_SPACE | _CLOSER) == 0).any():
            break
        low = max(0, low - 2 * (start - low))
    at = np.arange(len(kinds))
    space = kinds & _SPACE != 0
    core = np.maximum.accumulate(np.where(kinds & (_SPACE | _CLOSER) == 0, at, -1))
    solid = np.maximum.accumulate(np.where(~space, at, -1))
    breaks = np.cumsum((kinds & _NEWLINE != 0) & ~((points == 10) & np.r_[False, points[:-1] == 13]))
    out = np.full(len(kinds), ANYWHERE, dtype=np.uint8)
    # positions whose character is no space; before them, maybe, white space
    before, here = at[:-1], at[1:]
    after_space = space[before] & ~space[here]
    last = np.where(core[before] >= 0, kinds[core[before]], 0)
    beside = core[before] == before
    closed = solid[before] == before
    level = np.where(after_space, WORD, ANYWHERE)
    level = np.where((after_space & (last & _CLAUSE != 0)) | (beside & ~space[here] & (last & _WIDE_CLAUSE != 0)), CLAUSE, level)
    ends_wide = (last & _WIDE_STOP != 0) & ~space[here] & (kinds[here] & (_CLOSER | _WIDE_STOP) == 0) & (after_space | closed)
    level = np.where((after_space & (last & _STOP != 0)) | ends_wide, SENTENCE, level)
    lines = breaks[before] - np.where(solid[before] >= 0, breaks[np.maximum(solid[before], 0)], 0)
    level = np.where(after_space & (lines == 1), LINE, level)
    level = np.where(after_space & (lines > 1), PARAGRAPH, level)
    out[1:] = np.where(kinds[here] & _MARK != 0, NEVER, level)
    if len(points) > 1:
        out[1:][points[:-1] == 0x200D] = NEVER
    return out[start - low :]


def stitched(text: str, reach: int = RANGE) -> np.ndarray:
    """The boundary table of a whole text, put together from its ranges."""
    if len(text) <= reach:
        return strengths(text, 0, len(text))
    return np.concatenate([strengths(text, a, min(a + reach, len(text))) for a in range(0, len(text), reach)])


def _piece(levels: np.ndarray, start: int, size: int, overlap: int) -> tuple[int, int]:
    """End of the piece that begins at ``start``, where more than ``size`` characters are left, and begin of the next."""
    low = start + max(size // 2, overlap + 1)
    window = levels[low : start + size + 1][::-1]
    end = start + size - int(window.argmax())
    if levels[end] == NEVER:
        end = start + size
    shared = levels[end - overlap : end + 1] if overlap else levels[end : end + 1]
    shared = np.minimum(shared, SENTENCE)
    return end, end if shared.max() <= ANYWHERE and levels[end] > ANYWHERE else end - len(shared) + 1 + int(shared.argmax())


def spans(levels: np.ndarray, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Begin and end of the pieces: each ends at the last of the strongest cuts in the second half of its
    reach, the next begins at the earliest of the strongest cuts (up to sentences) within the overlap."""
    start, total = 0, len(levels)
    while total - start > size:
        end, following = _piece(levels, start, size, overlap)
        yield start, end
        start = following
    yield start, total


def _checked(size: int, overlap: int) -> None:
    if size < 2 or not 0 <= overlap < size // 2:
        raise ValueError("size must be at least 2 and overlap less than half of it")


def pieces(df: DataFrame, id_col: str, text_col: str, *, size: int = SIZE, overlap: int = OVERLAP, reach: int = RANGE) -> DataFrame:
    """(id, piece_no, start_char, end_char, piece) of each text of more than ``size`` characters.

    Texts up to the limit, empty and null texts give no row; a null id is kept; repeated rows give
    repeated pieces; other columns are not read. Pieces cover the whole text; consecutive ones share at
    most ``overlap`` characters. Where there is no natural boundary a piece is cut at the limit, but not
    before a combining mark unless there is nothing else. Rows are independent: no shuffle.
    """
    _checked(size, overlap)
    kind = df.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(df.schema[id_col].dataType)), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("piece", pa.string())])

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        out: dict[str, list] = {name: [] for name in schema.names}
        held = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for number, (a, b) in enumerate(spans(stitched(text, reach), size, overlap)):
                for name, value in zip(schema.names, (key, number, a, b, text[a:b]), strict=True):
                    out[name].append(value)
                held += b - a
                if held > 8_000_000:
                    yield out
                    out, held = {name: [] for name in schema.names}, 0
        if out["id"]:
            yield out

    long = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > size)
    return long.mapInArrow(arrow_rows(make, schema), f"id {kind}, piece_no int, start_char long, end_char long, piece string").withColumnRenamed("id", id_col)


def _opened(path: str):  # noqa: ANN202
    """A file at a path or URI, for reading at offsets."""
    from pyarrow import fs

    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
    else:
        system, path = fs.LocalFileSystem(), path.removeprefix("file:")
    return system.open_input_file(path)


def _size_of(path: str) -> int:
    with _opened(path) as file:
        return file.size()


def _characters(raw: bytes, skip_first: bool) -> bytes:
    """raw from the first byte on that begins a character."""
    at = 0
    while skip_first and at < min(3, len(raw)) and raw[at] & 0xC0 == 0x80:
        at += 1
    return raw[at:]


def _decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def _range(path: str, number: int, range_bytes: int, ahead: int) -> tuple[str, int, np.ndarray]:
    """Text of a range with what follows it, how many of its characters begin in the range, and the strengths of all cuts.

    ``ahead`` characters after the range are read, fewer at the end of the file; before it a halo as long as the boundaries need.
    """
    low, high = number * range_bytes, (number + 1) * range_bytes
    halo = 4 * HALO
    with _opened(path) as file:
        while True:
            begin = max(0, low - halo)
            file.seek(begin)
            raw = file.read(high - begin + 4 * ahead + 8)
            before, rest = raw[: low - begin], raw[low - begin :]
            # bytes that go on with a character begun before belong to it
            cut = len(rest) - len(_characters(rest, low > 0))
            before, rest = _characters(before + rest[:cut], begin > 0), rest[cut:]
            left = _decoded(before)
            if begin == 0 or any(not c.isspace() and not _classes()[min(ord(c), 0xFFFF)] & _CLOSER for c in left):
                break
            halo *= 4
    own = high - low - cut
    while own < len(rest) and rest[own] & 0xC0 == 0x80:
        own += 1
    end = len(rest)
    if begin + len(raw) < high + 4 * ahead + 8:
        pass  # the end of the file
    else:
        back = 1
        while back < 4 and rest[end - back] & 0xC0 == 0x80:
            back += 1
        end -= back  # the last character may not be whole
    inside, after = _decoded(rest[:own]), _decoded(rest[own:end])
    return inside + after, len(inside), strengths(left + inside + after, len(left), len(left) + len(inside) + len(after))


def _exits(levels: np.ndarray, inside: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the range's first ``size`` where a piece may begin: where the next range's first piece begins, relative to it (-1: the text has ended), and how many pieces begin in the range."""
    known: dict[int, tuple[int, int]] = {}
    exits, counts = np.empty(size, dtype=np.int32), np.zeros(size, dtype=np.int64)
    for entry in range(size):
        path, at, found = [], entry, None
        while at < inside:
            found = known.get(at)
            if found is not None:
                break
            path.append(at)
            if len(levels) - at <= size:
                at, found = -1, (-1, 0)
                break
            _, at = _piece(levels, at, size, overlap)
        out, count = found if found is not None else (at - inside, 0)
        for place in reversed(path):
            count += 1
            known[place] = (out, count)
        exits[entry], counts[entry] = out, count
    return exits, counts


def _composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One table for two neighbours."""
    goes_on = first[0] >= 0
    at = np.where(goes_on, first[0], 0)
    return np.where(goes_on, second[0][at], -1).astype(np.int32), first[1] + np.where(goes_on, second[1][at], 0)


def _tables(of: pa.Table) -> list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
    """(number, characters, table) of the rows, in order of their numbers."""
    rows = zip(*(of.column(name).to_pylist() for name in ("number", "chars", "exits", "counts")), strict=True)
    return [(n, c, (np.frombuffer(e, dtype=np.int32), np.frombuffer(k, dtype=np.int64))) for n, c, e, k in sorted(rows, key=lambda row: row[0])]


def split_files(spark: SparkSession, paths: list[str], *, size: int = SIZE, overlap: int = OVERLAP, range_bytes: int = 1 << 22) -> DataFrame:
    """(file_no, piece_no, start_char, end_char, piece) of UTF-8 text files, as ``spans`` cuts their whole texts, also those up to the limit.

    file_no counts the paths from 0. Paths are local or URIs of a store that all executors can open (as pyarrow does). Offsets are characters of the file. A byte that isn't
    UTF-8 is a character, given out as U+FFFD. Empty files give no row. Each range is read twice; one small table a range is shuffled.
    """
    _checked(size, overlap)
    ahead = size + 1
    range_bytes = max(range_bytes, 16)
    ranges = np.array([-(-_size_of(path) // range_bytes) for path in paths], dtype=np.int64)
    ends = np.cumsum(ranges)
    total = int(ends[-1]) if len(paths) else 0
    width = max(1, int(np.ceil(np.sqrt(max(ranges, default=1)))))  # ranges of a group
    tasks = max(1, min(total, 100_000))

    def place(number: int) -> tuple[int, int]:
        file = int(np.searchsorted(ends, number, side="right"))
        return file, number - int(ends[file] - ranges[file])

    def measure(batch: pa.RecordBatch):  # noqa: ANN202
        for number in batch.column(0).to_pylist():
            file, at = place(number)
            _, inside, levels = _range(paths[file], at, range_bytes, ahead)
            exits, counts = _exits(levels, inside, size, overlap)
            yield {"file_no": [file], "grp": [at // width], "number": [at], "chars": [inside], "exits": [exits.tobytes()], "counts": [counts.tobytes()]}

    def grouped(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = _tables(table)
        whole = rows[0][2]
        for _, _, more in rows[1:]:
            whole = _composed(whole, more)
        return pa.table({"file_no": [key[0].as_py()], "number": [key[1].as_py()], "chars": [sum(c for _, c, _ in rows)], "exits": [whole[0].tobytes()], "counts": [whole[1].tobytes()]}, schema=_GROUP)

    def walked(table: pa.Table, file: int, entry: int, chars: int, parts: int) -> pa.Table:
        out: dict[str, list] = {name: [] for name in _WALK.names}
        for number, inside, (exits, counts) in _tables(table):
            for name, value in zip(_WALK.names, (file, number, entry, chars, parts), strict=True):
                out[name].append(value)
            chars += inside
            if entry >= 0:
                parts += int(counts[entry])
                entry = int(exits[entry])
        return pa.table(out, schema=_WALK)

    def over_groups(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return walked(table, key[0].as_py(), 0, 0, 0)

    def over_ranges(key: tuple[pa.Scalar, ...], ours: pa.Table, begins: pa.Table) -> pa.Table:
        begin = begins.to_pylist()[0]
        return walked(ours, key[0].as_py(), begin["entry"], begin["chars"], begin["parts"])

    def emit(batch: pa.RecordBatch):  # noqa: ANN202
        for file, at, entry, chars, parts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if entry < 0:
                continue
            text, inside, levels = _range(paths[file], at, range_bytes, ahead)
            out: dict[str, list] = {name: [] for name in _PIECES.names}
            while 0 <= entry < inside:
                end, following = _piece(levels, entry, size, overlap) if len(levels) - entry > size else (len(levels), -1)
                piece = text[entry:end].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                for name, value in zip(_PIECES.names, (file, parts, chars + entry, chars + end, piece), strict=True):
                    out[name].append(value)
                entry, parts = following, parts + 1
            if out["piece"]:
                yield out

    if not total:
        return spark.createDataFrame([], _ddl(_PIECES))
    tables = settle(spark.range(0, total, 1, tasks).mapInArrow(arrow_rows(measure, _RANGE), _ddl(_RANGE)))
    groups = tables.groupBy("file_no", "grp").applyInArrow(grouped, _ddl(_GROUP))
    begins = groups.groupBy("file_no").applyInArrow(over_groups, _ddl(_WALK)).withColumnRenamed("number", "grp")
    placed = tables.groupBy("file_no", "grp").cogroup(begins.groupBy("file_no", "grp")).applyInArrow(over_ranges, _ddl(_WALK))
    return placed.repartition(tasks, "file_no", "number").mapInArrow(arrow_rows(emit, _PIECES), _ddl(_PIECES))


_RANGE = pa.schema([("file_no", pa.int64()), ("grp", pa.int64()), ("number", pa.int64()), ("chars", pa.int64()), ("exits", pa.binary()), ("counts", pa.binary())])
_GROUP = pa.schema([("file_no", pa.int64()), ("number", pa.int64()), ("chars", pa.int64()), ("exits", pa.binary()), ("counts", pa.binary())])
_WALK = pa.schema([("file_no", pa.int64()), ("number", pa.int64()), ("entry", pa.int64()), ("chars", pa.int64()), ("parts", pa.int64())])
_PIECES = pa.schema([("file_no", pa.int64()), ("piece_no", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("piece", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{field.name} {kinds[field.type]}" for field in schema)


def written_files(texts: DataFrame, column: str, folder: str) -> list[str]:
    """Writes the texts of a column, one after another with a line break, as text files in a folder all can reach; their paths in order."""
    texts.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(folder)
    return sorted(row.path for row in texts.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(folder).select("path").collect())
