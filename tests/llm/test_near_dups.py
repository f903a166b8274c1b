from __future__ import annotations

import random

import pytest

from tessella.llm import near_dups
from tessella.llm.common import words_of


def corpus():
    random.seed(7)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(30, 90))] for _ in range(60)]
    rows = [("a", f"{k:03d}", " ".join(b)) for k, b in enumerate(base)]
    for k in range(90):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 14)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append(("a", f"n{k:03d}", "  ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    rows += [("b", "000", rows[0][2]), ("b", "001", rows[0][2] + "!"), ("a", "short", "one two"), ("a", "null", None), ("a", "empty", ""), (None, "k1", rows[1][2]), (None, "k2", rows[1][2]), ("a", "000", rows[0][2])]
    return rows


def brute(rows, similarity, length, least):
    sets = {}
    for kind, key, text in rows:
        w = words_of(text or "")
        s = frozenset(zip(*(w[k:] for k in range(length))))
        if len(s) >= least:
            sets[(kind, key)] = s
    keys = sorted(sets, key=lambda x: x[1])
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("similarity,length,tile", [(0.6, 3, 20_000), (0.8, 5, 20_000), (0.5, 2, 1)])
def test_against_brute_force(spark, similarity, length, tile):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "kind_of string, key string, t string, digest string").repartition(5)
    members, links = near_dups.near_duplicates(frame, "kind_of", "key", "t", similarity=similarity, length=length, least=10, tile=tile)
    got = [(r.kind, r.id_a, r.id_b) for r in near_dups.all_pairs(members, links).collect()]
    want = brute(rows, similarity, length, 10)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    grouped = {(r.kind, r.id): r.group_id for r in near_dups.groups(members, links).collect()}
    parent = {k: k for k in grouped}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for kind, a, b in want:
        x, y = root((kind, a)), root((kind, b))
        parent[max(x, y, key=lambda z: z[1])] = min(x, y, key=lambda z: z[1])
    assert {k: root(k)[1] for k in grouped} == grouped


def test_chain_is_one_group(spark):
    words = [f"v{k}" for k in range(200)]
    rows = [("a", f"{k:02d}", " ".join(words[k * 4 : k * 4 + 60])) for k in range(30)]
    frame = spark.createDataFrame(rows, "kind string, id string, t string")
    members, links = near_dups.near_duplicates(frame, "kind", "id", "t", similarity=0.8, length=1, least=5)
    got = near_dups.groups(members, links).collect()
    assert {r.group_id for r in got} == {"00"} and max(r.n_links for r in got) == 2


def test_family_of_many_edits(spark):
    """A run that all texts share is compared tile by tile; a class of many equal texts is one class."""
    random.seed(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        words = list(base)
        for _ in range(3):
            words[random.randrange(20, 120)] = f"x{random.randrange(10**6)}"
        rows.append(("a", f"{k:04d}", " ".join(words)))
    rows += [("a", f"e{k:04d}", " ".join(base)) for k in range(300)]
    frame = spark.createDataFrame(rows, "kind string, id string, t string").repartition(4)
    for tile in (20_000, 90):
        members, links = near_dups.near_duplicates(frame, "kind", "id", "t", similarity=0.6, length=3, least=10, tile=tile)
        got = {(r.class_a, r.class_b) for r in links.collect()}
        heads = [(r[0], r[1], r[2]) for r in rows[:401]]
        assert got == {(a, b) for _, a, b in brute(heads, 0.6, 3, 10)}
    grouped = near_dups.groups(members, links).collect()
    assert len(grouped) == 700 and len({r.class_id for r in grouped}) == 401 and {r.group_id for r in grouped} == {"0000"}


def test_tiles_are_skipped_by_counts():
    share = 0.6 / 1.6
    assert near_dups.apart((100, 110, 40, 50), (100, 110, 110, 120), 0.6, share, True)  # 60 bits, beyond a radius of 55
    assert not near_dups.apart((100, 110, 40, 50), (100, 110, 110, 120), 0.6, share, False)
    assert not near_dups.apart((100, 110, 40, 50), (100, 110, 90, 120), 0.6, share, True)
    assert near_dups.apart((10, 20, 1, 9), (40, 50, 1, 9), 0.6, share, True)


def test_histogram_in_bytes():
    import numpy as np

    counts = np.r_[np.zeros(9000, np.int32), np.arange(1, 1000, dtype=np.int32), np.array([10**6, 2**31 - 1], np.int32)]
    assert (near_dups._unpacked(near_dups._packed(counts)) == counts).all()
    logs = near_dups._logarithms(counts)
    assert (np.diff(logs[9000:].astype(int)) >= 0).all() and (near_dups._COUNTS[logs] >= counts * 0.99 - 1).all() and (near_dups._COUNTS[logs] <= counts * 1.1 + 1).all()
    assert (logs[:9002] == counts[:9002]).all()


def test_memory_bounds_change_nothing(monkeypatch):
    monkeypatch.setattr(near_dups, "TILE_ROWS", 2)
    monkeypatch.setattr(near_dups, "HELD", 3)
    table = near_dups._compared_kind(0.5)
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 48, 500, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[: 60 + 10 * (k % 3)], 40 + k % 9, replace=False)) for k in range(40)]
    sketches = near_dups.parity_sketches(np.concatenate(sets), np.repeat(np.arange(40), [len(x) for x in sets]), np.where(np.arange(40) % 2, 256, 512))
    given = pa.table({"kind": ["a"] * 40, "part": [0] * 40, "digest": pa.array([bytes([k]) * 16 for k in range(40)], pa.binary()), "size": pa.array([len(x) for x in sets], pa.int32()), "sketch": pa.array(sketches, pa.binary()), "runs": pa.array([x[:20].tobytes() for x in sets], pa.binary()), "places": pa.array([np.arange(20, dtype=np.int32).tobytes()] * 40, pa.binary())})
    small = set(zip(table(given)["low"].to_pylist(), table(given)["high"].to_pylist()))
    monkeypatch.setattr(near_dups, "TILE_ROWS", 64)
    whole = set(zip(near_dups._compared_kind(0.5)(given)["low"].to_pylist(), near_dups._compared_kind(0.5)(given)["high"].to_pylist()))
    assert small == whole and len(whole) > 10


def test_empty_and_parameters(spark):
    frame = spark.createDataFrame([], "kind string, id string, t string")
    members, links = near_dups.near_duplicates(frame, "kind", "id", "t")
    assert members.count() == 0 and links.count() == 0 and near_dups.groups(members, links).count() == 0
    with pytest.raises(ValueError):
        near_dups.near_duplicates(frame, "kind", "id", "t", similarity=0.0)


def test_sketch_never_exceeds_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 1 << 48, 120, dtype=np.uint64)
        b = np.r_[a[: rng.integers(0, 120)], rng.integers(0, 1 << 48, 40, dtype=np.uint64)]
        sets = [np.unique(a), np.unique(b)]
        raw = near_dups.parity_sketches(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), np.array([512, 512]))
        x, y = (np.frombuffer(r, dtype=np.uint64) for r in raw)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
