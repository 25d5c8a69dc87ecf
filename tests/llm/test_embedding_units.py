"""Units of work of the embedding links: tiles in a circle, blocks that stream past."""

from collections import Counter

import numpy as np
import pytest

from veilspan.llm import embedding_dedup as ed


def _clustered(n, d, seed):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, d))
    near = rnd.integers(0, n, n // 2)
    m[: n // 2] = m[near] + rnd.normal(size=(n // 2, d)) * rnd.choice([0.0, 0.1, 0.2, 0.24, 0.3], size=(n // 2, 1))
    return m.astype("<f4")


def _brute(m, threshold=0.95):
    x = m.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


def _forest(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return find


@pytest.mark.parametrize("threshold", [0.95, 0.5])
def test_a_unit_counts_each_link_once(threshold):
    m = _clustered(900, 24, 1)
    ids = np.arange(900) * 3
    unit = ed.Unit(threshold, "<f4")
    for k in range(3):  # the tile: blocks 0 to 2
        unit.hold(k, ids[200 * k : 200 * k + 200], m[200 * k : 200 * k + 200])
    rows = [b for k in range(3) for b in unit.meet(k, ids[200 * k : 200 * k + 200], m[200 * k : 200 * k + 200])]
    rows += list(unit.meet(7, ids[600:], m[600:]))
    rows += list(unit.end())
    found = [r for b in rows for r in b.to_pylist()]
    linked = _brute(m, threshold)
    linked[600:, 600:] = False
    got = Counter()
    for r in found:
        got[r["a"]] += r["n"]
    assert got == Counter({int(i): int(n) for i, n in zip(ids, linked.sum(1), strict=True) if n})
    mine, theirs = _forest((r["a"], r["b"]) for r in found), _forest((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(linked), strict=True))
    assert all(mine(int(i)) == theirs(int(i)) for i in ids)


def test_a_pair_is_decided_alike_in_any_tiling(monkeypatch):
    m = np.concatenate([_clustered(400, 16, 2), np.ones((300, 16), "<f4")])
    a = ed.Tile(np.arange(len(m)), m)
    want = {(int(i), int(j)) for x, y in ed.links(a, a, 0.95) for i, j in zip(x, y, strict=True)}
    monkeypatch.setattr(ed, "STRIP", 7)
    monkeypatch.setattr(ed, "CHUNK", 11)
    monkeypatch.setattr(ed, "EXACT", 5)
    assert {(int(i), int(j)) for x, y in ed.links(a, a, 0.95) for i, j in zip(x, y, strict=True)} == want
    assert want == {(int(i), int(j)) for i, j in zip(*np.nonzero(_brute(m)), strict=True)} | {(k, k) for k in range(len(m))}


@pytest.mark.parametrize("tile", [None, 1500, 3000])
def test_blocks_in_many_tiles(spark, tile):
    m = _clustered(7000, 16, 3)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    rows = {r["vec_id"]: r for r in ed.near_duplicates(df.repartition(3), tile=tile).collect()}
    linked = _brute(m)
    assert [rows[i]["n_links"] for i in range(7000)] == linked.sum(1).tolist()
    find = _forest((int(i), int(j)) for i, j in zip(*np.nonzero(linked), strict=True))
    assert all(rows[i]["component_id"] == find(i) and rows[i]["kept"] == (find(i) == i) for i in range(7000))
