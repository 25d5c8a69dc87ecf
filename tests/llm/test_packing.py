"""The configuration program: what it fills, the plan's places, and the query's columns."""

import os
import random
from collections import Counter
from functools import cache

import pytest

from veilspan.llm import packing

DIR = "/root/testdata/sf0.001"


def _histogram(n, seed=2):
    rnd = random.Random(seed)
    return dict(Counter(min(2048, 1 + int(rnd.lognormvariate(5.6, 1.0))) for _ in range(n)))


def test_programs_fill_nearly_all():
    histogram = _histogram(20_000)
    configs, left = packing.configured(dict(histogram))
    filled = sum(k for c, k in configs if c != (2048,))
    every = packing.plan(dict(histogram))
    total = sum(k for _, k in every)
    assert total - sum(k for _, k in configs) <= 0.05 * filled  # what best fit packs
    assert total <= -(-sum(x * n for x, n in histogram.items()) // 2048) * 1.002 + 1
    assert sum((Counter({x: m * k for x, m in Counter(c).items()}) for c, k in every), Counter()) == Counter(histogram)
    assert all(sum(c) <= 2048 for c, _ in every)


def test_the_dearest_is_found_by_brute_force():
    import numpy as np

    rnd = random.Random(4)
    for _ in range(20):
        lengths = np.array(sorted(rnd.sample(range(1, 30), 5)))
        prices = np.array([rnd.random() * x for x in lengths])
        configs = packing._dearest(lengths, prices, 40, 5)
        value = lambda c: sum(prices[i] for i in c)

        @cache
        def best(room):
            return max((prices[i] + best(room - x) for i, x in enumerate(lengths.tolist()) if x <= room), default=0.0)  # noqa: B023

        assert value(configs[0]) == pytest.approx(best(40))
        assert all(sum(lengths[i] for i in c) <= 40 and value(c) >= value(configs[0]) * (1 - packing.NEARLY) - 1e-9 for c in configs)
        assert len({c[0] for c in configs}) == len(configs)


def test_places_are_gapless():
    configs = [((5, 5, 3), 4), ((5, 3, 3, 2), 3), ((3,), 2)]
    p = packing.places(configs)
    assert len(p["key"]) == 6  # an entry for each length of a configuration
    sequences = {}
    many = Counter()
    for c, k in configs:
        for x in c:
            many[x] += k
    for x, n in many.items():
        for number in range(n):
            at = int(p["key"].searchsorted(x << 48 | number, side="right")) - 1
            repeat, place = divmod((x << 48 | number) - int(p["key"][at]), int(p["many"][at]))
            sequences.setdefault(int(p["sequence"][at]) + place, []).append((int(p["offset"][at]) + repeat * x, x))
    assert len(sequences) == 9
    for s in sequences.values():
        at = 0
        for offset, x in sorted(s):
            assert offset == at
            at += x


def test_a_plan_too_large_is_an_error(monkeypatch):
    monkeypatch.setattr(packing, "ENTRIES", 1)
    with pytest.raises(ValueError):
        packing.places([((2, 1), 1)])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_columns_of_the_query(spark):
    out = packing.op7_packing(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
