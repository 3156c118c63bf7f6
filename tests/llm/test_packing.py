"""Containers: nothing lost, nothing split without need, capacity kept, little space left."""

import random
from collections import defaultdict

import numpy as np

from playledger.llm.packing import pack, report, sum_of_squares


def plain(sizes, capacity):
    """The same choice by trying every gap and counting the whole sum anew."""
    count, into, opened, made = defaultdict(int), [], defaultdict(list), 0
    for s in sizes:
        best = None
        for gap in [*[g for g in range(s, capacity) if count[g]], capacity]:
            c = dict(count)
            if gap < capacity:
                c[gap] -= 1
            if gap - s:
                c[gap - s] = c.get(gap - s, 0) + 1
            total = sum(v * v for v in c.values())
            if best is None or total < best[0]:
                best = (total, gap)
        gap = best[1]
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = opened[gap].pop()
            count[gap] -= 1
        if gap - s:
            opened[gap - s].append(b)
            count[gap - s] += 1
        into.append(b)
    return into


def test_equals_counting_the_whole_sum():
    rng = random.Random(2)
    for _ in range(40):
        capacity = rng.choice([5, 9, 20])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.choice([1, 30, 80]))]
        assert sum_of_squares(np.array(sizes), capacity)[0].tolist() == plain(sizes, capacity)


def test_pack(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 3, 17, 40, 99, 100, 101, 250, 1000]) for i in range(600)}
    items = spark.createDataFrame([*sizes.items(), (9000, None), (None, 5)], "doc_id long, n int")
    kinds = spark.createDataFrame([(1, 100), (2, 512), (3, 0), (4, None)], "kind_id int, cap int")
    rows = pack(items, kinds, key="doc_id", size="n", kind="kind_id", capacity="cap", per_shard=150).collect()
    for kind, cap in ((1, 100), (2, 512)):
        mine = [r for r in rows if r.kind_id == kind]
        load, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            load[r.container] += r.n
            pieces[r.doc_id].append((r.piece_no, r.start, r.n))
        assert max(load.values()) <= cap
        for i, n in sizes.items():
            p = sorted(pieces[i])
            assert sum(x for *_, x in p) == n and [s for _, s, _ in p] == [k * cap for k in range(len(p))]
            assert len(p) == max(1, -(-n // cap))
        assert sum(load.values()) / (len(load) * cap) > 0.9
        assert pieces[9000] == [(0, 0, 0)] and pieces[None] == [(0, 0, 5)]
    assert {r.kind_id for r in rows} == {1, 2}
    assert report(spark.createDataFrame(rows), kinds, kind="kind_id", capacity="cap").count() == 2
    assert pack(items.limit(0), kinds, key="doc_id", size="n", kind="kind_id", capacity="cap").count() == 0
