import itertools
import random
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import packing


def fewest(capacity, items):
    """Least number of bins by exhaustive search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def walk(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, r in enumerate(dict.fromkeys(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                walk(i + 1, [*rest, r - items[i]])
        walk(i + 1, [*rooms, capacity - items[i]])

    walk(0, [])
    return best[0]


def check(capacity, counts, patterns):
    used = Counter()
    for n, items in patterns:
        assert n > 0 and sum(x * m for x, m in items) <= capacity
        for x, m in items:
            used[x] += n * m
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for n, _ in patterns)


@pytest.mark.parametrize("seed", range(25))
def test_fewest_bins_on_small_sets(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([20, 31, 50])
    items = [rnd.randint(3, capacity) for _ in range(9)]
    counts = dict(Counter(items))
    assert check(capacity, counts, packing.pack(capacity, counts)) == fewest(capacity, items)


@pytest.mark.parametrize("seed", range(300))
def test_the_search_without_budget_is_exact(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([20, 31, 50, 58, 100])
    pool = [rnd.randint(3, capacity) if rnd.random() < 0.5 else rnd.randint(3, capacity // 2) for _ in range(rnd.choice([3, 5, 12]))]
    items = [rnd.choice(pool) for _ in range(rnd.randint(6, 12))]
    counts = dict(Counter(items))
    patterns, ended = packing.solve(capacity, counts, None)
    assert check(capacity, counts, patterns) == fewest(capacity, items) and ended in ("bound", "proof")
    assert packing.least_bins(capacity, counts) <= fewest(capacity, items)


def test_all_counts_of_a_length_are_tried():
    assert check(58, {25: 1, 7: 5, 9: 6}, packing.pack(58, {25: 1, 7: 5, 9: 6})) == 2
    left = {15: 3, 12: 1, 8: 1}
    first = next(packing.Shop(left).fillings(packing.Sums(50, left), 50, 50, packing._Budget(None), None))
    assert first == (0, ((15, 2), (12, 1), (8, 1)))


def test_budget_is_reported():
    rnd = random.Random(7)
    counts = dict(Counter(min(512, int(rnd.lognormvariate(5, 0.5)) % 512 + 1) for _ in range(800)))
    patterns, ended = packing.solve(512, counts, 50)
    assert ended == "budget" and check(512, counts, patterns) == sum(n for n, _ in packing.best_fit(512, counts))


def test_a_case_where_best_fit_fails():
    counts = dict(Counter([44, 24, 24, 22, 21, 17, 8, 8, 6, 6]))
    assert check(60, counts, packing.pack(60, counts)) == fewest(60, list(Counter(counts).elements()))


def test_large_histogram_is_nearly_full():
    rnd = random.Random(7)
    counts = dict(Counter(int(rnd.lognormvariate(5, 0.7)) % 1024 + 1 for _ in range(200_000)))
    bins = check(1024, counts, packing.pack(1024, counts))
    total = sum(k * v for k, v in counts.items())
    assert bins <= -(-total // 1024) + 2


def test_empty():
    assert packing.pack(10, {}) == [] and packing.pack(10, {5: 0}) == []


SCHEMA = "rec_id long, input_ids array<int>, loss_mask array<int>, len int, bucket string"


def table(spark, sizes):
    rows = [(i, list(range(n)), [1] * n, 0, "clash") for i, n in enumerate(sizes)]
    rows += [(900, None, [1], 0, None), (901, [], [], 0, None), (902, [1, 2], [1], 0, None), (903, [1], None, 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_id_has_one_place(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([7, 7, 7, rnd.randint(1, 70)]) for _ in range(300)]
    s = spark.createDataFrame([(1, 32), (2, 64), (None, 9), (3, None)], "setting_id int, capacity int")
    got = packing.packed(table(spark, sizes), s).collect()
    for setting, capacity in ((1, 32), (2, 64)):
        rows = [r for r in got if r.setting_id == setting]
        parts = defaultdict(list)
        for r in rows:
            parts[r.rec_id].append((r.rec_start, r.rec_end))
        assert set(parts) == set(range(300))
        for rec, spans in parts.items():
            spans.sort()
            assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == sizes[rec]
            assert len(spans) == -(-sizes[rec] // capacity)  # only what doesn't fit is cut
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.seq_id].append(r)
        assert set(seqs) == set(range(len(seqs)))
        for q in seqs.values():
            q.sort(key=lambda r: r.place)
            at = 0
            for place, r in enumerate(q):
                assert (r.place, r.seq_start) == (place, at)
                at += r.rec_end - r.rec_start
            assert at <= capacity
    assert {r.setting_id for r in got} == {1, 2}


def test_same_in_every_run_and_empty(spark):
    s = spark.createDataFrame([(1, 16)], "setting_id int, capacity int")
    t = table(spark, [5, 5, 6, 9, 9, 3, 3])
    a, b = (sorted(map(tuple, packing.packed(x, s).collect())) for x in (t, t.repartition(3)))
    assert a == b
    assert packing.packed(t.limit(0), s).count() == 0 and packing.packed(t, s.limit(0)).count() == 0
    r = packing.report(t, s).first()
    assert (r.n_parts, r.n_ids, r.least_sequences) == (7, 40, 3) and r.n_sequences == 3 and r.ended_by == "bound"
    v = packing.validity(packing.packed(t, s), s).first()
    assert tuple(v) == (1, 7, 40, 7, 0, 0)
    assert list(itertools.islice(iter(a), 1))
