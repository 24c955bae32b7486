"""Filling containers of fixed capacity with records (problem 1).

Lengths are whole numbers up to the capacity, so the whole corpus is a histogram of
at most ``capacity`` rows, whatever its size.  Bin completion runs on the histogram:
the largest length left gets its undominated fillings, least waste first; a filling is
used as often as the counts allow, then less often; branches whose waste exceeds what
the incumbent leaves are pruned, and the best-fit solution is the first incumbent.
Without a budget the search is exact; with one, ``ended_by`` says whether the result
meets the lower bound, is proven by an exhausted search, or is the incumbent at the
end of the budget.  Records then take the slots of the patterns by their rank within
their length, which is counted in hash buckets, so that a length that holds a third of
all records is never one group.

Edge cases: records with null or empty ids, or a mask that is null or of another
length, are not usable; a record longer than the capacity is cut into full
containers and a rest; null capacities are left out; equal records are placed by
rec_id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.session import cut

#: steps of the search of one setting; None searches until the result is proven
BUDGET = 400_000
#: of these, steps of the search for a filling of one sum; it then looks for the next smaller sum
FILL_STEPS = 2_000
#: reachable sums are computed anew when less than this share of the items is left
REBUILT = 0.8
#: records of a hash bucket of ranks, on average; slot rows that are broadcast at most (some 30 bytes each)
BUCKET_ROWS, BROADCAST_ROWS = 20_000, 200_000

Filling = tuple[tuple[int, int], ...]  # (length, how many) by falling length
Pattern = tuple[int, Filling]  # how often, and what is in it


class _Bins:
    """Open containers by room, equal ones counted, with the rooms in order."""

    def __init__(self):
        self.rooms: list[int] = []
        self.at: dict[int, dict[Filling, int]] = {}

    def add(self, room: int, content: Filling, n: int) -> None:
        if room not in self.at:
            insort(self.rooms, room)
            self.at[room] = {}
        self.at[room][content] = self.at[room].get(content, 0) + n

    def take(self, room: int, content: Filling, n: int) -> None:
        here = self.at[room]
        here[content] -= n
        if not here[content]:
            del here[content]
            if not here:
                del self.at[room], self.rooms[bisect_left(self.rooms, room)]


def best_fit(capacity: int, counts: dict[int, int]) -> list[Pattern]:
    """Best-fit decreasing on the histogram; containers of equal content are one entry."""
    bins = _Bins()
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(bins.rooms, length)
            if i == len(bins.rooms):
                break
            room = bins.rooms[i]
            content, have = next(iter(bins.at[room].items()))
            fit = min(room // length, n)
            take = min(have, n // fit)
            bins.take(room, content, take)
            bins.add(room - fit * length, (*content, (length, fit)), take)
            n -= take * fit
        full, rest = divmod(n, capacity // length)
        if full:
            bins.add(capacity % length, ((length, capacity // length),), full)
        if rest:
            bins.add(capacity - rest * length, ((length, rest),), 1)
    return [(n, content) for room in bins.rooms for content, n in sorted(bins.at[room].items())]


class _Spent(Exception):
    pass


class _Budget:
    """Steps that are left; None for no end."""

    def __init__(self, steps: int | None):
        self.left, self.gave_up = steps, False

    def take(self, steps: int) -> None:
        if self.left is not None:
            if self.left < steps:
                raise _Spent
            self.left -= steps

    def step(self) -> None:
        self.take(1)


def _smeared(bits: int, by: int) -> int:
    """Sums up to ``by`` above those of ``bits``."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


class Sums:
    """Lengths by falling size, and for suffixes of them the sums that the items at hand when it was made can reach."""

    MARKS = 2_048  # suffixes whose sums are kept; those between take the sums of the next longer one

    def __init__(self, capacity: int, left: dict[int, int]):
        self.lengths = sorted((x for x, n in left.items() if n > 0), reverse=True)
        self.rising = [-x for x in self.lengths]
        self.total = sum(x * left[x] for x in self.lengths)
        self._stride = len(self.lengths) // self.MARKS + 1
        mask, r, marks = (1 << (capacity + 1)) - 1, 1, []
        for i in range(len(self.lengths) - 1, -1, -1):
            x = self.lengths[i]
            n, k = min(left[x], capacity // x), 1
            while n > 0:
                r |= (r << x * min(k, n)) & mask
                n, k = n - k, 2 * k
            if i % self._stride == 0:
                marks.append(r)
        self._reach = [*marks[::-1], 1]

    def of(self, i: int) -> int:
        """Sums of the lengths from ``i`` on, as bits."""
        return self._reach[i // self._stride] if i < len(self.lengths) else 1


class Shop:
    """The items that are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.total = sum(x * n for x, n in counts.items())
        self.available = sum(1 << x for x, n in counts.items() if n)

    def take(self, x: int, n: int) -> None:
        self.left[x] -= n
        self.total -= n * x
        if self.left[x]:
            self.available |= 1 << x
        else:
            self.available &= ~(1 << x)

    def exact(self, sums: Sums, target: int, budget: _Budget, at: int = 0) -> Iterator[Filling]:
        """All fillings that sum to ``target``, those with larger items first; every count of a length is tried."""
        if not target:
            yield ()
            return
        for i in range(max(at, bisect_left(sums.rising, -target)), len(sums.lengths)):
            if not sums.of(i) >> target & 1:
                return  # what is left can't sum to it
            x = sums.lengths[i]
            budget.step()
            for m in range(min(self.left[x], target // x), 0, -1):
                rest = target - m * x
                if sums.of(i + 1) >> rest & 1:
                    for fill in self.exact(sums, rest, budget, i + 1):
                        yield ((x, m), *fill)

    def fillings(self, sums: Sums, room: int, waste: int, budget: _Budget, steps: int | None) -> Iterator[tuple[int, Filling]]:
        """(waste, filling) of the undominated fillings of ``room`` with at most ``waste``, by waste, then larger items first.

        A search for one sum is given up after ``steps``, which the budget takes note of.
        """
        if self.total <= room:  # the rest fits
            if room - self.total <= waste:
                yield room - self.total, tuple((x, self.left[x]) for x in sums.lengths if self.left[x])
            return
        target = room
        while True:
            target = (sums.of(bisect_left(sums.rising, -room)) & ((1 << (target + 1)) - 1)).bit_length() - 1
            if target < 0 or room - target > waste:
                return
            limit = _Budget(steps)
            try:
                for fill in self.exact(sums, target, limit):
                    if not self.dominated(fill, room - target):
                        yield room - target, fill
                    if steps is not None:
                        budget.take(steps - limit.left)
                        limit.left = steps
            except _Spent:
                budget.gave_up = True
            budget.take(1 if steps is None else 1 + steps - max(0, limit.left))
            target -= 1

    def dominated(self, fill: Filling, free: int) -> bool:
        """Whether one more item could replace some of the filling's that together are no larger: then another filling is at least as good."""
        one = several = 0
        spare = self.available
        for x, m in fill:
            for _ in range(m):
                several |= several << x | one << x
                one |= 1 << x
            if self.left[x] == m:
                spare &= ~(1 << x)
        return bool(_smeared(several, free) & spare or (free and _smeared(one << 1, free - 1) & spare))


def least_bins(capacity: int, counts: dict[int, int]) -> int:
    """The larger of the volume bound and Martello and Toth's bound over all thresholds."""
    xs = np.array(sorted(x for x, n in counts.items() if n > 0), np.int64)
    if not len(xs):
        return 0
    n = np.array([counts[int(x)] for x in xs], np.int64)
    cn, cs = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * xs)]
    best = -(-int(cs[-1]) // capacity)
    half = int(np.searchsorted(xs, capacity // 2, side="right"))  # lengths above the half begin here
    for k in {0, *xs[:half].tolist()}:
        small, large = int(np.searchsorted(xs, k)), int(np.searchsorted(xs, capacity - k, side="right"))
        large = max(large, half)
        n1, n2 = int(cn[-1] - cn[large]), int(cn[large] - cn[half])
        rest = int(cs[half] - cs[small]) - (n2 * capacity - int(cs[large] - cs[half]))
        best = max(best, n1 + n2 + max(0, -(-rest // capacity)))
    return best


def solve(capacity: int, counts: dict[int, int], budget: int | None = BUDGET) -> tuple[list[Pattern], str]:
    """Patterns for a histogram of lengths up to ``capacity`` in few containers, and what ended the search: ``bound``, ``proof`` or ``budget``."""
    counts = {x: n for x, n in counts.items() if n > 0}
    total = sum(x * n for x, n in counts.items())
    best = best_fit(capacity, counts)
    best_bins = sum(n for n, _ in best)
    floor = least_bins(capacity, counts)
    if best_bins <= floor:
        return best, "bound"
    shop, spent = Shop(counts), _Budget(budget)
    steps = None if budget is None else FILL_STEPS
    path: list[Pattern] = []
    wasted = 0

    def allowance() -> int:
        """Waste that a solution with one container less than the incumbent has left."""
        return (best_bins - 1) * capacity - total - wasted

    def options(sums: Sums, after: tuple[int, tuple[int, ...]] | None, big: int) -> Iterator[tuple[Pattern, tuple[int, tuple[int, ...]]]]:
        # containers with the same largest item come in one order, so that no set of them is tried twice
        shop.take(big, 1)
        found = shop.fillings(sums, capacity - big, max(-1, allowance()), spent, steps)
        while True:
            step = next(found, None)
            shop.take(big, -1)
            if step is None or step[0] > allowance():
                return
            free, fill = step
            key = (free, tuple(v for x, m in fill for v in (-x, -m)))
            if after is None or key > after:
                parts = dict(fill)
                parts[big] = parts.get(big, 0) + 1
                items = tuple(sorted(parts.items(), reverse=True))
                most = min(shop.left[x] // m for x, m in items)
                if free:
                    most = min(most, allowance() // free)
                for n in range(most, 0, -1):
                    if n * free <= allowance():
                        yield (n, items), key
            shop.take(big, 1)

    def put(n: int, items: Filling) -> None:
        nonlocal wasted
        for x, m in items:
            shop.take(x, n * m)
        wasted += n * (capacity - sum(x * m for x, m in items))

    def biggest() -> int:
        return shop.available.bit_length() - 1

    sums = Sums(capacity, shop.left)
    stack = [(options(sums, None, biggest()), biggest(), sums)]
    try:
        while stack:
            spent.step()
            step = next(stack[-1][0], None)
            if step is None:
                stack.pop()
                if path:
                    n, items = path.pop()
                    put(-n, items)
                continue
            (n, items), key = step
            put(n, items)
            path.append((n, items))
            if shop.total:
                big = biggest()
                sums = stack[-1][2]
                if shop.total < REBUILT * sums.total:
                    sums = Sums(capacity, shop.left)
                stack.append((options(sums, key if big == stack[-1][1] else None, big), big, sums))
                continue
            best, best_bins = list(path), sum(k for k, _ in path)
            if best_bins <= floor:
                return best, "bound"
            stack.append((iter(()), 0, sums))  # undone as any other step
    except _Spent:
        return best, "budget"
    return best, "budget" if spent.gave_up else "proof"


def pack(capacity: int, counts: dict[int, int], budget: int | None = BUDGET) -> list[Pattern]:
    """The patterns of ``solve``."""
    return solve(capacity, counts, budget)[0]


_SLOTS = "setting_id int, len int, lo bigint, hi bigint, seq_lo bigint, place int, seq_start int, ended_by string"


def slots(histogram: DataFrame, n_settings: int, budget: int | None = BUDGET) -> DataFrame:
    """Slots of each setting: ranks [lo, hi) of a length go to place ``place`` of the sequences from ``seq_lo`` on.

    ``histogram`` has setting_id, capacity, len, n: at most ``capacity`` rows for a setting.  Each setting is searched in a task of its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        setting, capacity = int(pdf.setting_id.iloc[0]), int(pdf.capacity.iloc[0])
        rows, used, seq = [], {}, 0
        patterns, ended = solve(capacity, dict(zip(pdf.len.astype(int), pdf.n.astype(int), strict=True)), budget)
        for n, items in patterns:
            place = at = 0
            for x, m in items:
                for _ in range(m):
                    lo = used.get(x, 0)
                    rows.append((setting, x, lo, lo + n, seq, place, at, ended))
                    used[x] = lo + n
                    place, at = place + 1, at + x
            seq += n
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _SLOTS.split(", ")])

    return histogram.repartitionByRange(max(1, n_settings), "setting_id").groupBy("setting_id").applyInPandas(run, _SLOTS)


def _settings(settings: DataFrame) -> list[tuple[int, int]]:
    """(setting_id, capacity) of the settings, a short list."""
    caps = settings.where("setting_id is not null and capacity > 0").groupBy("setting_id").agg(F.min("capacity").alias("capacity"))
    return [(int(r.setting_id), int(r.capacity)) for r in caps.orderBy("setting_id").collect()]


def items(records: DataFrame, listed: list[tuple[int, int]]) -> DataFrame:
    """(setting_id, capacity, rec_id, rec_start, len): every usable record, those above the capacity cut into parts."""
    n = F.size("input_ids")
    usable = records.where(F.col("input_ids").isNotNull() & F.col("loss_mask").isNotNull() & (n > 0) & (n == F.size("loss_mask")))
    lengths = usable.select("rec_id", n.alias("rec_len"))
    # every record goes into every setting: the settings are a short list beside each record
    if not listed:
        return lengths.where("false").selectExpr("0 setting_id", "0 capacity", "rec_id", "0 rec_start", "0 len")
    each = lengths.select(
        "rec_id", "rec_len", F.inline(F.array(*[F.struct(F.lit(s).alias("setting_id"), F.lit(c).alias("capacity")) for s, c in listed]))
    )
    parts = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rec_len") - 1) / F.col("capacity")).cast("int"))))
    start = F.col("part") * F.col("capacity")
    return parts.select("setting_id", "capacity", "rec_id", start.alias("rec_start"), F.least("capacity", F.col("rec_len") - start).alias("len"))


def packed(records: DataFrame, settings: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(setting_id, seq_id, place, seq_start, rec_id, rec_start, rec_end): where each part of each record goes; rec_end is exclusive."""
    listed = _settings(settings)
    parts = cut(items(records, listed))
    n_buckets = max(1, -(-parts.count() // BUCKET_ROWS))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("rec_id", "rec_start"), F.lit(n_buckets)))
    counts = parts.groupBy("setting_id", "capacity", "len", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hist = counts.groupBy("setting_id", "capacity", "len").agg(F.sum("n").alias("n"))
    # one row for a bucket of a length
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("setting_id", "len").orderBy("bucket")) - F.col("n")).drop("capacity", "n")
    ranked = (
        parts.withColumn("own", F.row_number().over(W.partitionBy("setting_id", "len", "bucket").orderBy("rec_id", "rec_start")) - 1)
        .join(before, ["setting_id", "len", "bucket"])
        .withColumn("rank", F.col("before") + F.col("own"))
    )
    # the slots of a length are one row, in which each record looks its rank up: the join doesn't multiply records
    made = cut(slots(hist, len(listed), budget))
    shelf = made.groupBy("setting_id", "len").agg(F.collect_list(F.struct("lo", "seq_lo", "place", "seq_start")).alias("slots"))
    if made.count() <= BROADCAST_ROWS:
        shelf = F.broadcast(shelf)
    slot = F.array_max(F.filter("slots", lambda x: x["lo"] <= F.col("rank")))
    return ranked.join(shelf, ["setting_id", "len"]).withColumn("slot", slot).select(
        "setting_id",
        (F.col("slot.seq_lo") + F.col("rank") - F.col("slot.lo")).alias("seq_id"),
        F.col("slot.place").alias("place"),
        F.col("slot.seq_start").alias("seq_start"),
        "rec_id",
        "rec_start",
        (F.col("rec_start") + F.col("len")).alias("rec_end"),
    )


def validity(placed: DataFrame, settings: DataFrame) -> DataFrame:
    """(setting_id, n_parts, n_ids, n_records, n_overfull, n_overlaps) of packed records: sequences above the capacity, and parts that begin elsewhere than the one before them ends."""
    caps = settings.groupBy("setting_id").agg(F.min("capacity").alias("capacity"))
    size = (F.col("rec_end") - F.col("rec_start")).cast("bigint")
    # a sequence has at most as many parts as its capacity
    ends = F.lag(F.col("seq_start") + size).over(W.partitionBy("setting_id", "seq_id").orderBy("place"))
    d = placed.withColumns({"size": size, "gap": (F.coalesce(ends, F.lit(0)) != F.col("seq_start")).cast("bigint")})
    seqs = d.groupBy("setting_id", "seq_id").agg(F.sum("size").alias("ids"), F.count(F.lit(1)).alias("parts"), F.sum("gap").alias("gaps"), F.sum((F.col("rec_start") == 0).cast("bigint")).alias("recs"))
    return seqs.join(caps, "setting_id").groupBy("setting_id").agg(
        F.sum("parts").alias("n_parts"), F.sum("ids").alias("n_ids"), F.sum("recs").alias("n_records"),
        F.sum((F.col("ids") > F.col("capacity")).cast("bigint")).alias("n_overfull"), F.sum("gaps").alias("n_overlaps"),
    )


def report(records: DataFrame, settings: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(setting_id, capacity, n_sequences, n_parts, n_ids, unused_share, least_sequences, ended_by) of each setting.

    ``ended_by`` is ``bound`` where the lower bound is met, ``proof`` where an exhausted search shows that fewer sequences
    are impossible, and ``budget`` where the search ended with its best result.
    """
    listed = _settings(settings)
    hist = items(records, listed).groupBy("setting_id", "capacity", "len").agg(F.count(F.lit(1)).alias("n"))
    made = slots(hist, len(listed), budget)
    top = made.groupBy("setting_id").agg(F.max(F.col("seq_lo") + F.col("hi") - F.col("lo")).alias("n_sequences"), F.first("ended_by").alias("ended_by"))
    sums = hist.groupBy("setting_id", "capacity").agg(F.sum("n").alias("n_parts"), F.sum(F.col("n") * F.col("len")).alias("n_ids"))
    room = F.col("n_sequences") * F.col("capacity")
    return sums.join(top, "setting_id").select(
        "setting_id",
        "capacity",
        "n_sequences",
        "n_parts",
        "n_ids",
        F.round(1 - F.col("n_ids") / room, 8).alias("unused_share"),
        F.ceil(F.col("n_ids") / F.col("capacity")).alias("least_sequences"),
        "ended_by",
    )
