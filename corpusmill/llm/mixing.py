"""Mixing sources to target weights along a curriculum (problem 7).

A plan's budget is the largest number of tokens for which every source meets its
share within its repeats.  A source's weight over training is a piecewise linear
schedule, a table of (plan_id, source, t, weight); without one, sources of shorter
documents come earlier on a ramp.  Its integral, scaled to the source's share, is the
cumulative demand; a document's place in the source is where this demand is inverted,
which gives the document its training position.

Prefix sums run in two levels, over hash buckets of bounded size and over bucket
sums, so that a source that holds a third of all documents is never one group.

Edge cases: null and blank sources are no source; documents without tokens are
never drawn; a planned source without documents is reported with share 0, doesn't
hold the others back, and makes the plan ``short``; equal hashes are ordered by
doc_id; weights below 0 count as 0, a schedule whose weights are all 0 as constant,
and the first and last weight hold to the ends of [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.encode import RANKS, count_tokens, source_name
from corpusmill.session import cut

#: documents of a bucket, on average; strength of the default curriculum
BUCKET_DOCS, TILT = 20_000, 0.5
#: difference of a share from its target from which a plan is off
OFF_BY = 0.01


def sizes(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that can be drawn."""
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("source is not null and doc_id is not null and text <> ''")
    return count_tokens(named, ["doc_id", "source"], "text", path).where("n_tokens > 0")


def segments(knots: Column) -> Column:
    """Pieces (cum, t, w, k, span) of a schedule with an area, scaled to an integral of 1: the area before, the start, the weight there, the weight's rise and the length."""
    flat = F.forall(knots, lambda x: x["weight"] <= 0)
    at = F.transform(knots, lambda x: F.struct(x["t"].alias("t"), F.when(flat, 1.0).otherwise(x["weight"]).alias("weight")))
    first, last = F.element_at(at, 1), F.element_at(at, -1)
    ends = lambda t, x: F.array(F.struct(F.lit(t).alias("t"), x["weight"].alias("weight")))
    at = F.concat(ends(0.0, first), at, ends(1.0, last))
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(
        a["t"].alias("t"), (b["t"] - a["t"]).alias("span"), a["weight"].alias("w"), b["weight"].alias("v")
    ))
    pairs = F.filter(pairs, lambda p: (p["span"] > 0) & (p["w"] + p["v"] > 0))
    area = lambda p: p["span"] * (p["w"] + p["v"]) / 2.0
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + area(p))
    empty = F.array(F.struct(*[F.lit(0.0).alias(c) for c in ("cum", "t", "w", "k", "span")]))
    return F.aggregate(pairs, F.slice(empty, 1, 0), lambda got, p: F.concat(got, F.array(F.struct(
        F.coalesce(F.try_element_at(F.transform(got, lambda g: g["cum"] + g["span"] * (g["w"] + g["k"] * g["span"] / 2.0)), F.lit(-1)), F.lit(0.0)).alias("cum"),
        p["t"].alias("t"), (p["w"] / total).alias("w"), ((p["v"] - p["w"]) / p["span"] / total).alias("k"), p["span"].alias("span"),
    ))))


def inverse(pieces: Column, x: Column) -> Column:
    """The time at which the integral of a schedule reaches ``x``."""
    p = F.array_max(F.filter(pieces, lambda g: g["cum"] <= x))
    left = x - p["cum"]
    root = F.sqrt(F.greatest(p["w"] * p["w"] + 2 * p["k"] * left, F.lit(0.0)))
    # w d + k d^2 / 2 = left, in the form that is stable for small k
    d = 2 * left / (p["w"] + root)
    return p["t"] + F.least(F.greatest(F.when(left <= 0, 0.0).otherwise(d), F.lit(0.0)), p["span"])


class Mixture:
    """The parts of one mix: documents with their places, plans with their budgets."""

    def __init__(self, documents: DataFrame, targets: DataFrame, path: str = RANKS, tilt: float = TILT, schedule: DataFrame | None = None):
        docs = cut(sizes(documents, path))
        n_buckets = max(1, -(-docs.count() // BUCKET_DOCS))
        h = F.xxhash64("doc_id")
        docs = docs.withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)))
        sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tok"), F.count(F.lit(1)).alias("n"))
        over = W.partitionBy("source").orderBy("bucket")
        starts = sums.withColumn("before", F.sum("tok").over(over) - F.col("tok")).select("source", "bucket", "before")
        own = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
        #: every document with the tokens of its source before it
        self.docs = (
            docs.withColumn("own", F.sum("n_tokens").over(own))
            .join(starts, ["source", "bucket"])
            .select("doc_id", "source", "n_tokens", (F.col("before") + F.col("own") - F.col("n_tokens")).alias("start"))
        )
        have = sums.groupBy("source").agg(F.sum("tok").alias("have"), F.sum("n").alias("n_docs"))
        want = (
            targets.select("plan_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
            .where("plan_id is not null and source is not null and target_share > 0")
            .join(have, "source", "left")
            .withColumn("have", F.coalesce("have", F.lit(0)))
        )
        plan = W.partitionBy("plan_id")  # a plan has as many rows as sources
        want = want.withColumn("budget", F.min(F.when(F.col("have") > 0, F.col("have") * F.coalesce("max_repeats", F.lit(1)) / F.col("target_share"))).over(plan))
        want = want.withColumn("demand", F.when(F.col("have") > 0, F.col("budget") * F.col("target_share")).otherwise(0.0))
        # sources of short documents come earlier: slopes by rank of mean length, centred by share
        rank = F.percent_rank().over(plan.orderBy((F.col("have") / F.col("n_docs")).asc_nulls_first(), "source"))
        want = want.withColumn("r", rank)
        mean = F.sum(F.col("target_share") * F.col("r")).over(plan) / F.sum("target_share").over(plan)
        slope = F.lit(tilt) * (F.col("r") - mean)
        ramp = F.array(*[F.struct(F.lit(t).alias("t"), (1 + sign * slope).alias("weight")) for t, sign in ((0.0, -1), (1.0, 1))])
        if schedule is None:
            want = want.withColumn("knots", ramp)
        else:
            given = schedule.select("plan_id", source_name(F.col("source")).alias("source"), F.col("t").cast("double").alias("t"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
            given = given.where("t between 0 and 1 and weight is not null").groupBy("plan_id", "source", "t").agg(F.max("weight").alias("weight"))
            # the knots of a source's schedule: a short list
            given = given.groupBy("plan_id", "source").agg(F.array_sort(F.collect_list(F.struct("t", "weight"))).alias("given"))
            want = want.join(given, ["plan_id", "source"], "left").withColumn("knots", F.coalesce("given", ramp)).drop("given")
        self.plans = want.withColumn("segments", segments(F.col("knots"))).drop("r", "knots")

    def chosen(self) -> DataFrame:
        """(plan_id, doc_id, source, n_tokens, n_uses, start, ...): full passes, and one more for the first part of the source."""
        d = self.docs.join(self.plans.where("demand > 0"), "source")
        passes = F.floor(F.col("demand") / F.col("have") + F.lit(1e-9))
        rest = F.col("demand") - passes * F.col("have")
        extra = (F.col("start") + F.col("n_tokens") / 2.0 <= rest).cast("int")  # nearest whole document
        d = d.withColumn("n_uses", F.least(passes.cast("int") + extra, F.coalesce("max_repeats", F.lit(1))))
        return d.where("n_uses > 0")

    def position(self, use: Column) -> Column:
        """Time at which the demand of the source reaches the middle of a document's ``use``-th turn (from 0)."""
        x = F.least((use * F.col("have") + F.col("start") + F.col("n_tokens") / 2.0) / F.col("demand"), F.lit(1.0))
        return F.round(inverse(F.col("segments"), x), 9)

    def documents(self) -> DataFrame:
        """(plan_id, doc_id, source, n_tokens, n_uses, first_position)."""
        return self.chosen().select("plan_id", "doc_id", "source", "n_tokens", "n_uses", self.position(F.lit(0)).alias("first_position"))

    def schedule(self) -> DataFrame:
        """(plan_id, position, doc_id, use_no), range-sorted by plan and position."""
        uses = self.chosen().withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("n_uses") - 1)))
        out = uses.select("plan_id", self.position(F.col("use_no")).alias("position"), "doc_id", "use_no")
        return out.repartitionByRange("plan_id", "position", "doc_id").sortWithinPartitions("plan_id", "position", "doc_id", "use_no")

    def shares(self) -> DataFrame:
        """(plan_id, source, target_share, actual_share, tokens, have_tokens, max_repeats, most_uses, plan_state).

        A plan is ``short`` when a source of it has no documents, so that the others' shares grow, or ``off`` when some share is off
        by more than ``OFF_BY``, as with few long documents; else ``met``.
        """
        used = self.chosen().groupBy("plan_id", "source").agg(F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens"), F.max("n_uses").alias("most_uses"))
        p = self.plans.join(used, ["plan_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        over = W.partitionBy("plan_id")
        total = F.sum("tokens").over(over)
        actual = F.when(total > 0, F.col("tokens") / total).otherwise(0.0)
        p = p.withColumn("off", F.abs(actual - F.col("target_share")))
        state = F.when(F.min("have").over(over) == 0, "short").when(F.max("off").over(over) > OFF_BY, "off").otherwise("met")
        return p.select(
            "plan_id",
            "source",
            "target_share",
            F.round(actual, 6).alias("actual_share"),
            "tokens",
            F.col("have").alias("have_tokens"),
            "max_repeats",
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            state.alias("plan_state"),
        )

    def validity(self) -> DataFrame:
        """(plan_id, n_over, n_foreign, n_wrong_uses, n_outside, plan_state): documents used too often or of no source of the plan, uses that the schedule has more or less than once, positions outside [0, 1]."""
        chosen = self.chosen()
        uses = self.schedule().groupBy("plan_id", "doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("use_no").alias("turns"), F.sum((~F.col("position").between(0, 1)).cast("bigint")).alias("out")
        )
        d = chosen.join(uses, ["plan_id", "doc_id"], "full").join(self.plans.select("plan_id", "source", F.lit(1).alias("own")), ["plan_id", "source"], "left")
        checks = d.groupBy("plan_id").agg(
            F.sum((F.col("n_uses") > F.coalesce("max_repeats", F.lit(1))).cast("bigint")).alias("n_over"),
            F.sum(F.col("own").isNull().cast("bigint")).alias("n_foreign"),
            F.sum((~((F.col("n") == F.col("n_uses")) & (F.col("turns") == F.col("n_uses"))).eqNullSafe(True)).cast("bigint")).alias("n_wrong_uses"),
            F.sum("out").alias("n_outside"),
        )
        return checks.join(self.shares().select("plan_id", "plan_state").distinct(), "plan_id")
