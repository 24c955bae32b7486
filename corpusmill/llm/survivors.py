"""Best representative of each duplicate group (problem 3).

Records are unpivoted to one row for each field; each row votes for its normalised value;
the votes of a value are summed up, the winner of each field is chosen by ``max_by``, and
the winners are pivoted back.  There are two kinds of votes:

* ``decay``   - source trust times recency decay, summed as numbers;
* ``trusted`` - votes whose weights are so steep that one vote of a more trusted, or then
  later, record outweighs any number of others.  Such a sum is decided by its largest
  term, so the sum of a value's votes is their maximum.  This is the order that the
  stated rule asks for: no sum of numbers can give it, since enough less trusted records
  would outweigh a trusted one.

A vote's order is one number, so votes are summed in hash tables before the shuffle; a hot
group is combined in every task and never gathered.

Edge cases: blank values never win; records without an identifier don't count; a null or
unknown source is trusted last and a null time is the oldest; records that belong to no
group are left out; times before 1900 or after 2184 count as those years' ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLANKS = r"[\s\x{ad}\x{180e}\x{200b}-\x{200f}\x{2060}\x{feff}]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_BLANKS}+|{_BLANKS}+$", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space, no-break and zero-width characters."""
    return c.isNull() | ~c.rlike(rf"(?U)[^\s\x{{ad}}\x{{180e}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]")


def puzzle_key(c: Column) -> Column:
    """An id without case, surrounding white space and a ``.txt`` ending."""
    return F.regexp_replace(F.lower(_trim(c)), r"\s*\.txt$", "")


def prompt_key(c: Column) -> Column:
    """Digest of a prompt in which white space runs count as one space; null for a blank prompt."""
    return F.when(~is_blank(c), F.sha2(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 256))


def group_key(ident: Column, prompt: Column) -> Column:
    """``i:`` and the id, or ``p:`` and the prompt's digest where the id is blank or a file position."""
    key = puzzle_key(ident)
    usable = ident.isNotNull() & (key != "") & ~key.startswith("row_")
    return F.when(usable, F.concat(F.lit("i:"), key)).otherwise(F.concat(F.lit("p:"), prompt_key(prompt)))


def with_group(df: DataFrame, prompts: DataFrame, on: str = "k") -> DataFrame:
    """Adds ``puzzle_id`` to rows with a ``group_key`` in ``on``; ``prompts`` has id and prompt."""
    ids = prompts.where(F.col("id").isNotNull()).groupBy(F.concat(F.lit("i:"), puzzle_key(F.col("id"))).alias(on)).agg(F.min("id").alias("puzzle_id"))
    texts = (
        prompts.where(F.col("id").isNotNull() & ~is_blank(F.col("prompt")))
        .groupBy(F.concat(F.lit("p:"), prompt_key(F.col("prompt"))).alias(on))
        .agg(F.min("id").alias("puzzle_id"))
    )
    return df.join(ids.unionByName(texts), on, "inner")


def trusted(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``trust_rank`` from the catalog, sources compared without case and surrounding white space."""
    level = [F.max("level").alias("level")] if "level" in catalog.columns else []
    ranks = catalog.groupBy(F.lower(_trim(F.col("source"))).alias("_src")).agg(F.min("trust_rank").alias("trust_rank"), *level)
    return df.withColumn("_src", F.lower(_trim(F.col("source")))).join(ranks, "_src", "left").drop("_src")


def _needed(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Identified records with the columns used here only, so that no other column can clash."""
    return df.select("trace_id", "id", "prompt", "source", "updated_at", *fields).where(F.col("trace_id").isNotNull())


def boxed(c: Column) -> Column:
    """Whether a text has a closed box with something in it and no braces inside."""
    return c.rlike(rf"(?U)\\boxed\{{[^{{}}]*[^{{}}\s\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}][^{{}}]*\}}")


def unpivot(df: DataFrame, fields: dict[str, Column], keep: list[Column]) -> DataFrame:
    """One row for each record and field: ``field_name``, ``value`` and the kept columns."""
    rows = F.array(*[F.struct(F.lit(name).alias("field_name"), value.alias("value")) for name, value in fields.items()])
    return df.select(*keep, F.inline(rows))


FIELDS = ("answer", "completion", "method")
#: bits of a time in microseconds since 1900, and of an identifier
TIME_BITS, ID_BITS, LEVELS = 53, 64, 254
_SINCE_1900 = 2_208_988_800_000_000


def _decimal(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _levels(catalog: DataFrame) -> DataFrame:
    """The catalog with its ranks made dense: ``trust_rank`` and ``level`` from 1, the least trusted, on."""
    ranks = catalog.where("trust_rank is not null").select("trust_rank").distinct()
    return ranks.withColumn("level", F.dense_rank().over(W.orderBy(F.desc("trust_rank"))))


def vote_order(first: Column, level: Column, time: Column, ident: Column) -> Column:
    """One number that orders votes by a flag of 0 or 1, trust level, later time and smaller identifier."""
    micros = F.unix_micros(time.cast("timestamp")) + F.lit(_SINCE_1900)
    when = F.when(time.isNull(), F.lit(0)).otherwise(F.greatest(F.least(micros, F.lit((1 << TIME_BITS) - 1)), F.lit(1)))
    high = (first * F.lit(LEVELS + 2) + F.coalesce(level, F.lit(0))).cast("decimal(38,0)")
    ident_part = _decimal((1 << (ID_BITS - 1)) - 1) - ident.cast("decimal(38,0)")
    return ((high * _decimal(1 << TIME_BITS) + when.cast("decimal(38,0)")).cast("decimal(38,0)") * _decimal(1 << ID_BITS)).cast("decimal(38,0)") + ident_part


def voted_by(order: Column) -> Column:
    """The identifier in a vote's order."""
    return (_decimal((1 << (ID_BITS - 1)) - 1) - order % _decimal(1 << ID_BITS)).cast("bigint")


def winners(
    df: DataFrame, prompts: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = FIELDS, votes: str = "trusted", half_life_days: float = 90.0
) -> DataFrame:
    """(puzzle_id, field_name, trace_id, share, n): for each group and field the record whose value wins, its value's share of the votes, and the group's size.

    With ``decay`` a source of rank r weighs 1/r (unknown: 1/100) and a record loses half its weight in ``half_life_days``; decay is
    relative, so the day it is counted from is of no account; equal sums go to the value with the later, then the smaller record.
    With ``trusted`` the share is null.  Values are normalised by white space.
    """
    levels = _levels(catalog)
    if votes == "trusted" and levels.agg(F.max("level")).first()[0] not in (None, *range(LEVELS + 1)):
        raise ValueError(f"more than {LEVELS} levels of trust")
    src = trusted(_needed(df, fields), catalog.join(levels, "trust_rank", "left"))
    norm = {}
    for f in fields:
        # the value's digest, and whether it is one of the first kind
        first = boxed(F.col(f)) if f == "completion" and votes == "trusted" else F.lit(False)
        digest = F.xxhash64(F.trim(F.regexp_replace(F.col(f), r"(?U)\s+", " ")))
        norm[f] = F.when(~is_blank(F.col(f)), F.struct(digest.alias("digest"), F.coalesce(first, F.lit(False)).cast("int").alias("first")))
    age = F.datediff(F.col("updated_at").cast("date"), F.lit("2025-01-01").cast("date"))
    weight = F.coalesce(1.0 / F.col("trust_rank"), F.lit(0.01)) * F.coalesce(F.pow(F.lit(2.0), age / F.lit(half_life_days)), F.lit(1e-6))
    keep = [group_key(F.col("id"), F.col("prompt")).alias("k"), F.col("trace_id"), F.col("updated_at"), F.col("level"), weight.alias("w")]
    long = unpivot(src, norm, keep).where(F.col("k").isNotNull())
    order = vote_order(F.col("value.first"), F.col("level") if votes == "trusted" else F.lit(0), F.col("updated_at"), F.col("trace_id"))
    votes_of = long.select("k", "field_name", F.col("value.digest").alias("digest"), F.when(F.col("value").isNotNull(), order).alias("vote"), "w")
    # summed by spelling of the group first: the join then meets each spelling once, whatever its size
    spelled = votes_of.groupBy("k", "field_name", "digest").agg(F.max("vote").alias("vote"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    summed = with_group(spelled, prompts).groupBy("puzzle_id", "field_name", "digest").agg(F.max("vote").alias("vote"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    # sums are compared at nine digits, so that the order of addition decides nothing; blank values have no vote
    ballot = F.struct(F.round("w", 9).alias("w"), "vote") if votes == "decay" else F.col("vote")
    won = summed.groupBy("puzzle_id", "field_name").agg(
        F.max_by("vote", F.when(F.col("vote").isNotNull(), ballot)).alias("vote"), F.max(F.when(F.col("vote").isNotNull(), F.col("w"))).alias("top"),
        F.sum(F.when(F.col("vote").isNotNull(), F.col("w"))).alias("all"), F.sum("n").alias("n"),
    )
    share = F.round(F.col("top") / F.col("all"), 6) if votes == "decay" else F.lit(None).cast("double")
    return won.where(F.col("vote").isNotNull()).select("puzzle_id", "field_name", voted_by(F.col("vote")).alias("trace_id"), share.alias("share"), "n")


def pivoted(won: DataFrame, cols: dict[str, str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each puzzle with the columns of its fields; ``cols`` gives each column's suffix."""
    wide = [F.max(F.when(F.col("field_name") == f, F.col(c))).alias(f"{f}{suffix}") for f in fields for c, suffix in cols.items()]
    return won.groupBy("puzzle_id").agg(*wide)


def lexicographic(df: DataFrame, prompts: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = FIELDS, least: int = 2) -> DataFrame:
    """(puzzle_id, field_name, trace_id): for each group of ``least`` or more records the record each field is taken from, by ``trusted`` votes."""
    record = pivoted(winners(df, prompts, catalog, fields).where(F.col("n") >= least), {"trace_id": ""}, fields)
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("trace_id")) for f in fields])
    return record.select("puzzle_id", F.inline(rows)).where(F.col("trace_id").isNotNull())


def votes(df: DataFrame, prompts: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = FIELDS, half_life_days: float = 90.0) -> DataFrame:
    """(puzzle_id, then value, trace and vote share of each field): the record built of the values with the largest sums of trust times recency decay."""
    chosen = winners(df, prompts, catalog, fields, "decay", half_life_days)
    values = unpivot(_needed(df, fields), {f: F.col(f) for f in fields}, [F.col("trace_id")]).where(F.col("value").isNotNull())
    # a trace_id that comes again gives its largest value
    values = values.groupBy("trace_id", "field_name").agg(F.max("value").alias("value"))
    return pivoted(chosen.join(values, ["trace_id", "field_name"], "left"), {"value": "", "trace_id": "_trace_id", "share": "_share"}, fields)
