"""Driver queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import rewards
from corpusmill.functions import text as tx
from corpusmill.operators import candidates as cd
from corpusmill.operators import harvest, joins, preferences, ranking, solvers, tails, tensors, tokens
from corpusmill.session import table

Query = Callable[[SparkSession, str], DataFrame]
HARD = "hard_tail_v5_64_diagnostic"
#: sources in the order in which a positive is preferred
PRIORITY = {"mossgate": 0, "vespertxt": 1, "oakrill": 2, "quillmoor": 3}
SUFFIXES = [("fit", 1.0), ("ratio_fit", 2.0), ("vote", 3.0), ("y", 4.0)]
SEED = 20260606


def _over(name: str, how: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: how(table(s, d, name))


def _mean(c: str) -> Column:
    """A mean over ``n`` rows by its rounded sum: a rounded mean of short decimals could fall on a tie."""
    return F.round(F.col(c) * F.col("n"), 6) / F.col("n")


def _both(a: str, b: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda s, d: how(table(s, d, a), table(s, d, b))


# texts ------------------------------------------------------------------------------


def classes(t: DataFrame) -> DataFrame:
    return t.select("trace_id", tx.corpus_class(F.col("prompt")).alias("corpus_class"), tx.audit_class(F.col("prompt")).alias("audit_class"))


def class_heads(t: DataFrame) -> DataFrame:
    """The first five prompts of each class by id."""
    d = t.select("id", solvers.family(F.col("prompt")).alias("family"), tx.prefix(F.col("prompt")).alias("prefix")).distinct()
    d = d.withColumn("place", F.row_number().over(W.partitionBy("family").orderBy("id", "prefix")))
    return d.where("place <= 5")


def normal_forms(t: DataFrame) -> DataFrame:
    return t.select(
        "trace_id", tx.normal_prompt(F.col("prompt")).alias("prompt_n"), tx.normal_answer(F.col("answer")).alias("answer_n"), tx.clean_answer(F.col("answer")).alias("answer_c"), tx.reward_task(F.col("task_type")).alias("task_n")
    )


def overlap(t: DataFrame, p: DataFrame) -> DataFrame:
    """Whether the id and the normal prompt of a trace occur in train."""
    ids = p.select(F.col("id").alias("_i")).distinct().withColumn("id_known", F.lit(True))
    texts = p.select(F.sha2(tx.normal_prompt(F.col("prompt")), 256).alias("_p")).distinct().withColumn("prompt_known", F.lit(True))
    d = t.select("trace_id", F.coalesce("id", F.concat(F.lit("\0"), F.col("trace_id").cast("string"))).alias("_i"), F.sha2(tx.normal_prompt(F.col("prompt")), 256).alias("_p"))
    d = d.join(ids, "_i", "left").join(texts, "_p", "left")
    return d.select("trace_id", F.coalesce("id_known", F.lit(False)).alias("id_known"), F.coalesce("prompt_known", F.lit(False)).alias("prompt_known"))


def boxes(t: DataFrame) -> DataFrame:
    c = F.col("completion")
    return t.select("trace_id", F.size(tx.flat_boxes(c)).alias("n_boxes"), tx.final_box(c).alias("final_box"), tx.closing_box(c).alias("closing_box"))


def ensured(t: DataFrame) -> DataFrame:
    text, flags = tx.ensure_box(F.col("completion"), F.col("answer"))
    return t.select("trace_id", text.alias("completion"), F.array_join(flags, ";").alias("flags"))


def stated(t: DataFrame) -> DataFrame:
    return t.select("trace_id", tx.stated_answer(F.col("completion"), tx.flat_boxes(F.col("completion"))).alias("stated"))


def _with_gold(t: DataFrame, p: DataFrame) -> DataFrame:
    """Traces with the answer of the train row of the same id."""
    gold = p.where("id is not null").groupBy("id").agg(F.max("answer").alias("gold"))
    return t.where("id is not null").join(gold, "id")


def same_answers(t: DataFrame, p: DataFrame) -> DataFrame:
    d = _with_gold(t, p)
    return d.where("answer is not null").select("trace_id", tx.same_answer(F.col("gold"), F.col("answer")).alias("same"))


def partial_scores(t: DataFrame, p: DataFrame) -> DataFrame:
    box = tx.final_box(F.col("completion"))
    d = _with_gold(t, p).select("trace_id", tx.clean_answer(F.col("gold")).alias("a"), tx.clean_answer(box).alias("g"))
    return d.select("trace_id", F.round(tx.bit_share(F.col("a"), F.col("g")), 9).alias("bit_share"), F.round(tx.number_share(F.col("a"), F.col("g")), 9).alias("number_share"))


def romans(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", tx.roman(F.col("o_orderkey") % 3999 + 1).alias("roman"), tx.bits8(F.col("o_orderkey")).alias("bits"))


def cosines(t: DataFrame, p: DataFrame) -> DataFrame:
    d = _with_gold(t, p).select("trace_id", F.col("gold").alias("a"), tx.final_box(F.col("completion")).alias("b"))
    return rewards.with_cosine(d, ["trace_id"], "a", "b")


# candidates ------------------------------------------------------------------------------


def _candidates(t: DataFrame, p: DataFrame) -> DataFrame:
    return cd.candidates(t, p, "trace_id", attach_box=True, oracle=F.coalesce(F.col("method") == "replay", F.lit(False)))


def flags(t: DataFrame, p: DataFrame) -> DataFrame:
    return _candidates(t, p).select("row", "id", "task_type", "quality_flags", "enabled", F.length("completion").alias("n_chars"))


def kept(t: DataFrame, p: DataFrame) -> DataFrame:
    d = cd.keep_records(t, sources=list(PRIORITY), ids=p, require=("prompt", "answer"), drop_flags=["no_boxed", "multiple_boxed"])
    return d.select("trace_id", "id", "source")


def relaxed(h: DataFrame, t: DataFrame) -> DataFrame:
    d = joins.strict_relaxed_match(h, t.withColumnRenamed("trace_id", "row"), "row_index", "row")
    return d.select("row_index", "arrived_at", "match_row", "manifest_match")


def key_winners(t: DataFrame) -> DataFrame:
    d = t.where("id is not null").select("id", "trace_id", "answer")
    first = ranking.first_per_key(d, ["id"], F.col("trace_id")).select("id", F.col("trace_id").alias("first_row"))
    last = ranking.first_per_key(d, ["id"], F.col("trace_id"), last=True).select("id", F.col("trace_id").alias("last_row"), F.col("answer").alias("last_answer"))
    return first.join(last, "id")


def resumed(t: DataFrame, p: DataFrame) -> DataFrame:
    train = p.where("id is not null").select("id").distinct()
    return joins.resume(train, t.where("source = 'mossgate'"), t.where("source in ('oakrill', 'quillmoor')"), "id", "trace_id")


# tails --------------------------------------------------------------------------------------


#: what the tail queries need of an audit row; the order of delivery goes beside it
AUDIT = ("row_index", "id", "source", "task_type", "method", "hard_tail_score", "mean_logprob", "quality_flags")


def _scored(h: DataFrame, *extra: str) -> DataFrame:
    """The first delivery of each row, in the columns a query needs only, scored."""
    once = ranking.first_per_key(h.select(*AUDIT, "arrived_at", *extra), ["row_index"], F.col("arrived_at"), least_nulls=True)
    return tails.scored(once, "hard_tail_score")


def holdout(h: DataFrame) -> DataFrame:
    return tails.holdout(_scored(h), 0.08, SEED, "row_index").select("row_index", "task", "held")


def round_robin(h: DataFrame) -> DataFrame:
    return tails.round_robin(_scored(h), 64, 256, SEED, "row_index")


def score_summary(h: DataFrame) -> DataFrame:
    return tails.score_summary(_scored(h)).select("n", "min", *[F.round(c, 9).alias(c) for c in ("p01", "p05", "p50", "mean")])


def decision(h: DataFrame) -> DataFrame:
    d = _scored(h, "worst_context")
    selected = d.where("score < -10")
    worst = selected.where("score < -14")
    return tails.choose_path(tails.path_scores(selected, worst, ("mossgate", "oakrill"))).select("path", F.round("score", 9).alias("score"), "chosen")


def worst_tokens(h: DataFrame) -> DataFrame:
    d = tails.worst_tokens(_scored(h, "worst_context", "min_logprob"), "worst_context", "min_logprob", "row_index")
    return d.withColumn("mean_score", _mean("mean_score"))


# preferences -----------------------------------------------------------------------------------


def _sides(t: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces whose final box is the train answer, and those with another or none."""
    d = _with_gold(t, p).withColumns({"answer": tx.normal_answer(F.col("gold")), "row": F.col("trace_id")})
    right = tx.final_box(F.col("completion")) == F.col("answer")
    return d.where(right), d.where(~right)


def best_positives(t: DataFrame, p: DataFrame) -> DataFrame:
    return preferences.best_positive(_sides(t, p)[0], PRIORITY, "row")


def pairs(t: DataFrame, p: DataFrame) -> DataFrame:
    return preferences.pairs(*_sides(t, p), PRIORITY)


def verifier(t: DataFrame, p: DataFrame) -> DataFrame:
    return preferences.verifier_rows(*_sides(t, p)).select("row", "id", "origin", "extracted_answer", "reward", F.array_join("flags", ";").alias("flags"))


def margin_sets(h: DataFrame) -> DataFrame:
    d = preferences.margins(_scored(h, "min_logprob").select("mean_logprob", "min_logprob", "source", F.col("method")), F.col("mean_logprob"), F.col("min_logprob"), ["source", "method"])
    return d.select("dim", "value", "n", _mean("mean_margin").alias("mean_margin"), F.round("win_rate", 9).alias("win_rate"))


def margin_medians(h: DataFrame) -> DataFrame:
    d = preferences.margin_medians(_scored(h, "min_logprob"), F.col("mean_logprob"), F.col("min_logprob"), "source")
    return d.select("source", F.round("median", 9).alias("median"))


# tokens and tensors --------------------------------------------------------------------------------


#: ids of a record that the reference trains and audits on
MAX_IDS = 8192


def examples(r: DataFrame, limit: int = 256) -> DataFrame:
    return tokens.example(r, limit).select("rec_id", "full_len", "prompt_len", "truncated", F.size("input_ids").alias("n_ids"), tokens.total("loss_mask").alias("n_scored"))


def shifted(r: DataFrame, limit: int = 512) -> DataFrame:
    d = tokens.shifted(r, limit)
    return d.select("rec_id", F.size("tokens").alias("n"), tokens.total("weights").alias("weight"), F.element_at("targets", 1).alias("first_target"), F.element_at("targets", -1).alias("last_target"))


def pad_batches(r: DataFrame) -> DataFrame:
    return tokens.batches(r.where(tokens.usable()), "rec_id", 32, "input_ids")


def token_totals(r: DataFrame) -> DataFrame:
    return r.where(tokens.usable()).groupBy(tx.text_of(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size("input_ids").cast("bigint")).alias("n_ids"), F.sum(tokens.total("loss_mask")).alias("n_scored")
    )


def worst_slices(e: DataFrame) -> DataFrame:
    w = tokens.worst_slice(F.col("embedding"), F.sequence(F.lit(1), F.size("embedding")), skip=16)
    return e.select("vec_id", w["scored"].alias("scored"), F.round(w["mean"], 6).alias("mean"), w["least"].alias("least"), w["place"].alias("place"), F.size(w["context"]).alias("n_context"))


def prefixes(r: DataFrame) -> DataFrame:
    """Common start of every record with the first record of its id."""
    d = r.where("id is not null and size(input_ids) > 0").select("id", "rec_id", "input_ids")
    first = ranking.first_per_key(d, ["id"], F.col("rec_id")).select("id", F.col("rec_id").alias("first_rec"), F.col("input_ids").alias("_f"))
    return d.join(first, "id").select("rec_id", "first_rec", tokens.common_prefix(F.col("input_ids"), F.col("_f")).alias("prefix"))


def _tensors(e: DataFrame, odd: int) -> DataFrame:
    return e.where(F.col("vec_id") % 2 == odd).select((F.col("vec_id") - odd).cast("string").alias("key"), "label", F.col("embedding").alias("data"))


def tensor_audit(e: DataFrame) -> DataFrame:
    d = tensors.compare(_tensors(e, 0), _tensors(e, 1), F.col("label"))
    return d.select("category", "tensors", "missing", "other_shape", *[F.round(c, 6).alias(c) for c in ("mean_cosine", "min_cosine", "mean_delta")])


def tensor_overlay(e: DataFrame) -> DataFrame:
    d = tensors.overlay(_tensors(e, 0), _tensors(e, 1), F.col("key").cast("bigint") % 3 == 0)
    return d.select("key", "origin", F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def low_rank(e: DataFrame) -> DataFrame:
    """Vectors of 64 values as factor pairs of 8 x 4 and 4 x 8, merged for each module of two adapters."""
    d = e.select(F.floor(F.col("vec_id") / 2).cast("string").alias("module"), (F.col("vec_id") % 2).cast("string").alias("adapter"), "embedding")
    d = d.select(
        "module", "adapter", F.lit(0.5).alias("weight"), F.lit(1.0).alias("scale"), F.array(F.lit(4), F.lit(8)).alias("a_shape"), F.slice("embedding", 1, 32).alias("a"),
        F.array(F.lit(8), F.lit(4)).alias("b_shape"), F.slice("embedding", 33, 32).alias("b"),
    )
    return tensors.merge_low_rank(d, 4, 4.0)


def suffixes(h: DataFrame) -> DataFrame:
    p = h.sparkSession.createDataFrame(SUFFIXES, "pattern string, value double")
    return joins.longest_suffix(h.select("row_index", "arrived_at", "method"), p, "method").select("row_index", "arrived_at", "pattern", "value")


# harvest ----------------------------------------------------------------------------------------------


def _page(d: DataFrame) -> DataFrame:
    """Documents with a line of references behind the text."""
    ref = F.concat_ws("", F.col("text"), F.lit("\nMerged adapter of "), F.col("source"), F.lit(": see https://www.Example.org/datasets/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(". Its reward, rewards."))
    return d.select("doc_id", ref.alias("page"))


def references(d: DataFrame) -> DataFrame:
    u = harvest.urls(F.col("page"))
    p = _page(d).select("doc_id", u.alias("u"), harvest.keyword_counts(F.col("page")).alias("k"))
    ref = harvest.page_ref(F.col("u")[0], "example.org", {"dataset": ("datasets", "d")})
    return p.select(
        "doc_id", F.size("u").alias("n_urls"), F.try_element_at("u", F.lit(1)).alias("first_url"), ref.alias("ref"),
        F.coalesce(F.try_element_at("k", F.lit("adapter")), F.lit(0)).alias("n_adapter"), F.coalesce(F.try_element_at("k", F.lit("reward")), F.lit(0)).alias("n_reward"),
    )


def _family(p: DataFrame, *names: str) -> DataFrame:
    """Puzzles of some families: the filter stands before the solver, which none passes."""
    return p.where(solvers.family(F.col("prompt")).isin(*names))


def queries() -> dict[str, Query]:
    two = ("traces", "train_puzzles")
    return {
        "prompt_classes": _over("traces", classes),
        "class_heads": _over("train_puzzles", class_heads),
        "answer_shapes": _over("traces", lambda t: t.select("trace_id", tx.answer_shape(F.col("answer")).alias("shape"))),
        "normal_forms": _over("traces", normal_forms),
        "train_overlap": _both(*two, overlap),
        "flat_boxes": _over("traces", boxes),
        "ensured_boxes": _over("traces", ensured),
        "stated_answers": _over("traces", stated),
        "same_answers": _both(*two, same_answers),
        "partial_scores": _both(*two, partial_scores),
        "roman_numerals": _over("orders", romans),
        "trigram_cosines": _both(*two, cosines),
        "candidate_flags": _both(*two, flags),
        "source_stats": _both(*two, lambda t, p: cd.source_stats(_candidates(t, p))),
        "flag_counts": _both(*two, lambda t, p: cd.flag_counts(_candidates(t, p))),
        "kept_records": _both(*two, kept),
        "relaxed_matches": _both(HARD, "traces", relaxed),
        "key_winners": _over("traces", key_winners),
        "resumed_work": _both(*two, resumed),
        "manifest_sample": _over("traces", lambda t: ranking.seeded_sample(t.select("trace_id", "source"), "source", "trace_id", {"mossgate": 40, "oakrill": 60, "quillmoor": 100}, SEED)),
        "hash_holdout": _over(HARD, holdout),
        "round_robin_tail": _over(HARD, round_robin),
        "score_summary": _over(HARD, score_summary),
        "repair_decision": _over(HARD, decision),
        "worst_tokens": _over(HARD, worst_tokens),
        "best_positives": _both(*two, best_positives),
        "preference_pairs": _both(*two, pairs),
        "verifier_rewards": _both(*two, verifier),
        "margin_sets": _over(HARD, margin_sets),
        "margin_medians": _over(HARD, margin_medians),
        "token_examples": _over("tokenized_records", examples),
        "token_examples_full": _over("tokenized_records", lambda r: examples(r, MAX_IDS)),
        "shifted_tokens": _over("tokenized_records", shifted),
        # records are cut before they are shifted, so there is one target less
        "shifted_tokens_full": _over("tokenized_records", lambda r: shifted(r, MAX_IDS - 1)),
        "pad_batches": _over("tokenized_records", pad_batches),
        "token_totals": _over("tokenized_records", token_totals),
        "worst_slices": _over("embeddings", worst_slices),
        "common_prefixes": _over("tokenized_records", prefixes),
        "tensor_audit": _over("embeddings", tensor_audit),
        "tensor_overlay": _over("embeddings", tensor_overlay),
        "low_rank_merge": _over("embeddings", low_rank),
        "suffix_patterns": _over(HARD, suffixes),
        "page_references": _over("documents", references),
        "keyword_documents": _over("documents", lambda d: harvest.document_frequency(_page(d), "page")),
        "json_entries": _over("events", lambda e: harvest.json_keys(e, ["event_id"], "props")),
        "redacted_documents": _over("documents", lambda d: harvest.redacted(d, "doc_id")),
        "text_digests": _over("documents", lambda d: harvest.inventory(d.where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")))),
        "plain_words": _over("train_puzzles", lambda p: solvers.plain_words(p, "prompt")),
        "solved_puzzles": _over("train_puzzles", lambda p: solvers.solved(p, ["id"])),
        "solved_numerals": _over("train_puzzles", lambda p: solvers.solved(_family(p, "numeral_system"), ["id"]).select("id", "prediction", "correct")),
        "solved_rates": _over("train_puzzles", lambda p: solvers.solved(_family(p, "gravity_physics", "unit_conversion"), ["id"]).select("id", "family", "prediction", "correct")),
        "family_accuracy": _over("train_puzzles", lambda p: solvers.accuracy(solvers.solved(p, ["id"]))),
    }
