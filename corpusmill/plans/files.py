"""Driver queries of sources, sinks and pipelines: what a sink writes to the shared folder, a reader gives back."""

from __future__ import annotations

import json
import os
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import bits, render
from corpusmill.functions import text as tx
from corpusmill.operators import harvest, merges, notebooks, preferences, solvers, summaries, tensors, tokens
from corpusmill.plans import pipelines
from corpusmill.plans import queries as core
from corpusmill.plans.queries import HARD, MAX_IDS, Query, _both, _over
from corpusmill.session import shared_folder, table
from corpusmill.sources import catalog, readers, sinks
from corpusmill.sources import tensors as tensor_files

# sources and sinks ---------------------------------------------------------------------------


def csv_rows(p: DataFrame) -> DataFrame:
    """Puzzles through CSV: every column as text, line breaks and leading zeros kept."""
    out = shared_folder(p.sparkSession, "csv")
    sinks.write_csv(p, out, ["id", "prompt", "answer", "absent"])
    d = readers.csv(p.sparkSession, out, readers.csv_columns(p.sparkSession, out))
    return d.select("id", "answer", F.sha2("prompt", 256).alias("prompt_digest"), F.col("absent").alias("absent"))


def jsonl_traces(t: DataFrame) -> DataFrame:
    """Traces through JSON lines and the reader of traces with stored flags."""
    out = shared_folder(t.sparkSession, "jsonl")
    sinks.write_traces(t, out)
    d = readers.oracle_traces(readers.jsonl(t.sparkSession, out, catalog.JSON_TRACE), "base")
    return d.select("id", "source", "task_type", "answer", "method", "quality_flags", F.sha2("completion", 256).alias("completion_digest"))


def csv_traces(t: DataFrame) -> DataFrame:
    """Traces of a CSV file with other names of its columns."""
    out = shared_folder(t.sparkSession, "traces-csv")
    named = t.where("id <> ''").select("id", F.col("prompt").alias("user_content"), F.col("completion").alias("generated_cot"), "answer", F.col("task_type").alias("category"))
    sinks.write_csv(named, out, named.columns)
    d = catalog.KINDS["generic_csv"](t.sparkSession, out, "base", t)
    return d.select("id", "source", "task_type", "answer", F.length("prompt").alias("n_prompt"), F.length("completion").alias("n_completion"))


def _write_files(d: DataFrame, folder: str) -> None:
    """One file for each row of (name, content); names may hold folders."""
    os.makedirs(folder, exist_ok=True)

    def put(rows) -> None:
        for name, content in rows:
            path = os.path.join(folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.write(content)

    d.select("name", "content").foreachPartition(put)


def text_traces(p: DataFrame) -> DataFrame:
    """A folder of one text for each puzzle; prompt and answer come from train."""
    out = shared_folder(p.sparkSession, "texts")
    one = p.where("id <> '' and prompt <> ''").groupBy("id").agg(F.max("prompt").alias("content")).withColumn("name", F.concat("id", F.lit(".txt")))
    _write_files(one, out)
    d = readers.text_folder(p.sparkSession, out, p, "texts")
    return d.select("id", "source", "method", "answer", "quality_flags", F.sha2("completion", 256).alias("completion_digest"))


def _token_lines(r: DataFrame, out: str) -> None:
    """Records as JSON lines in the order of their keys, in parts by ranges of keys, with names by line beside them."""
    one = r.where("rec_id is not null and input_ids is not null and loss_mask is not null").repartitionByRange("rec_id").sortWithinPartitions("rec_id")
    labels = F.zip_with("input_ids", "loss_mask", lambda x, m: F.when(m > 0, x).otherwise(F.when(x.isNotNull(), -100)))
    one.select("input_ids", F.slice(labels, F.lit(1), F.size("loss_mask")).alias("labels")).write.json(f"{out}/ids", ignoreNullFields=False, compression="lz4")
    one.select("id", F.when(F.col("rec_id") % 3 > 0, F.col("rec_id").cast("string")).alias("answer")).write.json(f"{out}/names", ignoreNullFields=False, compression="lz4")


def token_lines(r: DataFrame) -> DataFrame:
    """Pre-tokenised records by line: unequal arrays dropped, ignored labels as mask 0, names by line."""
    out = shared_folder(r.sparkSession, "tokens")
    _token_lines(r, out)
    counts = {"n_ids": F.size("input_ids"), "n_scored": tokens.total("loss_mask")}
    return catalog.load_tokens(r.sparkSession, f"{out}/ids", f"{out}/names", "lines", counts)


def id_filter(t: DataFrame, p: DataFrame) -> DataFrame:
    """Traces whose id is in a file of ids with comments and trailing columns."""
    out = shared_folder(t.sparkSession, "ids")
    p.where("id is not null").select(F.concat(F.when(F.col("answer").rlike("^[0-9]"), F.lit("")).otherwise("# "), F.col("id"), F.lit(" , x")).alias("value")).write.text(out)
    return t.join(readers.id_list(t.sparkSession, out), "id", "left_semi").select("trace_id", "id")


def loaded_sources(t: DataFrame, p: DataFrame) -> DataFrame:
    """(name, kind, there, n) of a registry of four sources, of which one is missing."""
    s = t.sparkSession
    root = shared_folder(s, "registry")
    sinks.write_traces(t, f"{root}/base.jsonl")
    sinks.write_csv(t.where("id <> ''"), f"{root}/plain.csv", ["id", "prompt", "answer", "completion"])
    one = p.where("id <> ''").groupBy("id").agg(F.max(F.coalesce("prompt", F.lit(""))).alias("content"))
    _write_files(one.withColumn("name", F.concat("id", F.lit(".txt"))), f"{root}/texts")
    specs = [readers.source_spec(f"{n}:{k}:{root}/{path}:{target}") for n, k, path, target in (
        ("base", "oracle_jsonl", "base.jsonl", 5), ("plain", "generic_csv", "plain.csv", 0), ("texts", "txt_dir", "texts", 7), ("gone", "generic_csv", "gone.csv", 1)
    )]
    rows, noted = catalog.load(s, specs, p)
    # records name their own sources; what is counted here is who loaded them
    counts = rows.groupBy(F.when(F.col("source").isin("plain", "texts"), F.col("source")).otherwise("base").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    listed = s.createDataFrame([(x["name"], x["kind"], int(x["target"]), bool(x["exists"])) for x in noted], "name string, kind string, target bigint, there boolean")
    return listed.join(counts, "name", "left").select("name", "kind", "target", "there", F.coalesce("n", F.lit(0)).alias("n"))


def source_kinds(c: DataFrame) -> DataFrame:
    """Kinds of files by their names."""
    names = ("a/nemo_x.jsonl", "b/X.JSONL", "c/formatted_train_dataset_2.csv", "d/any.csv")
    return c.sparkSession.createDataFrame([(n, readers.kind_of(n)) for n in names], "path string, kind string")


def json_reports(d: DataFrame) -> DataFrame:
    """A small report as a JSON document and back."""
    folder = shared_folder(d.sparkSession, "report")
    os.makedirs(folder, exist_ok=True)
    langs = {r.k: r.n for r in summaries.counts(d, F.col("lang"), "k").where("k rlike '^[a-z]{2}$'").collect()}
    sinks.write_json(f"{folder}/report.json", {"rows": d.count(), "by_lang": langs})
    back = readers.json_document(d.sparkSession, f"{folder}/report.json", "rows bigint, by_lang map<string,bigint>")
    return back.select("rows", F.explode("by_lang").alias("lang", "n"))


def markdown_lines(c: DataFrame) -> DataFrame:
    """A table of Markdown, by line."""
    text = sinks.markdown(c.select("source", "kind", "target", "trust_rank").orderBy("trust_rank", "source"))
    return c.sparkSession.createDataFrame([(i, x) for i, x in enumerate(text.strip().split("\n"))], "line int, content string")


def zip_members(c: DataFrame) -> DataFrame:
    """Files of a zip: one for each source of the catalog, by name and size."""
    folder = shared_folder(c.sparkSession, "zip")
    _write_files(c.select(F.concat("source", F.lit(".txt")).alias("name"), F.concat_ws("|", "source", "kind", F.col("target").cast("string")).alias("content")), folder)
    names = sorted(r.source for r in c.select("source").collect())  # the catalog is a short list
    sinks.write_zip(f"{folder}/all.zip", {f"in/{n}.txt": f"{folder}/{n}.txt" for n in names})
    with zipfile.ZipFile(f"{folder}/all.zip") as z:
        rows = [(i.filename, i.file_size) for i in z.infolist()]
    return c.sparkSession.createDataFrame(rows, "name string, bytes bigint")


def tensor_file(e: DataFrame) -> DataFrame:
    """The mean vector of each label through a tensor file, values and header."""
    s = e.sparkSession
    folder = shared_folder(s, "tensors")
    os.makedirs(folder, exist_ok=True)
    means = tensors.tied(e.select(F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("data"), "label"), F.col("label"))
    tensor_files.write(f"{folder}/mean.safetensors", {str(r.group): np.array(r.data) for r in means.collect()})  # one row for each label
    s.dataSource.register(tensor_files.TensorSource)
    d = s.read.format("tensors").load(folder)
    heads = s.read.format("tensors").option("headers", True).load(folder).select("key", "shape", F.col("data").isNull().alias("bare"))
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return d.select("key", F.round(total, 3).alias("total")).join(heads, "key").select("key", F.element_at("shape", 1).alias("width"), "total", "bare")


# notebooks and folders -------------------------------------------------------------------------


def notebook_index(d: DataFrame) -> DataFrame:
    """Index of folders with one Python file for each document and a metadata file for each folder."""
    root = shared_folder(d.sparkSession, "notebooks")
    page = core._page(d.where("text is not null and source is not null and doc_id is not null"))
    folder = F.concat(F.lit("own__note-"), (F.col("doc_id") % 40).cast("string"))
    _write_files(page.select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("name"), F.col("page").alias("content")), root)
    meta = page.select(folder.alias("folder")).distinct()
    _write_files(meta.select(F.concat("folder", F.lit("/kernel-metadata.json")).alias("name"), F.lit('{"title": "A note", "dataset_sources": ["x/y", "x/y", ""]}').alias("content")), root)
    x = notebooks.index(readers.files(d.sparkSession, root), root)
    return x.select("folder", "notebook_id", "title", "file_count", "py_count", "json_count", F.size("dataset_sources").alias("n_datasets"), F.size("http_urls").alias("n_urls"), "parse_error_count",
        F.coalesce(F.try_element_at("keyword_counts", F.lit("reward")), F.lit(0)).alias("n_reward"))


def discovered(c: DataFrame) -> DataFrame:
    """At most four files of each kind of source by size."""
    f = c.select(F.col("kind").alias("dataset"), F.concat(F.lit("/in/"), "source", F.when(F.col("trust_rank") % 3 == 0, ".jsonl").when(F.col("trust_rank") % 3 == 1, ".csv").otherwise(".md")).alias("path"), F.col("target").alias("length"))
    return catalog.discover(f, 2)


def text_folder(d: DataFrame) -> DataFrame:
    """The folder with the most text files."""
    f = d.where("doc_id is not null").select(F.concat(F.lit("/in/"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, "/deep/").otherwise("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return catalog.best_text_folder(f)


def replay(t: DataFrame, p: DataFrame) -> DataFrame:
    """Puzzles at the first place their id has in the traces."""
    order = t.select(F.col("id").alias("problem_id"), F.lit(0).alias("epoch"), F.col("trace_id").alias("pos"))
    rows = p.select(F.col("id").alias("problem_id"), "answer").where("problem_id is not null").distinct()
    return catalog.replay_order(order, rows).select("problem_id", "answer", "pos")


# summaries ------------------------------------------------------------------------------------


def audit_counts(h: DataFrame) -> DataFrame:
    """Counts and mean scores of an audit by task, of all tasks."""
    got = summaries.audit_summary(h, ("min_logprob",))
    means = got["min_logprob"]["by_task_mean"].select("task_type", "mean")
    return got["by_task_type"].join(means, "task_type", "left").select("task_type", "n", F.round("mean", 10).alias("mean"))


def dry_run(r: DataFrame) -> DataFrame:
    """Records without an example, then the examples."""
    ex = tokens.example(r, MAX_IDS).select("rec_id")
    return summaries.dry_run(r.select("rec_id"), ex, "rec_id")


def verifier_counts(t: DataFrame, p: DataFrame) -> DataFrame:
    """Rows of the verifier set by side and task."""
    d = preferences.verifier_rows(*core._sides(t, p))
    return d.groupBy("origin", "task").agg(F.count(F.lit(1)).alias("n"))


def _numeric_sides(t: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the verifier set with numbers or bits as answers, stated without nested braces: what SQL can score too."""
    text = tx.text_of(F.col("completion"))
    stated = tx.stated_answer(tx.strip_ws(text), tx.flat_boxes(text))
    plain = F.col("answer").rlike(r"^[01]+\z") | (F.col("answer").rlike(r"^-?[0-9]+(\.[0-9]+)?\z") & stated.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"))
    up, down = core._sides(t, p)
    return tuple(d.where(plain & ~text.rlike(r"\\boxed\{[^{}]*\{")) for d in (up, down))


def numeric_rewards(t: DataFrame, p: DataFrame) -> DataFrame:
    """Rewards of completions whose answers are numbers or bits."""
    d = preferences.verifier_rows(*_numeric_sides(t, p))
    return d.select("row", "id", "origin", "extracted_answer", "reward", F.array_join("flags", ";").alias("flags"))


def numeric_pairs(t: DataFrame, p: DataFrame) -> DataFrame:
    """Preference pairs of the same rows."""
    return preferences.pairs(*_numeric_sides(t, p), core.PRIORITY)


def worked_traces(p: DataFrame) -> DataFrame:
    """Worked texts of the solved numerals."""
    d = solvers.correct_traces(solvers.solved(core._family(p, "numeral_system"), ["id"]), ["id"])
    return d.select("id", "family", "method", "completion")


def exact_accuracy(p: DataFrame) -> DataFrame:
    """Accuracy on the families that are solved by one formula."""
    d = solvers.solved(core._family(p, "numeral_system", "gravity_physics", "unit_conversion"), ["id"])
    return solvers.accuracy(d)


def completed_numerals(t: DataFrame, p: DataFrame) -> DataFrame:
    """Numerals completed from earlier results, then base ones, then by the solver."""
    rows = t.where("id is not null").withColumn("row", F.col("trace_id"))
    d = pipelines.completed(core._family(p, "numeral_system").where("id is not null"), rows.where("source = 'mossgate'"), rows.where("source in ('oakrill', 'quillmoor')"))
    return d.select("id", "origin", "prediction", "method")


def profile(t: DataFrame, p: DataFrame) -> DataFrame:
    """(what, name, n) of puzzles beside traces: rows, overlaps, classes, shapes and lengths of answers."""
    got = pipelines.profile(p, t)
    rows = [("total", k, int(got[k])) for k in ("train_rows", "test_rows", "id_overlap", "prompt_overlap")]
    rows += [(k, name, int(n)) for k in ("by_class", "by_answer") for name, n in got[k].items()]
    return p.sparkSession.createDataFrame(rows, "what string, name string, n bigint")


# texts -----------------------------------------------------------------------------------------


def training_texts(t: DataFrame) -> DataFrame:
    """Digests of training texts, conversations and closed corpus texts."""
    talk = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit(None).cast("string").alias("role"), F.col("answer").alias("content")))
    return t.select(
        "trace_id", F.sha2(render.training_text(F.col("prompt"), F.col("completion"), F.col("method"), F.col("answer")), 256).alias("training"),
        F.sha2(render.conversation(talk, open_turn=True), 256).alias("talk"), F.length(render.corpus_text(F.col("completion"), F.col("answer"))).alias("n_corpus"),
    )


def _bytes_of() -> object:
    return lambda s: list(s.encode())


def byte_examples(t: DataFrame) -> DataFrame:
    """Examples by a tokenizer of bytes, cut at 4096 ids."""
    d = render.tokenized(t.select("trace_id", "prompt", "completion"), ["trace_id"], _bytes_of, 4096)
    return d.select("trace_id", F.size("input_ids").alias("n_ids"), "prompt_len", "completion_len", "truncated", "prefix_mismatch")


def _scorer() -> object:
    return lambda lists: [[-float((i or 0) % 97) / 8.0 for i in ids or []] for ids in lists]


def audited(r: DataFrame) -> DataFrame:
    """Log-probabilities of a stand-in model, with the worst scored place of each record."""
    d = tokens.with_logprobs(r.where(tokens.usable()).select("rec_id", "loss_mask", "input_ids"), ["rec_id", "loss_mask"], _scorer)
    w = tokens.worst_slice(F.col("logprobs"), F.col("input_ids"), F.col("loss_mask"))
    return d.select("rec_id", w["scored"].alias("scored"), F.round(w["mean"], 6).alias("mean"), w["least"].alias("least"), w["place"].alias("place"))


def weighted_losses(h: DataFrame) -> DataFrame:
    """Weighted mean loss of the audit rows of each source."""
    d = core._scored(h).withColumns({"loss": -F.col("score"), "weight": (F.col("row_index") % 5).cast("double")})
    return d.groupBy(tx.text_of(F.col("source")).alias("source")).agg(F.round(tokens.weighted_mean("loss", "weight"), 6).alias("loss"))


def small_forms(t: DataFrame) -> DataFrame:
    """First filled values, manifest tasks, and texts without case and ends."""
    return t.select(
        "trace_id", tx.first_filled(F.col("answer"), F.col("method"), F.lit("none")).alias("first"), tx.manifest_task(tx.text_of(F.col("task_type"))).alias("task"),
        tx.text_of(F.col("source")).alias("source"), harvest.matches_any("moss, OAK", F.col("source"), F.col("method")).alias("named"), F.array_join(harvest.stable_unique(F.array("source", "method", "source")), "|").alias("unique_texts"),
    )


def dispositions(d: DataFrame) -> DataFrame:
    """What may be done with files of some groups and names."""
    group = F.element_at(F.array(F.lit("reports"), F.lit("public_radar"), F.lit("external"), F.lit("corpora")), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.element_at(F.array(F.lit("Public_Audit"), F.lit("trace-x"), F.lit("plain"), F.lit("a"), F.lit("b")), (F.col("doc_id") % 5 + 1).cast("int")), F.element_at(F.array(F.lit(".csv"), F.lit(".md"), F.lit(".zip")), (F.col("doc_id") % 3 + 1).cast("int")))
    x = d.where("doc_id is not null").select("doc_id", harvest.disposition(group, path).alias("x"))
    return x.select("doc_id", "x.class", "x.reason")


def record_digests(t: DataFrame) -> DataFrame:
    """Digests of whole records."""
    return harvest.record_digest(t, ["trace_id"], ["trace_id", "source", "method"])


def redacted_texts(t: DataFrame) -> DataFrame:
    """Texts with paths and labelled content replaced."""
    text = F.concat(F.lit("at /tmp/x/"), F.col("trace_id").cast("string"), F.lit(" Answer: "), tx.text_of(F.col("method")), F.lit("\nend "), tx.text_of(F.col("source")))
    return t.select("trace_id", harvest.redact_text(text).alias("clean"))


def json_harvest(t: DataFrame) -> DataFrame:
    """Wanted keys at any depth of nested JSON, and JSON with sensitive strings as lengths."""
    doc = F.to_json(F.struct(F.struct(F.struct(F.col("source").alias("keywords")).alias("deep"), F.array(F.struct(F.col("method").alias("keywords"))).alias("list")).alias("meta"), F.col("trace_id").alias("n")))
    d = t.select("trace_id", harvest.json_walk(doc, ["keywords"]).alias("w"))
    return d.select("trace_id", F.size("w").alias("n_found"), F.array_join(F.transform("w", lambda x: x["value"]), "|").alias("found"))


def whole_counts(e: DataFrame) -> DataFrame:
    """Entries of a JSON object that are whole numbers."""
    m = harvest.counts_of(F.from_json("props", "map<string,string>"))
    return e.where("props is not null").select("event_id", F.size(m).alias("n"), F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


# puzzles ---------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORDS = "garden castle river mirror violet candle whisper dragon bridge puzzle forest marble".split()


def _lines(left: Column, right: Column, between: str) -> Column:
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(between), b)), "\n")


def planted_puzzles(s: DataFrame) -> DataFrame:
    """Puzzles with a known rule: bytes that are rotated, words whose letters are moved on, products of numbers."""
    n = F.col("s_suppkey").cast("int")
    d = s.where("s_suppkey is not null").select(n.alias("n")).distinct()
    n = F.col("n")

    def byte(v: Column) -> Column:
        return tx.bits8(v.cast("bigint"))

    def turned(v: Column) -> Column:
        return F.coalesce(*[F.when(n % 7 + 1 == k, bits.shift8(v, "ROT", k)) for k in range(1, 8)])

    steps = F.sequence(F.lit(0), F.lit(9))
    ins = F.transform(steps, lambda j: (n * 13 + j * 29 + j * j * 3) % 256)
    target = (n * 13 + 211) % 256
    rotated = F.concat(_lines(F.transform(ins, byte), F.transform(ins, lambda v: byte(turned(v))), " -> "), F.lit("\nNow, determine the output for: "), byte(target))
    words = F.array(*[F.lit(w) for w in WORDS])
    moved = [LETTERS[k:] + LETTERS[:k] for k in range(1, 26)]
    coded = lambda t: F.coalesce(*[F.when(n % 25 + 1 == k + 1, F.translate(t, LETTERS, to)) for k, to in enumerate(moved)])
    plain = F.concat(F.element_at(words, n % 12 + 1), F.lit(" "), F.element_at(words, n % 5 + 1))
    cipher = F.concat(_lines(F.transform(words, coded), words, " -> "), F.lit("\nNow, decrypt the following text: "), coded(plain))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    a, b = F.transform(steps, lambda j: (n * 7 + j * 17) % 90 + 10), F.transform(steps, lambda j: (n * 3 + j * 23) % 90 + 10)
    products = F.concat(
        _lines(F.zip_with(a, b, lambda x, y: F.concat(two(x), F.lit("#"), two(y))), F.zip_with(a, b, lambda x, y: (x * y).cast("string")), " = "),
        F.lit("\nNow, determine the result for: "), two(n % 90 + 10), F.lit("#"), two((n + 41) % 90 + 10),
    )
    rows = F.array(
        F.struct(F.lit("byte").alias("kind"), rotated.alias("prompt"), byte(turned(target)).alias("answer")),
        F.struct(F.lit("word").alias("kind"), cipher.alias("prompt"), plain.alias("answer")),
        F.struct(F.lit("product").alias("kind"), products.alias("prompt"), ((n % 90 + 10) * ((n + 41) % 90 + 10)).cast("string").alias("answer")),
    )
    return solvers.solved(d.select("n", F.inline(rows)), ["n", "kind"]).select("n", "kind", "family", "prediction", "correct")


def number_forms(o: DataFrame) -> DataFrame:
    """Operations on pairs of two-digit texts in all orders."""
    k = F.col("o_orderkey")
    ops = F.array(*[F.lit(x) for x in solvers.OPERATIONS])
    modes = F.array(*[F.lit(x) for x in solvers.CRYPT_MODES])
    d = o.where("o_orderkey is not null").select(
        "o_orderkey", F.lpad((k * 7 % 100).cast("string"), 2, "0").alias("x"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0").alias("y"),
        F.element_at(modes, (k % 6 + 1).cast("int")).alias("mode"), F.element_at(ops, (F.floor(k / 6) % 25 + 1).cast("int")).alias("op"),
    )
    return solvers.evaluated(d, ["o_orderkey"], "x", "y", "mode", "op")


def bit_forms(o: DataFrame) -> DataFrame:
    """Shifts and gates of bytes."""
    a, b = F.col("o_orderkey") * 11 % 256, F.col("o_custkey") % 256
    return o.select("o_orderkey", *[bits.shift8(a, k, n).alias(f"{k.lower()}{n}") for k, n in (("ROT", 3), ("SHL", 2), ("SHR", 5))], *[bits.gate8(a, b, g).alias(f"gate_{g.lower()}") for g in bits.GATES])


def adapter_archives(e: DataFrame) -> DataFrame:
    """An adapter in a zip: found, unpacked, its configuration checked, its tensors listed."""
    s = e.sparkSession
    root = shared_folder(s, "adapter")
    os.makedirs(f"{root}/deep")
    sinks.write_json(f"{root}/deep/adapter_config.json", {"peft_type": "LORA", "r": 8, "base_model_name_or_path": "some/base"})
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    tensor_files.write(f"{root}/deep/adapter_model.safetensors", {"m.lora_A.weight": np.zeros((8, width)), "m.lora_B.weight": np.zeros((width, 8))})
    sinks.write_zip(f"{root}/run_adapter.zip", {f"x/{n}": f"{root}/deep/{n}" for n in ("adapter_config.json", "adapter_model.safetensors")})
    found = catalog.pick_archive([f"{root}/other_long_name.zip", f"{root}/run_adapter.zip", f"{root}/a.txt"], "adapter")
    folder = catalog.adapter_folder(found, f"{root}/unpacked")
    with open(f"{folder}/adapter_config.json", encoding="utf-8") as f:
        config = catalog.checked_config(json.load(f), 32, "some/base")
    name, _, weight = tensors.adapter_spec(f"run={folder}:0.25")
    s.dataSource.register(tensor_files.TensorSource)
    d = s.read.format("tensors").option("headers", True).load(folder)
    return d.select("key", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), F.lit(int(config["r"])).alias("rank"), F.lit(name).alias("name"), F.lit(weight).alias("weight"))


def manifest_counts(t: DataFrame, p: DataFrame) -> DataFrame:
    """(what, name, n) of the summary of all candidates."""
    got = summaries.manifest_summary(core._candidates(t, p))
    rows = [("rows", "", int(got["rows"]))]
    rows += [(k, name, int(n)) for k in ("by_source", "quality_flags") for name, n in got[k].items()]
    rows += [("enabled", name, int(x["enabled_rows"])) for name, x in got["sources"].items() if name]
    return t.sparkSession.createDataFrame(rows, "what string, name string, n bigint")


# tensors ----------------------------------------------------------------------------------------


def _keys(e: DataFrame) -> DataFrame:
    """Names of factors: two adapters by parity, modules with and without experts."""
    i = F.floor(F.col("vec_id") / 4)
    kind = F.element_at(F.array(F.lit("mlp.experts.3.up_proj"), F.lit("self_attn.q_proj"), F.lit("mixer.in_proj"), F.lit("norm")), (i % 4 + 1).cast("int"))
    side = F.when(F.col("vec_id") % 2 == 0, "lora_A").otherwise("lora_B")
    adapter = F.when(F.floor(F.col("vec_id") / 2) % 2 == 0, "base").otherwise("other")
    module = F.concat(F.lit("model.layers."), i.cast("string"), F.lit("."), kind)
    wide = F.when((adapter == "other") & (i % 5 == 0), 6).otherwise(8)
    shape = F.when(side == "lora_A", F.array(F.lit(4), wide)).otherwise(F.array(F.lit(8), F.lit(4)))
    return e.select("vec_id", adapter.alias("adapter"), F.concat(module, F.lit("."), side, F.lit(".weight")).alias("key"), shape.alias("shape"), "label", F.col("embedding").alias("data"))


def tensor_names(e: DataFrame) -> DataFrame:
    """Categories, modules, partners, renamed and restored names."""
    k = _keys(e)
    return k.select(
        "vec_id", tensors.category(F.col("key")).alias("category"), tensors.module_of(F.col("key")).alias("module"), tensors.partner(F.col("key")).alias("partner"),
        tensors.renamed(F.col("key"), [("model.", "base.model."), (".weight", "")]).alias("renamed"), tensors.restored(F.col("key"), "all_moe").alias("restored"),
        F.size(tensors.key_variants(F.col("key"), [[("model.", "base.")], [("nothing", "x")]])).alias("variants"),
    )


def merge_plan(e: DataFrame) -> DataFrame:
    """What a merge of two adapters does with each module of the anchor."""
    d = merges.plan(_keys(e), "base", "anchor-copy", exclude=r"norm$")
    return d.select("module", "a_key", "b_key", "status", "action", F.size("offenders").alias("n_offenders"))


def module_scales(e: DataFrame) -> DataFrame:
    """Scales of modules by the longest pattern of their names, else by a default."""
    d = _keys(e).where("adapter = 'base'").select(tensors.module_of(F.col("key")).alias("module")).distinct().withColumn("rank", F.lit(4))
    alphas = e.sparkSession.createDataFrame([("proj", 8.0), ("up_proj", 16.0)], "pattern string, value double")
    return merges.scales(d, alphas, 2.0).select("module", F.round("scale", 6).alias("scale"))


def load_map(e: DataFrame) -> DataFrame:
    """Targets of an adapter's names in a model that has some under another name."""
    k = _keys(e).where("adapter = 'base'").select("vec_id", "key")
    model = k.where("vec_id % 8 < 2").select("key").unionByName(k.where("vec_id % 8 >= 4").select(F.replace("key", F.lit("model."), F.lit("base.")).alias("key")))
    return tensors.load_mapping(k.select("key"), model, tensors.key_variants(F.col("key"), [[("model.", "base.")]]))


def tied_experts(e: DataFrame) -> DataFrame:
    """Vectors that share their values: the mean of each label, place by place."""
    d = tensors.tied(e.select(F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("data"), "label"), F.col("label"))
    return d.select("group", F.size("data").alias("width"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.element_at("data", 1), 5).alias("first"))


def low_rank_product(e: DataFrame) -> DataFrame:
    """The product of merged factors of full rank: that of the sum of both adapters, by module."""
    d = e.select(F.floor(F.col("vec_id") / 2).alias("m"), (F.col("vec_id") % 2).cast("string").alias("adapter"), "embedding").where(F.size("embedding") == 64)
    f = d.select(
        F.col("m").cast("string").alias("module"), "adapter", F.lit(0.5).alias("weight"), F.lit(1.0).alias("scale"), F.array(F.lit(4), F.lit(8)).alias("a_shape"), F.slice("embedding", 1, 32).alias("a"),
        F.array(F.lit(8), F.lit(4)).alias("b_shape"), F.slice("embedding", 33, 32).alias("b"),
    )
    out = tensors.merge_low_rank(f, 8, 8.0)
    both = out.groupBy("module").agg(F.max(F.when(F.col("side") == "lora_A", F.col("data"))).alias("a"), F.max(F.when(F.col("side") == "lora_B", F.col("data"))).alias("b"))
    # sum of all entries of B A: column sums of B by row sums of A
    ks = F.sequence(F.lit(0), F.lit(7))
    term = F.transform(ks, lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.get("b", i * 8 + k).cast("double")) * F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, j: s + F.get("a", k * 8 + j).cast("double")))
    return both.select("module", F.round(F.aggregate(term, F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


def queries() -> dict[str, Query]:
    two = ("traces", "train_puzzles")
    return {
        "csv_rows": _over("train_puzzles", csv_rows),
        "jsonl_traces": _over("traces", jsonl_traces),
        "csv_traces": _over("traces", csv_traces),
        "text_traces": _over("train_puzzles", text_traces),
        "token_lines": _over("tokenized_records", token_lines),
        "id_filter": _both(*two, id_filter),
        "loaded_sources": _both(*two, loaded_sources),
        "source_kinds": _over("source_catalog", source_kinds),
        "json_reports": _over("documents", json_reports),
        "markdown_lines": _over("source_catalog", markdown_lines),
        "zip_members": _over("source_catalog", zip_members),
        "tensor_file": _over("embeddings", tensor_file),
        "notebook_index": _over("documents", notebook_index),
        "discovered": _over("source_catalog", discovered),
        "text_folder": _over("documents", text_folder),
        "replay_order": _both(*two, replay),
        "audit_counts": _over(HARD, audit_counts),
        "dry_run": _over("tokenized_records", dry_run),
        "verifier_counts": _both(*two, verifier_counts),
        "numeric_rewards": _both(*two, numeric_rewards),
        "numeric_pairs": _both(*two, numeric_pairs),
        "worked_traces": _over("train_puzzles", worked_traces),
        "exact_accuracy": _over("train_puzzles", exact_accuracy),
        "completed_numerals": _both(*two, completed_numerals),
        "train_profile": _both(*two, profile),
        "training_texts": _over("traces", training_texts),
        "byte_examples": _over("traces", byte_examples),
        "audited_records": _over("tokenized_records", audited),
        "weighted_losses": _over(HARD, weighted_losses),
        "small_forms": _over("traces", small_forms),
        "dispositions": _over("documents", dispositions),
        "record_digests": _over("traces", record_digests),
        "redacted_texts": _over("traces", redacted_texts),
        "json_harvest": _over("traces", json_harvest),
        "whole_counts": _over("events", whole_counts),
        "planted_puzzles": _over("supplier", planted_puzzles),
        "number_forms": _over("orders", number_forms),
        "bit_forms": _over("orders", bit_forms),
        "adapter_archives": _over("embeddings", adapter_archives),
        "manifest_counts": _both(*two, manifest_counts),
        "tensor_names": _over("embeddings", tensor_names),
        "merge_plan": _over("embeddings", merge_plan),
        "module_scales": _over("embeddings", module_scales),
        "load_map": _over("embeddings", load_map),
        "tied_experts": _over("embeddings", tied_experts),
        "low_rank_product": _over("embeddings", low_rank_product),
    }
