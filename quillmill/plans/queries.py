"""Registered queries over the reference operators: each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import cleaners, metrics
from quillmill.functions import text as X
from quillmill.operators import contamination, dedup, index, ingest, ngram, report, splits, suite, tokenizer
from quillmill.plans.durable import cut, shared_folder
from quillmill.plans.pipeline import Pipeline
from quillmill.sources import records as R

Query = Callable[[SparkSession, str], DataFrame]
#: Threshold that flags some of the test documents, whose similarity to benchmark texts stays low.
LOW_THRESHOLD = 0.1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records: (id, pos, text, source, language)."""
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text", "source", F.col("lang").alias("language"))


def suite_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of the scored suite, each once."""
    return table(spark, folder, "scored_tasks").dropDuplicates(["id"])


def normalize_docs(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).select(F.col("pos").alias("doc_id"), X.normalize_text(F.col("text")).alias("t"))
    return d.select("doc_id", X.content_hash(F.col("t")).alias("text_sha1"), X.characters(F.col("t")).alias("chars"), X.utf8_bytes(F.col("t")).alias("bytes"))


def record_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    return d.select(F.col("pos").alias("doc_id"), X.record_id(F.lit("docs"), F.col("pos"), F.col("text")).alias("record_id"))


def ingest_docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.ingest(documents(spark, folder), "docs", 7)
    return rows.select("pos", "id", "source", X.content_hash(F.col("text")).alias("text_sha1"))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, folder)).select(F.col("pos").alias("doc_id"))


def exact_dedup_records(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, folder, "records")).select("id", "pos")


def quality_filter(spark: SparkSession, folder: str) -> DataFrame:
    limits = ingest.QualityLimits(min_chars=200, max_chars=20_000, max_symbol_ratio=0.12, max_whitespace_ratio=0.3, max_repeat_line_ratio=0.2)
    return ingest.quality_filter(documents(spark, folder), limits).select(F.col("pos").alias("doc_id"))


def quality_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.quality_ratios(documents(spark, folder).withColumnRenamed("pos", "doc_id"), "doc_id")


def char_shingle_stats(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("pos").alias("doc_id"), X.char_ngram_count(F.col("text"), 5).alias("shingles"))


def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    unique = cut(dedup.exact_dedup(table(spark, folder, "records").where("text is not null")).select("pos", "text"), "unique")
    return dedup.similar_pairs(unique, 0.8, 5)


def near_dup_kept(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_dedup(documents(spark, folder), 0.8, 5).select(F.col("pos").alias("doc_id"))


def near_dup_kept_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "records")
    return dedup.near_dedup(rows, 0.8, 5).select("id", "pos")


def contamination_flag(spark: SparkSession, folder: str) -> DataFrame:
    flagged = contamination.flag_contaminated(documents(spark, folder), table(spark, folder, "benchmark_items"), "pos", LOW_THRESHOLD)
    return flagged.select(F.col("pos").alias("doc_id"), "contaminated", F.floor(F.col("contamination_score") * 1000 + 0.5).cast("long").alias("score_permille"))


def contamination_flag_joined(spark: SparkSession, folder: str) -> DataFrame:
    flagged = contamination.flag_contaminated(documents(spark, folder), table(spark, folder, "benchmark_items"), "pos", LOW_THRESHOLD, joined=True)
    return flagged.select(F.col("pos").alias("doc_id"), "contaminated", F.floor(F.col("contamination_score") * 1000 + 0.5).cast("long").alias("score_permille"))


def contamination_remove(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.remove_contaminated(documents(spark, folder), table(spark, folder, "benchmark_items"), "pos", LOW_THRESHOLD).select(F.col("pos").alias("doc_id"))


def corpus_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.corpus_report(documents(spark, folder))


def aggregate_shards_additive(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    return report.merge_reports(*[report.corpus_report(d.where(F.pmod("pos", F.lit(3)) == k)) for k in range(3)])


def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return report.duplicate_ids(table(spark, folder, "records"), table(spark, folder, "probes"))


def benchmark_index(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "probes").groupBy("id").agg(F.min("text").alias("text")).withColumn("pos", F.xxhash64("id") * 0)
    tasks = suite_tasks(spark, folder).select("id", "prompt", "answer").withColumn("pos", F.lit(0))
    # Places are the ids themselves: equal texts keep the smallest id.
    built = index.benchmark_index(probes.drop("pos").withColumn("pos", F.col("id")), tasks.drop("pos").withColumn("pos", F.col("id")), "scored")
    return built.select("id", X.content_hash(F.col("text")).alias("text_sha1"), "source")


def train_eval_split(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).withColumn("id", F.lpad("id", 12, "0"))
    return splits.tail_split(d).select(F.col("pos").alias("doc_id"), "is_eval")


def heldout_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).withColumn("id", F.lpad("id", 12, "0"))
    return splits.heldout_disjoint(splits.tail_split(d)).select(F.col("pos").alias("doc_id"))


def paragraph_explode(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.paragraph_rows(documents(spark, folder).withColumnRenamed("id", "key"))
    return rows.select("id", "key", "idx", X.content_hash(F.col("text")).alias("text_sha1"), "bytes")


def line_explode(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.paragraph_rows(documents(spark, folder).withColumnRenamed("id", "key"), fine=True)
    return rows.select("id", "key", "idx", X.content_hash(F.col("text")).alias("text_sha1"), "bytes")


def byte_budget_cap(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).withColumn("language", F.coalesce("language", F.lit("none")))
    rows = splits.paragraph_rows(d.withColumnRenamed("id", "key")).join(d.select(F.col("id").alias("key"), "language", F.col("pos").alias("ord")), "key")
    return splits.byte_budget(rows, 60_000).select("language", "ord", "idx", "bytes")


def tokenizer_compression(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "probes").groupBy("id").agg(F.min("language").alias("language"), F.min("domain").alias("domain"), F.min("text").alias("text"))
    return tokenizer.score(probes)


def tokenizer_compression_bpe(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer.model_from_table(table(spark, folder, "bpe_merges"))
    probes = table(spark, folder, "probes").groupBy("id").agg(F.min("language").alias("language"), F.min("domain").alias("domain"), F.min("text").alias("text"))
    return tokenizer.score(probes, tokenizer.TOKENIZERS | {"bpe": tokenizer.token_count(model)})


def probe_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.probe_summary(table(spark, folder, "probes")).withColumn("level", F.col("level").cast("long"))


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = ngram.ngram_counts(documents(spark, folder), 2)
    return counts.select(F.col("k").cast("long").alias("k"), "context", F.col("byte").cast("long").alias("byte"), "n")


def ngram_bpb(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).withColumn("id", F.lpad("id", 12, "0"))
    split = cut(splits.tail_split(d).select("text", "language", "is_eval"), "split")
    results = ngram.evaluate_orders(split, [0, 1, 2])
    return results.select(F.col("order").cast("long").alias("model_order"), "language", "total", "bytes", F.round(F.col("bits") / F.col("bytes"), 4).alias("bpb"))


def _suite(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        scored = suite.run_suite(suite_tasks(spark, folder).withColumn("language", F.coalesce("language", F.lit("none"))), name)
        return suite.accuracy(scored)

    return run


def metric_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric on every task, the prompt's tail and the answer against each other."""
    tasks = suite_tasks(spark, folder)
    answer, other = F.col("answer"), F.concat(F.lit(" The answer is "), F.upper(F.trim("answer")), F.lit(" !"))
    return tasks.select("id", *[f(other, answer).cast("int").alias(name) for name, f in metrics.METRICS.items()])


def suite_failures(spark: SparkSession, folder: str) -> DataFrame:
    return suite.known_failures(suite.run_suite(suite_tasks(spark, folder), "echo"))


def suite_violations(spark: SparkSession, folder: str) -> DataFrame:
    tasks = table(spark, folder, "scored_tasks")
    parts = None
    for name, ok in R.suite_rules().items():
        row = tasks.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("rows")).select(F.lit(name).alias("rule"), "rows")
        parts = row if parts is None else parts.unionByName(row)
    return parts


def niah_tasks(spark: SparkSession, folder: str) -> DataFrame:
    t = suite.haystack_tasks(spark)
    return t.select("id", "answer", X.content_hash(F.col("prompt")).alias("prompt_sha1"), F.col("length").cast("long").alias("length"), "depth", F.col("needle_pos").cast("long").alias("needle_pos"))


def niah_matrix_window(spark: SparkSession, folder: str) -> DataFrame:
    scores = suite.haystack_scores(suite.haystack_tasks(spark), suite.window_predictor(600))
    wide = suite.haystack_matrix(scores, suite.DEFAULT_DEPTHS)
    return wide.select(F.col("length").cast("long").alias("length"), *[F.col(f"`d{d}`").cast("long").alias(f"d{int(d * 100)}") for d in suite.DEFAULT_DEPTHS])


def niah_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    scores = suite.haystack_scores(suite.haystack_tasks(spark), suite.window_predictor(600))
    return suite.haystack_accuracy(scores).withColumn("length", F.col("length").cast("long"))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Each task as a conversation of three turns."""
    turn = lambda n, role, content: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), content.alias("content"))
    return suite_tasks(spark, folder).select(F.col("id").alias("conv_id"), F.inline(F.array(turn(2, "assistant", F.col("answer")), turn(0, "system", F.col("area")), turn(1, "user", F.col("prompt")))))


def format_chat(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.format_chat(_conversations(spark, folder))


def encode_chat(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer.model_from_table(table(spark, folder, "bpe_merges"))
    return tokenizer.encode_chat(_conversations(spark, folder), model).select("conv_id", F.size("ids").cast("long").alias("tokens"))


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from their own tokens: the text's hash comes back."""
    model = tokenizer.model_from_table(table(spark, folder, "bpe_merges"))
    back = documents(spark, folder).where("text is not null").select(F.col("pos").alias("doc_id"), tokenizer.decode(model)(tokenizer.encode(model)(F.col("text"))).alias("t"))
    return back.select("doc_id", X.content_hash(F.col("t")).alias("text_sha1"))


def bpe_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer.model_from_table(table(spark, folder, "bpe_merges"))
    return documents(spark, folder).select(F.col("pos").alias("doc_id"), tokenizer.token_count(model)(F.col("text")).alias("tokens"))


def bpe_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokenizer.text_pair_counts(documents(spark, folder), tokenizer.BpeModel([]))
    return counts.select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), "n")


def bpe_pair_top(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.top_pair(bpe_pair_counts(spark, folder))


def bpe_train(spark: SparkSession, folder: str) -> DataFrame:
    """Merges of a model trained on the probes."""
    model = tokenizer.train_bpe(table(spark, folder, "probes").select("text"), 512)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(model.merges)], "merge_rank int, left_id int, right_id int")


# Published sizes and Japanese tokens per character of the candidates of a vocabulary comparison.
PUBLISHED = [("bpe-512", 512, 1.3611), ("bpe-1024", 1024, 1.0598), ("bpe-2048", 2048, 0.8653), ("bpe-4096", 4096, 0.7165), ("bpe-8192", 8192, 0.6152)]


def _published(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PUBLISHED, "name string, effective_vocab_size long, candidate_ja double")
    return rows.withColumns({"collapsed": F.lit(False), "beats_byte_baseline": F.col("candidate_ja") < 3.0})


def vocab_gains(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.with_gains(_published(spark)).select("name", F.round("gain", 6).alias("gain"), tokenizer.embedding_cost(F.col("effective_vocab_size"), 2048).alias("embed_params"))


def vocab_knee(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.choose_vocab(_published(spark), 0.18)


def tokenizer_bakeoff(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of three sizes trained on the probes' training part and scored on the rest."""
    probes = table(spark, folder, "probes").where("language is not null and text is not null").groupBy("id").agg(F.min("language").alias("language"), F.min("domain").alias("domain"), F.min("text").alias("text"))
    split = cut(splits.tail_split(probes.withColumn("source", F.col("domain"))), "bakeoff")
    model = tokenizer.train_bpe(split.where(~F.col("is_eval")).select("text"), 1024)
    found = tokenizer.candidates(model, [300, 512, 1024])
    scores = tokenizer.score(split.where("is_eval"), {"byte": X.utf8_bytes} | {c["name"]: tokenizer.token_count(c["model"]) for c in found})
    return scores.where("level in ('overall', 'language')").select("tokenizer", "level", "language", "tokens", "chars", "bytes")


def load_order(spark: SparkSession, folder: str) -> DataFrame:
    return splits.load_order(documents(spark, folder), None, 25, 100).select(F.col("pos").alias("doc_id"), "ord")


def load_order_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    return splits.load_order(documents(spark, folder), 17).select(F.col("pos").alias("doc_id"), "ord")


def load_order_buffered(spark: SparkSession, folder: str) -> DataFrame:
    placed = R.with_positions(documents(spark, folder).drop("pos"), "id")
    return splits.buffered_load_order(placed, 17, 64).select("id", "ord")


def record_json(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as JSON and read back."""
    rows = table(spark, folder, "records").select("pos", X.record_json(F.col("id"), F.col("text"), F.col("source"), F.col("meta")).alias("line"))
    back = rows.select("pos", F.from_json("line", R.RECORD).alias("r")).select("pos", "r.*")
    return back.select("pos", "id", X.content_hash(F.col("text")).alias("text_sha1"), "source", *[F.col("meta")[k].alias(k) for k in ("license", "batch", "domain", "language")])


def meta_update(spark: SparkSession, folder: str) -> DataFrame:
    merged = X.merge_meta(F.col("meta"), batch=F.lit("b0"), checked=F.col("split_name"))
    return table(spark, folder, "records").select("pos", merged["batch"].alias("batch"), merged["checked"].alias("checked"), merged["license"].alias("license"))


def source_manifest_checks(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "dataset_sources").distinct()
    return s.select(
        "source", "title", F.coalesce(F.rlike("snapshot_date", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False)).alias("date_ok"), F.coalesce(F.rlike("language", F.lit("^[a-z]{2,3}(-[A-Z]{2})?$")), F.lit(False)).alias("language_ok"),
        (F.length(F.coalesce("license_name", F.lit(""))) > 0).alias("license_ok"),
    )


def archive_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = [(1, "http://a.test/cards/x.html", '<a href="./files/12_ruby_3.zip">z</a><a href="files/9.zip">y</a>'), (2, "http://b.test/c/y.html", '<a href="files/abc.zip">y</a>')]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    return rows.select("page_id", cleaners.archive_url(F.col("url"), F.col("html")).alias("archive"))


def pipeline_report(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over all documents, with their own sources kept for the report."""
    d = documents(spark, folder)
    run = Pipeline(source="docs", near_threshold=None, limits=ingest.QualityLimits(min_chars=3), contamination_threshold=LOW_THRESHOLD)
    clean = run.records(d, table(spark, folder, "benchmark_items"))
    return report.corpus_report(clean.drop("source").join(d.select("pos", "source"), "pos"))


def pipeline_near(spark: SparkSession, folder: str) -> DataFrame:
    """The same with near duplicates removed."""
    run = Pipeline(source="docs", limits=ingest.QualityLimits(min_chars=3), contamination_threshold=LOW_THRESHOLD)
    return run.records(documents(spark, folder), table(spark, folder, "benchmark_items")).select("id", F.col("pos").alias("doc_id"))


def stream_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Records through the streaming steps, processed to the end."""
    import uuid

    from quillmill.streaming import ingest as S

    base = f"{shared_folder(spark)}/quillmill/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "records").schema
    stream = S.clean_stream(S.read_stream(spark, f"{folder}/records.parq*et", schema), ingest.QualityLimits(min_chars=200))
    S.run_available(stream.select("id", "pos", X.content_hash(F.col("text")).alias("text_sha1")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("text_sha1").agg(F.count("*").alias("rows"))


def queries() -> dict[str, Query]:
    """All queries by name."""
    named = [
        pipeline_report, pipeline_near, normalize_docs, record_ids, ingest_docs, exact_dedup, exact_dedup_records, quality_filter, quality_ratios, char_shingle_stats, near_dup_pairs,
        near_dup_kept, near_dup_kept_records, contamination_flag, contamination_flag_joined, contamination_remove, corpus_report, aggregate_shards_additive, duplicate_ids, benchmark_index,
        train_eval_split, heldout_disjoint, paragraph_explode, line_explode, byte_budget_cap, tokenizer_compression, tokenizer_compression_bpe, probe_summary, ngram_counts, ngram_bpb,
        metric_matrix, suite_failures, suite_violations, niah_tasks, niah_matrix_window, niah_accuracy, format_chat, encode_chat, bpe_round_trip, bpe_token_counts, bpe_pair_counts,
        bpe_pair_top, bpe_train, vocab_gains, vocab_knee, tokenizer_bakeoff, load_order, load_order_shuffled, load_order_buffered, record_json, meta_update, source_manifest_checks,
        archive_links, stream_clean,
    ]
    return {f.__name__: f for f in named} | {f"scored_suite_{p}": _suite(p) for p in ("gold", "empty", "echo", "mock")}
