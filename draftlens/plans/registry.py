"""All queries by name. Each takes (spark, sf_dir) and returns a DataFrame; oracle.py has the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import ids
from draftlens.functions import process
from draftlens.functions import prompts
from draftlens.functions import text as T
from draftlens.functions import times
from draftlens.operators import calibration, clipboard, detect, diffs, events, metrics, ordering, replay, revisions, sessions, spans, traces
from draftlens.plans import oracle
from draftlens.session import spread, union_all
from draftlens.sources.readers import table
from draftlens.streaming import events as stream

#: Labels of the events table, in the order that breaks ties.
EVENT_LABELS = ("view", "click", "signup", "purchase", "error")
START, END = "2024-01-01", "2024-02-01"
#: ASCII tokens, the same in every engine.
ASCII_TOKENS = "[a-z0-9_]+"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def _log(spark: SparkSession, d: str) -> DataFrame:
    return events.edit_log(table(spark, d, "events"))


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    return revisions.from_conversations(table(spark, d, "conversations"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """For work by character, which takes far longer than reading."""
    return spread(table(spark, d, "documents").select("doc_id", "text"))


# activity


@query
def label_counts(spark, d):
    return events.label_counts(_log(spark, d))


@query
def label_counts_by_project(spark, d):
    return events.label_counts(_log(spark, d), "project")


@query
def label_counts_dense(spark, d):
    return events.dense_label_counts(_log(spark, d), vocab.ranked(spark, (*EVENT_LABELS, "refund")))


@query
def label_log_freq(spark, d):
    return events.label_shares(_log(spark, d))


@query
def label_shares_by_project(spark, d):
    return events.label_shares(_log(spark, d), "project")


@query
def daily_activity_dense(spark, d):
    return events.activity(_log(spark, d), "day", START, END)


@query
def weekly_activity(spark, d):
    return events.activity(_log(spark, d), "week", START, END)


@query
def monthly_activity(spark, d):
    return events.activity(_log(spark, d), "month", "2024-01-01", "2025-01-01")


@query
def daily_activity_by_project(spark, d):
    return events.activity(_log(spark, d), "day", START, END, by="project")


@query
def daily_activity_closed(spark, d):
    return events.activity(_log(spark, d), "day", START, "2024-01-15", by="label", closed=True)


@query
def top_users_breakdown(spark, d):
    return events.top_breakdown(_log(spark, d), "author", "project")


@query
def top_projects_breakdown(spark, d):
    return events.top_breakdown(_log(spark, d), "project", "author", 3)


@query
def breakdown_entries(spark, d):
    m = events.breakdown_map(_log(spark, d), "project", "label")
    return m.select("project", F.explode("counts").alias("key", "n"), "total")


@query
def activity_rollup(spark, d):
    return events.rollup_counts(_log(spark, d))


@query
def stacked_series(spark, d):
    return events.stacked_series(_log(spark, d), EVENT_LABELS)


@query
def first_last_edit(spark, d):
    return events.last_edit(_log(spark, d))


@query
def replay_page(spark, d):
    return events.page(_log(spark, d), 300).select("project", "place", "tie", "label")


@query
def distinct_authors(spark, d):
    return _log(spark, d).groupBy("project").agg(F.count_distinct("author").alias("authors"), F.count_distinct("label").alias("coverage"))


# gaps, transitions, runs, windows


@query
def gap_stats(spark, d):
    return events.gap_stats(_log(spark, d), "project", "author")


@query
def gap_histogram(spark, d):
    return events.gap_histogram(_log(spark, d), "project", "author")


@query
def gap_drop_pct(spark, d):
    return events.drop_percent(events.gap_histogram(_log(spark, d), "project", "author"))


@query
def transitions(spark, d):
    return events.transitions(_log(spark, d))


@query
def transitions_early(spark, d):
    return events.transitions(_log(spark, d), part=(0, 1))


@query
def transitions_late(spark, d):
    return events.transitions(_log(spark, d), part=(2, 3))


@query
def transitions_by_project(spark, d):
    return events.transitions(_log(spark, d), "project")


@query
def transition_matrix(spark, d):
    return events.transition_matrix(events.transitions(_log(spark, d)), EVENT_LABELS)


@query
def top_next_label(spark, d):
    return events.top_next(events.transitions(_log(spark, d)), vocab.ranked(spark, EVENT_LABELS))


@query
def label_runs(spark, d):
    return events.runs(_log(spark, d))


@query
def flow_links(spark, d):
    return events.visible_links(events.run_edges(_log(spark, d), ("error",)), ("signup",))


@query
def run_composition(spark, d):
    return events.binary_composition(_log(spark, d), F.col("label") == "view")


@query
def windowed_label_dist(spark, d):
    return events.windowed_labels(_log(spark, d))


@query
def label_uniform_w1(spark, d):
    return events.uniform_distance(events.windowed_labels(_log(spark, d)))


@query
def label_temporal_mean(spark, d):
    return events.temporal_mean(events.windowed_labels(_log(spark, d)))


@query
def phase_shares(spark, d):
    return events.label_counts(events.phased(_log(spark, d)), "project", "phase")


@query
def merged_runs(spark, d):
    return events.merge_runs(_log(spark, d), "tie")


@query
def prompt_rows(spark, d):
    rows = events.with_previous_label(_log(spark, d))
    return rows.select("tie", F.md5(T.prompt_columns(F.col("label"), F.col("previous")).cast("binary")).alias("prompt"))


# sessions


@query
def sessions_gap(spark, d):
    return sessions.sessions(sessions.mark_sessions(_log(spark, d))).select("project", "session", "start_ts", "end_ts", "n", F.round("minutes", 4).alias("minutes"))


@query
def sessions_strict(spark, d):
    s = sessions.sessions(sessions.mark_sessions(_log(spark, d)), strict=True)
    return s.select("project", "session", "index", "n", F.array_join("label_list", ",").alias("labels"), F.round("minutes", 6).alias("minutes"))


@query
def intention_sessions(spark, d):
    s = sessions.sessions(sessions.mark_sessions(_log(spark, d).filter("project <> 3"), label_breaks=True), least_minutes=0.01, strict=True)
    return s.select("project", "session", "index", "label", "n", F.round("minutes", 6).alias("minutes"))


@query
def session_duration_stats(spark, d):
    return sessions.duration_stats(sessions.sessions(sessions.mark_sessions(_log(spark, d))), "project")


@query
def session_duration_classes(spark, d):
    return sessions.duration_classes(sessions.sessions(sessions.mark_sessions(_log(spark, d))))


@query
def session_starts(spark, d):
    return sessions.cumulative_starts(sessions.sessions(sessions.mark_sessions(_log(spark, d)))).select("project", "session", F.round("begins", 4).alias("begins"))


@query
def time_per_label(spark, d):
    return sessions.with_shares(sessions.time_per_label(_log(spark, d), 5.0, "project"), "project")


@query
def time_per_label_early_late(spark, d):
    log = events.phased(_log(spark, d)).filter("phase <> 2")
    return sessions.time_per_label(log, 5.0, "phase", within=("project", "phase"))


@query
def duration_vs_labels_ols(spark, d):
    s = sessions.sessions(sessions.mark_sessions(_log(spark, d))).withColumn("kinds", F.size(F.array_distinct("label_list")).cast("double"))
    return sessions.linear_fit(s, F.col("minutes"), F.col("kinds"), "project")


@query
def window_sessions(spark, d):
    """The gap part of a session by the session window, as streams compute it."""
    return stream.gap_sessions(_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))).select("project", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_s"), "n")


@query
def sliding_counts(spark, d):
    w = stream.windowed_counts(_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "2 days", "10 minutes", "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start_s"), "n")


# revisions


@query
def word_delta_by_conv(spark, d):
    return revisions.added_and_deleted(revisions.word_deltas(_revisions(spark, d)))


@query
def revision_deltas(spark, d):
    return revisions.word_deltas(_revisions(spark, d))


@query
def revision_anomalies(spark, d):
    return revisions.anomalies(_revisions(spark, d)).select("doc_id", "revision_index", "anomaly")


@query
def word_jaccard_consecutive(spark, d):
    return revisions.consecutive_jaccard(_revisions(spark, d))


@query
def edit_classes(spark, d):
    return revisions.edit_classes(_revisions(spark, d), F.lit(0), F.lit(200), pattern=ASCII_TOKENS)


@query
def trajectory_states(spark, d):
    t = revisions.trajectories(revisions.edit_classes(_revisions(spark, d), F.lit(0), F.lit(200), pattern=ASCII_TOKENS))
    return t.select("doc_id", "state", "flag")


@query
def trajectory_history(spark, d):
    t = revisions.trajectories(revisions.edit_classes(_revisions(spark, d), F.lit(0), F.lit(200), pattern=ASCII_TOKENS))
    return t.select("doc_id", F.inline("history"))


@query
def carry_forward_asof(spark, d):
    """What the user said last, at each turn."""
    said = revisions.from_conversations(table(spark, d, "conversations").filter("role = 'user'"))
    return revisions.as_of(_revisions(spark, d), said.select("doc_id", F.col("revision_index").alias("born"), F.md5(F.col("text").cast("binary")).alias("value")))


@query
def active_spans(spark, d):
    """Spans that each user turn begins, counted and measured from there on."""
    said = revisions.from_conversations(table(spark, d, "conversations").filter("role = 'user'"))
    return revisions.active_totals(_revisions(spark, d), said.select("doc_id", F.col("revision_index").alias("born"), F.char_length("text").alias("size")))


# text


@query
def doc_ids(spark, d):
    return _docs(spark, d).select("doc_id", ids.doc_id(F.col("doc_id")).alias("hashed_id"), ids.revision_id(F.col("source"), F.col("doc_id")).alias("rev_id"), ids.md5_mod(F.col("doc_id").cast("string"), 10000).alias("bucket"))


@query
def provenance_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.provenance_hash(F.col("text"), T.nfc(F.col("text"))).alias("provenance"))


@query
def lexical_diversity(spark, d):
    return _docs(spark, d).select("doc_id", T.lexical_diversity(T.tokens(F.col("text"), ASCII_TOKENS)).alias("diversity"))


@query
def composed_hashes(spark, d):
    """Provenance of texts that come decomposed: composition makes them one with those that come composed."""
    text = F.concat(F.col("text"), F.lit(" e\u0301 A\u030a"))
    return _texts(spark, d).select("doc_id", T.provenance_hash(F.col("text"), T.nfc(text)).alias("hash"))


@query
def long_revisions(spark, d):
    """Revisions of 50 words or more."""
    return _revisions(spark, d).select("doc_id", "revision_index", T.word_count(F.col("text")).alias("n_words")).filter("n_words >= 50")


@query
def labelled_documents(spark, d):
    """Documents whose ids an index holds."""
    return _docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query
def document_means(spark, d):
    """Means over documents of each document's mean words a revision and of its revisions."""
    per = _revisions(spark, d).groupBy("doc_id").agg(F.avg(T.word_count(F.col("text"))).alias("w"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_docs"), F.round(F.avg("w"), 6).alias("mean_words"), F.round(F.avg("n"), 6).alias("mean_revisions"))


@query
def dashboard_projects(spark, d):
    return events.dashboard(_log(spark, d), START, END, "project", keep=~F.col("label").isin("error"))


def _overview(spark: SparkSession, d: str, form: str, grain: str) -> DataFrame:
    p = times.period(F.lit(form))
    return events.dashboard(_log(spark, d), p["start"], p["end"], "project", grain)


@query
def overview_week(spark, d):
    return _overview(spark, d, "2024-W03", "day")


@query
def overview_month(spark, d):
    return _overview(spark, d, "2024-01", "day")


@query
def overview_year(spark, d):
    return _overview(spark, d, "2024-01-01", "month")


@query
def period_forms(spark, d):
    """Week, month and year from a day of each order's date as forms name them, with the orders that name each."""
    t = F.col("o_orderdate").cast("date")
    week = F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad((F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7)).cast("string"), 2, "0"))
    forms = F.explode(F.array(week, F.date_format(t, "yyyy-MM"), F.date_format(t, "yyyy-MM-dd"))).alias("form")
    n = table(spark, d, "orders").select(t.alias("day"), forms).groupBy("form").agg(F.count("*").alias("n"))
    x = times.period(F.col("form"))
    return n.select("form", x["start"].alias("start"), x["end"].alias("end"), x["grain"].alias("grain"), "n")


@query
def consented_find(spark, d):
    """A page of purchases and errors of the authors whose customer row consents (an account that is not in debt), newest first."""
    consents = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("author"))
    rows = events.find(_log(spark, d), [F.desc("ts"), F.desc("tie")], F.col("label").isin("purchase", "error"), skip=50, limit=100, users=consents)
    return rows.select("project", "author", "ts", "tie", "label")


@query
def passage_prompts(spark, d):
    """Prompts for the middle fifth of each document, by level."""
    n = F.char_length(T.empty_if_null(F.col("text")))
    start, end = F.floor(n * 2 / 5).cast("int"), F.floor(n * 3 / 5).cast("int")
    made = {"naive": prompts.naive(), "topical": prompts.topical(F.col("source"), F.col("lang")), "contextual": prompts.contextual(F.col("source"), F.col("text"), start, end)}
    each = F.inline(F.array(*(F.struct(F.lit(level).alias("level"), c.alias("prompt")) for level, c in made.items())))
    return _docs(spark, d).select("doc_id", each).select("doc_id", "level", F.char_length("prompt").alias("n_chars"), ids.digest(F.col("prompt")).alias("prompt_hash"))


@query
def dashboard_authors(spark, d):
    return events.dashboard(_log(spark, d), START, END, "author", "week")


@query
def present_labels(spark, d):
    return events.label_counts(events.present(_log(spark, d).withColumn("label", F.when(F.col("tie") % 7 != 0, F.col("label"))), "label", "view", "click"))


@query
def local_places(spark, d):
    return events.local_index(_log(spark, d), "project", "author").select("project", "author", "tie", "index")


@query
def gantt_bars(spark, d):
    return events.gantt(_log(spark, d))


@query
def sentence_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query
def sentence_offsets(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(T.sentence_offsets(F.col("text"))).alias("k", "o")).select("doc_id", "k", "o.start", "o.end")


@query
def discourse_density(spark, d):
    return detect.density(_texts(spark, d)).select("doc_id", "n_markers", "n_words")


@query
def syntactic_demand(spark, d):
    return detect.density(_texts(spark, d)).select("doc_id", "demand")


@query
def conceptual_ruptures(spark, d):
    split = _texts(spark, d).select("doc_id", "text", T.words(F.col("text")).alias("w"))
    return split.select("doc_id", F.posexplode(T.conceptual_ruptures(F.col("text"), F.col("w"))).alias("k", "at"))


@query
def pii_counts_by_rule(spark, d):
    return detect.pii_counts(_texts(spark, d)).groupBy("rule_id", "severity").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query
def pii_docs(spark, d):
    return detect.pii_counts(_texts(spark, d)).groupBy("doc_id").agg(F.sum(F.when(F.col("severity") == "high", F.col("n")).otherwise(0)).alias("n_high"), F.sum("n").alias("n"))


@query
def pii_findings(spark, d):
    return detect.pii_findings(_texts(spark, d))


@query
def leakage_flags(spark, d):
    return detect.flags(_texts(spark, d))


@query
def template_hits(spark, d):
    return detect.contained_templates(_texts(spark, d), table(spark, d, "benchmark"))


@query
def parsed_labels(spark, d):
    replies = table(spark, d, "events").select("event_id", F.concat(F.lit("The label is '"), F.element_at(F.array(*map(F.lit, (*vocab.WRITING_INTENTIONS, "Other"))), (F.col("event_id") % 16 + 1).cast("int")), F.lit("'.")).alias("reply"))
    return replies.groupBy(T.parse_label(F.col("reply")).alias("label")).agg(F.count("*").alias("n"))


@query
def iso_timestamps(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", times.iso_from_millis(ms - ms % 1000).alias("iso"), F.round(times.delta_seconds(F.col("ts"), w), 3).alias("delta_s"))


# evaluation


def _pairs(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(_docs(spark, d), "doc_id").select("doc_id", "quality", "toxic", "n_chars", "source", "lang")


@query
def classification_report(spark, d):
    return metrics.per_class(metrics.confusion(_pairs(spark, d), "quality", "toxic"))


@query
def classification_summary(spark, d):
    return metrics.summary(metrics.confusion(_pairs(spark, d), "quality", "toxic"))


@query
def confusion_matrix(spark, d):
    return metrics.confusion(_pairs(spark, d), "quality", "toxic", dense=True)


@query
def binary_f1(spark, d):
    return metrics.binary_f1(_pairs(spark, d), F.col("quality") == 1, F.col("n_chars") > 1500, "lang")


@query
def auc_length_quality(spark, d):
    return metrics.auc(_pairs(spark, d), F.col("quality") == 1, F.col("n_chars"), "lang")


@query
def kappa(spark, d):
    return metrics.kappa(_pairs(spark, d), "quality", "toxic")


@query
def class_weights(spark, d):
    return metrics.class_weights(_log(spark, d), "label", vocab.ranked(spark, (*EVENT_LABELS, "refund")))


@query
def harm_rates(spark, d):
    r = _revisions(spark, d)
    s = _spans(r)
    return metrics.harm(s.withColumn("ord", F.col("start")), r.select("doc_id", "revision_index", F.lower("text").contains("the").alias("hit")))


@query
def harm_by_source(spark, d):
    rows = table(spark, d, "labels").join(_docs(spark, d), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg(F.when(F.col("toxic") == 1, (F.col("n_chars") > 1000).cast("double"))), 6).alias("sensitivity"), F.round(F.avg(F.when(F.col("toxic") == 0, (F.col("n_chars") > 1000).cast("double"))), 6).alias("fpr"), F.count("*").alias("n"))


@query
def coupling_evaluation(spark, d):
    base = table(spark, d, "labels")
    gold = base.select(F.col("doc_id").alias("k"), (F.col("quality") * 0.9).alias("resource_coupling"))
    pred = base.select(F.col("doc_id").alias("k"), (F.col("toxic") * 0.8).alias("predicted_coupling"))
    return metrics.evaluation(gold, pred, ["k"])


@query
def gold_sample(spark, d):
    return metrics.sample(_docs(spark, d), 50, 17, "doc_id").select("doc_id", "source")


@query
def stratified_rotation(spark, d):
    place = F.col("doc_id")
    return metrics.rotation(_docs(spark, d), place, vocab.LEVELS, vocab.STATES).groupBy("level", "state").agg(F.count("*").alias("n"))


@query
def weighted_choice(spark, d):
    return metrics.weighted_choice(_docs(spark, d), {"naive": 0.35, "topical": 0.40, "contextual": 0.25}, 11, "doc_id").groupBy("choice").agg(F.count("*").alias("n"))


@query
def diverse_selection(spark, d):
    return metrics.diverse(_docs(spark, d), "source", "n_chars", "doc_id", 2, 60).select("doc_id", "source", "n_chars")


@query
def model_selection(spark, d):
    """Documents as models: sources as vendors, lengths as scores, costs from their numbers."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("key"), F.col("source").alias("vendor"), F.char_length("source").alias("priority"), F.col("n_chars").alias("score"), (F.col("doc_id") % 17).cast("double").alias("cost"))
    return metrics.select_models(rows, 14, 3, cost_limit=9.0).select("key", "vendor", "phase")


@query
def fallback_ranking(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("key"), F.col("source").alias("vendor"), F.col("n_chars").alias("score"))
    return metrics.fallbacks(rows, rows.filter("key = 1"), 20)


@query
def split_disjointness(spark, d):
    ids_ = _docs(spark, d).select(F.col("doc_id").alias("id"))
    parts = [ids_.filter(f"id % {m} = 0").withColumn("split", F.lit(n)) for n, m in (("train", 2), ("val", 3), ("test", 5))]
    return metrics.disjointness(union_all(parts))


@query
def annotator_agreement(spark, d):
    base = table(spark, d, "labels")
    ann = union_all([base.select("doc_id", F.lit("a").alias("annotator"), F.col("quality").alias("label")), base.select("doc_id", F.lit("b").alias("annotator"), F.col("toxic").alias("label"))])
    return metrics.agreement(ann, 2, ["doc_id"]).select("doc_id", F.col("labels")[0].alias("first"), F.col("labels")[1].alias("second"))


# spans


def _spans(r: DataFrame) -> DataFrame:
    """Spans derived from revisions: two in each even revision, one in each odd one; states follow the revision's number."""
    n = F.char_length("text")
    one = r.select("doc_id", "revision_index", F.inline(F.array(
        F.struct(F.concat(F.lit("inj_"), F.col("doc_id").cast("string")).alias("injection_id"), F.when(F.col("revision_index") % 4 == 3, "anomaly.truncation").otherwise("injection.topical").alias("label"), F.floor(n / 4).cast("int").alias("start"), F.floor(n / 2).cast("int").alias("end")),
        F.struct(F.concat(F.lit("two_"), F.col("doc_id").cast("string")).alias("injection_id"), F.lit("injection.naive").alias("label"), F.floor(n / 3).cast("int").alias("start"), (F.floor(n * 3 / 4) + F.when(F.col("revision_index") == 2, 5000).otherwise(0)).cast("int").alias("end")),
    )))
    inj = F.col("label").startswith("injection.")
    state = F.element_at(F.array(*map(F.lit, vocab.STATES)), F.pmod(F.col("doc_id") + F.col("revision_index"), F.lit(3)).cast("int") + 1)
    kept = one.filter("revision_index % 2 = 0 or injection_id like 'inj%'")
    return kept.withColumns({"level": F.when(inj, F.substring_index("label", ".", -1)), "state": F.when(inj, state), "flag": F.element_at(F.array(*map(F.lit, vocab.FLAGS)), F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1)})


def _traced(r: DataFrame) -> DataFrame:
    """Spans with traces made from their numbers: statuses and complexities repeat in ways that give every case."""
    size = (F.pmod(F.col("doc_id"), F.lit(9)) + 1).cast("int")

    def event(i):
        bad = F.pmod(i * 3 + F.col("doc_id"), F.lit(4)) == 0
        fixed = F.pmod(i + F.col("doc_id"), F.lit(3)) == 0
        return F.struct(
            F.when(bad, F.when(fixed, "repair").otherwise("failure")).otherwise("success").alias("status"),
            F.when(fixed, "x").alias("repair_artifact"),
            (F.lit(1.0) - i * 0.01 + F.when(F.pmod(F.col("doc_id"), F.lit(5)) == 0, i * 0.02).otherwise(0.0)).alias("glucose_at_event"),
            (F.pmod(i * i + F.col("doc_id"), F.lit(7)).cast("double") / 2).alias("syntactic_complexity"),
        )

    return _spans(r).withColumn("trace", F.transform(F.sequence(F.lit(1), size), event))


@query
def span_iou_by_conv(spark, d):
    s = _spans(_revisions(spark, d)).select("doc_id", "injection_id", "start", "end")
    return spans.iou(s.filter("injection_id like 'inj%'"), s.filter("injection_id like 'two%'"), "doc_id")


@query
def span_iou_pooled(spark, d):
    s = _spans(_revisions(spark, d)).select("injection_id", "start", "end")
    return spans.iou(s.filter("injection_id like 'inj%'"), s.filter("injection_id like 'two%'"))


@query
def span_overlaps(spark, d):
    return spans.overlaps(_spans(_revisions(spark, d)))


@query
def span_boundary_errors(spark, d):
    r = _revisions(spark, d)
    sentence = (F.col("doc_id") % 5 - 1).cast("int")
    return spans.boundary_violations(_spans(r).withColumns({"start_sentence": sentence, "end_sentence": (F.col("revision_index") % 3).cast("int")}), r)


@query
def revision_checks(spark, d):
    r = _revisions(spark, d)
    return spans.revision_violations(_traced(r), r)


@query
def trace_sufficiency(spark, d):
    return spans.trace_sufficiency_violations(_traced(_revisions(spark, d)))


@query
def coupling_support(spark, d):
    return spans.coupling_flag_violations(_traced(_revisions(spark, d)))


@query
def span_iou_every_conv(spark, d):
    """Documents without such spans agree."""
    r = _revisions(spark, d)
    s = _spans(r).select("doc_id", "injection_id", "start", "end")
    return spans.iou(s.filter("injection_id like 'inj%'"), s.filter("injection_id like 'two%'"), "doc_id", every=r)


@query
def span_content_errors(spark, d):
    r = _revisions(spark, d)
    return spans.content_violations(_spans(r), r)


@query
def span_content_totals(spark, d):
    """Each span must hold the eight characters that its first revision's holds where it begins."""
    r = _revisions(spark, d)
    s = _spans(r)
    first = s.filter("revision_index = 0").join(r, ["doc_id", "revision_index"]).groupBy("injection_id").agg(F.min(F.substring(F.col("text"), F.col("start") + 1, F.lit(8))).alias("expected"))
    return spans.content_totals(s, r, first)


@query
def leakage_totals(spark, d):
    """Of spans that cover the whole of a text, every other one with leaked words around it."""
    odd = F.col("revision_index") % 2 == 0
    r = _revisions(spark, d).withColumn("text", F.when(odd, F.concat(F.lit("Here is it. "), F.col("text"), F.lit(" as an AI "))).otherwise(F.col("text")))
    whole = r.select("doc_id", "revision_index", F.char_length("text").alias("n"))
    return spans.leakage_totals(_spans(r).join(whole, ["doc_id", "revision_index"]).withColumns({"start": F.lit(0), "end": F.col("n")}), r)


@query
def span_constraints(spark, d):
    s = _spans(_revisions(spark, d))
    return spans.constraint_violations(s.withColumn("level", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.coalesce("level", F.when(F.col("doc_id") % 5 == 0, "naive")))))


@query
def flag_consistency(spark, d):
    return spans.flag_violations(_spans(_revisions(spark, d)))


@query
def metadata_errors(spark, d):
    s = _spans(_revisions(spark, d))
    return spans.metadata_violations(s.withColumns({"provenance_hash": F.when(F.col("doc_id") % 2 == 0, "h"), "generator_class": F.lit("g"), "prompt_hash": F.when(F.col("doc_id") % 3 == 0, "").otherwise("p")}))


@query
def boundary_erosion(spark, d):
    return spans.erosion(_spans(_revisions(spark, d)))


@query
def state_monotonicity(spark, d):
    return spans.monotonicity_violations(_spans(_revisions(spark, d)))


@query
def earned_labels(spark, d):
    return spans.earned_label_violations(_traced(_revisions(spark, d)))


@query
def earned_flags(spark, d):
    s = _traced(_revisions(spark, d))
    return spans.earned_flag_violations(s, spans.erosion(s))


@query
def span_leakage(spark, d):
    r = _revisions(spark, d).withColumn("text", F.concat(F.lit("Here is it. "), F.col("text"), F.lit(" as an AI ")))
    whole = r.select("doc_id", "revision_index", F.char_length("text").alias("n"))
    return spans.leakage_violations(_spans(r).join(whole, ["doc_id", "revision_index"]).withColumns({"start": F.lit(0), "end": F.col("n")}), r)


@query
def validation_report(spark, d):
    r = _revisions(spark, d)
    return spans.error_counts(spans.validate(_traced(r), r))


@query
def text_insertion(spark, d):
    r = _revisions(spark, d)
    rec = lambda i, body: F.struct(F.lit(f"i{i}").alias("injection_id"), F.floor(F.char_length("text") / (i + 1)).cast("int").alias("start"), F.lit(body).alias("body"))
    made = r.withColumn("x", spans.insert_all(F.col("text"), F.array(rec(1, " FIRST "), rec(2, " SECOND é "), rec(3, " THIRD "))))
    return made.select("doc_id", "revision_index", F.md5(F.col("x.text").cast("binary")).alias("text_md5"), F.inline("x.spans"))


# traces


@query
def causal_signatures(spark, d):
    return traces.with_signatures(_traced(_revisions(spark, d))).select("doc_id", "revision_index", "injection_id", "locality", "coupling", "plausible")


@query
def signature_anomalies(spark, d):
    return traces.anomaly_spans(_traced(_revisions(spark, d))).select("doc_id", "revision_index", "injection_id", "label", "flag")


@query
def spans_with_anomalies(spark, d):
    return traces.with_anomalies(_traced(_revisions(spark, d))).select("doc_id", "revision_index", "injection_id", "label", "level", "state", "flag", "start", "end")


@query
def signature_states(spark, d):
    s = traces.with_signatures(_traced(_revisions(spark, d)))
    state = traces.state_from_signatures(F.col("plausible"), F.col("coupling"), F.col("locality"))
    return s.select("doc_id", "revision_index", "injection_id", state.alias("state"), traces.flag_from_state(state).alias("flag"))


@query
def trace_summary(spark, d):
    return traces.revision_summary(_traced(_revisions(spark, d)))


@query
def document_trajectory(spark, d):
    r = _revisions(spark, d)
    return traces.document_trajectory(_traced(r), r)


@query
def resource_simulation(spark, d):
    """The resource recurrence over all words of a document, of demands made from their lengths."""
    made = F.transform(T.words(F.col("text")), lambda w: F.struct((F.char_length(w) % 9).cast("double").alias("depth"), (F.char_length(w) % 10 / 10.0).alias("rarity"), F.lit(0.004).alias("cost")))
    e = traces.simulate_rows(_texts(spark, d).select(F.col("doc_id").alias("key"), made.alias("intentions")), columns=("failure", "glucose_after", "latency_ms"))
    return e.groupBy(F.col("key").alias("doc_id")).agg(F.count("failure").alias("n_failures"), F.round(F.min("glucose_after"), 6).alias("least_glucose"), F.round(F.avg("latency_ms"), 3).alias("mean_latency"))


@query
def process_classes(spark, d):
    """Classes and settings of the process model on levels made from documents' numbers."""
    u = lambda k: (F.pmod(F.col("doc_id") * k, F.lit(100)) / 100.0)
    rows = _docs(spark, d).select("doc_id", u(7).alias("g"), u(13).alias("f"), u(29).alias("a"), u(37).alias("s"), F.pmod(F.col("doc_id"), F.lit(90)).cast("int").alias("m"), (F.col("doc_id") % 3 + 1).cast("int").alias("w"))
    c = F.col
    settings = process.generation_settings(c("g"), c("f"), c("a"), c("s"), c("w"))
    share = traces.allocation(c("g"), c("f"), c("m") / 10.0)
    return rows.select("doc_id", process.cognitive_load(c("g"), c("f")).alias("load"), process.latency_class(c("m") * 7).alias("latency"), process.burst_class(c("m") / 20.0).alias("burst"), process.complexity_ceiling(c("g")).alias("ceiling"), process.intrusion_severity(c("m"), c("w")).alias("severity"), settings["temperature"].alias("temperature"), settings["max_tokens"].alias("max_tokens"), share["syntactic"].alias("syntactic"))


@query
def stand_in_signatures(spark, d):
    n = F.pmod(F.col("doc_id"), F.lit(4))
    x = process.stand_in_signatures(F.col("doc_id") % 50, F.lit(50), (n == 1).cast("int"), (n == 2).cast("int"), (n == 3).cast("int"), F.col("doc_id"))
    return _docs(spark, d).select("doc_id", x.alias("x")).select("doc_id", "x.*")


def _timed(spark, d) -> DataFrame:
    """Revisions with times: a project's edits, with the texts of the events' properties and values."""
    log = ordering.sequenced(events.edit_log(table(spark, d, "events"), with_text=True), "project")
    return log.select(F.col("project").alias("doc_id"), F.col("place").alias("revision_index"), "ts", "text")


@query
def calibration_report(spark, d):
    return calibration.report(calibration.steps(_timed(spark, d)))


@query
def calibration_fit(spark, d):
    return calibration.depletion(calibration.minute_rates(calibration.steps(_timed(spark, d))))


@query
def calibration_divisor(spark, d):
    return calibration.fatigue_divisor(calibration.minute_rates(calibration.steps(_timed(spark, d))))


@query
def engine_signatures(spark, d):
    events_ = F.transform(T.words(F.col("text")), lambda w: F.struct(F.when(F.char_length(w) > 9, "x").alias("failure"), (F.char_length(w) % 7).cast("double").alias("depth")))
    return traces.engine_signatures(_texts(spark, d).select(F.col("doc_id").alias("key"), events_.alias("events"))).withColumnRenamed("key", "doc_id")


@query
def paragraph_lines(spark, d):
    lines = F.size(F.split("text", "\n"))
    return _docs(spark, d).select("doc_id", lines.alias("n_lines"), F.array_max(T.paragraph_numbers(F.col("text"))).alias("n_paragraphs"))


@query
def reply_quality(spark, d):
    return _docs(spark, d).groupBy(F.regexp_replace(T.content_quality(F.col("text"), 200, 30, ("password",)), r":\d+$", "").alias("reason")).agg(F.count("*").alias("n"))


@query
def escaped_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.escape_html(F.col("text")).cast("binary")).alias("html"), F.md5(T.escape_tex(F.col("text")).cast("binary")).alias("tex"))


# similarity


@query
def ncd_discontinuity(spark, d):
    return detect.discontinuity(_revisions(spark, d))


@query
def compression_anomalies(spark, d):
    return detect.compression_anomalies(_revisions(spark, d))


@query
def baseline_scores(spark, d):
    n = detect.discontinuity(_revisions(spark, d)).filter("revision_index > 0")
    return detect.baselines(n.select((F.col("revision_index") % 2 == 0).alias("y"), "ncd", (F.col("revision_index") / 10.0).alias("coupling")))


@query
def revision_diffs(spark, d):
    before = F.lag("text").over(revisions.in_order())
    pairs = _revisions(spark, d).select(F.concat_ws(":", "doc_id", "revision_index").alias("key"), before.alias("before"), F.col("text").alias("after")).filter("before is not null")
    return diffs.compare(pairs).select("key", F.round("ratio", 6).alias("ratio"), F.size("spans").alias("n_spans"))


@query
def edit_changes(spark, d):
    part = lambda op, a, n: F.struct(F.lit(op).alias("op"), F.substring("text", a, n).alias("text"))
    ops = F.array(part(0, 1, 20), part(-1, 21, 15), F.struct(F.lit(1).alias("op"), F.lit("new words").alias("text")), part(0, 36, F.char_length("text")))
    edits = _revisions(spark, d).select(F.concat_ws(":", "doc_id", "revision_index").alias("key"), F.lit(0).alias("line"), ops.alias("ops"))
    return diffs.changes(edits).select("key", F.explode("changes").alias("change"))


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@query
def cosine_consecutive(spark, d):
    """Cosine of each vector with the one before of its label."""
    e = ordering.sequenced(table(spark, d, "embeddings"), "label", ts="vec_id", tie="vec_id", carry=("embedding",), grain=4096).filter("prev is not null")
    return e.select("vec_id", "label", F.round(_cosine(F.col("prev.embedding"), F.col("embedding")), 5).alias("cosine"))


@query
def cosine_by_label(spark, d):
    """Mean cosine of vectors with the mean vector of their label."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda v: v["m"]).alias("centre"))
    return e.join(centre, "label").groupBy("label").agg(F.round(F.avg(_cosine(F.col("embedding"), F.col("centre"))), 5).alias("mean_cosine"), F.count("*").alias("n"))


# the joins and pivots above, on larger tables


@query
def revenue_topk(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    sums = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return sums.join(c, sums["o_custkey"] == c["c_custkey"]).select("c_custkey", "c_name", F.round("r", 2).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query
def priority_pivot(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


# replay, cards, identifiers and the process model by document


@query
def replay_frames(spark, d):
    """Turns as diffs of all five operations and an unchanged rest, rendered."""
    part = lambda op, a, n: F.struct(F.lit(op).alias("op"), F.substring("text", a, n).alias("text"))
    ops = F.array(*(part(op, 9 * k + 1, 9) for k, op in enumerate((1, -1, 2, 3, 4, 9))), part(0, 55, F.char_length("text")), F.struct(F.lit(0).alias("op"), F.lit("  ").alias("text")))
    return replay.frames(_revisions(spark, d).select("doc_id", "revision_index", ops.alias("ops"))).select("doc_id", "revision_index", F.md5(F.col("diff_html").cast("binary")).alias("html_md5"))


@query
def rendered_diffs(spark, d):
    part = lambda op, a, n: F.struct(F.lit(op).alias("op"), F.substring("text", a, n).alias("text"))
    ops = F.array(part(0, 1, 20), part(-1, 21, 15), part(1, 36, 15), part(0, 51, F.char_length("text")))
    return _revisions(spark, d).select("doc_id", "revision_index", F.md5(T.render_diff(ops).cast("binary")).alias("html_md5"))


@query
def annotation_cards(spark, d):
    return replay.cards(_traced(_revisions(spark, d)))


@query
def project_titles(spark, d):
    return replay.titles(_log(spark, d))


@query
def lines_in_paragraphs(spark, d):
    """For three lines of each document, the paragraph that holds them."""
    docs = _docs(spark, d).select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.array((F.col("doc_id") % 7 + 1).cast("int"), F.lit(9), F.lit(100_000))).alias("line"))
    return replay.paragraph_of(lines.distinct(), replay.paragraph_ranges(docs))


@query
def repair_choices(spark, d):
    g = F.pmod(F.col("doc_id") * 7, F.lit(100)) / 100.0
    way = F.element_at(F.array(F.lit("lexical_starvation"), F.lit("syntactic_collapse"), F.lit("cognitive_overflow")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", process.repair_choice(F.col("source"), way, g, F.col("doc_id"), {"web": ("site", "page")}).alias("x")).select("doc_id", "x.*")


@query
def state_samples(spark, d):
    u = lambda k: (F.pmod(F.col("doc_id") * k, F.lit(100)) / 100.0)
    x = process.state_sample(F.col("source"), F.col("doc_id") % 50, F.lit(50), u(7), u(13), traces.allocation(u(7), u(13), F.col("doc_id") % 9))
    return _docs(spark, d).select("doc_id", x.alias("x")).select("doc_id", "x.*")


@query
def placeholder_texts(spark, d):
    three = lambda w: tuple(f"{w} {k}" for k in range(3))
    return _docs(spark, d).select("doc_id", process.placeholder(F.col("doc_id"), three("intro"), three("body"), three("end")).alias("text"))


@query
def session_minutes(spark, d):
    minute = process.session_minute(F.col("doc_id") % 50, F.lit(50))
    return _docs(spark, d).select("doc_id", minute.alias("minute"), F.round(process.intrusion_chance(minute, F.col("doc_id") % 3 + 1), 6).alias("chance"))


@query
def eroded_turns(spark, d):
    """Every turn as a reader sees it whose attention falls with the turn's number."""
    seen = process.eroded(F.col("text"), 1.0 - (F.col("revision_index") + 1) / 10.0, F.col("doc_id").cast("string"))
    return _revisions(spark, d).select("doc_id", "revision_index", seen.alias("seen"))


@query
def key_intervals(spark, d):
    """Intervals between the keys of each turn's words."""
    r = _revisions(spark, d)
    key = F.concat_ws(":", "doc_id", "revision_index")
    rows = traces.with_intervals(r.select(key.alias("key"), (F.lit(120.0) + F.col("doc_id") % 50).alias("latency_ms"), T.word_count(F.col("text")).alias("n"), key.alias("salt")))
    return rows.select("key", F.size("intervals").cast("long").alias("n"), F.round(F.array_min("intervals"), 2).alias("least"), F.round(F.array_max("intervals"), 2).alias("most"), F.round(F.try_element_at("intervals", F.lit(-1)), 2).alias("last"))


@query
def hashed_names(spark, d):
    loc, r = F.pmod(F.col("doc_id"), F.lit(40)) / 8.0, F.pmod(F.col("doc_id"), F.lit(16)) / 16.0
    return _docs(spark, d).select("doc_id", ids.author_id(F.col("source")).alias("author"), ids.causal_id(F.col("doc_id"), F.col("lang"), loc, r).alias("causal"), ids.cache_key(F.col("source"), F.col("doc_id")).alias("cache"))


@query
def character_overlap(spark, d):
    before = F.lag("text").over(revisions.in_order())
    rows = _revisions(spark, d).select("doc_id", "revision_index", "text", before.alias("b")).filter("b is not null")
    return rows.select("doc_id", "revision_index", F.round(T.character_jaccard(F.col("b"), F.col("text")), 6).alias("jaccard"))


@query
def span_sentences(spark, d):
    """First and last sentence of each span."""
    r = _revisions(spark, d).withColumn("offsets", T.sentence_offsets(F.col("text")))
    s = _spans(r).select("doc_id", "revision_index", "injection_id", "start", "end").join(r.select("doc_id", "revision_index", "offsets"), ["doc_id", "revision_index"])
    first, last = T.sentence_index(F.col("offsets"), F.col("start"), F.col("end"))
    return s.select("doc_id", "revision_index", "injection_id", first.alias("first_sentence"), last.alias("last_sentence"))


@query
def insertion_checks(spark, d):
    """What is wrong with spans said to hold the first word of their text."""
    r = _revisions(spark, d)
    s = _spans(r).join(r, ["doc_id", "revision_index"])
    wrong = spans.insertion_errors(F.col("text"), F.col("start"), F.col("end"), F.substring_index("text", " ", 1))
    return s.select("doc_id", "revision_index", "injection_id", F.explode(wrong).alias("reason"))


@query
def label_kinds(spark, d):
    """Revisions' span labels and the log's labels by kind, validity as an intention, and initials."""
    s = _spans(_revisions(spark, d)).select("label")
    x = s.unionByName(table(spark, d, "events").select(F.element_at(F.array(F.lit("Clarity"), F.lit("Idea Generation"), F.lit("none")), (F.col("event_id") % 3 + 1).cast("int")).alias("label")))
    return x.groupBy(T.label_kind(F.col("label")).alias("kind"), T.valid_label(F.col("label")).alias("valid"), T.abbreviate(F.col("label")).alias("initials")).agg(F.count("*").alias("n"))


@query
def first_arrays(spark, d):
    """What stands from the first opening bracket to the last closing one of a document."""
    return _docs(spark, d).select("doc_id", F.md5(T.first_json_array(F.concat(F.lit("x ["), F.col("text"), F.lit("] y"))).cast("binary")).alias("array_md5"))


@query
def leakage_pattern_counts(spark, d):
    r = _revisions(spark, d).select(F.concat(F.lit("Here is it. "), F.col("text"), F.lit(" as an AI ")).alias("text"))
    return detect.pattern_counts(r)


@query
def generated_scores(spark, d):
    """Each turn against the one before it and a generated one: the turn without its first word."""
    before = F.lag("text").over(revisions.in_order())
    rows = _revisions(spark, d).select(F.concat_ws(":", "doc_id", "revision_index").alias("key"), before.alias("before"), F.col("text").alias("after"), F.regexp_replace("text", r"^\S+\s*", "").alias("generated")).filter("before is not null")
    return diffs.score_generated(rows).select("key", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def evaluation_report(spark, d):
    base = table(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality", "toxic")
    at = (F.col("k") % 40 * 25).cast("int")
    gold = base.select("k", (F.col("quality") * 0.9).alias("resource_coupling"), at.alias("span_start_char"), (at + 10).alias("span_end_char"))
    pred = base.select("k", (F.col("toxic") * 0.8).alias("predicted_coupling"), (at + 4).alias("pred_start"), (at + 12).alias("pred_end"))
    return metrics.evaluation_report(gold, pred, ["k"])



@query
def revision_char_diffs(spark, d):
    """Each turn against the one before it, by character and cleaned up, with the HTML that replay shows."""
    before = F.lag("text").over(revisions.in_order())
    pairs = _revisions(spark, d).select(F.concat_ws(":", "doc_id", "revision_index").alias("key"), before.alias("before"), F.col("text").alias("after")).filter("before is not null")
    ops = F.col("ops")
    size = lambda op: F.aggregate(F.filter(ops, lambda o: o["op"] == op), F.lit(0), lambda n, o: n + F.char_length(o["text"]))
    found = diffs.char_diffs(pairs).select("key", F.size(ops).alias("n_ops"), size(-1).alias("deleted"), size(1).alias("inserted"), size(0).alias("kept"), "ops")
    return replay.frames(found).withColumn("html_md5", F.md5(F.col("diff_html").cast("binary"))).drop("diff_html")


@query
def edit_stream_tokens(spark, d):
    """What typing, copies, pastes and undos of the edit log do to turns of conversations."""
    stream_ = clipboard.bound(_log(spark, d), table(spark, d, "conversations"))
    out = clipboard.tokenised(stream_)
    return out.select("project", "tie", "kind", "height", "undone", F.md5(F.col("token").cast("binary")).alias("token_md5"))


@query
def relocated_selections(spark, d):
    """A selection from each document's middle, with an error in it, found again where the text's halves have changed places, and its whole sentences."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    moved = F.concat(F.substring("text", half + 1, n), F.substring(F.col("text"), F.lit(1), half))
    start = F.floor(n / 3).cast("int")
    selection = F.concat(F.substring("text", start + 1, F.lit(20)), F.lit("#"), F.substring("text", start + 22, F.lit(30)))
    rows = _texts(spark, d).select(F.col("doc_id").cast("string").alias("key"), moved.alias("text"), selection.alias("selection"), start.alias("near"))
    found = diffs.expanded_context(rows)
    return found.select(F.col("key").cast("long").alias("doc_id"), "at", "start", "end", F.md5(F.col("selected").cast("binary")).alias("selected_md5"))


@query
def sessions_similarity(spark, d):
    """Sessions that a gap ends, or an edit unlike the one before: likeness is the smaller over the larger value."""
    log = ordering.sequenced(_log(spark, d), "project", carry=("label", "value")).drop("nxt", "place", "total")
    low, high = F.least("value", "prev.value"), F.greatest("value", "prev.value")
    log = log.withColumn("likeness", F.when(F.col("prev").isNotNull(), F.coalesce(F.try_divide(low, high), F.lit(1.0)))).drop("prev")
    found = sessions.sessions(sessions.mark_sessions(log, similarity="likeness", least_similarity=0.5))
    return found.select("project", "session", "start_ts", "n", "closed_by")


@query
def selected_spans(spark, d):
    """Three sentences of each document that do not overlap, longer ones first."""
    s = _texts(spark, d).select("doc_id", F.inline(T.sentence_offsets(F.col("text"))))
    near = s.select("doc_id", F.greatest(F.col("start") - 20, F.lit(0)).alias("start"), (F.col("end") + 20).alias("end"), F.floor((F.col("end") - F.col("start")) / 40).alias("priority"))
    return metrics.select_spans(near, 3, 17)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
