"""Templates in texts, anomalies beside their spans, totals, trajectories, forms of dates, prompts, catalogues of models."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import prompts, times
from draftlens.operators import detect, events, metrics, models, spans, traces

TRACE = "array<struct<status:string,repair_artifact:string,glucose_at_event:double,syntactic_complexity:double>>"


@pytest.mark.parametrize("tried, sent", [(64, 100_000), (0, 100_000), (0, 0)])
def test_templates_are_those_of_a_plain_search(spark, tried, sent):
    r = random.Random(7)
    word = lambda: "".join(r.choice("aBé") for _ in range(r.randint(1, 2)))
    texts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "  ", "𝒳𝒴 z", "a\nb  c"]
    bodies = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(40)] + [t[3:25] for t in texts[:20]] + [None, " ", "A", "a b", "𝒴 Z", "b  c"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, low string")
    items = spark.createDataFrame([(k, b, 1) for k, b in enumerate(bodies)], "item_id long, text string, h int")
    got = {tuple(x) for x in detect.contained_templates(docs, items, size=3, tried_templates=tried, broadcast_templates=sent).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k, b in enumerate(bodies) if (b or "").strip() and b.strip().lower() in (t or "").lower()} and got


def test_templates_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert detect.contained_templates(docs.limit(0), items).count() == 0
    none = detect.contained_templates(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "item_id"]


def test_templates_join_no_texts_by_loop(spark, sf):
    from draftlens.plans import registry

    text = registry.queries()["template_hits"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def _spans(spark):
    bad = [("failure", None, 0.9, 1.0)] + [("success", None, 0.8 - k / 100, 1.0) for k in range(6)] + [("success", "x", 0.5, 1.0)]
    rows = [
        (1, 0, "inj_abcdefgh", "injection.naive", "naive", "cold", "none", 2, 5, 77, bad, 1.5),
        (1, 0, "o", "anomaly.truncation", None, None, "high", 0, 1, 5, bad, None),
        (1, 2, "p", "injection.topical", "topical", "warm", "low", -1, 3, 9, [("repair", "x", 0.0, 2.0)], 2.5),
        (2, 0, "q", "injection.topical", "topical", "assimilated", "low", 0, 4, 9, None, 2.5),
        (2, 1, "r", "injection.topical", "topical", "assimilated", "low", 0, 3, 9, [], 2.5),
    ]
    return spark.createDataFrame(rows, f"doc_id long, revision_index int, injection_id string, label string, level string, state string, flag string, start int, end int, rng_seed int, trace {TRACE}, locality double")


def test_anomalies_stand_beside_their_spans(spark):
    s = _spans(spark)
    out = traces.with_anomalies(s)
    assert out.schema.names == s.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in s.schema]
    rows = [r.asDict(recursive=True) for r in out.collect()]
    given = [r.asDict(recursive=True) for r in s.collect()]
    assert all(r in rows for r in given)
    new = [r for r in rows if r not in given]
    assert sorted(r["injection_id"] for r in new) == ["anom_inj_abcd", "anom_p", "anom_r"]
    a = next(r for r in new if r["injection_id"] == "anom_inj_abcd")
    assert (a["label"], a["level"], a["state"], a["flag"], a["start"], a["end"], a["rng_seed"], a["locality"]) == ("anomaly.process_violation", None, None, "high", 2, 5, 0, 1.5)
    assert {r["label"] for r in new if r is not a} == {"anomaly.no_resource_coupling"}
    assert traces.with_anomalies(s.limit(0)).count() == 0


def test_trajectory_of_documents(spark):
    r = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)], "doc_id long, revision_index int")
    got = {x["doc_id"]: x for x in traces.document_trajectory(_spans(spark).drop("locality"), r).collect()}
    assert [(got[k]["n_revisions"], got[k]["n_spans"], got[k]["cold"], got[k]["warm"], got[k]["assimilated"], got[k]["repairs"]) for k in (1, 2, 3)] == [(3, 3, 1, 1, 0, 1), (2, 2, 0, 0, 2, 0), (1, 0, 0, 0, 0, 0)]
    # the only span of the last revision ends at zero, which counts as not known; revisions without traces are plausible
    assert got[1]["final_glucose"] == 1.0 and got[3]["plausible_share"] == 1.0 and got[2]["mean_locality"] == 0.0
    sig = {x["injection_id"]: x for x in traces.with_signatures(_spans(spark).drop("locality")).collect()}
    first = (sig["inj_abcdefgh"]["locality"] + sig["o"]["locality"]) / 2
    values = [v for v in (first, sig["p"]["locality"]) if v]
    assert got[1]["mean_locality"] == pytest.approx(sum(values) / len(values), abs=1e-6)


def test_totals_of_content_and_leakage(spark):
    r = spark.createDataFrame([(1, 0, "Here is it"), (1, 2, "as an AI"), (2, 0, "    "), (2, 1, "fine"), (9, 0, None)], "doc_id long, revision_index int, text string")
    want = spark.createDataFrame([("r", "zzz"), ("inj_abcdefgh", "re"), ("none", "x")], "injection_id string, expected string")
    s = _spans(spark)
    # crossed (negative), blank and unexpected ones fail; the first holds "re "
    assert spans.content_totals(s, r, want).first().asDict() == {"documents_checked": 3, "revisions_checked": 5, "spans_verified": 4, "spans_failed": 3, "failure_rate": 0.75}
    assert spans.content_totals(s, r).first()["spans_failed"] == 2
    assert spans.content_totals(s.limit(0), r.limit(0)).first().asDict() == {"documents_checked": 0, "revisions_checked": 0, "spans_verified": 0, "spans_failed": 0, "failure_rate": 0.0}
    whole = s.join(r, ["doc_id", "revision_index"]).withColumns({"start": F.lit(0), "end": F.char_length("text")}).drop("text")
    got = {x["metric"]: x["n"] for x in spans.leakage_totals(whole, r).collect()}
    assert got == {"spans_checked": 4, "spans_with_leakage": 2, "pattern:" + vocab.LEAKAGE_PATTERNS[0]: 1, "pattern:" + vocab.LEAKAGE_PATTERNS[1]: 1}
    assert spans.leakage_totals(s.limit(0), r).count() == 0


def test_periods_are_those_of_the_calendar(spark):
    days = [dt.date(y, 1, 1) + dt.timedelta(n) for y in (1999, 2000, 2004, 2018, 2024) for n in range(0, 365, 3)]
    forms = [d.strftime("%Y-W%W") for d in days] + [d.strftime("%Y-%m") for d in days] + [d.isoformat() for d in days] + ["", "2024", "2024-13", "2024-02-30", None]
    rows = spark.createDataFrame([(f,) for f in forms], "form string").select("form", times.period(F.col("form")).alias("p")).select("form", "p.*").collect()
    for x in rows:
        form = x["form"] or ""
        if "W" in form:
            begin = dt.datetime.strptime(form.replace("W", "") + "-1", "%Y-%W-%w").date()
            assert (x["start"], x["end"], x["grain"]) == (begin, begin + dt.timedelta(7), "day")
        elif form in ("", "2024", "2024-13", "2024-02-30"):
            assert (x["start"], x["end"], x["grain"]) == (None, None, None)
        elif len(form) == 7:
            begin = dt.date.fromisoformat(form + "-01")
            assert (x["start"], x["end"], x["grain"]) == (begin, (begin + dt.timedelta(32)).replace(day=1), "day")
        else:
            begin = dt.date.fromisoformat(form)
            later = begin.replace(year=begin.year + 1) if (begin.month, begin.day) != (2, 29) else dt.date(begin.year + 1, 2, 28)
            assert (x["start"], x["end"], x["grain"]) == (begin, later, "month")


def test_find_by_order_users_and_place(spark):
    log = spark.createDataFrame([(k, k % 3, "ab"[k % 2]) for k in range(30)], "tie long, author long, label string")
    users = spark.createDataFrame([(1,), (2,), (2,), (None,)], "author long")
    got = [r["tie"] for r in events.find(log, [F.desc("tie")], F.col("label") == "a", skip=2, limit=5, users=users).collect()]
    assert got == [k for k in range(29, -1, -1) if k % 2 == 0 and k % 3 in (1, 2)][2:7]
    assert events.find(log, ["tie"]).count() == 30 and events.find(log, ["tie"], skip=28).count() == 2


def test_prompts(spark):
    text = "".join(chr(97 + k % 26) for k in range(2_000))
    df = spark.createDataFrame([("Intro", text, 900, 950), (None, "short", 2, 3), (None, None, 0, 0)], "section string, text string, start int, end int")
    got = [r["p"] for r in df.select(prompts.contextual(F.col("section"), F.col("text"), F.col("start"), F.col("end")).alias("p")).collect()]
    make = lambda s, a, b: vocab.PROMPTS["contextual"].format(section=s, preceding=a, following=b)
    assert got == [make("Intro", text[400:900], text[950:1450]), make("", "sh", "rt"), make("", "", "")]
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert one(prompts.topical(F.lit("bees"), F.lit("biology"))) == vocab.PROMPTS["topical"].format(topic="bees", domain="biology")
    assert one(prompts.fill("{{a}} {b}{b}", b=F.lit(1))) == "{a} 11" and one(prompts.naive()) == vocab.PROMPTS["naive"]
    assert one(prompts.ending(F.lit("abc"), 2)) == "bc" and one(prompts.opening(F.lit("abc"), 2)) == "ab" and one(prompts.ending(F.lit(None), 2)) == ""
    with pytest.raises(KeyError):
        prompts.fill("{missing}")


def test_catalogue_of_models(spark):
    rows = [
        ("openai/gpt-4-turbo", "G", 128_000, "0.00001", "0.00003", ["seed", "temperature", "tools"]),
        ("meta-llama/llama-3.1-8b", None, None, "x", None, None),
        ("qwen/qwen-small", "Q", 4095, "0", "0", []),
        ("acme/one:free", "F", 9_000, "0", "0", []),
        ("acme/image-pro", "I", 9_000, "0", "0", []),
        ("acme/pro-mini", "P", 8_192, "0.000002", "0.000004", []),
        (None, "N", 9_000, "0", "0", []),
    ]
    df = spark.createDataFrame(rows, "id string, name string, context_length long, prompt_price string, completion_price string, supported_parameters array<string>")
    got = {r["id"]: r for r in models.discovered(df).collect()}
    assert set(got) == {"openai/gpt-4-turbo", "meta-llama/llama-3.1-8b", "acme/pro-mini"}
    g, m, p = got["openai/gpt-4-turbo"], got["meta-llama/llama-3.1-8b"], got["acme/pro-mini"]
    assert (g["vendor"], g["priority"], g["score"], g["parameters"]) == ("openai", 2, 15, ["max_tokens", "seed", "temperature"])
    assert g["prompt_price"] == pytest.approx(10) and g["completion_price"] == pytest.approx(30) and g["cost"] == pytest.approx(0.02)
    assert (m["vendor"], m["priority"], m["score"], m["name"], m["context_length"], m["cost"]) == ("meta", 4, 5, "meta-llama/llama-3.1-8b", 4096, 0.0)
    assert m["parameters"] == ["max_tokens", "repetition_penalty", "stop", "temperature", "top_k", "top_p"]
    assert (p["vendor"], p["priority"], p["score"], p["parameters"]) == ("other", 99, 5, ["max_tokens", "stop", "temperature", "top_p"])
    kept = models.discovered(df).select(models.filter_parameters(F.create_map(F.lit("seed"), F.lit("1"), F.lit("stop"), F.lit(None).cast("string"), F.lit("top_p"), F.lit(".9")), F.col("parameters")).alias("m"), "id").collect()
    assert {r["id"]: r["m"] for r in kept} == {"openai/gpt-4-turbo": {"seed": "1"}, "meta-llama/llama-3.1-8b": {"top_p": ".9"}, "acme/pro-mini": {"top_p": ".9"}}
    chosen = metrics.select_models(models.discovered(df).select(F.col("id").alias("key"), "vendor", "priority", "score", "cost"), 2, 1)
    assert [r["key"] for r in chosen.collect()] == ["openai/gpt-4-turbo", "meta-llama/llama-3.1-8b"]


def test_dense_matrix_is_bounded(spark):
    rows = spark.range(10).select(F.col("id").alias("t"), F.col("id").alias("p"))
    assert metrics.confusion(rows, "t", "p", dense=True).count() == 100
    with pytest.raises(ValueError, match="at most"):
        metrics.confusion(rows, "t", "p", dense=True, most_labels=9)
