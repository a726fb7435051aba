"""What the pipeline's first two stages keep where ids repeat or are missing, and where labels say nothing."""

from __future__ import annotations

import random

import pytest

from draftlens.llm import quality, simhash


def text(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    rows = [(1, text(1)), (2, text(2)), (2, text(3)), (3, text(1)), (2, text(1)), (5, text(5)), (5, text(5)), (None, text(2)), (None, text(7)), (None, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, text(1)), (2, text(2)), (2, text(3)), (5, text(5)), (0, text(7))], key=str)


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (3, 0, 0)], [(1, 1, 0)]])
def test_without_two_classes_all_documents_stay(spark, labels):
    docs = spark.createDataFrame([(1, text(1)), (2, ""), (3, None), (None, "x")], "doc_id long, text string")
    assert quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 4


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Rows of cells are many times what the planner takes them for, and links grow with the input: neither may pass through the driver."""
    plans, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: (plans.append((label, df._jdf.queryExecution().sparkPlan().toString())), write(df, label))[1])
    fps = spark.createDataFrame([(k << 8,) for k in range(64)], "fp long")
    links = simhash.near_links(fps)
    plans.append(("near_links", links._jdf.queryExecution().sparkPlan().toString()))
    found = simhash.components(links).select("root").distinct().count()
    assert found == 1
    assert {label for label, _ in plans} == {"cells", "links", "near_links"}
    assert [label for label, plan in plans if "Broadcast" in plan] == []
