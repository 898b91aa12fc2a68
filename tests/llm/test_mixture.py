"""Mixtures reach their shares, keep to the caps and do not change when run again."""

import os

import pytest

from strandwork.llm import mixture as m

DOC, TARGET = "doc_id long, text string, source string, tokens long", "source string, target_share double, max_repeats int, docs int"

pytestmark = pytest.mark.skipif(not os.path.exists(m.TOKENIZER), reason="no tokenizer file")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"document number {i} " * (1 + i % 7), " Big" if i % 3 else "big", 1) for i in range(2000)]
    rows += [(5000 + i, "a small text " * 5, "small", 1) for i in range(60)]
    rows += [(9000, None, "big", 1), (9001, "", "small", 1), (9002, "unlisted", "other", 1), (9003, "x", None, 1)]
    return spark.createDataFrame(rows, DOC)


def test_shares_and_caps(spark, docs):
    targets = spark.createDataFrame([("BIG", 0.6, 1, 0), ("small ", 0.3, 4, 0), ("absent", 0.1, 9, 0)], TARGET)
    mixed, report = m.mix(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["absent"]["actual_share"] == 0 and got["absent"]["mixed_tokens"] == 0
    assert abs(got["big"]["actual_share"] - 0.6 / 0.9) < 0.03 and abs(got["small"]["actual_share"] - 0.3 / 0.9) < 0.03
    assert got["small"]["most_copies"] <= 4 and got["big"]["most_copies"] <= 1
    rows = sorted(map(tuple, mixed.collect()))
    assert rows == sorted(map(tuple, m.mix(docs, targets)[0].collect()))
    assert len(set((r[0], r[3]) for r in rows)) == len(rows) and {r[1] for r in rows} == {"big", "small"}
    assert sum(r[2] for r in rows) == sum(r["mixed_tokens"] for r in got.values())


def test_capped_source_falls_short(spark, docs):
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.5, 2, 0)], TARGET)
    got = {r["source"]: r for r in m.mix(docs, targets, total=10_000)[1].collect()}
    assert got["small"]["rate"] == 2.0 and got["small"]["actual_share"] < 0.5


def test_awkward_tables(spark, docs):
    targets = spark.createDataFrame([("big", None, None, 0), (None, 0.5, 2, 0), ("small", 0.5, 2, 0), ("small", 0.5, 3, 0)], TARGET)
    got = {r["source"]: r for r in m.mix(docs, targets)[1].collect()}
    assert got["big"]["mixed_tokens"] == 0 and got["small"]["max_repeats"] == 2 and got["small"]["actual_share"] == 1.0
    mixed, report = m.mix(docs.limit(0), targets)
    assert mixed.count() == 0 and report.count() == 2
    mixed, report = m.mix(docs, targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


def test_rows_without_an_id_toss_their_own_coins(spark):
    rows = [(None, "the very same text of all of them", "big", 1)] * 900 + [(i, "a small one", "small", 1) for i in range(100)]
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.5, 1, 0)], TARGET)
    mixed, report = m.mix(spark.createDataFrame(rows, DOC), targets)
    assert all(abs(r["actual_share"] - 0.5) < 0.1 for r in report.collect())
