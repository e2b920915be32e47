"""Intervals, default plans, plan edits and histories on literal rows, and random edits against a small model."""

from __future__ import annotations

import datetime
import random

import pytest

from furrow.operators import harvests as H
from furrow.plans import daily as P

D = datetime.date
DAY = D(2024, 8, 4)
PLAN = "plan_date date, field_id int, position int"
HARVEST = "harvest_date date, field_id int, interval_days int, a decimal(12,2), b decimal(12,2), c decimal(12,2), xl decimal(12,2)"


def fields(spark, n=14):
    return spark.createDataFrame([(i, f"Field {i}") for i in range(1, n + 1)], "id int, name string")


def harvests(spark, rows):
    from decimal import Decimal

    one, zero = Decimal("1.00"), Decimal("0.00")
    return spark.createDataFrame([(d, f, 5, one, zero, zero, zero) for d, f in rows], HARVEST)


def test_interval_is_strictly_before_with_a_positional_fallback(spark):
    known = harvests(spark, [(DAY, 1), (D(2024, 8, 3), 2), (D(2024, 8, 5), 3), (D(2024, 7, 1), 4), (D(2024, 8, 1), 4)])
    plan = spark.createDataFrame([(DAY, f, f) for f in range(1, 7)], PLAN)
    probes = spark.createDataFrame([(DAY, f) for f in range(1, 8)], "plan_date date, field_id int")
    got = {r["field_id"]: r["interval_days"] for r in H.intervals(probes, known, plan).collect()}
    assert got == {1: 5, 2: 1, 3: 4, 4: 3, 5: 5, 6: 4, 7: 5}


def test_default_plan_of_an_empty_store_and_of_an_emptied_day(spark):
    days = spark.createDataFrame([(DAY,), (D(2024, 8, 5),)], "plan_date date")
    marked = spark.createDataFrame([(DAY, True)], "plan_date date, initialized boolean")
    got = sorted(tuple(r) for r in P.default_plan(days, marked, fields(spark), harvests(spark, [])).collect())
    assert got == [(D(2024, 8, 5), i, i) for i in (1, 2, 3)]


def test_default_plan_ranks_by_all_harvests_or_as_of_a_day(spark):
    known = harvests(spark, [(D(2024, 8, 1), f) for f in range(1, 14)] + [(D(2024, 9, 1), 14), (D(2024, 9, 1), 1)])
    top = {r["position"]: r["field_id"] for r in P.stalest(fields(spark), known).collect()}
    assert top == {1: 2, 2: 3, 3: 4}
    top = {r["position"]: r["field_id"] for r in P.stalest(fields(spark), known, as_of=D(2024, 8, 15)).collect()}
    assert top == {1: 14, 2: 1, 3: 2}


def test_random_edits_keep_positions_without_gaps(spark):
    rng = random.Random(7)
    model, plan = [1, 2, 3], spark.createDataFrame([(DAY, f, f) for f in (1, 2, 3)], PLAN)
    for _ in range(8):
        f = rng.randint(1, 6)
        row = spark.createDataFrame([(DAY, f)], "plan_date date, field_id int")
        if rng.random() < 0.5:
            plan = P.add_fields(plan, row)
            model = model if f in model else [*model, f]
        else:
            plan = P.remove_fields(plan, row)
            model = [x for x in model if x != f]
        rows = sorted((r["position"], r["field_id"]) for r in plan.collect())
        assert rows == list(enumerate(model, 1))
        plan = spark.createDataFrame([(DAY, x, p) for p, x in rows], PLAN)


@pytest.mark.parametrize(("asked", "given"), [(-1, 1), (0, 1), (1, 1), (300, 300), (2000, 2000), (5000, 2000), (None, 2000)])
def test_history_limit_is_clamped(asked, given):
    assert H.clamped(asked) == given


def test_marked_days_are_added_once(spark):
    old = spark.createDataFrame([(DAY, True)], "plan_date date, initialized boolean")
    days = spark.createDataFrame([(DAY,), (D(2024, 8, 5),), (D(2024, 8, 5),)], "plan_date date")
    assert sorted(tuple(r) for r in P.marked(old, days).collect()) == [(DAY, True), (D(2024, 8, 5), True)]


def test_adding_a_field_marks_the_day_and_refuses_unknown_ones(spark):
    day = datetime.date(2024, 1, 1)
    plan = spark.createDataFrame([], "plan_date date, field_id int, position int")
    days = spark.createDataFrame([], "plan_date date, initialized boolean")
    fields = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, name string")
    added = spark.createDataFrame([(day, 2)], "plan_date date, field_id int")
    new_plan, new_days = P.add_known_fields(plan, days, fields, added)
    assert [tuple(r) for r in new_plan.collect()] == [(day, 2, 1)] and [tuple(r) for r in new_days.collect()] == [(day, True)]
    for wrong in P.add_known_fields(plan, days, fields, spark.createDataFrame([(day, 9)], "plan_date date, field_id int")):
        with pytest.raises(Exception, match="unknown field 9"):
            wrong.collect()
    assert sorted(tuple(r) for r in P.ids_by_name(fields).collect()) == [("a", 1), ("b", 3)]
