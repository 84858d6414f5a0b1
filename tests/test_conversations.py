import random

import pytest

from formlens.operators.conversations import whole_conversations
from formlens.operators.formats import leaked_formats
from formlens.plans.studies import study_formats, training_set

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, messages STRING"


def found_of(frame, *parameters):
    return {row["conv_id"]: [tuple(m) for m in row["messages"]] for row in whole_conversations(frame, *parameters).collect()}


def test_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "é", "x" * 300]), "m") for _ in range(2000)]
    rows += [(900, k, "user", f"turn {k}", "m") for k in range(25_000, 0, -1)] + [(None, 1, "user", "nobody's", "m"), (901, 1, "user", "twice", "m"), (901, 1, "user", "twice", "m")]
    expected = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            expected.setdefault(conv, []).append((turn is not None, turn or 0, role or "user", text or ""))
    expected = {conv: [row[2:] for row in sorted(turns)] for conv, turns in expected.items()}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found_of(frame) == expected
    assert found_of(frame, "be brief") == {conv: [("system", "be brief"), *turns] for conv, turns in expected.items()}
    plan = whole_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 2  # one of them deals the fixture out


def test_limits_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "é" * 50, "m"), (1, 1, "user", "a", "m"), (2, 0, "user", "a", "m")], SCHEMA)
    assert len(found_of(frame, None, 101)) == 2
    with pytest.raises(Exception, match="conversation 1 has over 100 bytes"):
        whole_conversations(frame, None, 100).collect()
    assert found_of(frame.limit(0)) == {}


def test_training_formats_that_look_like_test_formats_are_left_out(spark, toy_examples):
    formats = study_formats(spark, 960, 24)
    leaked = {row["format_id"] for row in leaked_formats(formats.filter("format_id < 10"), formats.filter("format_id >= 10")).collect()}
    assert leaked
    used = []
    for exclude in (False, True):
        texts, held_out = training_set(toy_examples, 3, 900, 24, exclude_leaks=exclude)
        assert held_out.count() == 10
        used.append({row["format_id"] for row in texts.select("format_id").distinct().collect()})
    assert used[0] & leaked and not used[1] & leaked
