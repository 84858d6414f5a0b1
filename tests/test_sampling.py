import hashlib
import random

import pytest
from pyspark.sql import functions as F

from formlens.operators import sampling as sp
from formlens.operators.examples import (
    head_examples,
    longest_examples,
    order_by_question_length,
    select_few_shot,
    split_disjoint,
)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows share one question length; ids have gaps."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        size = 40 if i % 2 else rng.randrange(1, 90)
        rows.append((i * 3 + 1, "q" * size, "a" * rng.choice([5, 5, 5, rng.randrange(1, 60)]) + " #### 1"))
    table = spark.createDataFrame(rows, "example_id BIGINT, question STRING, answer STRING").repartition(16)
    return table, rows


def test_hash_ranks_are_the_seeded_order(skewed):
    table, rows = skewed
    order = sorted((md5(f"24:{i}"), i) for i, _, _ in rows)
    expected = {i: rank for rank, (_, i) in enumerate(order)}
    found = {r["example_id"]: r["sample_rank"] for r in sp.hash_ranked(table, 24, "example_id").collect()}
    assert found == expected
    some = {r["example_id"]: r["sample_rank"] for r in sp.hash_ranked(table, 24, "example_id", 17).collect()}
    assert some == {i: rank for i, rank in expected.items() if rank < 17}


def test_longest_with_ties(skewed):
    table, rows = skewed
    order = sorted(rows, key=lambda r: (-len(r[1]) - len(r[2]), r[0]))
    for n in (1, 700, 5000):
        found = {r["example_id"] for r in longest_examples(table, n).collect()}
        assert found == {i for i, _, _ in order[:n]}


def test_tops_of_any_size_are_filters(skewed, monkeypatch):
    """With ties, few sampled keys and string keys; and the same plan, without a shuffle, for every n."""
    table, rows = skewed
    monkeypatch.setattr(sp, "SAMPLED_KEYS", 60)
    named = table.withColumn("example_id", F.format_string("k%06d", "example_id"))
    for n in (3, 900, 1001, 2500):
        wanted = {f"k{i:06d}" for i, _, _ in sorted(rows)[:n]}
        top = sp.first_rows(named, n, F.lit(0), "example_id")
        assert {r["example_id"] for r in top.collect()} == wanted
    order = sorted(rows, key=lambda r: (-len(r[1]) - len(r[2]), r[0]))
    assert {r["example_id"] for r in longest_examples(table, 900).collect()} == {i for i, _, _ in order[:900]}
    assert {r["example_id"] for r in head_examples(table, 900).collect()} == {i for i, _, _ in rows[:900]}
    plans = [sp.first_rows(table, n, F.length("question"), "example_id")._jdf.queryExecution().toString() for n in (150, 1001, 2900)]
    assert [plan.count("Exchange") for plan in plans] == [1] * 3  # the fixture's own



def test_head_clamps(skewed):
    table, rows = skewed
    assert {r["example_id"] for r in head_examples(table, 5).collect()} == {1, 4, 7, 10, 13}
    assert head_examples(table, 10_000).count() == len(rows)


def test_ordinals_of_a_hot_value_and_sparse_keys(skewed):
    table, rows = skewed
    table = table.withColumn("example_id", F.col("example_id") * 1_000_003_000_003)
    rows = [(i * 1_000_003_000_003, q, a) for i, q, a in rows]
    order = sorted(rows, key=lambda r: (-len(r[1]), r[0]))
    found = {r["ordinal"]: r["example_id"] for r in order_by_question_length(table).collect()}
    assert found == {n: r[0] for n, r in enumerate(order)}


def test_few_shot_takes_the_ends_of_the_subset(skewed):
    table, rows = skewed
    subset = sorted(rows, key=lambda r: (md5(f"7:{r[0]}"), r[0]))[:50]
    shortest = min(subset, key=lambda r: len(r[2]))
    longest = max(subset, key=lambda r: len(r[2]))
    found = select_few_shot(table, 7, 50).orderBy("shot_rank").collect()
    assert [r["example_id"] for r in found] == [shortest[0], longest[0]]


def test_disjoint_halves(skewed):
    table, rows = skewed
    halves = split_disjoint(table, 100, 1).collect()
    parts = [{r["example_id"] for r in halves if r["half"] == h} for h in (0, 1)]
    assert [len(p) for p in parts] == [100, 100] and not parts[0] & parts[1]
    with pytest.raises(Exception, match="fewer than"):
        split_disjoint(table, len(rows), 1).collect()


def test_draws_stay_in_range_and_blocks_have_two_formats(spark):
    pairs = sp.sample_pairs(spark, 500, 24, 7, 3).collect()
    assert {r["left_pos"] for r in pairs} == set(range(7)) and {r["right_pos"] for r in pairs} == set(range(3))
    assert pairs[0]["left_pos"] == int(md5(f"24:{pairs[0]['pair_id']}:left")[:15], 16) % 7
    blocks = sp.sample_blocks(spark, 40, 8, 24, 5, F.lit(100)).collect()
    assert len(blocks) == 320 and all(r["first_pos"] != r["second_pos"] for r in blocks)
    by_block = {}
    for r in blocks:
        by_block.setdefault(r["pair_id"] // 8, set()).add((r["first_pos"], r["second_pos"]))
    assert all(len(p) == 1 for p in by_block.values()) and len({q for p in by_block.values() for q in p}) > 10


def test_a_missing_question_is_ordered_last_and_kept(spark):
    table = spark.createDataFrame([(5, None), (2**60, "ab"), (2**60 + 1, "ab"), (9, "")], "example_id BIGINT, question STRING")
    found = {r["ordinal"]: r["example_id"] for r in order_by_question_length(table).collect()}
    assert found == {0: 2**60, 1: 2**60 + 1, 2: 5, 3: 9}


def test_whole_rows_are_shuffled_once_and_lie_in_order(spark):
    """Nine tenths of the questions are of one length; the query plan moves the rows once, and parts stay even."""
    rows = spark.range(20_000).selectExpr("id AS example_id", "repeat('q', IF(id % 10 = 0, CAST(id % 97 AS INT), 50)) AS question")
    ordered = order_by_question_length(rows)
    found = [(r["ordinal"], -len(r["question"]), r["example_id"]) for r in ordered.collect()]
    assert found == sorted(found) and [n for n, _, _ in found] == list(range(20_000))
    assert [row[1:] for row in found] == sorted(row[1:] for row in found)
    sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    plan = ordered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionBy") == 1 and "Join" not in plan
    assert order_by_question_length(rows.limit(0)).collect() == []


def test_drawn_positions_are_distinct_and_even(spark):
    """Every pair out of seven is as likely as any other, and any size from the number wanted will do."""
    rows = spark.range(21_000).select(sp.distinct_positions(3, F.col("id"), 2, F.lit(7)).alias("at"))
    counts = {}
    for row in rows.collect():
        assert len(set(row["at"])) == 2 and set(row["at"]) <= set(range(7))
        counts[frozenset(row["at"])] = counts.get(frozenset(row["at"]), 0) + 1
    assert len(counts) == 21 and all(abs(n - 1000) < 160 for n in counts.values())
    whole = spark.range(5).select(sp.distinct_positions(3, F.col("id"), 4, F.lit(4)).alias("at")).collect()
    assert all(sorted(r["at"]) == [0, 1, 2, 3] for r in whole)
