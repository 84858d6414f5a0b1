import json

import pytest
from pyspark.sql import functions as F

from conftest import make_formats
from formlens.fixed_values import SEPARATORS, SPACES, TRANSFORMS
from formlens.operators import formats as fm
from formlens.operators.dimensions import for_each_format
from formlens.operators.prompts import augment_examples, augment_with_drawn_formats
from formlens.plans.studies import study_formats
from formlens.sources.formats import load_format_specs, save_format_specs


def test_grid_is_the_product_in_order(spark):
    rows = fm.format_grid(spark).orderBy("idx").collect()
    expected = [(s, p, t) for s in SEPARATORS for p in SPACES for t in TRANSFORMS]
    assert [(r["separator"], r["space"], r["transform"]) for r in rows] == expected
    assert all(r["idx"] == r["separator_pos"] * 64 + r["space_pos"] * 4 + r["transform_pos"] for r in rows)


def test_sample_is_distinct_dense_and_seeded(spark):
    def drawn(n, seed):
        return [(r["format_id"], r["idx"]) for r in fm.sample_formats(fm.format_grid(spark), n, seed).orderBy("format_id").collect()]

    first = drawn(50, 24)
    assert [i for i, _ in first] == list(range(50)) and len({idx for _, idx in first}) == 50
    assert drawn(10, 24) == first[:10] and drawn(10, 25) != first[:10]
    for n in (0, -1, 961):
        with pytest.raises(ValueError):
            drawn(n, 24)


def test_duplicate_renderings_and_leaks(spark):
    everything = study_formats(spark, 960, 24)
    assert fm.distinct_formats(everything).count() == 675
    test, train = fm.split_formats(everything, 10)
    assert (test.count(), train.count()) == (10, 950)
    keys = {r["format_id"]: r["render_key"] for r in fm.render_key(everything).collect()}
    expected = {i for i in keys if i >= 10 and keys[i] in {keys[j] for j in range(10)}}
    assert {r["format_id"] for r in fm.leaked_formats(test, train).collect()} == expected


def test_specs_round_trip_keeps_whitespace(spark, tmp_path):
    rows = [(0, "title", "\n\t", ""), (1, "identity", "", " \n"), (2, "upper", "\t", " ,  ")]
    formats = make_formats(spark, rows)
    path = str(tmp_path / "specs")
    save_format_specs(formats, path)
    assert sorted(load_format_specs(spark, path).select(*formats.columns).collect()) == sorted(formats.collect())


def test_specs_are_read_from_plain_json(spark, tmp_path):
    spec = ["lambda x: x.upper()", "::", "; \n", "question", "reasoning", "answer", "<input>", " <robustness_on>", "<end_of_response>"]
    path = tmp_path / "format_specs.json"
    path.write_text(json.dumps([spec, ["lambda x: x"] + spec[1:]], indent=2))
    found = load_format_specs(spark, str(path)).orderBy("format_id").collect()
    assert [r["transform"] for r in found] == ["upper", "identity"] and found[0]["space"] == "; \n"
    path.write_text(json.dumps([["lambda x: x[::-1]"] + spec[1:]]))
    with pytest.raises(Exception, match="unknown descriptor transform"):
        load_format_specs(spark, str(path)).collect()


def test_unknown_transform_is_an_error(spark):
    with pytest.raises(Exception, match="unknown descriptor transform"):
        fm.label_descriptors(make_formats(spark, [(0, "shout", "", "")])).collect()


def test_formats_are_bounded_by_bytes_alone(spark):
    table = spark.range(1200).select(F.col("id").cast("int").alias("format_id"), F.repeat(F.lit("x"), 100).alias("separator"))
    examples = spark.range(2).select(F.col("id").alias("example_id"))
    assert for_each_format(examples, table).count() == 2400
    with pytest.raises(Exception, match="more than 50000 bytes"):
        for_each_format(examples, table, max_bytes=50_000).count()


def test_samples_are_checked_against_the_grid_given(spark):
    grid = fm.format_grid(spark, ["a", "b"], ["c"], ["upper"])
    assert fm.sample_formats(grid, 2, 1).count() == 2
    with pytest.raises(ValueError, match="from 2"):
        fm.sample_formats(grid, 3, 1)
    wide = fm.format_grid(spark, [str(k) for k in range(1000)], ["c"], ["upper"])
    assert fm.sample_formats(wide, 1000, 1).select("idx").distinct().count() == 1000


def test_work_list_and_what_is_left(spark, toy_examples):
    formats = make_formats(spark, [(3, "identity", "", ""), (5, "title", "", "")])
    grid = fm.example_format_grid(toy_examples, formats)
    assert sorted(map(tuple, grid.collect())) == [(e, f) for e in (1, 2, 3) for f in (3, 5)]
    done = spark.createDataFrame([(1, 3), (2, 3), (2, 3)], "example_id BIGINT, format_id INT")
    left = fm.pending_work(grid, done, ["example_id", "format_id"])
    assert sorted(map(tuple, left.collect())) == [(1, 5), (2, 5), (3, 3), (3, 5)]
    assert fm.pending_work(grid, done, ["example_id", "format_id"], force=True).count() == 6
    kept, missing = fm.available_formats(formats, done)
    assert [r["format_id"] for r in kept.collect()] == [3] and [r["format_id"] for r in missing.collect()] == [5]


def test_augmentation_gives_distinct_pairs_of_the_longest(spark, toy_examples):
    formats = study_formats(spark, 20, 24)
    rows = augment_examples(toy_examples, formats, 2, 7, 24).collect()
    assert len(rows) == 14 and len({(r["example_id"], r["format_id"]) for r in rows}) == 14
    assert {r["example_id"] for r in rows} == {2, 3}
    assert all(r["text"].startswith("<input>") and r["text"].endswith("<end_of_response>") for r in rows)
    assert rows != augment_examples(toy_examples, formats, 2, 7, 25).collect()
    with pytest.raises(Exception, match="fewer than 21 formats"):
        augment_examples(toy_examples, formats, 2, 21, 24).collect()


def test_drawn_formats_are_distinct_pairs_of_the_longest(spark, toy_examples):
    formats = study_formats(spark, 20, 24)
    rows = augment_with_drawn_formats(toy_examples, formats, 2, 7, 24).collect()
    assert len(rows) == 14 and len({(r["example_id"], r["format_id"]) for r in rows}) == 14
    rendered = {tuple(r) for r in augment_examples(toy_examples, formats, 2, 20, 24).collect()}
    assert {tuple(r) for r in rows} <= rendered
    with pytest.raises(Exception, match="fewer than 21 formats"):
        augment_with_drawn_formats(toy_examples, formats, 2, 21, 24).collect()
