import statistics

import pytest
from pyspark.sql import functions as F

from conftest import make_formats
from formlens.operators import report
from formlens.operators.examples import select_few_shot
from formlens.operators.prompts import chat_messages
from formlens.operators.scoring import check_counts, format_accuracy
from formlens.plans.studies import evaluate, evaluation_prompts, study_formats, training_set

GENERATIONS = "experiment STRING, format_id INT, example_id BIGINT, generation STRING"


@pytest.fixture(scope="module")
def generations(spark):
    rows = [
        ("exp", 0, 1, "it is 42."), ("exp", 0, 2, "so 0"), ("exp", 0, 3, "1,000"),
        ("exp", 3, 1, "-42"), ("exp", 3, 2, "no idea"), ("exp", 3, 3, None),
    ]
    return spark.createDataFrame(rows, GENERATIONS)


def test_accuracy_keeps_format_ids(generations, toy_examples):
    found = {r["format_id"]: (round(r["accuracy"], 6), r["n_scored"]) for r in format_accuracy(generations, toy_examples).collect()}
    assert found == {0: (0.666667, 3), 3: (0.333333, 3)}


def test_missing_generation_is_an_error_when_strict(generations, toy_examples):
    short = generations.filter("NOT (format_id = 3 AND example_id = 1)")
    with pytest.raises(Exception, match="scored generations 2, examples 3"):
        format_accuracy(short, toy_examples).collect()
    loose = {r["format_id"]: r["accuracy"] for r in format_accuracy(short, toy_examples, strict=False).collect()}
    assert loose[3] == 0.0
    assert {r["format_id"]: r["complete"] for r in check_counts(short, toy_examples).collect()} == {0: True, 3: False}


def test_no_generations_give_no_accuracy(spark, toy_examples):
    assert format_accuracy(spark.createDataFrame([], GENERATIONS), toy_examples).collect() == []


def test_evaluation_of_one_run(generations, toy_examples):
    result = evaluate(generations, toy_examples)
    assert round(result.spread.collect()[0]["spread"], 6) == 0.333333
    assert result.extremes.collect()[0].asDict() == {"experiment": "exp", "best_format": 0, "worst_format": 3}
    assert result.summary.collect()[0]["n_formats"] == 2


def test_report_figures(spark):
    metrics = spark.createDataFrame(
        [("m", 0, 0.5), ("m", 1, 0.9), ("m", 2, 0.9), ("m", 3, 0.5), ("m", 4, None), ("single", 0, 0.4)],
        "experiment STRING, format_id INT, accuracy DOUBLE",
    )
    keys = ["experiment"]
    summary = {r["experiment"]: r for r in report.accuracy_summary(metrics, keys).collect()}
    assert summary["m"]["median_accuracy"] == pytest.approx(0.7) and summary["m"]["n_formats"] == 4
    assert summary["m"]["sd_accuracy"] == pytest.approx(statistics.stdev([0.5, 0.9, 0.9, 0.5]))
    assert summary["single"]["sd_accuracy"] is None
    extremes = {r["experiment"]: (r["best_format"], r["worst_format"]) for r in report.best_worst_format(metrics, keys).collect()}
    assert extremes == {"m": (1, 0), "single": (0, 0)}
    models = metrics.select("experiment").distinct()
    frame = report.metrics_by_format(models, make_formats(spark, [(i, "identity", "", "") for i in range(6)]), metrics)
    assert frame.count() == 12 and frame.filter("accuracy IS NULL").count() == 7


def test_model_labels(spark):
    names = report.model_name_table(spark)
    paths = spark.createDataFrame([("exp/qwen3b",), ("a/b/Llama-3.2-1B-Instruct_lora",)], "path STRING")
    found = {r["model"]: (r["model_rank"], r["family"]) for r in report.label_models(paths, names).collect()}
    assert found == {"Qwen2.5-3B": (8, "Qwen"), "Llama-3.2-1B LoRA": (1, "Llama")}
    for bad in (spark.createDataFrame([("exp/other",)], "path STRING"),):
        with pytest.raises(Exception, match="unknown model: exp/other"):
            report.label_models(bad, names).collect()
    strange = spark.createDataFrame([("exp/qwen3b", "Other", 0)], "last_part STRING, model STRING, model_rank INT")
    strange = strange.withColumn("last_part", F.lit("qwen3b"))
    with pytest.raises(Exception, match="unknown model"):
        report.label_models(paths.filter("path LIKE '%qwen3b'"), strange).collect()


def test_study_prompts_skip_finished_formats(spark, toy_examples):
    formats = study_formats(spark, 4, 24)
    done = spark.createDataFrame([(0,), (2,)], "format_id INT")
    prompts = evaluation_prompts(toy_examples, toy_examples, formats, done, seed=24)
    assert sorted((r["example_id"], r["format_id"]) for r in prompts.collect()) == [(e, f) for e in (1, 2, 3) for f in (1, 3)]
    tagged = evaluation_prompts(toy_examples, None, formats, None, seed=24).collect()
    assert len(tagged) == 12 and all(r["prompt"].startswith("<input>") for r in tagged)


def test_training_set_holds_out_test_formats(toy_examples):
    texts, held_out = training_set(toy_examples, 3, 4, 24)
    rows = texts.collect()
    assert len(rows) == 12 and all(r["has_response"] for r in rows)
    assert not {r["format_id"] for r in rows} & {r["format_id"] for r in held_out.collect()}


def test_strict_scores_are_not_fooled(spark, toy_examples):
    """The right number of generations, but one repeated, unknown or of another format."""
    def table(*rows):
        return spark.createDataFrame([("exp", f, e, "42") for f, e in rows], GENERATIONS)

    whole = [(0, 1), (0, 2), (0, 3)]
    for rows, amiss in (
        ([(0, 1), (0, 1), (0, 2)], "repeated 1, missing 1"),
        ([(0, 1), (0, 2), (0, 99)], "without a reference 1, repeated 0, missing 1"),
        (whole + [(1, 97), (1, 98), (1, 99)], "format 1.*without a reference 3"),
    ):
        with pytest.raises(Exception, match=amiss):
            format_accuracy(table(*rows), toy_examples).collect()
    loose = format_accuracy(table(*whole, (1, 97)), toy_examples, strict=False).collect()
    assert {r["format_id"]: (r["accuracy"] is None, r["n_scored"]) for r in loose} == {0: (False, 3), 1: (True, 0)}


def test_few_shot_examples_have_answers(spark):
    rows = [(1, "q", None), (2, "q", "long answer #### 1"), (3, "q", "a #### 1")]
    shots = select_few_shot(spark.createDataFrame(rows, "example_id BIGINT, question STRING, answer STRING"), 1, 3)
    assert [r["example_id"] for r in shots.orderBy("shot_rank").collect()] == [3, 2]


def test_messages_keep_their_roles(spark):
    turns = spark.createDataFrame([("assistant", "a"), (None, "b")], "role STRING, prompt STRING")
    assert [[m["role"] for m in r["messages"]] for r in chat_messages(turns, "s").collect()] == [["system", "assistant"], ["system", "user"]]
    assert chat_messages(turns.drop("role")).first()["messages"][0]["role"] == "user"


@pytest.mark.parametrize("text, value", [
    ("1,000", "1000"), ("is 12,345,678.900 then", "12345678.9"), ("1,00", "0"), ("1,0000", "0"), ("-5", "-5"), ("+5", "5"), ("-0.00", "0"),
    ("5%", "0.05"), ("0.5 %", "0.5"), ("100%", "1"), ("-1,250.50%", "-12.505"), ("007", "7"), ("none", ""), ("", ""), (None, None),
    ("3.14 or 2", "2"), ("2. Done", "2"), ("t 1-2", "-2"), ("9" * 60 + ".10", "9" * 60 + ".1"), ("42<end_of_response> 7", "42"), ("٣", ""),
    (".5", "5"), ("1.2.3", "3"), ("$1,000,000!", "1000000"), ("0%", "0"), ("1e5", "5"),
])
def test_canonical_numbers(spark, text, value):
    from formlens.operators.scoring import predictions

    frame = spark.createDataFrame([("e", 0, 1, text)], "experiment STRING, format_id INT, example_id BIGINT, generation STRING")
    assert predictions(frame, strict_numeric=True).first()["prediction"] == value


def test_accuracy_by_value(spark):
    from formlens.operators.scoring import format_accuracy

    examples = spark.createDataFrame([(1, "q", "r #### 1,000"), (2, "q", "r #### -5")], "example_id BIGINT, question STRING, answer STRING")
    rows = [("e", 0, 1, "1000.00"), ("e", 0, 2, "5"), ("e", 1, 1, "100000%"), ("e", 1, 2, "-5.0")]
    generations = spark.createDataFrame(rows, "experiment STRING, format_id INT, example_id BIGINT, generation STRING")
    found = {r["format_id"]: r["accuracy"] for r in format_accuracy(generations, examples, strict_numeric=True).collect()}
    assert found == {0: 0.5, 1: 1.0}
    found = {r["format_id"]: r["accuracy"] for r in format_accuracy(generations, examples).collect()}
    assert found == {0: 0.5, 1: 0.0}


def test_last_numbers_of_long_texts_are_those_of_the_whole_text(spark):
    """Runs of number characters at, across and far before the closing characters, against a search through all of the text."""
    import random
    import re

    from formlens.functions.text import CLOSING_CHARS, WRITTEN_NUMBER, with_canonical_number

    rng = random.Random(5)
    runs = ["".join(rng.choice("0123456789,,..%+-") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    runs += ["1," + "234," * 90 + "567", "%" * 300, "7" + "%," * 150, "5%%", "+-.,", "9" * 400]
    texts = [f"{rng.choice(runs)} and {run}{rng.choice(['', '.', ' x', 'y' * (CLOSING_CHARS - rng.randrange(12))])}" for run in runs]
    rows = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "n INT, text STRING")
    plan = with_canonical_number(rows, F.col("text"), "value")
    found = {r["n"]: r["value"] for r in plan.collect()}
    whole = {n: (re.findall(WRITTEN_NUMBER, text) or [""])[-1] for n, text in enumerate(texts)}
    # A text that is nothing but the number, far shorter than the closing characters or searched as a whole.
    alone = spark.createDataFrame(list(whole.items()), "n INT, text STRING")
    assert found == {r["n"]: r["value"] for r in with_canonical_number(alone, F.col("text"), "value").collect()}
    assert plan.columns == ["n", "text", "value"] and len(set(found.values())) > 200


def test_a_whole_text_is_searched_backwards_for_its_last_number(spark):
    """A number is looked for from the back, once: texts full of numbers take no search through all of them."""
    import time

    from formlens.operators.scoring import predictions

    rows = spark.range(400).selectExpr("'e' AS experiment", "0 AS format_id", "id AS example_id", "concat(repeat('7 ', 100000), id, '.50') AS generation")
    rows.cache().count()
    began = time.time()
    found = predictions(rows, strict_numeric=True).agg(F.count_if(F.col("prediction") == F.concat("example_id", F.lit(".5")))).first()[0]
    took = time.time() - began
    rows.unpersist()
    assert found == 400 and took < 10
