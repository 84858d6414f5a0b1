import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import make_formats
from formlens.functions.text import normalized, title_case, until_stop
from formlens.operators.examples import parse_examples, reference_answers, rejected_examples, response_segments
from formlens.operators.prompts import chat_messages, few_shot_prompts, render_prompts, tagged_prompts
from formlens.operators.scoring import cut_at_end_tag, extract_answers, predictions, truncate_at_stop


def column(spark, values, name="generation"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")


def values(df, name):
    return [row[name] for row in df.orderBy("i").collect()]


EDGES = {
    "none": "",
    "": "",
    "ans 1,000": "000",
    "x -5. done": "-5",
    "t 1-2": "-2",
    "a 3.14<end_of_response> 99": "3.14",
    "<end_of_response> 99": "",
    "1.2.3": "3",
    "1.2.3.4": "3.4",
    "--7.": "-7",
    "7": "7",
    "٣": "",
    "5 then " + "." * 400: "5",
    "5" * 300: "5" * 300,
    "8" + "x" * 5000: "8",
    "1.5" * 200 + " end": re.findall(r"-?\d+(?:\.\d+)?", "1.5" * 200)[-1],
}


def test_last_number_edges(spark):
    assert values(extract_answers(column(spark, list(EDGES))), "extracted") == list(EDGES.values())


def test_last_number_of_null_is_null(spark):
    assert values(extract_answers(column(spark, [None, "1"])), "extracted") == [None, "1"]


def test_last_number_equals_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0019.-- a,é\n") for _ in range(rng.choice([3, 20, 255, 257, 700]))) for _ in range(400)]
    texts += ["".join(rng.choice("09.-") for _ in range(300)) for _ in range(50)]
    expected = [([""] + re.findall(r"-?[0-9]+(?:\.[0-9]+)?", text))[-1] for text in texts]
    assert values(extract_answers(column(spark, texts)), "extracted") == expected


def test_normalized(spark):
    raw = [" 42.", "-5", "(A)\n", "x > ", "1 000", "->3<-", ""]
    found = column(spark, raw, "x").select("i", normalized(F.col("x")).alias("y"))
    assert values(found, "y") == [text.strip(" .,()\n-><").lower() for text in raw]


def test_predictions_take_the_number_before_the_end_tag(spark):
    assert values(predictions(column(spark, ["is -7.<end_of_response>8"])), "prediction") == ["7"]


def test_cut_at_end_tag(spark):
    assert values(cut_at_end_tag(column(spark, ["a<end_of_response>b<end_of_response>c", "d"])), "generation") == ["a", "d"]


def test_stops_are_literal_and_the_earliest_wins(spark):
    texts = ["one question two", "a.*b", "You are an AI assistant", "nothing", "xab", None]
    rows = column(spark, texts)
    stops = ["question", ".*", "You are an AI assistant", "ab", "xa"]
    assert values(truncate_at_stop(rows, stops), "generation") == ["one ", "a", "", "nothing", "", None]
    kept = values(truncate_at_stop(rows, stops, keep_stop=True), "generation")
    assert kept == ["one question", "a.*", "You are an AI assistant", "nothing", "xa", None]


def test_empty_stop_is_refused():
    with pytest.raises(ValueError):
        until_stop(F, [""])


def test_title_case_is_that_of_python(spark):
    words = ["question", "it's o2x", "ABC dEF", "a-b_c", "", "élan vital", "x1y 2z"]
    found = column(spark, words, "x").select("i", title_case(F.col("x")).alias("y"))
    assert values(found, "y") == [word.title() for word in words]


def parsed(spark, rows, **options):
    table = spark.createDataFrame(rows, "example_id BIGINT, question STRING, answer STRING")
    return {r["example_id"]: (r["reasoning"], r["answer"]) for r in parse_examples(table, **options).collect()}


def test_parse_keeps_blanks_and_accepts_missing_answers(spark):
    found = parsed(spark, [(1, "q", "why #### 7"), (2, "q", None), (3, "q", "#### 7"), (4, "q", "a####")])
    assert found == {1: ("why ", " 7"), 2: (None, None), 3: ("", " 7"), 4: ("a", "")}


def test_parse_without_answer_column(spark):
    table = spark.createDataFrame([(1, "q")], "example_id BIGINT, question STRING")
    assert parse_examples(table).collect()[0].asDict() == {"example_id": 1, "question": "q", "reasoning": None, "answer": None}


def test_wrong_number_of_parts(spark):
    rows = [(1, "q", "a"), (2, "q", "a####b####c"), (3, "q", "a####b")]
    for bad in rows[:2]:
        with pytest.raises(Exception, match="two answer parts"):
            parsed(spark, [bad])
    assert parsed(spark, rows, strict=False) == {3: ("a", "b")}
    table = spark.createDataFrame(rows, "example_id BIGINT, question STRING, answer STRING")
    assert sorted(r["example_id"] for r in rejected_examples(table).collect()) == [1, 2]


def test_misfit_is_an_error_whichever_column_is_read(spark):
    table = spark.createDataFrame([(1, "q", "no parts")], "example_id BIGINT, question STRING, answer STRING")
    for name in ("reasoning", "answer"):
        with pytest.raises(Exception, match="two answer parts"):
            parse_examples(table).select(name).collect()


def test_references(spark, toy_examples):
    assert {r["example_id"]: r["reference"] for r in reference_answers(toy_examples).collect()} == {1: "42", 2: "0", 3: "1000"}


QUESTION = "A box holds 4 * 6 eggs. How many?"
REASONING = "4 * 6 = 24"


def test_worked_renderings(spark):
    table = spark.createDataFrame([(1, QUESTION, REASONING, "24")], "example_id BIGINT, question STRING, reasoning STRING, answer STRING")
    formats = make_formats(spark, [(0, "lower", ": ", "\n"), (1, "upper", "\t", "-- ")])
    found = {r["format_id"]: r["prompt"] for r in render_prompts(table, formats).collect()}
    assert found[0] == f"question: {QUESTION}\nreasoning: {REASONING}\nanswer: 24"
    assert found[1] == f"QUESTION\t{QUESTION}-- REASONING\t{REASONING}-- ANSWER\t24"


def test_tags_and_dropped_sections(spark):
    table = spark.createDataFrame(
        [(1, "q", "", "7"), (2, "q", None, None), (3, "q", "r", "")],
        "example_id BIGINT, question STRING, reasoning STRING, answer STRING",
    )
    formats = make_formats(spark, [(0, "title", ": ", "\n")])
    found = {r["example_id"]: r["prompt"] for r in render_prompts(table, formats, add_tags=True).collect()}
    assert found == {
        1: "<input>Question: q\nAnswer: 7<end_of_response>",
        2: "<input>Question: q\n",
        3: "<input>Question: q\n <robustness_on>Reasoning: r\n",
    }
    assert [r["prompt"] for r in tagged_prompts(table.filter("example_id = 1"), formats).collect()] == ["<input>Question: q\n"]


def test_few_shot_prompt(spark, toy_examples):
    shots = toy_examples.filter("example_id < 3").withColumn("shot_rank", F.col("example_id").cast("int"))
    formats = make_formats(spark, [(0, "identity", ":", " | ")])
    tests = spark.createDataFrame([(9, "Why?")], "example_id BIGINT, question STRING")
    prompt = few_shot_prompts(tests, shots, formats).collect()[0]["prompt"]
    assert prompt == (
        "question:What is six times seven? | reasoning:Just multiply.  | answer: 42\n\n"
        "question:Nine birds sit on a wire and all of them fly away; how many stay? | reasoning:None of them stays.  | answer: 0\n\n"
        "question:Why? | "
    )


def test_worked_example_without_answer_is_an_error(spark):
    shots = spark.createDataFrame([(0, 1, "q", None)], "shot_rank INT, example_id BIGINT, question STRING, answer STRING")
    tests = spark.createDataFrame([(9, "Why?")], "example_id BIGINT, question STRING")
    with pytest.raises(Exception, match="must have an answer"):
        few_shot_prompts(tests, shots, make_formats(spark, [(0, "identity", ":", " ")])).collect()


def test_response_segments(spark):
    table = spark.createDataFrame([("ask <robustness_on>tell",), ("ask only",), ("é <robustness_on>",)], "text STRING")
    found = {r["text"]: (r["has_response"], r["instruction"], r["response"]) for r in response_segments(table).collect()}
    assert found == {
        "ask <robustness_on>tell": (True, "ask <robustness_on>", "tell"),
        "ask only": (False, "ask only", ""),
        "é <robustness_on>": (True, "é <robustness_on>", ""),
    }


def test_chat_messages(spark):
    table = spark.createDataFrame([("hi",)], "prompt STRING")
    plain = chat_messages(table).collect()[0]["messages"]
    assert [tuple(m) for m in plain] == [("user", "hi")]
    with_system = chat_messages(table, "be brief").collect()[0]["messages"]
    assert [tuple(m) for m in with_system] == [("system", "be brief"), ("user", "hi")]
