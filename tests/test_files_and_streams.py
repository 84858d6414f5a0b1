import json
import os
import uuid

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from formlens.operators.examples import order_by_question_length, reference_answers
from formlens.operators.inference import batch_embed, batch_generate
from formlens.operators.scoring import format_accuracy
from formlens.sources import examples as example_files
from formlens.sources import generations as generation_files
from formlens.sources import metrics as metric_files
from formlens.sources import states as state_files
from formlens.sources.lines import numbered_lines
from formlens.streaming.scoring import accuracy_stream, latest_accuracy, running_accuracy, score_stream, stream_generations

GENERATIONS = "experiment STRING, format_id INT, example_id BIGINT, generation STRING"


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 50) for i in range(3000)]
    (tmp_path / "text").mkdir()
    for part in range(3):
        (tmp_path / "text" / f"part-{part}").write_text("\n".join(lines[part * 1000 : part * 1000 + 1000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = numbered_lines(spark, str(tmp_path / "text"), "^.*/").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in sorted(rows, key=lambda r: r["line_no"])] == lines


@pytest.mark.parametrize("split_bytes", ["700", "3k", "1m"])
def test_lines_are_counted_and_not_copied(spark, tmp_path, split_bytes):
    sizes = [1, 0, 400, 2500, 3, 90]
    texts = [[f"{part} {i} " + "x" * (i * 7 % 60) for i in range(n)] for part, n in enumerate(sizes)]
    for part, lines in enumerate(texts):
        (tmp_path / f"part-{part}").write_text("".join(line + "\n" for line in lines))
    shared = os.path.join(spark.conf.get("spark.checkpoint.dir"), "formlens")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    limits = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "100"}
    kept = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        lines = numbered_lines(spark, str(tmp_path), "^.*/")
        found = [r["value"] for r in sorted(lines.collect(), key=lambda r: r["line_no"])]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert found == [line for part in texts for line in part]
    # Fewer and longer splits of a later scan: the same numbers.
    assert [r["value"] for r in sorted(lines.select("*").collect(), key=lambda r: r["line_no"])] == found
    new = set(os.listdir(shared)) - before
    assert {name.split("-")[0] for name in new} == {"lines"}
    stored_bytes = sum(os.path.getsize(os.path.join(shared, name, file)) for name in new for file in os.listdir(os.path.join(shared, name)))
    assert split_bytes == "700" or stored_bytes < 40_000 < sum(len(line) for part in texts for line in part)


def test_example_ids_are_line_numbers(spark, tmp_path):
    rows = [{"question": f"q{i}\n", "answer": f"a {i} #### {i}"} for i in range(200)]
    (tmp_path / "set.jsonl").write_text("".join(json.dumps(row) + "\n" for row in rows))
    found = example_files.read_examples(spark, str(tmp_path / "set.jsonl"), "json").orderBy("example_id").collect()
    assert [r.asDict() for r in found] == [{"example_id": i, **row} for i, row in enumerate(rows)]
    (tmp_path / "bad.jsonl").write_text('{"question": "q", \n')
    with pytest.raises(Exception):
        example_files.read_examples(spark, str(tmp_path / "bad.jsonl"), "json").collect()


def test_examples_with_an_id_column(spark, tmp_path, toy_examples):
    path = str(tmp_path / "table")
    toy_examples.withColumnRenamed("example_id", "id").write.parquet(path)
    assert sorted(example_files.read_examples(spark, path, id_column="id").collect()) == sorted(toy_examples.collect())
    with pytest.raises(ValueError, match="id column"):
        example_files.read_examples(spark, path)
    with pytest.raises(ValueError, match="csv"):
        example_files.read_examples(spark, path, "csv")


def test_sorted_examples_round_trip(spark, tmp_path, toy_examples):
    path = str(tmp_path / "sorted")
    example_files.write_sorted_examples(toy_examples, path)
    rows = example_files.read_sorted_examples(spark, path).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["example_id"]) for r in rows] == [(0, 2), (1, 1), (2, 3)]
    assert order_by_question_length(toy_examples).count() == 3


TEXTS = ["plain", "", "two\nlines", 'a "quoted", text,', "[", "]", ",", " padded ", "ünï", "\\back\t"]


@pytest.mark.parametrize("indent", [2, None])
def test_generation_arrays_of_other_tools(spark, tmp_path, indent):
    for i in (0, 12):
        with open(tmp_path / f"generations_format_spec_{i}.json", "w") as f:
            json.dump([f"{i}{text}" for text in TEXTS], f, indent=indent)
    with open(tmp_path / "generations_format_spec_3.json", "w") as f:
        json.dump([], f, indent=indent)
    (tmp_path / "metrics.json").write_text('{"format_accuracies": []}')
    rows = generation_files.read_generations(spark, str(tmp_path)).orderBy("format_id", "ordinal").collect()
    assert [tuple(r) for r in rows] == [(i, n, f"{i}{text}") for i in (0, 12) for n, text in enumerate(TEXTS)]


def test_written_parts_make_one_json_array(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = [(f, n, text) for f in (1, 2) for n, text in enumerate(TEXTS * 20)]
    table = spark.createDataFrame(rows, "format_id INT, ordinal BIGINT, generation STRING").repartition(8)
    generation_files.write_generation_arrays(table, path)
    for f in (1, 2):
        folder = os.path.join(path, f"array=generations_format_spec_{f}.json")
        parts = sorted(name for name in os.listdir(folder) if name.startswith("part-"))
        whole = "".join(open(os.path.join(folder, name), encoding="utf-8").read() for name in parts)
        assert json.loads(whole) == TEXTS * 20
    assert sorted(map(tuple, generation_files.read_generations(spark, path).collect())) == sorted(rows)


def test_finished_formats_are_kept_unless_forced(spark, tmp_path):
    path = str(tmp_path / "generations")

    def rows(text, formats):
        return spark.createDataFrame([("exp", f, e, text) for f in formats for e in range(3)], GENERATIONS)

    def stored():
        return {r["format_id"]: r["generation"] for r in generation_files.read_stored_generations(spark, path).collect()}

    generation_files.write_generations(rows("first", [0, 1]), path)
    generation_files.write_generations(rows("second", [1, 2]), path)
    assert stored() == {0: "first", 1: "first", 2: "second"}
    generation_files.write_generations(rows("third", [1]), path, force=True)
    assert stored() == {0: "first", 1: "third", 2: "second"}
    assert generation_files.read_stored_generations(spark, path).count() == 9


def test_states_are_pruned_by_layer_and_format(spark, tmp_path):
    path = str(tmp_path / "states")
    rows = [(f, e, l, [float(f), float(l)]) for f in (0, 2) for e in range(4) for l in range(3)]
    state_files.write_hidden_states(spark.createDataFrame(rows, "format_id INT, example_id BIGINT, layer INT, embedding ARRAY<FLOAT>"), path)
    found = state_files.read_hidden_states(spark, path, layer=1, format_ids=[0, 1, 2])
    assert sorted((r["format_id"], r["example_id"]) for r in found.collect()) == [(f, e) for f in (0, 2) for e in range(4)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(layer" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_metrics_round_trip_with_a_gap(spark, tmp_path):
    path = str(tmp_path / "metrics")
    metrics = spark.createDataFrame([("a b", 0, 0.5), ("a b", 2, 0.25), ("c", 1, 1.0)], "experiment STRING, format_id INT, accuracy DOUBLE")
    metric_files.write_metrics(metrics, path)
    found = metric_files.read_metrics(spark, path)
    assert sorted(map(tuple, found.filter("accuracy IS NOT NULL").collect())) == sorted(map(tuple, metrics.collect()))
    assert found.filter("accuracy IS NULL").count() == 2


def test_metrics_of_other_tools(spark, tmp_path):
    (tmp_path / "qwen1b").mkdir()
    (tmp_path / "qwen1b" / "metrics.json").write_text(json.dumps({"format_accuracies": [0.5, 0.75]}, indent=2))
    assert sorted(map(tuple, metric_files.read_metrics(spark, str(tmp_path)).collect())) == [("qwen1b", 0, 0.5), ("qwen1b", 1, 0.75)]


def prompts(spark, n=100):
    return spark.createDataFrame([(0, i, "x" * (i % 7) + str(i)) for i in range(n)], "format_id INT, example_id BIGINT, prompt STRING")


def test_every_prompt_gets_one_generation(spark):
    def echo_model(temperature):
        def run(texts):
            assert len(texts) <= 8
            return [f"{text}|{temperature}" for text in texts]

        return run

    table = prompts(spark)
    rows = batch_generate(table, echo_model, batch_size=8, temperature=0.5, n_tasks=3).collect()
    assert sorted((r["example_id"], r["prompt"], r["generation"]) for r in rows) == sorted(
        (r["example_id"], r["prompt"], r["prompt"] + "|0.5") for r in table.collect()
    )
    with pytest.raises(ValueError, match="temperature"):
        batch_generate(table, echo_model, temperature=-1.0)


def test_batches_keep_to_a_budget_and_waste_little(spark):
    """Each prompt tells its batch; what is padded to the longest stays within the budget, nearly full."""
    def model(temperature):
        def run(texts):
            name = uuid.uuid4().hex
            return [f"{name} {len(texts)} {max(map(len, texts))}" for _ in texts]

        return run

    table = spark.range(6_000).selectExpr("0 AS format_id", "id AS example_id", "repeat('x', CAST(id * id % 211 AS INT)) AS prompt")
    table = table.unionByName(spark.createDataFrame([(0, -1, "y" * 5000), (0, -2, None)], table.schema)).filter("prompt IS NOT NULL")
    rows = batch_generate(table, model, 400, n_tasks=2, max_batch_tokens=2_000).collect()
    assert sorted((r["example_id"], r["prompt"]) for r in rows) == sorted((r["example_id"], r["prompt"]) for r in table.collect())
    batches = {}
    for r in rows:
        name, n, longest = r["generation"].split()
        batches.setdefault((name, int(n), int(longest)), []).append(len(r["prompt"]))
    padded = used = 0
    for (_, n, longest), sizes in batches.items():
        assert len(sizes) == n <= 400 and max(sizes) == longest
        assert n * longest <= 2_000 or sizes == [5000]
        padded, used = padded + n * longest, used + sum(sizes)
    assert used > 0.97 * padded and len(batches) < 1.1 * used / 2_000 + 10
    halves = batch_generate(table, model, 400, n_tasks=2, max_batch_tokens=2_000, size=F.length("prompt") * 2).collect()
    assert all(int(n) * int(longest) * 2 <= 2_000 or n == "1" for _, n, longest in (r["generation"].split() for r in halves))
    with pytest.raises(ValueError, match="max_batch_tokens"):
        batch_generate(table, model, max_batch_tokens=0)


def test_a_model_that_loses_a_prompt_is_an_error(spark):
    with pytest.raises(Exception, match="results for"):
        batch_generate(prompts(spark, 3), lambda temperature: lambda texts: texts[1:]).collect()


def test_embeddings_come_by_layer(spark):
    def encoder():
        return lambda texts: [[[float(len(text))], [0.5]] for text in texts]

    rows = batch_embed(prompts(spark, 20), encoder, batch_size=6).collect()
    assert len(rows) == 40 and {r["layer"] for r in rows} == {0, 1}
    lengths = {r["example_id"]: len(r["prompt"]) for r in prompts(spark, 20).collect()}
    assert all(r["embedding"] == ([float(lengths[r["example_id"]])] if r["layer"] == 0 else [0.5]) for r in rows)


def test_stream_equals_batch_and_counts_once(spark, tmp_path, toy_examples):
    landing, scores, progress = (str(tmp_path / name) for name in ("landing", "scores", "progress"))
    references = reference_answers(toy_examples)

    def land(format_id, answers):
        rows = [("exp", format_id, e, answer) for e, answer in zip((1, 2, 3), answers)]
        spark.createDataFrame(rows, GENERATIONS).write.mode("append").parquet(landing)

    def run():
        score_stream(stream_generations(spark, landing, max_files=1), references, scores, progress).awaitTermination()
        return {r["format_id"]: (round(r["accuracy"], 6), r["n_scored"]) for r in running_accuracy(spark, scores).collect()}

    land(0, ["42", "0", "7"])
    assert run() == {0: (0.666667, 3)}
    land(1, ["42", "0", "1000"])
    assert run() == {0: (0.666667, 3), 1: (1.0, 3)}
    assert run() == {0: (0.666667, 3), 1: (1.0, 3)}
    batch = format_accuracy(spark.read.schema(GENERATIONS).parquet(landing), toy_examples)
    assert {r["format_id"]: (round(r["accuracy"], 6), r["n_scored"]) for r in batch.collect()} == run()
    land(0, ["42", "0", "1000"])
    assert run() == {0: (1.0, 3), 1: (1.0, 3)}


def test_ids_are_unique_over_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.json").write_text(f'{{"question": "{folder}1"}}\n{{"question": "{folder}2"}}\n')
    found = example_files.read_examples(spark, str(tmp_path), "json").orderBy("example_id").collect()
    assert [(r["example_id"], r["question"]) for r in found] == [(0, "a1"), (1, "a2"), (2, "b1"), (3, "b2")]


def test_arrays_refuse_gaps_and_keep_experiments_apart(spark, tmp_path):
    fields = "experiment STRING, format_id INT, ordinal BIGINT, generation STRING"
    for ordinals in ((1, 3), (0, 0, 2, 2), (0, 1, 1)):
        rows = spark.createDataFrame([("e", 0, n, "x") for n in ordinals], fields)
        with pytest.raises(Exception, match="ordinals are not"):
            generation_files.write_generation_arrays(rows, str(tmp_path / "gap"))
    rows = [(e, 0, n, f"{e}{n}") for e in ("one", "two") for n in range(4)]
    generation_files.write_generation_arrays(spark.createDataFrame(rows, fields), str(tmp_path / "both"))
    found = generation_files.read_generations(spark, str(tmp_path / "both"), with_experiment=True)
    assert sorted(map(tuple, found.collect())) == rows


def test_stored_layers_stay_unless_forced(spark, tmp_path):
    def states(value, layers):
        rows = [(0, 1, layer, [value]) for layer in layers]
        return spark.createDataFrame(rows, "format_id INT, example_id BIGINT, layer INT, embedding ARRAY<FLOAT>")

    path = str(tmp_path / "states")
    state_files.write_hidden_states(states(1.0, [0, 1]), path, force=False)
    state_files.write_hidden_states(states(2.0, [1, 2]), path, force=False)
    found = {r["layer"]: r["embedding"][0] for r in state_files.read_hidden_states(spark, path).collect()}
    assert found == {0: 1.0, 1: 1.0, 2: 2.0}


def test_prompts_are_spread_and_a_worker_makes_one_model(spark):
    """One input partition becomes several tasks; a model is made once per process, not per task."""
    def model(temperature):
        name = uuid.uuid4().hex
        return lambda texts: [f"{os.getpid()} {TaskContext.get().partitionId()} {name}" for _ in texts]

    rows = batch_generate(prompts(spark).coalesce(1), model, batch_size=4).collect()
    pids, tasks, models = zip(*(r["generation"].split() for r in rows), strict=True)
    assert len(set(tasks)) == 8 and len(set(models)) == len(set(pids))


def test_tasks_grow_with_the_bytes_of_the_prompts(spark, monkeypatch):
    """``n_tasks`` bounds the number of tasks from below only: a task gets about so many bytes, however many there are."""
    from formlens.operators import inference

    def model(temperature):
        return lambda texts: [str(TaskContext.get().partitionId()) for _ in texts]

    def encoder():
        return lambda texts: [[[float(TaskContext.get().partitionId())]] for _ in texts]

    table = prompts(spark).withColumn("prompt", F.repeat(F.lit("ü"), 50))
    found = []
    for n_bytes in (128 << 20, 1_000):
        monkeypatch.setattr(inference, "TASK_BYTES", n_bytes, raising=False)
        found.append(len({r["generation"] for r in batch_generate(table, model, n_tasks=2).collect()}))
        found.append(len({r["embedding"][0] for r in batch_embed(table, encoder, n_tasks=2).collect()}))
    assert found == [2, 2, 10, 10]


def test_unknown_answers_and_new_checkpoints(spark, tmp_path, toy_examples):
    landing, scores = str(tmp_path / "landing"), str(tmp_path / "scores")
    rows = [("exp", 0, e, "42") for e in (1, 99)]
    spark.createDataFrame(rows, GENERATIONS).write.parquet(landing)
    for progress in ("first", "second"):
        query = score_stream(stream_generations(spark, landing), reference_answers(toy_examples), scores, str(tmp_path / progress))
        query.awaitTermination()
    assert len(os.listdir(scores)) == 2
    assert [(r["accuracy"], r["n_scored"]) for r in running_accuracy(spark, scores).collect()] == [(1.0, 1)]


def test_counters_follow_scores_that_change(spark, tmp_path, toy_examples):
    landing, counters, progress = (str(tmp_path / name) for name in ("landing", "counters", "progress"))
    references = reference_answers(toy_examples)

    def land(rows):
        spark.createDataFrame([("exp", *row) for row in rows], GENERATIONS).coalesce(1).write.mode("append").parquet(landing)

    def run():
        query = accuracy_stream(stream_generations(spark, landing), references, counters, progress)
        query.awaitTermination()
        found = {r["format_id"]: (round(r["accuracy"], 6), r["n_scored"]) for r in latest_accuracy(spark, counters).collect()}
        work = [p for p in query.recentProgress if p["numInputRows"]]
        return found, sum(p["numInputRows"] for p in work), sum(p["stateOperators"][0]["numRowsUpdated"] for p in work)

    land([(f, e, answer) for f in range(40) for e, answer in ((1, "42"), (2, "0"), (3, "7"), (99, "no reference"))])
    assert run() == ({f: (0.666667, 3) for f in range(40)}, 160, 120)
    # One example scored anew: work for one row, whatever has been counted before.
    land([(5, 3, "1000")])
    found, n_read, n_updated = run()
    assert (found[5], found[6], n_read, n_updated) == ((1.0, 3), (0.666667, 3), 1, 1)
    # Right again, wrong again, twice in a batch (the greater string counts), a new format, nothing new.
    land([(5, 3, "1000"), (6, 1, "41"), (7, 2, "0"), (7, 2, "9"), (41, 1, "42")])
    found, n_read, n_updated = run()
    assert (found[5], found[6], found[7], found[41], n_read) == ((1.0, 3), (0.333333, 3), (0.333333, 3), (1.0, 1), 5)
    assert run() == (found, 0, 0)
    batch = format_accuracy(spark.read.schema(GENERATIONS).parquet(landing).filter("format_id = 41"), toy_examples, strict=False)
    assert [(r["accuracy"], r["n_scored"]) for r in batch.collect()] == [found[41]]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, toy_examples):
    landing, counters, progress = (str(tmp_path / name) for name in ("landing", "counters", "progress"))
    references = reference_answers(toy_examples)
    for format_id, answer in ((0, "42"), (0, "41")):
        spark.createDataFrame([("exp", format_id, 1, answer), ("exp", 1, 1, "42")], GENERATIONS).coalesce(1).write.mode("append").parquet(landing)
        accuracy_stream(stream_generations(spark, landing), references, counters, progress).awaitTermination()
        # As after a loss before the commit: the batch's counters are there, its commit is not.
        last = max(int(name) for name in os.listdir(f"{progress}/commits") if name.isdigit())
        for name in (f"{last}", f".{last}.crc"):
            if os.path.exists(f"{progress}/commits/{name}"):
                os.remove(f"{progress}/commits/{name}")
        accuracy_stream(stream_generations(spark, landing), references, counters, progress).awaitTermination()
    found = {r["format_id"]: (r["accuracy"], r["n_scored"]) for r in latest_accuracy(spark, counters).collect()}
    assert found == {0: (0.0, 1), 1: (1.0, 1)}


def test_a_block_of_examples_is_scored_in_one_call(spark, tmp_path):
    """Examples of one stripe share a row of the state store; ids may be negative or large, or come again."""
    landing, counters, progress = (str(tmp_path / name) for name in ("landing", "counters", "progress"))
    ids = [*range(0, 256 * 1100, 256), -1, -256, 2**62, 2**63 - 1, -(2**63)]
    references = spark.createDataFrame([(e, str(abs(e) % 7)) for e in ids], "example_id BIGINT, reference STRING")

    def run(rows):
        spark.createDataFrame([("exp", *row) for row in rows], GENERATIONS).repartition(3).write.mode("append").parquet(landing)
        query = accuracy_stream(stream_generations(spark, landing), references, counters, progress)
        query.awaitTermination()
        found = {r["format_id"]: (round(r["accuracy"] * r["n_scored"]), r["n_scored"]) for r in latest_accuracy(spark, counters).collect()}
        return found, sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"])

    right = {e: e % 3 == 0 for e in ids}
    found, n_updated = run([(f, e, str(abs(e) % 7) if right[e] else "8") for f in (0, 1) for e in ids])
    assert found == {f: (sum(right.values()), len(ids)) for f in (0, 1)}
    assert n_updated == 2 * (2 + 5)
    # Again: some turn wrong, some right, some stay; the greater of two strings counts.
    again = {e: e % 2 == 0 for e in ids[::5]}
    rows = [(0, e, str(abs(e) % 7) if value else "9") for e, value in again.items()]
    found, _ = run(rows + [(0, e, "") for e in again])
    assert found == {0: (sum({**right, **again}.values()), len(ids)), 1: (sum(right.values()), len(ids))}


def test_generations_are_written_where_they_are(spark, tmp_path):
    """A file per task and format: nothing is dealt out anew, and more formats than open files come through, too."""
    path = str(tmp_path / "generations")
    rows = spark.range(0, 400, 1, 4).selectExpr("'exp' AS experiment", "CAST(id % 50 AS INT) AS format_id", "id AS example_id", "'x' AS generation")
    generation_files.write_generations(rows, path)
    assert generation_files.read_stored_generations(spark, path).distinct().count() == 400
    assert {len([f for f in os.listdir(f"{path}/experiment=exp/format_id={k}") if f.endswith(".parquet")]) for k in range(50)} == {4}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_arrays_from_partitions_in_order(spark, tmp_path):
    """Partitions that follow each other by ordinal are written as they are, compressed if asked; others are refused."""
    import gzip

    path = str(tmp_path / "arrays")
    texts = spark.createDataFrame([(n, text) for n, text in enumerate(TEXTS * 20)], "ordinal BIGINT, generation STRING")
    rows = texts.repartitionByRange(4, "ordinal").selectExpr("explode(array('one', 'two')) AS experiment", "1 AS format_id", "*")
    generation_files.write_generation_arrays(rows, path, in_order=True, compression="gzip")
    for experiment in ("one", "two"):
        folder = os.path.join(path, f"experiment={experiment}", "array=generations_format_spec_1.json")
        parts = sorted(name for name in os.listdir(folder) if name.startswith("part-"))
        assert len(parts) == 6 and all(name.endswith(".gz") for name in parts)
        assert json.loads(b"".join(gzip.open(os.path.join(folder, name)).read() for name in parts)) == TEXTS * 20
    found = generation_files.read_generations(spark, path, with_experiment=True)
    assert sorted(map(tuple, found.collect())) == sorted((e, 1, n, text) for e in ("one", "two") for n, text in enumerate(TEXTS * 20))
    shuffled = rows.repartition(4, "generation")
    with pytest.raises(Exception, match="not in order"):
        generation_files.write_generation_arrays(shuffled, path, in_order=True)
    with pytest.raises(Exception, match="ordinals are not"):
        generation_files.write_generation_arrays(rows.filter("ordinal <> 7"), path, in_order=True)
    assert generation_files.read_generations(spark, path).count() == 2 * 20 * len(TEXTS)


def test_a_folder_is_scored_without_moving_its_texts(spark, tmp_path, toy_examples, monkeypatch):
    """Ordinals meet short answers, not texts; and documents in order are so before they are multiplied."""
    from formlens.plans import studies
    from formlens.queries import inputs

    seen = []
    monkeypatch.setattr(studies, "predicted_accuracy", lambda answers, *rest, **named: seen.append(answers.columns) or predicted(answers, *rest, **named), raising=False)
    from formlens.operators.scoring import predicted_accuracy as predicted

    examples, arrays = str(tmp_path / "examples"), str(tmp_path / "arrays")
    example_files.write_sorted_examples(toy_examples, examples)
    rows = [("exp", 0, n, text) for n, text in enumerate(["so 0", "it is 42", "7"])]
    generation_files.write_generation_arrays(spark.createDataFrame(rows, "experiment STRING, format_id INT, ordinal BIGINT, generation STRING"), arrays)
    found = studies.evaluate_folder(spark, examples, arrays).accuracy.collect()
    assert [(round(r["accuracy"], 6), r["n_scored"]) for r in found] == [(0.666667, 3)]
    assert len(seen) == 1 and "generation" not in seen[0]
    documents = spark.range(6).selectExpr("id AS doc_id", "'text' AS text", "4L AS n_chars", "5 - id AS ordinal")
    plan = inputs.generations_in_order(documents, "ordinal")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.index("Generate") < plan.index("rangepartitioning")
