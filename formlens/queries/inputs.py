"""Study tables derived from the shared tables: whole tables, whole texts, row by row.

Every table comes twice, as a DataFrame and as the same SELECT in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.fixed_values import DESCRIPTORS, END_TAG, INSTRUCTION_TAG, RESPONSE_TAG, SEPARATORS, SPACES, TRANSFORMS
from formlens.plans.studies import study_formats

SEED = 24
N_FORMATS = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


# A document is an example: its first half asks, its second half reasons, its length is the answer.
HALF = "CAST(floor(length(text) / 2) AS INT)"
QUESTION = f"substr(text, 1, {HALF})"
ANSWER = f"concat(substr(text, {HALF} + 1), ' #### ', CAST(n_chars AS {{string}}))"
EXAMPLES_SQL = f"SELECT doc_id AS example_id, {QUESTION} AS question, {ANSWER.format(string='VARCHAR')} AS answer FROM documents"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by key, at every size: a small part of the product that each is about to become."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def examples(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).selectExpr(
        "doc_id AS example_id", f"{QUESTION} AS question", f"{ANSWER.format(string='STRING')} AS answer"
    )


def dealt_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples for a product with formats."""
    return dealt(examples(spark, folder), "example_id")


PARSED_SQL = f"""
SELECT example_id, question, split_part(answer, '####', 1) AS reasoning, split_part(answer, '####', 2) AS answer
FROM ({EXAMPLES_SQL})"""

# A generation repeats its document, then gives a number that is right for a share of formats.
# One document in fifty has no answer sentence, one in four goes on after the end tag.
EXPERIMENTS = ["qwen1b", "Llama-3.2-1B-Instruct"]
GENERATION = """
concat(text, CASE WHEN doc_id % 50 = 0 THEN ' no idea' ELSE concat(
    {newline}, 'Step 1-', CAST(format_id AS {string}), '. So the result is ',
    CAST(n_chars + CASE WHEN (doc_id * 7 + format_id * (3 + model)) % 10 < 5 + format_id % 4 THEN 0 ELSE 1 END AS {string}),
    '.', CASE WHEN doc_id % 4 = 0 THEN '<end_of_response> 99' ELSE '' END) END)"""
GENERATIONS_SQL = f"""
SELECT {EXPERIMENTS!r}[model + 1] AS experiment, CAST(format_id AS INT) AS format_id, doc_id AS example_id,
       {GENERATION.format(string='VARCHAR', newline='chr(10)')} AS generation
FROM documents, range({N_FORMATS}) AS f(format_id), range({len(EXPERIMENTS)}) AS m(model)"""


def answered(documents: DataFrame, *kept: str) -> DataFrame:
    """Every document's generations, where the document is; ``kept`` are columns that go along."""
    each = documents.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_FORMATS - 1))).alias("format_id"))
    each = each.select("*", F.posexplode(F.array(*[F.lit(name) for name in EXPERIMENTS])).alias("model", "experiment"))
    text = GENERATION.format(string="STRING", newline="char(10)")
    return each.selectExpr("experiment", "format_id", "doc_id AS example_id", *kept, f"{text} AS generation")


def generations(spark: SparkSession, folder: str) -> DataFrame:
    return answered(dealt(documents(spark, folder), "doc_id"))


def generations_in_order(documents: DataFrame, ordinal: str) -> DataFrame:
    """Generations with ``ordinal``: the documents lie in its order, partition after partition, before they are multiplied."""
    n_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return answered(documents.repartitionByRange(n_parts, ordinal), ordinal)


# Twenty vectors in a row are one example: ten formats in two layers.
STATES = [
    "CAST(vec_id % 10 AS INT) AS format_id",
    "CAST(floor(vec_id / 20) AS BIGINT) AS example_id",
    "CAST(floor(vec_id / 10) % 2 AS INT) AS layer",
    "embedding",
]
STATES_SQL = f"SELECT {', '.join(STATES)} FROM embeddings"


def states(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(*STATES)


LABELLED_SQL = "SELECT vec_id, embedding, label = 0 AS is_target FROM embeddings"


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr("vec_id", "embedding", "label = 0 AS is_target")


# Conversation turns as prompts, and as answers that only sometimes have two parts.
TURNS = ["conv_id * 100 + turn AS example_id", "role AS question", "text AS answer"]
TURNS_SQL = f"SELECT {', '.join(TURNS)} FROM conversations"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").selectExpr(*TURNS)


def formats(spark: SparkSession, n: int = N_FORMATS) -> DataFrame:
    return study_formats(spark, n, SEED)


def sql_string(text: str) -> str:
    parts = text.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")
    return f"('{parts}')"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_string(value) for value in values) + "]"


GRID_SQL = f"""
SELECT CAST(i AS INT) AS idx, CAST(i // {len(SPACES) * len(TRANSFORMS)} AS INT) AS separator_pos,
       CAST(i // {len(TRANSFORMS)} % {len(SPACES)} AS INT) AS space_pos, CAST(i % {len(TRANSFORMS)} AS INT) AS transform_pos,
       {sql_list(SEPARATORS)}[separator_pos + 1] AS separator, {sql_list(SPACES)}[space_pos + 1] AS space,
       {sql_list(TRANSFORMS)}[transform_pos + 1] AS transform
FROM range({len(SEPARATORS) * len(SPACES) * len(TRANSFORMS)}) AS r(i)"""


def label_sql(name: str) -> str:
    word = sql_string(name)
    return (
        f"CASE transform WHEN 'identity' THEN {word} WHEN 'title' THEN upper(left({word}, 1)) || lower(substr({word}, 2))"
        f" WHEN 'upper' THEN upper({word}) ELSE lower({word}) END"
    )


def formats_sql(n: int = N_FORMATS) -> str:
    first, second, third = DESCRIPTORS
    return f"""
SELECT *, '{first}' AS first_descriptor, '{second}' AS second_descriptor, '{third}' AS third_descriptor,
       '{INSTRUCTION_TAG}' AS instruction_tag, '{RESPONSE_TAG}' AS response_tag, '{END_TAG}' AS end_tag,
       {label_sql(first)} AS first_label, {label_sql(second)} AS second_label, {label_sql(third)} AS third_label
FROM (SELECT CAST(row_number() OVER (ORDER BY md5('{SEED}:' || idx), idx) - 1 AS INT) AS format_id, * FROM ({GRID_SQL}))
WHERE format_id < {n}"""


def rendered_sql(tags: bool, question="question", reasoning="reasoning", answer="answer") -> str:
    """One prompt from the columns of an example and of a labelled format."""
    opening, reply, closing = ("instruction_tag", "response_tag", "end_tag") if tags else ("''", "''", "''")
    return (
        f"{opening} || first_label || separator || {question} || space"
        f" || CASE WHEN coalesce({reasoning}, '') = '' THEN '' ELSE {reply} || second_label || separator || {reasoning} || space END"
        f" || CASE WHEN coalesce({answer}, '') = '' THEN '' ELSE third_label || separator || {answer} || {closing} END"
    )
