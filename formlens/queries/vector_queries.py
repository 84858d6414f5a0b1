"""Queries over hidden states, differences, directions and projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions.vectors import dot, norm
from formlens.operators import differences, directions, projection, singular
from formlens.operators import states as st
from formlens.operators.dimensions import as_array
from formlens.operators.sampling import hash_ranked
from formlens.operators.sampling import sample_pairs as drawn_pairs
from formlens.queries import inputs as at
from formlens.queries.text_queries import SQL, query, rounded
from formlens.session import scratch_path
from formlens.sources import states as state_files

N_BLOCKS, BLOCK_SIZE = 32, 32
N_PAIRS = 512


def shape(vectors: DataFrame, column: str, *keys: str) -> DataFrame:
    """A vector by figures that change when any element does: size, length, weighted sum."""
    places = F.transform(F.sequence(F.lit(1), F.size(column)), lambda i: i.cast("double"))
    return vectors.select(
        *keys,
        F.size(column).alias("width"),
        (F.round(norm(F.col(column)), 6) + 0.0).alias("length"),
        (F.round(dot(F.col(column), places), 6) + 0.0).alias("weighted"),
    )


def shape_sql(source: str, column: str, *keys: str) -> str:
    """``source`` has one row per element: the keys, ``pos`` from 0, and the value."""
    return f"""
SELECT {', '.join(keys)}, CAST(count(*) AS INT) AS width, round(sqrt(sum({column} * {column})), 6) + 0.0 AS length,
       round(sum({column} * (pos + 1)), 6) + 0.0 AS weighted
FROM ({source}) GROUP BY {', '.join(keys)}"""


def elements_sql(source: str, *keys: str, vector: str = "embedding") -> str:
    return (
        f"SELECT {', '.join(keys)}, generate_subscripts({vector}, 1) - 1 AS pos, CAST(unnest({vector}) AS DOUBLE) AS x FROM ({source})"
    )


STATE_KEYS = ("format_id", "example_id", "layer")
STATE_ELEMENTS = elements_sql(at.STATES_SQL, *STATE_KEYS)
LABELLED_ELEMENTS = elements_sql(at.LABELLED_SQL, "vec_id", "is_target")


@query(shape_sql(f"SELECT * FROM ({STATE_ELEMENTS}) WHERE layer = 1", "x", *STATE_KEYS))
def read_hidden_states(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "hidden-states")
    state_files.write_hidden_states(at.states(spark, folder), path)
    found = state_files.read_hidden_states(spark, path, layer=1, format_ids=list(range(at.N_FORMATS + 2)))
    return shape(found, "embedding", *STATE_KEYS)


@query(shape_sql(f"SELECT * FROM ({STATE_ELEMENTS}) WHERE layer = 1", "x", *STATE_KEYS))
def select_layer(spark: SparkSession, folder: str) -> DataFrame:
    return shape(st.select_layer(at.states(spark, folder), fraction=0.55), "embedding", *STATE_KEYS)


@query(f"""
SELECT format_id, layer, count(*) AS n_rows, CAST(min(len(embedding)) AS INT) AS min_size,
       CAST(max(len(embedding)) AS INT) AS max_size,
       bool_or(list_contains(list_transform(embedding, lambda x: isnan(x) OR isinf(x)), true)) AS has_broken
FROM ({at.STATES_SQL}) GROUP BY ALL""")
def vector_quality(spark: SparkSession, folder: str) -> DataFrame:
    return st.vector_quality(at.states(spark, folder))


TOKENS = [
    "0 AS format_id", "CAST(floor(vec_id / 7) AS BIGINT) AS example_id", "0 AS layer", "vec_id % 7 AS position", "embedding",
]


@query(shape_sql(elements_sql(
    f"SELECT {', '.join(TOKENS)} FROM embeddings QUALIFY position = max(position) OVER (PARTITION BY example_id)", *STATE_KEYS
), "x", *STATE_KEYS))
def last_token_states(spark: SparkSession, folder: str) -> DataFrame:
    """Seven vectors in a row are the tokens of one sequence."""
    tokens = at.table(spark, folder, "embeddings").selectExpr(*TOKENS)
    return shape(st.last_token_states(tokens), "embedding", *STATE_KEYS)


# Differences


def draw_sql(index: str, side: str, size: str) -> str:
    return f"('0x' || left(md5('{at.SEED}:' || {index} || ':{side}'), 15))::BIGINT % ({size})"


LAYER_SQL = f"SELECT format_id, example_id, pos, x FROM ({STATE_ELEMENTS}) WHERE layer = 1"
PAIRS_SQL = f"""
WITH ids AS (SELECT DISTINCT example_id FROM ({at.STATES_SQL}) WHERE layer = 1),
ranked AS (SELECT example_id, row_number() OVER (ORDER BY md5('{at.SEED}:' || example_id), example_id) - 1 AS example_pos FROM ids),
formats AS (SELECT list(DISTINCT format_id ORDER BY format_id) AS f FROM ({at.STATES_SQL}) WHERE layer = 1),
drawn AS (
    SELECT i AS pair_id, {draw_sql(f"(i // {BLOCK_SIZE})", "first", "SELECT len(f) FROM formats")} AS a,
           {draw_sql(f"(i // {BLOCK_SIZE})", "step", "SELECT len(f) - 1 FROM formats")} AS step,
           {draw_sql("i", "example", "SELECT count(*) FROM ids")} AS example_pos
    FROM range({N_BLOCKS * BLOCK_SIZE}) AS r(i))
SELECT pair_id, f[a + 1] AS fmt_a, f[(a + 1 + step) % len(f) + 1] AS fmt_b, example_id
FROM drawn JOIN ranked USING (example_pos), formats"""


def layer_one(spark: SparkSession, folder: str) -> DataFrame:
    return st.select_layer(at.states(spark, folder), 1)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return differences.sampled_format_pairs(layer_one(spark, folder), N_BLOCKS, BLOCK_SIZE, at.SEED)


@query(PAIRS_SQL)
def sample_format_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder)


def unit_sql(raw: str, epsilon: str, *keys: str) -> str:
    """``raw`` has the keys, ``pos`` and ``d``; the result divides by the length of each difference."""
    each = ", ".join(keys)
    return f"SELECT {each}, pos, d / (sqrt(sum(d * d) OVER (PARTITION BY {each})) + {epsilon}) AS x FROM ({raw})"


PAIR_KEYS = ("pair_id", "fmt_a", "fmt_b", "example_id")
PAIR_DIFFS_SQL = unit_sql(
    f"""SELECT pair_id, fmt_a, fmt_b, p.example_id, a.pos, a.x - b.x AS d FROM ({PAIRS_SQL}) AS p
        JOIN ({LAYER_SQL}) AS a ON a.format_id = fmt_a AND a.example_id = p.example_id
        JOIN ({LAYER_SQL}) AS b ON b.format_id = fmt_b AND b.example_id = p.example_id AND a.pos = b.pos""",
    "1e-8", *PAIR_KEYS,
)


@query(shape_sql(PAIR_DIFFS_SQL, "x", *PAIR_KEYS))
def format_pair_diffs(spark: SparkSession, folder: str) -> DataFrame:
    diffs = differences.format_pair_diffs(layer_one(spark, folder), pairs(spark, folder))
    return shape(diffs, "diff", *PAIR_KEYS)


CONTRAST_KEYS = ("fmt_a", "fmt_b", "example_id")
CONTRAST_SQL = unit_sql(
    f"""SELECT a.format_id AS fmt_a, b.format_id AS fmt_b, a.example_id, a.pos, a.x - b.x AS d
        FROM ({LAYER_SQL}) AS a JOIN ({LAYER_SQL}) AS b ON a.example_id = b.example_id AND a.pos = b.pos
        AND a.format_id = 3 AND b.format_id <> 3""",
    "1e-8", *CONTRAST_KEYS,
)


def contrasts(spark: SparkSession, folder: str) -> DataFrame:
    return differences.contrast_diffs(layer_one(spark, folder), 3)


@query(shape_sql(CONTRAST_SQL, "x", *CONTRAST_KEYS))
def contrast_diffs(spark: SparkSession, folder: str) -> DataFrame:
    return shape(contrasts(spark, folder), "diff", *CONTRAST_KEYS)


def member_sql(is_target: str) -> str:
    return (
        f"SELECT vec_id, row_number() OVER (ORDER BY md5('{at.SEED}:' || vec_id), vec_id) - 1 AS place"
        f" FROM embeddings WHERE (label = 0) = {is_target}"
    )


GROUP_PAIRS_SQL = f"""
WITH t AS ({member_sql('true')}), b AS ({member_sql('false')}),
drawn AS (SELECT i AS pair_id, {draw_sql('i', 'left', 'SELECT count(*) FROM t')} AS left_pos,
                 {draw_sql('i', 'right', 'SELECT count(*) FROM b')} AS right_pos FROM range({N_PAIRS}) AS r(i))
SELECT pair_id, left_pos, right_pos, t.vec_id AS target_id, b.vec_id AS baseline_id
FROM drawn JOIN t ON left_pos = t.place JOIN b ON right_pos = b.place"""


@query(GROUP_PAIRS_SQL)
def sample_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Positions drawn with replacement from two groups, and the vectors they stand for."""
    vectors = at.labelled(spark, folder)
    target, baseline = vectors.filter("is_target"), vectors.filter("NOT is_target")
    sizes = [group.agg(F.count("*").alias("n")).scalar() for group in (target, baseline)]
    found = drawn_pairs(spark, N_PAIRS, at.SEED, *sizes)
    for group, side in ((target, "left_pos"), (baseline, "right_pos")):
        name = "target_id" if side == "left_pos" else "baseline_id"
        ranked = hash_ranked(group.select("vec_id"), at.SEED, "vec_id")
        found = found.join(ranked.select(F.col("sample_rank").alias(side), F.col("vec_id").alias(name)), side)
    return found


GROUP_DIFFS_SQL = unit_sql(
    f"""SELECT pair_id, a.pos, a.x - b.x AS d FROM ({GROUP_PAIRS_SQL}) AS p
        JOIN ({LABELLED_ELEMENTS}) AS a ON a.vec_id = target_id
        JOIN ({LABELLED_ELEMENTS}) AS b ON b.vec_id = baseline_id AND a.pos = b.pos""",
    "1e-12", "pair_id",
)


@query(shape_sql(GROUP_DIFFS_SQL, "x", "pair_id"))
def group_pair_diffs(spark: SparkSession, folder: str) -> DataFrame:
    return shape(differences.group_pair_diffs(at.labelled(spark, folder), N_PAIRS, at.SEED), "diff", "pair_id")


# Directions

MEAN_SQL = f"SELECT pos, avg(x) FILTER (is_target) - avg(x) FILTER (NOT is_target) AS d FROM ({LABELLED_ELEMENTS}) GROUP BY pos"
MEAN_DIRECTION_SQL = f"SELECT pos, d / sqrt(sum(d * d) OVER ()) AS x FROM ({MEAN_SQL})"


@query(f"SELECT CAST(pos AS INT) AS pos, round(x, 6) + 0.0 AS x FROM ({MEAN_DIRECTION_SQL})")
def group_mean_direction(spark: SparkSession, folder: str) -> DataFrame:
    found = directions.group_mean_direction(at.labelled(spark, folder))
    return found.select(F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6) + 0.0)


LABEL_ELEMENTS = elements_sql("SELECT vec_id, label, embedding FROM embeddings", "vec_id", "label")
LABEL_MEANS_SQL = f"SELECT label, pos, avg(x) AS x FROM ({LABEL_ELEMENTS}) GROUP BY label, pos"


@query(f"""
SELECT a.label AS name_a, b.label AS name_b,
       round(sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)), 6) + 0.0 AS cosine
FROM ({LABEL_MEANS_SQL}) AS a JOIN ({LABEL_MEANS_SQL}) AS b USING (pos) GROUP BY ALL""")
def direction_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Cosines between the mean vectors of the labels."""
    means = directions.group_means(at.table(spark, folder, "embeddings"), "label")
    named = means.select(F.col("label").alias("name"), F.col("mean").alias("vector"))
    return directions.direction_similarity(named).withColumn("cosine", F.round("cosine", 6) + 0.0)


@query(f"""
WITH d AS (SELECT fmt_b, example_id, pos, x FROM ({CONTRAST_SQL}))
SELECT CAST(a.pos AS INT) AS row_idx, CAST(b.pos AS INT) AS col_idx, round(sum(a.x * b.x), 6) + 0.0 AS value
FROM d AS a JOIN d AS b USING (fmt_b, example_id) GROUP BY ALL""")
def gram_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = directions.gram_rows(contrasts(spark, folder)).filter("row_idx >= 0")
    cells = rows.select("row_idx", F.posexplode("values").alias("col_idx", "value"))
    return cells.withColumn("value", F.round("value", 6) + 0.0)


CHECKED_DIRECTIONS = 5


@query(f"""
SELECT CAST(component AS INT) AS component, 1.0::DOUBLE AS length, 0.0::DOUBLE AS residual,
       (SELECT round(sum(x * x), 6) FROM ({CONTRAST_SQL})) AS total_variance
FROM range({CHECKED_DIRECTIONS}) AS r(component)""")
def principal_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Every direction v must have unit length and satisfy (XᵀX) v = s² v; the trace must match."""
    diffs = contrasts(spark, folder)
    found = directions.principal_directions(diffs, CHECKED_DIRECTIONS)
    axes = as_array(found, "component")
    gram = directions.gram_rows(diffs).filter("row_idx >= 0").select("*", F.explode(axes).alias("d"))
    image = dot(F.col("values"), F.col("d.vector"))
    expected = F.col("d.singular_value") ** 2 * F.element_at("d.vector", F.col("row_idx") + 1)
    return gram.groupBy("d.component").agg(
        F.round(norm(F.first("d.vector")), 6).alias("length"),
        F.abs(F.round(F.max(F.abs(image - expected)), 6)).alias("residual"),
        F.round(F.first("d.total_variance"), 6).alias("total_variance"),
    )


@query(SQL["principal_directions"])
def singular_directions(spark: SparkSession, folder: str) -> DataFrame:
    """The same for directions by a tree of QR factors; the Gram matrix only checks them."""
    diffs = contrasts(spark, folder)
    found = singular.singular_directions(diffs, CHECKED_DIRECTIONS)
    gram = directions.gram_rows(diffs).filter("row_idx >= 0").select("*", F.explode(as_array(found, "component")).alias("d"))
    image = dot(F.col("values"), F.col("d.vector"))
    expected = F.col("d.singular_value") ** 2 * F.element_at("d.vector", F.col("row_idx") + 1)
    return gram.groupBy("d.component").agg(
        F.round(norm(F.first("d.vector")), 6).alias("length"),
        F.abs(F.round(F.max(F.abs(image - expected)), 6)).alias("residual"),
        F.round(F.first("d.total_variance"), 6).alias("total_variance"),
    )


def gram_sql(elements: str, *keys: str) -> str:
    each = ", ".join(keys)
    return f"""
WITH d AS ({elements}), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT {each} FROM d)),
m AS (SELECT pos, avg(x) AS m FROM d GROUP BY pos),
g AS (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS g FROM d AS a JOIN d AS b USING ({each}) GROUP BY ALL)"""


@query(f"""{gram_sql(GROUP_DIFFS_SQL, "pair_id")},
c AS (SELECT i, j, g - n * a.m * b.m AS g FROM g JOIN m AS a ON a.pos = i JOIN m AS b ON b.pos = j, n)
SELECT 64::BIGINT AS n_directions, (SELECT round(sum(g), 6) FROM c WHERE i = j) AS sum_squares,
       (SELECT round(sum(g * g), 4) FROM c) AS sum_fourths,
       (SELECT round(sum(m * (pos + 1)) / sqrt(sum(m * m)), 6) FROM m) AS mean_weighted""")
def centred_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and centred principal directions of random group pairs.

    Sums of squared and fourth powers of the singular values are the trace and the squared
    norm of the centred Gram matrix.
    """
    diffs = differences.group_pair_diffs(at.labelled(spark, folder), N_PAIRS, at.SEED)
    found = directions.principal_directions(diffs, 64, center=True, prepend_mean=True)
    weighted = shape(found.filter("kind = 'mean'"), "vector").select("weighted")
    powers = found.filter("kind = 'principal'").agg(
        F.count("*").alias("n_directions"),
        F.round(F.sum(F.col("singular_value") ** 2), 6).alias("sum_squares"),
        F.round(F.sum(F.col("singular_value") ** 4), 4).alias("sum_fourths"),
    )
    return powers.select("*", weighted.scalar().alias("mean_weighted"))


@query(f"""{gram_sql(CONTRAST_SQL, "fmt_b", "example_id")}
SELECT 64::BIGINT AS n_directions, 1.0::DOUBLE AS all_shares,
       round((SELECT sum(g * g) FROM g) / (SELECT sum(g) FROM g WHERE i = j) ** 2, 6) AS sum_squared_shares""")
def explained_variance(spark: SparkSession, folder: str) -> DataFrame:
    """Over all directions the shares add up to one, and their squares follow from the Gram matrix."""
    shares = directions.explained_variance(directions.principal_directions(contrasts(spark, folder), 64))
    return shares.agg(
        F.count("*").alias("n_directions"),
        F.round(F.max("running_share"), 6).alias("all_shares"),
        F.round(F.sum(F.col("share") ** 2), 6).alias("sum_squared_shares"),
    )


# Projections: the mean vectors of labels 0 and 1 are taken out one after the other.

AXES_SQL = f"SELECT label AS component, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS v FROM ({LABEL_MEANS_SQL}) WHERE label < 2"


def label_axes(spark: SparkSession, folder: str, n: int = 2) -> DataFrame:
    means = directions.group_means(at.table(spark, folder, "embeddings"), "label")
    return means.filter(F.col("label") < n).select(F.col("label").alias("component"), F.col("mean").alias("vector"))


def removed_sql(source: str, component: int, weight: float) -> str:
    axis = f"SELECT pos, v FROM ({AXES_SQL}) WHERE component = {component}"
    return f"SELECT vec_id, pos, x - {weight} * v * sum(x * v) OVER (PARTITION BY vec_id) AS x FROM ({source}) JOIN ({axis}) USING (pos)"


VECTORS_SQL = elements_sql("SELECT vec_id, embedding FROM embeddings", "vec_id")
WITHOUT_ONE_SQL = removed_sql(VECTORS_SQL, 0, 0.5)
WITHOUT_BOTH_SQL = removed_sql(removed_sql(VECTORS_SQL, 0, 1.0), 1, 1.0)


@query(shape_sql(WITHOUT_ONE_SQL, "x", "vec_id"))
def project_out(spark: SparkSession, folder: str) -> DataFrame:
    """Half of one direction is taken out."""
    vectors = at.table(spark, folder, "embeddings")
    return shape(projection.project_out(vectors, label_axes(spark, folder, 1), 0.5), "embedding", "vec_id")


@query(shape_sql(WITHOUT_BOTH_SQL, "x", "vec_id"))
def project_out_all(spark: SparkSession, folder: str) -> DataFrame:
    vectors = at.table(spark, folder, "embeddings")
    return shape(projection.project_out_all(vectors, label_axes(spark, folder)), "embedding", "vec_id")


def overlap_sql(source: str, when: str) -> str:
    return f"""
SELECT component, max(size) AS max_{when}, avg(size) AS mean_{when} FROM (
    SELECT vec_id, component, abs(sum(x * v)) AS size FROM ({source}) JOIN ({AXES_SQL}) USING (pos) GROUP BY ALL) GROUP BY ALL"""


@query(f"""
SELECT component, round(max_before, 6) AS max_before, round(mean_before, 6) AS mean_before,
       round(max_after, 6) AS max_after, round(mean_after, 6) AS mean_after
FROM ({overlap_sql(VECTORS_SQL, 'before')}) JOIN ({overlap_sql(WITHOUT_BOTH_SQL, 'after')}) USING (component)""")
def projection_residual(spark: SparkSession, folder: str) -> DataFrame:
    vectors, axes = at.table(spark, folder, "embeddings"), label_axes(spark, folder)
    after = projection.project_out_all(vectors, axes)
    sizes = projection.projection_residual(vectors, after, axes)
    return rounded(sizes, "max_before", "mean_before", "max_after", "mean_after")


COLUMN_AXIS_SQL = "SELECT pos, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT pos, x AS v FROM ({means}) WHERE label = 0 AND pos < 4)"
MATRICES_SQL = elements_sql("SELECT vec_id // 4 AS matrix_id, CAST(vec_id % 4 AS INT) AS row_idx, embedding FROM embeddings", "matrix_id", "row_idx")


@query(shape_sql(f"""
SELECT matrix_id, row_idx, pos, x - v * sum(v * x) OVER (PARTITION BY matrix_id, pos) AS x
FROM ({MATRICES_SQL}) JOIN (SELECT pos AS row_idx, v FROM ({COLUMN_AXIS_SQL.format(means=LABEL_MEANS_SQL)})) USING (row_idx)""",
    "x", "matrix_id", "row_idx"))
def project_out_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Four vectors in a row are the rows of one matrix; the last one may have fewer."""
    matrices = at.table(spark, folder, "embeddings").selectExpr(
        "CAST(floor(vec_id / 4) AS BIGINT) AS matrix_id", "CAST(vec_id % 4 AS INT) AS row_idx", "embedding AS values"
    )
    axis = label_axes(spark, folder, 1).select(F.slice("vector", 1, 4).alias("vector"))
    return shape(projection.project_out_columns(matrices, axis, partial=True), "values", "matrix_id", "row_idx")
