import numpy as np
import pytest

from formlens.llm.vector_dedup import near_vectors, possible_links, quantised


def brute_force(rows):
    fine = {
        k: np.array(v, dtype=float)
        for k, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    group, links = list(range(len(rows))), [0] * len(rows)
    for a in fine:
        for b in fine:
            if a < b and len(fine[a]) == len(fine[b]):
                if fine[a] @ fine[b] / (np.linalg.norm(fine[a]) * np.linalg.norm(fine[b])) >= 0.9:
                    links[a] += 1
                    links[b] += 1
                    old, new = group[b], group[a]
                    group = [new if g == old else g for g in group]
    names = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            names[g] = min(i, names.get(g, i))
    return sorted(((i, n, names.get(g), i == names.get(g)) for n, g, (i, _) in zip(links, group, rows, strict=True)), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    out = []
    for _ in range(25):
        centre = draw.normal(size=24)
        for _ in range(6):
            out.append((centre + draw.normal(size=24) * draw.uniform(0, 0.6)).astype(np.float32).tolist())
    out += [out[0]] * 5 + [[-0.0] + out[1][1:], [0.0] + out[1][1:], [2 * x for x in out[2]]]
    rows = [(int(i), v) for i, v in zip(draw.permutation(len(out)), out, strict=True)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    return rows + [(1000 + k, v) for k, v in enumerate(odd)] + [(None, out[3]), (None, None), (2000, [2.0, 4.0])]


def test_against_all_pairs(spark, rows):
    frame = spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<float>, copies int").repartition(3)
    want = brute_force(rows)
    for block_rows in (7, 4096):
        assert sorted(map(tuple, near_vectors(frame, block_rows=block_rows).collect()), key=str) == want


def test_bounds_miss_nothing():
    draw = np.random.default_rng(1)
    left, right = draw.normal(size=(300, 16)), draw.normal(size=(200, 16))
    right[:100] = left[:100] + draw.normal(size=(100, 16)) * 0.45
    cosines = left @ right.T / np.outer(np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1))
    for threshold in (0.5, 0.9, 0.0, -0.3):
        found = {(a, b) for r, c in possible_links(quantised(left), quantised(right), threshold) for a, b in zip(r, c, strict=True)}
        wanted = set(zip(*np.nonzero(cosines >= threshold), strict=True))
        assert wanted <= found
        assert len(found - wanted) < 0.05 * cosines.size


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_very_small_and_very_large_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [base, base * 1e-200, base * 1e200, -base, base + 1e-9, rng.normal(size=8) * 1e-300, np.full(8, 5e-324), np.full(8, 1.7e308)]
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(rows)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    found = {row["vec_id"]: (row["n_links"], row["component_id"]) for row in near_vectors(frame).collect()}
    assert [found[k] for k in (0, 1, 2, 3, 4, 6, 7)] == [(3, 0), (3, 0), (3, 0), (0, 3), (3, 0), (1, 6), (1, 6)]
