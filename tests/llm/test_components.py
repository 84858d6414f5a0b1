import random

from formlens.llm.common import components, fresh_name, sampled


def by_force(edges):
    name = {}
    for a, b in edges:
        name.setdefault(a, a)
        name.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(name[a], name[b])
            changed |= name[a] != least or name[b] != least
            name[a] = name[b] = least
    return {(n, c) for n, c in name.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_chains_hubs_and_loops(spark):
    rng = random.Random(6)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False))
    edges += [(500, k) for k in range(501, 620)] + [(k, 700) for k in range(600, 640)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    edges += [(7, 7), (8, 9), (9, 8), (8, 9), (-5, 8)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = [tuple(row) for row in components(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == by_force(edges)
    assert components(frame.limit(0)).count() == 0
    assert components(frame.filter("a = b")).count() == 0


def test_names_and_samples(spark):
    frame = spark.range(2000).selectExpr("id", "id AS N", "id AS _n")
    assert fresh_name(frame, "n") == "__n" and fresh_name(frame, "m") == "m"
    assert 50 < sampled(frame, 200, "id").count() < 400
    assert sampled(frame, 5000, "id").count() == 2000 and sampled(frame.limit(0), 5, "id").count() == 0
