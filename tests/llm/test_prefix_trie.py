import hashlib
import random
import zlib

import pytest

from formlens.llm.prefix_trie import numbered_turns, prefix_trie, shared_heads

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, depth STRING, total INT, C1 INT"


def by_force(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [row[2:] for row in sorted(turns)] for conv, turns in own.items()}
    nodes = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        head = conv - (abs(conv) % 5 if conv >= 0 else -(abs(conv) % 5))
        rebuilt = tuple(own.get(head, [])[:h] + turns[h:])
        for depth in range(len(rebuilt) + 1):
            nodes.setdefault(rebuilt[:depth], []).append((conv, len(rebuilt) == depth))
    children = {}
    for prefix in nodes:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    totals = {}
    for prefix in sorted(nodes, key=len, reverse=True):
        below = [totals[child] for child in children.get(prefix, [])]
        saved = (len(nodes[prefix]) - 1) * (len(prefix[-1][1].encode()) if prefix else 0)
        totals[prefix] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    found = set()
    for prefix, members in nodes.items():
        ends = ",".join(str(conv) for conv in sorted(conv for conv, ends in members if ends))
        found.add((
            min(members)[0], len(prefix), min(nodes[prefix[:-1]])[0] if prefix else None, len(members),
            len(children.get(prefix, [])), *totals[prefix], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return found


def trie(spark, rows):
    frame = spark.createDataFrame([(*row, "x", 1, 2) for row in rows], SCHEMA).repartition(3)
    return [tuple(row[name] for name in COLUMNS) for row in prefix_trie(*shared_heads(numbered_turns(frame))).collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), 103, 104, -7, -5, 1 << 40]:
        for turn in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((conv, turn if turn or rng.random() < 0.5 else None, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""])))
    rows += [(3, 1, None, None), (9, None, "user", None), (None, 0, "user", "nobody's"), (200, 0, "user", "a" * 200_000)]
    rows += [(conv, turn, "user", "same") for conv in range(300, 400) for turn in range(3)]
    rows += [(500, turn, "user", str(turn)) for turn in range(130)] + [(505, turn, "user", str(turn)) for turn in range(70)]
    found = trie(spark, rows)
    assert len(found) == len(set(found)) and set(found) == by_force(rows)


def test_turnless_conversations_and_empty_tables(spark):
    without = next(conv for conv in range(1, 999) if conv % 5 and zlib.crc32(str(conv).encode()) % 9 > 1)
    assert set(trie(spark, [(without, 0, "user", "gone")])) == by_force([(without, 0, "user", "gone")])
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "a")]) == []


@pytest.mark.parametrize("n", [1, 2, 20_000])
def test_long_lists_of_ends(spark, n):
    frame = spark.range(n).selectExpr("id * 5 AS conv_id", "0L AS turn", "'user' AS role", "'hello' AS text")
    rows = prefix_trie(*shared_heads(numbered_turns(frame))).collect()
    ends = ",".join(str(5 * k) for k in range(n))
    assert {(row["depth"], row["n_convs"], row["saved_tokens"]) for row in rows} == {(0, n, 5 * (n - 1)), (1, n, 5 * (n - 1))}
    assert {row["ends_sha256"] for row in rows if row["depth"]} == {hashlib.sha256(ends.encode()).hexdigest()}
