import hashlib
import random
import re

import numpy as np
import pytest

from formlens.llm.pii import CARD, EMAIL, IP, PHONE, Graph, SkipChainField, all_spans, base_spans, find_personal_data, joined, passes_luhn, segments, train


def plain_spans(text):
    """The contract by the letter: every match of every pattern, then the checks."""
    def digits(match):
        return re.sub("[^0-9]", "", match.group())

    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(part) <= 255 for part in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and passes_luhn(digits(m))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    ]


def test_base_spans_by_the_letter():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab1.@-+ %é_", k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choices("0123456789 -.+()", weights=[3] * 10 + [2] * 6, k=60)) for _ in range(2000)]
    texts += ["a@b.c@d.e", "a@b@c.d", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4111 1111-1111 1111", "é@a.b", "a" * 9 + "@" + "b.c" * 3]
    for text in texts:
        assert base_spans(text) == plain_spans(text), text


def test_luhn():
    assert passes_luhn("4111111111111111") and not passes_luhn("4111111111111112")


def test_shared_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = find_personal_data(docs, train(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found) for found in base]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))
        assert len(list(filter(None, r.spans.split(",")))) == sum(map(len, base)) + r.n_added
    assert any(r.n_email for r in rows) and any(r.n_card for r in rows)


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        digits = "".join(rng.choices("0123456789", k=7))
        words = [f"word{rng.randint(1, 99)}" if rng.random() < 0.1 else "word" for _ in range(30)]
        words[3] = f"+49 170 {digits}"
        words[20] = f"{rng.choice('abc')}name{k}@host.example"
        words[25] = f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}"
        rows.append((k, " ".join(words)))
    return train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_follow_what_the_patterns_found(field):
    texts = [
        "call +49 170 7654321 today. It was again 7654321, and then some words, 7654321 once more.",
        "write to jane.roe@host.example or jane.roe@intranet in the office",
        "number 7654321 alone, 7654321 twice",
        "plain text with the year 1999 and 42 things",
    ]
    base, added = all_spans(texts, field)
    assert [texts[0][a:b] for a, b in added[0][3]] == ["7654321", "7654321"]
    assert [texts[1][a:b] for a, b in added[1][0]] == ["jane.roe@intranet"]
    assert not any(added[2]) and not any(added[3])


def test_messages_equal_exact_chances_on_a_tree():
    draw = np.random.default_rng(2)
    field = SkipChainField()
    field.unary = draw.normal(size=field.unary.shape)
    field.chain, field.skip = (m + m.T for m in draw.normal(size=(2, 5, 5)))
    features = (draw.random((4, field.unary.shape[0])) < 0.2).astype(float)
    graph = Graph([0] * 4, [], [], np.array([0, 2, 0, 0]), features, np.array([[0, 1], [1, 2]]), np.array([[0, 3]]))
    own = features @ field.unary
    want = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        if labels[1] == 2:
            raw = sum(own[i, k] for i, k in enumerate(labels) if i != 1)
            raw += field.chain[labels[0], labels[1]] + field.chain[labels[1], labels[2]] + field.skip[labels[0], labels[3]]
            for i, k in enumerate(labels):
                want[i, k] += np.exp(raw)
    assert np.allclose(field.chances(graph), want / want.sum(axis=1, keepdims=True), atol=2e-3)


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "a@b.cd", 5), (2, "", 5), (3, "no data", 5), (3, "no data", 5), (4, "x " * 60_000 + "a@b.cd", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in find_personal_data(docs, train(docs)).collect())
    assert got == [(0, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (3, 0, ""), (4, 1, "email:120000:120006")]
    assert find_personal_data(docs.limit(0), SkipChainField()).count() == 0


def test_groups_of_digits_are_one_span(field):
    text = "call +49 170 765 4321 today or later 170 765 4321 or again 170 765 4321 thanks"
    base, added = all_spans([text], field)
    assert len(base[0][3]) == 1 and [text[a:b] for a, b in added[0][3]] == ["170 765 4321"] * 2


def test_runs_are_joined_if_the_whole_is_plausible():
    def parts(kind, text):
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        return [text[tokens[a][0] : tokens[b - 1][1]] for a, b in segments(kind, text, tokens)]

    assert parts(3, "4111 1111 1111 1112") == ["4111 1111 1111 1112"]
    assert parts(3, "4111 1111 1111 1112 4111 1111 1111 1113") == ["4111 1111 1111 1112", "4111 1111 1111 1113"]
    assert parts(4, "030 1234567") == ["030 1234567"]
    assert parts(4, "7654321 7654321") == ["7654321", "7654321"]
    assert parts(4, "170 765 4321 170 765 4321") == ["170 765 4321"] * 2
    assert parts(4, "12 34") == []


class Sure(SkipChainField):
    """Every token with a digit is a phone, for sure."""

    def chances(self, graph):
        return np.eye(5)[np.full(len(graph.observed), 4)]


def test_documents_without_patterns_are_labelled():
    texts = ["first 170 765 4321, then 170 765 4321", "first 170\n765 4321, 170 765", "no digits"]
    base, added = all_spans(texts, Sure())
    assert not any(base[0]) and [texts[0][a:b] for a, b in added[0][3]] == ["170 765 4321"] * 2
    assert [texts[1][a:b] for a, b in added[1][3]] == ["765 4321"] and not any(added[2])


def test_parts_of_very_many_zeros():
    text = "0" * 5000 + ".1.1.1 " + "0" * 5000 + "256.1.1.1"
    assert base_spans(text)[1] == [(0, 5006)]


def test_addresses_by_runs_are_those_of_the_pattern():
    import random
    import time

    from formlens.llm.pii import IP, IP_RUNS, all_spans, base_spans

    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("0123459..²⁴٣ a") for _ in range(rng.randrange(30)))
        assert [m.span() for m in IP.finditer(text)] == [m.span() for m in IP_RUNS.finditer(text)]
    began = time.perf_counter()
    assert base_spans("7" * 1_000_000) == [[], [], [], []]
    assert base_spans("1." * 300_000 + "1")[1]
    assert time.perf_counter() - began < 10
    for digit in ("²", "⁴", "٣", "①", "๓"):
        all_spans([f"see 1.2.3.{digit} and {digit}.1.1.1 or +{digit}23 456 789 {digit}@x.de"], SkipChainField())
