import random

import xxhash

from formlens.llm.simhash import fingerprint, near_duplicates, print_links, segments


def plain_fingerprint(text):
    words = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [word for word in words.split(" ") if word]
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(each), 42) for each in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    prints = [(i, plain_fingerprint(text)) for i, text in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    names = {}
    for g, (i, _) in zip(group, prints, strict=True):
        if i is not None:
            names[g] = min(i, names.get(g, i))
    return sorted(((i, f"{p:016x}", names.get(g)) for g, (i, p) in zip(group, prints, strict=True)), key=str)


def test_fingerprint_by_the_letter():
    texts = ["", " \t", "One", "Two WORDS", "a b c", "É e É\x85x \x1c y", "a b a b a b a b", "x " * 20_000 + "end"]
    assert [fingerprint(text.encode()) for text in texts] == [plain_fingerprint(text) for text in texts]


def test_links_against_all_pairs(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(6):
            values.add(base ^ sum(1 << bit for bit in rng.sample(range(64), rng.randint(1, 5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    for n_segments in (2, 3, 4):
        links = print_links(prints, 3, n_segments)
        assert {tuple(row) for row in links.collect()} == want
    assert segments(3, 2) == [(0, 32, 1), (32, 32, 1)]


def test_groups(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = [(k * 3, " ".join(base[:50] + [base[100 + k]])) for k in range(30)]
    rows += [(200 + k, " ".join(base[k : k + 60])) for k in range(30)]
    rows += [(None, rows[0][1]), (900, None), (5, ""), (7, " "), (7, " "), (901, "A B"), (902, "a  b"), (None, "alone here now")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, print string").repartition(5)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == brute_force(rows)


def test_shared_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == brute_force([tuple(row) for row in docs.collect()])
    assert near_duplicates(docs.limit(0)).count() == 0
