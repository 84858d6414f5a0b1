import zlib

import numpy as np
import pyarrow as pa
import pytest

from formlens.llm import language
from formlens.llm.language import SWITCH_PENALTY, LanguageModel, label_languages, train, words_of

EN = "the quick brown fox jumps over the lazy dog while they were thinking about something with which nothing other could be had"
DE = "der schnelle braune fuchs springt über den faulen hund während sie nicht wissen welche möglichkeiten sich noch ergeben würden"
RU = "быстрая лиса прыгает через ленивую собаку пока они думают о чем то другом"


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        lang, words = [("en", EN), ("de", DE), ("ru", RU)][k % 3]
        rows.append((k, " ".join(rng.choice(words.split(), 40)) + ".", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


@pytest.fixture(scope="module")
def model(documents):
    return train(documents)


def test_mixed_texts_are_cut_where_the_language_changes(spark, model):
    assert model.languages == ["de", "en", "ru"]
    text = f"{EN}, 12 {DE} -- {RU}"
    row = label_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    n_en, n_de, n_ru = (len(part.split()) for part in (EN, DE, RU))
    assert [tuple(span) for span in row.lang_spans] == [(0, n_en, "en"), (n_en + 1, n_de, "de"), (n_en + n_de + 2, n_ru, "ru")]
    assert row.lang_pred == "en" and row.lang_score == pytest.approx(n_en / (n_en + n_de + n_ru))


def test_scripts_narrow_the_candidates(model):
    scores, _ = model.word_scores(["лиса", "fox", "狐"])
    assert scores[0].tolist()[2] == 0 and max(scores[0].tolist()[:2]) == -language.WORD_LIMIT
    assert scores[1, 2] == -language.WORD_LIMIT and scores[2].tolist() == [0, 0, 0]


def test_paths_equal_plain_viterbi(model):
    rng = np.random.default_rng(5)
    words = (EN + " " + DE + " " + RU).split()
    texts = [" ".join(rng.choice(words, n)) for n in [1, 2, 3, 40, 700, *rng.integers(1, 60, 80).tolist()]] + ["", "1 2", None]
    _, labels, bounds = model.label(pa.array(texts))
    for k, text in enumerate(texts):
        found = labels[bounds[k] : bounds[k + 1]].tolist()
        split = words_of(pa.array([text], pa.string()))
        scores, lettered = model.word_scores(split.spelled)
        rows = [scores[code] for code in split.codes if lettered[code]]
        assert len(found) == len(rows)
        if not rows:
            continue
        total = rows[0].copy()
        for row in rows[1:]:
            total = np.maximum(total, total.max() - SWITCH_PENALTY) + row
        path = sum(row[label] for row, label in zip(rows, found, strict=True))
        path -= SWITCH_PENALTY * sum(a != b for a, b in zip(found, found[1:], strict=False))
        assert path == pytest.approx(total.max())


def test_odd_rows(spark, model):
    rows = [(1, None, 1), (2, "", 1), (3, "12 ² Ⅷ _ !?", 1), (None, EN, 1), (4, EN, 1), (4, EN, 1), (5, "狐" * 5, 1), (6, DE * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred int")
    result = label_languages(docs, model)
    assert result.columns == ["doc_id", "text", "lang_pred", "_lang_pred", "lang_score", "lang_spans"]
    got = sorted(((r.doc_id or 0, r._lang_pred, r.lang_score, len(r.lang_spans)) for r in result.collect()))
    none = [(k, "und", 0.0, 0) for k in (1, 2, 3)]
    assert got == [(0, "en", 1.0, 1), *none, (4, "en", 1.0, 1), (4, "en", 1.0, 1), (5, "de", 1.0, 1), (6, "de", 1.0, 1)]
    assert label_languages(docs.limit(0), model).count() == 0
    nothing = train(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert isinstance(nothing, LanguageModel) and {r._lang_pred for r in label_languages(docs, nothing).collect()} == {"und"}


ZH = "今天天气很好 我们去公园散步 孩子在河边看小鸟 他们喜欢喝茶和读书 明天会下雨"
JA = "今日はとても良い天気です 私たちは公園を歩きました 子供は川で鳥を見ています 本を読むのが好きです"
TH = "วันนี้อากาศดีมาก เราไปเดินเล่นในสวน เด็กดูนกที่ริมน้ำ พวกเขาชอบดื่มชาและอ่านหนังสือ"


def plainly_cut(text):
    """Words letter by letter."""
    words = []
    for part in text.split():
        run, known = "", 0
        for letter in filter(str.isalpha, part.lower()):
            at = max(k for k, (start, _) in enumerate(language.SCRIPTS) if start <= ord(letter))
            script = language.SCRIPTS[at][1] or known
            full = len(run) == language.PIECE and known in language.UNSPACED
            if run and ((known and script != known) or full):
                words.append(run)
                run = ""
            run, known = run + letter, script
        words.append(run)
    return words


def test_words_are_cut_by_script_as_letter_by_letter():
    rng = np.random.default_rng(8)
    letters = list("ab Z é ß1_ -ая ש ع 今天気 のカ ไท ย် ក 한 ꓐ 𠀀 .") + [" ", "\u00aa", "\u0e31"]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 40, 400)] + [None, "", ZH + EN + TH, "今" * 10_001]
    words = words_of(pa.array(texts, pa.string()))
    for low, high, text in zip(words.bounds[:-1], words.bounds[1:], texts, strict=True):
        found = [words.spelled[code] for code in words.codes[low:high]]
        assert [word for word in found if word] == [word for word in plainly_cut(text or "") if word]


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        lang, words, between = [("en", EN, " "), ("zh", ZH, ""), ("ja", JA, ""), ("th", TH, "")][k % 4]
        rows.append((k, between.join(rng.choice(words.split(), 12)), lang))
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [
        (1, ZH.replace(" ", "") * 8 + " the park", "zh"),
        (2, JA.replace(" ", "") + "hello world" + JA.replace(" ", ""), "ja"),
        (3, TH.replace(" ", "") + " hello", "th"),
        (4, ZH.replace(" ", "，") * 20_000, "zh"),
    ]
    found = {r.doc_id: r for r in label_languages(spark.createDataFrame(texts, "doc_id long, text string, want string"), model).collect()}
    assert all(found[k].lang_pred == want and found[k].lang_score > 0.9 for k, _, want in texts if k != 2)
    assert found[2].lang_pred == "ja"
    mixed = spark.createDataFrame([(1, "今天天气很好Hello the world is here今天天气很好")], "doc_id long, text string")
    assert [tuple(span) for span in label_languages(mixed, model).first().lang_spans] == [(0, 3, "zh"), (3, 5, "en"), (8, 3, "zh")]


def test_held_out_languages_are_not_learnt(spark, documents):
    keys = [k for k in range(2000, 2100) if zlib.crc32(str(k).encode()) % 5 == 0]
    poison = spark.createDataFrame([(k, EN, "xx") for k in keys], "doc_id long, text string, lang string")
    assert train(documents.union(poison)).languages == ["de", "en", "ru"]


def test_shared_documents_on_held_out_rows(spark):
    from formlens.llm.queries import op2_language

    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op2_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in docs if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.97
