import numpy as np
import pytest

import corpus_pipeline as cp
from formlens.llm.decontamination import MAX_EDITS, folded
from test_decontamination import within_edits
from test_line_dedup import brute_force as dedup_by_force
from test_packing import check
from test_simhash import brute_force as groups_by_force

FOLDER = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the result of every stage, each reread from Parquet."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in cp.STAGES:
        result = cp.stored(stage(spark, docs, FOLDER), "stage")
        out.append((name, docs, result))
        docs = result
    return out


def test_names_and_columns(stages):
    assert [name for name, _, _ in stages] == [
        "language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"
    ]
    assert all(result.dtypes == docs.dtypes for _, docs, result in stages[:-1])


def test_languages_keep_clean_documents(stages):
    _, docs, kept = stages[0]
    before, after = rows_of(docs), rows_of(kept)
    assert set(after) <= set(before) and len(after) > 0.98 * len(before)


def test_lines(stages):
    _, docs, kept = stages[1]
    force = dedup_by_force([(r.doc_id, r.text) for r in docs.collect()], 50)
    want = []
    for r in docs.collect():
        text, gone = force[r.doc_id]
        if gone < len(r.text.split("\n")):
            want.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    assert rows_of(kept) == sorted(want, key=str)
    assert any(gone for _, gone in force.values())


def test_one_of_each_group_stays(stages):
    _, docs, kept = stages[2]
    first = {component for _, _, component in groups_by_force([(r.doc_id, r.text) for r in docs.collect()])}
    assert rows_of(kept) == [row for row in rows_of(docs) if row[0] in first]


def test_documents_with_items_go(spark, stages):
    _, docs, kept = stages[3]
    items = [folded(r.text).strip() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [
        row for row in rows_of(docs)
        if not any(within_edits(item, folded(row[1]), int(len(item) * MAX_EDITS)) for item in items)
    ]
    assert rows_of(kept) == clean and len(clean) < docs.count()


def test_packing_and_the_whole_run(spark, stages):
    _, docs, pieces = stages[4]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, pieces.collect(), 2048)
    assert sorted((p.doc_id, p.doc_tokens) for p in cp.run(spark, FOLDER).select("doc_id", "doc_tokens").distinct().collect()) == sorted(
        (p.doc_id, p.doc_tokens) for p in pieces.select("doc_id", "doc_tokens").distinct().collect()
    )


def test_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) > 2000").limit(3).collect()
    rows = [(k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(prose)]
    rows += [(10, None, None, None, None), (11, "", "en", "s", 0), (12, "12 !", "en", "s", 4), (None, "the of and that", None, "s", 15),
             (13, "to the of that", "en", "s", 14), (13, "to the of that", "en", "s", 14)]
    docs = spark.createDataFrame(rows, FIELDS).withColumns({name: cp.F.lit("x") for name in ("items_found", "lang_pred", "n_lines", "place")})
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        result = stage(spark, docs, str(tmp_path))
        assert name == "packing" or result.dtypes == docs.dtypes, name
        docs = cp.stored(result, "odd")
    assert np.isin([0, 13], [r.doc_id for r in docs.collect()]).any()
