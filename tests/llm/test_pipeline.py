"""The pipeline's stages on the smallest tables, each against a plain version of itself."""

import os

import pytest

import corpus_pipeline
from fencewatch.llm import pii, repetition
from tests.llm.cases import DATA, odd_documents, with_clashes
from tests.llm.test_pairs import _plain_components
from tests.llm.test_texts import _library_pieces

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def _rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_all_but_the_last_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.count() > 0


def test_rules_and_classifier_keep_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = stages[0]
    verdicts = {r["doc_id"]: r["kept"] for r in repetition.measured(before).collect()}
    assert sorted(i for i, _ in _rows(after)) == sorted(i for i, good in verdicts.items() if good)
    before, after = stages[1]
    stays = {i for i, _ in _rows(after)}
    clean = [i for i, _ in _rows(before) if labels.get(i) == 1]
    junk = [i for i, _ in _rows(before) if labels.get(i) == 0]
    assert len(stays & set(clean)) >= 0.97 * len(clean) and len(stays & set(junk)) <= 0.2 * len(junk) + 1


def test_one_of_each_component_stays(stages):
    before, after = stages[2]
    wanted = sorted(i for i, n, c in _plain_components(_rows(before)) if n == 0 or i == c)
    assert sorted(i for i, _ in _rows(after)) == wanted


def test_personal_data_is_gone_and_packing_is_whole(stages):
    before, after = stages[3]
    assert sorted(i for i, _ in _rows(before)) == sorted(i for i, _ in _rows(after))
    assert not any(pii.base_spans(t) for _, t in _rows(after))
    docs, packed = stages[4]
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
    assert got == sorted(_library_pieces(_rows(docs)))


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(keys).collect())) == sorted(
        map(tuple, stages[4][1].select(keys).collect())
    )


_ODD = "doc_id long, text string"


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    rows = odd_documents()
    docs = with_clashes(spark, rows, _ODD)
    by_key = lambda pairs: sorted(pairs, key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns, name
        got = [(r["doc_id"], r["text"]) for r in made.collect()]
        if name == "quality_rules":
            assert by_key(got) == by_key((i, t) for i, t in rows if repetition_keeps(spark, t))
        elif name == "quality_classifier":
            assert set(got) <= set(rows)
        elif name == "near_duplicates":
            assert by_key(got) == by_key(rows)  # no odd text is a copy of one with a smaller id
        else:
            assert by_key(i for i, _ in got) == by_key(i for i, _ in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert by_key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()) == by_key(_library_pieces(rows))


def repetition_keeps(spark, text):
    return repetition.measured(spark.createDataFrame([(text,)], "text string")).first()["kept"]


def test_no_rows_go_through_every_stage(spark):
    docs = with_clashes(spark, odd_documents(), _ODD).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0, name


def test_near_copies_of_one_text_leave_one(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(9 - i, " ".join([*words, f"end{i}"])) for i in range(6)] + [(4, " ".join([*words, "end5"])), (50, "another text of some words")]
    stays = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, _ODD), DATA).collect()
    assert sorted((r["doc_id"], r["text"][-4:]) for r in stays) == [(4, "end5"), (4, "end5"), (50, "ords")]
