"""The pipeline against brute-force versions of its stages."""

import random

import pytest
from corpus import SF

import corpus_pipeline as P
from meltgrid.llm import decontamination as D
from meltgrid.llm import near_dedup as N
from meltgrid.llm import substring_dedup as W
from meltgrid.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        out.append(docs.collect())
    return out


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_stages_return_documents(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "pieces"]
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == COLUMNS
    assert list(stages[-1][0].asDict()) == [*COLUMNS, "piece_ids", "round_trip"]
    assert all(r["round_trip"] for r in stages[-1])


def test_near_duplicates_of_quality(stages):
    kept = {d for d, _, _, k in N.brute_components(pairs(stages[1]), 5, 80) if k}
    assert sorted(pairs(stages[2])) == sorted(x for x in pairs(stages[1]) if x[0] in kept)


def test_substrings_of_near_duplicates(stages):
    gone = {r[0]: (r[1], r[2]) for r in W.brute_windows(pairs(stages[2]))}
    before = dict(pairs(stages[2]))
    for d, text in pairs(stages[3]):
        n, removed = gone[d]
        assert (text == before[d]) if not removed else len(text.encode().split()) == n - removed
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_decontamination_of_substrings(stages, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in D.brute_contained(pairs(stages[3]), items)}
    assert sorted(pairs(stages[4])) == sorted(x for x in pairs(stages[3]) if x[0] not in bad)


def test_pieces_decode(stages):
    import sentencepiece

    from meltgrid.llm.piece_coding import default_model

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert {d: t for d, t in pairs(stages[5])} == {r["doc_id"]: model.decode(list(r["piece_ids"])) for r in stages[5]}


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(9)
    words = [f"u{i}" for i in range(400)]
    long = lambda: " ".join(rng.choice(words) for _ in range(80))
    text = long()
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, long(), "en", "s", 1), (2, None, None, "s", 0),
            (3, "", "x", None, 0), (4, long(), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
    assert sorted(r["doc_id"] or -1 for r in docs.collect()) == [-1, 1, 4]
    docs = spark.createDataFrame([], docs.drop("piece_ids").schema)
    for _, stage in P.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
    assert docs.count() == 0
