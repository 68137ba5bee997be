"""Texts longer than a slice, beside short ones, through every operator that reads texts."""

import zlib

import numpy as np
import pytest
from corpus import frame, same
from pyspark.sql import functions as F

from meltgrid.llm import binary_output, decontamination, near_dedup, piece_coding, quality_rules, sharding
from meltgrid.llm import kernels as K
from meltgrid.llm import substring_dedup, suffix_dedup
from meltgrid.session import scratch_path

LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(150_000))
ROWS = [(1, LONG), (2, "before " + LONG[:4000]), (3, "short text"), (4, "y" * 200_000), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > K.SLICE
    return frame(spark, ROWS, parts=2).cache()


def test_dedup(docs):
    out = substring_dedup.dedup_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    assert same(out.collect(), substring_dedup.brute_windows(ROWS))
    out = {r["doc_id"]: r for r in suffix_dedup.dedup_strings(docs).collect()}
    assert out[1]["removed"][0] == [0, 4000] and out[2]["n_removed"] == 4000 and out[4]["n_removed"] == 200_000
    assert bytes(out[2]["kept"]) == b"before " and out[3]["n_removed"] == 0


def test_near_duplicates(docs, spark):
    more = docs.union(spark.createDataFrame([(9, LONG + " tail"), (8, "Y" * 200_000)], docs.schema))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(more).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 8: 4, 9: 1}


def test_decontamination(docs, spark):
    items = spark.createDataFrame([(1, LONG[900_000:900_300]), (2, "nowhere to be found in these texts")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.contained_items(docs, items).collect()] == [1]


def test_statistics_and_shards(docs):
    counts = {r["doc_id"]: r for r in quality_rules.count_rules(docs).collect()}
    assert counts[1]["n_words"] == 150_000 and counts[4]["word_chars"] == 200_000 and counts[5]["n_words"] == 0
    out = {r["_id"]: r for r in sharding.shard_rows(docs, limit=1000).collect()}
    assert out[1]["_bytes"] == len(LONG) and out[1]["shard_rows"] == 1


def test_coding(docs, spark):
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=piece_coding.default_model())
    tokenizer = Tokenizer.from_file(binary_output.default_tokenizer())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r["doc_id"]: r["ids_crc32"] for r in piece_coding.code_digest(docs).collect()}
    assert got == {d: crc(model.encode(t or "")) for d, t in ROWS}
    shards = binary_output.write_token_shards(docs, scratch_path(spark, "long"))
    back = shards.read(shards.lookup(binary_output.document_keys(docs)), digest=True).collect()
    assert {r["_doc"]: r["ids"] for r in back} == {
        d: crc(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in ROWS}
