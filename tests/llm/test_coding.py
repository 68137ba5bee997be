"""Token shards and piece coding against the libraries."""

import random
import zlib

import numpy as np
import pytest
from corpus import SF, empty, frame, same, stored
from pyspark.sql import functions as F

from meltgrid.llm import binary_output as B
from meltgrid.llm import piece_coding as P
from meltgrid.llm.common import null_again
from meltgrid.session import scratch_path

ODD = list("  \n\tabcdeéè日本語の ①🎉s'") + ["<0x41>", "  ", "    ", "the", "ing", "\x00", "İ", "<|endoftext|>", "'s", "12", "\x1c", "﷽", "ࢀ", "₀"]


def texts(seed, n=300, alphabet=ODD):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def encoded(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(B.default_tokenizer())
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_perfect_index():
    key = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    index = B.PerfectIndex.load(B.PerfectIndex.build(key, {"v": np.arange(5000)}).dump())
    assert sorted(index.slot(key)) == list(range(5000))
    got = index.find(key)
    assert got["known"].all() and (got["v"] == np.arange(5000)).all()
    assert not index.find(np.random.default_rng(2).integers(0, 2**64, 50_000, dtype=np.uint64))["known"].any()
    with pytest.raises(ValueError):
        B.PerfectIndex.build(np.array([7, 7], dtype=np.uint64), {})


def test_shards_come_back(spark):
    rows = [(i, t) for i, t in enumerate(texts(2))] + [(2000, None), (None, "x")]
    df = frame(spark, rows).withColumn("shard", F.lit("clash"))
    shards = B.write_token_shards(df, scratch_path(spark, "t"), index_keys=40)
    back = shards.read(shards.lookup(B.document_keys(df)), digest=True)
    assert shards.parts > 1 and same(back.select(null_again("_doc"), "start", "n_tokens", "ids").collect(), encoded(rows))
    ids = shards.read(shards.lookup(B.document_keys(df).where("_doc = 3"))).first()["ids"]
    assert zlib.crc32(np.array(ids, "<u4").tobytes()) == next(r[3] for r in encoded(rows) if r[0] == 3)
    foreign = spark.createDataFrame([(5_000_000, 0), (3, 9)], "_doc long, _ordinal long")
    assert shards.lookup(foreign).count() == 0


def test_repeated_ids_have_their_own_keys(spark):
    rows = [(1, "one"), (1, "two three"), (1, "one"), (0, "zero")]
    df = frame(spark, rows)
    shards = B.write_token_shards(df, scratch_path(spark, "t"))
    got = shards.read(shards.lookup(B.document_keys(df)), digest=True).collect()
    assert sorted(r["_ordinal"] for r in got if r["_doc"] == 1) == [0, 1, 2]
    assert sorted(r["ids"] for r in got) == sorted(r[3] for r in encoded(rows))


def test_registered_shards_and_empty_table(spark):
    assert same(B.op1_binary_output(spark, SF).collect(), encoded(stored()))
    shards = B.write_token_shards(empty(spark), scratch_path(spark, "t"))
    assert shards.read(shards.lookup(B.document_keys(empty(spark)))).count() == 0


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def test_pieces_equal_the_library():
    coder, model = P.PieceCoder(P.default_model()), library()
    some = texts(3, 4000, ODD + ["▁", "tion"])
    for text, raw in zip(some, coder.encode(some)):
        ids = model.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert P.decode_ids(P.piece_bytes(P.default_model()), ids) == model.decode(ids)


def test_small_caches_change_nothing():
    coder, model = P.PieceCoder(P.default_model(), keep=5), library()
    for text in texts(4, 300):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == model.encode(text)


def test_registered_pieces(spark):
    model = library()
    want = []
    for d, t in stored():
        ids = model.encode(t or "")
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert same(P.op6_piece_coding(spark, SF).collect(), want)


def test_encode_and_decode_frames(spark):
    rows = [(1, "a  b\n"), (1, "a  b\n"), (None, None), (2, "")]
    df = frame(spark, rows).withColumn("piece_ids", F.lit("mine")).withColumn("lang", F.lit("x"))
    out = P.decode_pieces(P.encode_pieces(df))
    assert out.columns == ["doc_id", "text", "lang", "piece_ids", "decoded"]
    assert same(out.select("doc_id", "decoded").collect(), [(d, t or "") for d, t in rows])
    assert P.decode_pieces(P.encode_pieces(empty(spark))).count() == 0
