"""Token shards of texts that hold the vocabulary's added token, against the library's ids of whole texts."""

import random
import zlib

import numpy as np
from corpus import frame, same
from test_coding import ODD, texts

from meltgrid.llm import binary_output as B
from meltgrid.llm.common import null_again
from meltgrid.session import scratch_path

TOKEN = "<|endoftext|>"
SPACES = ["", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x0c ", "\xa0", "　", "\x1c"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_tokenizer())


def some():
    beside = [f"{a}{x}{TOKEN}{y}{b}" for a in ("", "end", "'s", "12", TOKEN) for b in ("", "next", "é", TOKEN)
              for x in SPACES for y in SPACES]
    return beside + texts(5, 2000, ODD + [TOKEN, TOKEN[:-1], "<|", "|>", "\r", "\x0b"])


def test_units_equal_whole_texts():
    tokenizer, all_texts = library(), some()
    random.Random(1).shuffle(all_texts)
    for keep in (B.KEEP, 50):
        coder = B.TokenCoder(B.default_tokenizer(), keep)
        for at in range(0, len(all_texts), 500):
            part = all_texts[at:at + 500]
            raw = [t.encode() for t in part]
            off = np.cumsum([0] + [len(x) for x in raw])
            ids, count = coder.encode(part, np.frombuffer(b"".join(raw), dtype=np.uint8), off)
            for text, got in zip(part, np.split(ids, np.cumsum(count)[:-1])):
                assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_added_token_is_one_id():
    text = f"end of text {TOKEN} next"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    ids, _ = B.TokenCoder(B.default_tokenizer()).encode([text], data, np.array([0, len(data)]))
    assert ids.tolist() == [437, 286, 2420, 220, 50256, 1306]


def test_shards_hold_the_library_ids(spark):
    rows, tokenizer = list(enumerate(some()[::9])), library()
    start, want = 0, []
    for d, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [B.END_ID]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = frame(spark, rows)
    shards = B.write_token_shards(df, scratch_path(spark, "t"))
    got = shards.read(shards.lookup(B.document_keys(df)), digest=True)
    assert same(got.select(null_again("_doc"), "start", "n_tokens", "ids").collect(), want)
