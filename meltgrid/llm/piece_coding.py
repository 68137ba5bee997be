"""SentencePiece encoding and decoding over a shared-prefix trie.

A text is marked (a space becomes ``MARK``, one stands before the text) and cut before every run of marks: no piece
of the vocabulary has a mark after another character, so the cuts never split a piece and the words between are
independent.  The distinct words of a slice are sorted, which lays out their trie depth first; the walk keeps the
forward states of the current path, and a word reuses those of the prefix that it shares with the word before.

The model is a merge (BPE) model.  Its scores order merges; a path of the largest total score, as for a unigram
model, would give other pieces than the library.  So the forward state of a prefix is not a score but the last
piece of the prefix's only valid segmentation: a piece may follow another if merging their joint text gives these
two pieces again, and a segmentation is the library's if and only if all its neighbours may follow each other.  No score
is summed; unigram models, whose best path needs summed scores, are refused.

Encoded words are kept per Python worker, at most ``KEEP`` of them; texts are not shuffled.

Defined results: null and empty texts have no pieces and decode to the empty text; a character outside the
vocabulary becomes its UTF-8 byte pieces; the mark character itself, if it stands in a text, decodes to a space (the
library does the same); repeated rows are encoded each; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meltgrid.llm import kernels as K
from meltgrid.llm.common import table

MARK = "▁"
KEEP = 300_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_coders: dict[str, PieceCoder] = {}
_bytes: dict[str, list[bytes]] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a ①b\n"
        if model.encode(probe, out_type=int) and model.decode(model.encode(probe)) != probe:
            raise ValueError("models that normalise their input are not handled")
        size = model.vocab_size()
        text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(text[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size)
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {text[i]: i for i in plain}
        self.score = {text[i]: model.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", t) for t in self.id):
            raise ValueError("pieces that end a word and start the next are not handled")
        if any(s != int(s) or s > 0 for s in self.score.values()):
            raise ValueError("only merge models are handled")
        self.unknown = model.unk_id()
        self.keep = keep
        self.words: dict[str, bytes] = {}
        self.pairs = 0
        #: Every ending of a piece; a piece's own entry has the answers of ``may_follow`` so far.
        self.tails: dict[str, dict[str, bool] | None] = {t[i:]: None for t in self.id for i in range(1, len(t))}
        self.tails |= {t: {} for t in self.id}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored, then leftmost neighbours are joined first."""
        part = list(text)
        while True:
            best, where = None, -1
            for i in range(len(part) - 1):
                s = self.score.get(part[i] + part[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if where < 0:
                return part
            part[where:where + 2] = [part[where] + part[where + 1]]

    def may_follow(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """Whether merging the joint text gives these two pieces; ``left`` is empty at the start of a word."""
        self.pairs += 1
        if self.pairs > 8 * self.keep:
            for e in self.tails.values():
                if e:
                    e.clear()
            self.pairs = 0
        known[left] = out = self.merge(left + right) == [p for p in (left, right) if p]
        return out

    def piece_ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def walk(self, words: list[str]) -> None:
        """Encode sorted distinct words; ``last[d]`` is the last piece of the first d characters of the path."""
        last: list[str] = [""]
        before = ""
        tails = self.tails
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1:]
            for d in range(same + 1, len(word) + 1):
                start = d - 1
                if word[start] not in tails or tails[word[start]] is None:
                    tails[word[start]] = {}  # a character outside the vocabulary stands for itself
                while start >= 0:
                    piece = word[start:d]
                    known = tails.get(piece, tails)
                    if known is tails:
                        start = -1
                        break
                    if known is not None:
                        ok = known.get(last[start])
                        if ok or ok is None and self.may_follow(last[start], piece, known):
                            break
                    start -= 1
                if start < 0:
                    raise AssertionError(f"no segmentation of {word[:d]!r}")
                last.append(piece)
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= len(last[d])
            self.words[word] = np.array([i for p in reversed(ids) for i in self.piece_ids(p)], dtype="<u4").tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > self.keep:
            self.words.clear()
        new = set().union(*split).difference(self.words)
        self.walk(sorted(new))
        get = self.words.__getitem__
        return [b"".join(map(get, s)) for s in split]


def piece_bytes(path: str) -> list[bytes]:
    """What each id decodes to; once per worker and model, without what encoding needs."""
    if path not in _bytes:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = []
        for i in range(model.vocab_size()):
            text = model.id_to_piece(i)
            raw.append(bytes([int(text[1:-1], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i)
                       else b"" if model.is_control(i) or model.is_unused(i) else text.replace(MARK, " ").encode())
        _bytes[path] = raw
    return _bytes[path]


def decode_ids(raw: list[bytes], ids: list[int]) -> str:
    out = b"".join([raw[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def coder(path: str) -> PieceCoder:
    """One coder per worker and model."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def _ids_array(coded: list[bytes]) -> pa.ListArray:
    off = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))


def encode_pieces(docs: DataFrame, model: str | None = None, text_col: str = "text",
                  ids_col: str = "piece_ids") -> DataFrame:
    """All columns of ``docs`` and the piece ids of each text; an existing ``ids_col`` is replaced."""
    path = model or default_model()
    docs = docs.drop(ids_col)
    place = docs.columns.index(text_col)
    names = [*docs.columns, ids_col]

    def run(batches):
        for rows, _, _ in K.text_slices(batches, text_col):
            coded = coder(path).encode([t or "" for t in rows.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*rows.columns, _ids_array(coded)], names=names)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_pieces(coded: DataFrame, model: str | None = None, ids_col: str = "piece_ids",
                  text_col: str = "decoded") -> DataFrame:
    """All columns and the decoded text; a null list decodes to the empty text."""
    path = model or default_model()
    coded = coded.drop(text_col)
    place = coded.columns.index(ids_col)
    names = [*coded.columns, text_col]

    def run(batches):
        raw = piece_bytes(path)
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                col = part.column(place)
                flat, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                known = col.is_valid().to_numpy(zero_copy_only=False).tolist()
                texts = [decode_ids(raw, flat[a:b].tolist() if k else [])
                         for a, b, k in zip(off[:-1].tolist(), off[1:].tolist(), known)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)
    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(text_col, T.StringType())]))


def _digest(batches):
    """(doc_id, n_pieces, ids_crc32, round_trip) of rows (doc_id, text, piece_ids, decoded)."""
    for rows in batches:
        doc, text, ids, decoded = rows.columns
        off = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        same = [d == (t or "").replace(MARK, " ") for t, d in zip(text.to_pylist(), decoded.to_pylist())]
        yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)],
                                         names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])


def code_digest(docs: DataFrame) -> DataFrame:
    """Texts ``(doc_id, text)`` encoded and decoded: pieces, checksum of the ids as little-endian unsigned 32-bit
    integers, whether the text came back."""
    coded = decode_pieces(encode_pieces(docs.select("doc_id", "text")))
    return coded.mapInArrow(_digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def op6_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every whole text of documents."""
    return code_digest(table(spark, sf_dir, "documents"))
