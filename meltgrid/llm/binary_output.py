"""Token-id shards with a minimal perfect hash index.

``write_token_shards`` encodes texts and writes raw ids to ``shard-NNNNN.bin`` in ascending id order: nothing but
little-endian ids, two bytes each if the vocabulary allows it, else four.  ``index-NNNNN.npz`` maps the keys of one
hash range to (shard, offset, count).  Each index is minimal and perfect: at every level keys that fall alone on a
bit keep it and the others go on to the next level, and the rank of a key's bit is its slot.  Slots hold a 32-bit
fingerprint, so a foreign key is refused except with probability 2^-32.  A lookup probes a few bits and reads one
slot, however many keys there are.  Shards and indexes are bounded by the size of a Spark partition.

Files are written to the shared folder through ``pyarrow.fs`` under a name of the attempt and renamed when complete,
so a retried or speculative task never leaves half a shard under a final name.

Defined results: null and empty texts store the end id only; rows with equal ids are stored one after another in the
order of their text hashes, and their keys are (id, ordinal); a null id stands before all others and comes back null;
empty tables give no shards; other columns are not read.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm.common import keyed, null_again, table
from meltgrid.session import cut_lineage, scratch_path

END_ID = 2
KEEP = 2_000_000
INDEX_KEYS = 200_000
_LEVELS = 64
#: White space beyond the six ASCII characters; a text that has any goes through the library whole.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_coders: dict[str, TokenCoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenCoder:
    """Encodes through the library, each distinct unit of a worker once while it is kept.

    A unit is a run of white space and the word behind it.  A byte-level vocabulary splits texts by a pattern whose
    matches hold white space only at their start, so no match crosses the end of a unit and units are encoded by
    themselves.  Added tokens are found before that; none may hold or strip white space, so each lies within a unit
    and cuts it as it cuts the whole text; with other added tokens texts go through the library whole.  At most ``keep`` units are kept, in sorted arrays under their 64-bit hashes.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content) for t in added)
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64))
        self.ids, self.used = np.zeros(1 << 16, dtype=self.type), 0

    def _learn(self, key: np.ndarray, units: list[str]) -> None:
        """Keep new units under their ascending keys."""
        if len(self.key) + len(key) > self.keep:
            self._forget()
        size = np.zeros(len(key), dtype=np.int64)
        for i in range(0, len(units), 20_000):
            coded = self.tokenizer.encode(units[i:i + 20_000], is_pretokenized=True, add_special_tokens=False)
            size[i:i + 20_000] = np.bincount(np.array(coded.word_ids, dtype=np.int64), minlength=len(units[i:i + 20_000]))
            new = np.array(coded.ids, dtype=self.type)
            if self.used + len(new) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(new), dtype=self.type)])
            self.ids[self.used:self.used + len(new)] = new
            self.used += len(new)
        at = self.used - size.sum() + np.cumsum(size) - size
        place = np.searchsorted(self.key, key)
        self.key, self.at, self.size = (np.insert(x, place, y) for x, y in
                                        ((self.key, key), (self.at, at), (self.size, size)))

    def encode(self, texts: list[str], data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); ``data`` and ``off`` are their bytes."""
        words = K.Words(data, off)
        # A unit ends where a word ends; white space at the end of a text is a unit of its own.
        cut = np.unique(np.concatenate([words.end, off]))
        start, end = cut[:-1], cut[1:]
        bounds = np.searchsorted(start, off)
        key, where, unit = np.unique(K.piece_hash(data, end - start), return_index=True, return_inverse=True)
        place = np.searchsorted(self.key, key)
        new = np.flatnonzero(self.key[np.minimum(place, len(self.key) - 1)] != key) if len(self.key) \
            else np.arange(len(key))
        if len(new) and len(self.key) + len(new) > self.keep:
            self._forget()
            new = np.arange(len(key))
        raw = data.tobytes()
        if len(new):
            self._learn(key[new], [raw[a:b].decode() for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist())])
        place = np.searchsorted(self.key, key)[unit]
        size = self.size[place]
        done = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.at[place] - done, size) + np.arange(int(size.sum()))] if len(size) \
            else np.zeros(0, dtype=self.type)
        total = np.append(np.cumsum(size), 0)[bounds - 1] if len(size) else np.zeros(len(off), dtype=np.int64)
        total[bounds == 0] = 0
        count = np.diff(total)
        odd = [i for i, t in enumerate(texts) if self.whole or OTHER_SPACE.search(t)]
        if odd:
            parts = np.split(ids, total[1:-1])
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=self.type)
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return ids, count


def coder(path: str) -> TokenCoder:
    """One coder per worker and vocabulary."""
    if path not in _coders:
        _coders[path] = TokenCoder(path)
    return _coders[path]


class PerfectIndex:
    """Minimal perfect hash over distinct 64-bit keys, with what the slots hold."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, slots: dict[str, np.ndarray]):
        self.sizes, self.words, self.slots = sizes, words, slots
        self.start = np.cumsum(sizes) - sizes
        self.ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    @staticmethod
    def _place(key: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix(key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def fingerprint(key: np.ndarray) -> np.ndarray:
        return (K.mix(key ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, key: np.ndarray, values: dict[str, np.ndarray]) -> PerfectIndex:
        left, sizes, bits = key, [], []
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("two keys have the same 64-bit hash")
            size = 2 * len(left) + 1
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        packed = np.packbits(np.pad(flat, (0, -len(flat) % 64)), bitorder="little").view(np.uint64)
        out = cls(np.array(sizes, dtype=np.int64), packed, {})
        order = np.argsort(out.slot(key))
        out.slots = {"fingerprint": cls.fingerprint(key)[order], **{k: v[order] for k, v in values.items()}}
        return out

    def slot(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key; a foreign key may get any slot or -1."""
        out = np.full(len(key), -1, dtype=np.int64)
        todo = np.arange(len(key))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.start[level] + self._place(key[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
        return out

    def find(self, key: np.ndarray) -> dict[str, np.ndarray]:
        """Values of each key and whether its fingerprint agrees."""
        slot = self.slot(key)
        have = slot >= 0
        safe = np.where(have, slot, 0)
        known = have & (self.slots["fingerprint"][safe] == self.fingerprint(key))
        return {"known": known, **{k: v[safe] for k, v in self.slots.items()}}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, words=self.words, **{f"slot_{k}": v for k, v in self.slots.items()})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> PerfectIndex:
        x = np.load(io.BytesIO(raw))
        return cls(x["sizes"], x["words"], {k[5:]: x[k] for k in x.files if k.startswith("slot_")})


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _attempt(path: str) -> str:
    return f"{path}.attempt-{TaskContext.get().taskAttemptId()}"


class _Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.temp = _attempt(self.path)

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.temp)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


def shard_name(shard: int) -> str:
    return f"shard-{shard:05d}.bin"


def index_name(part: int) -> str:
    return f"index-{part:05d}.npz"


def key_hash() -> Column:
    return F.xxhash64("_doc", "_ordinal")


def _write(root: str, tokenizer: str, end_id: int):
    def run(batches):
        shard, offset, previous, ordinal, output = TaskContext.get().partitionId(), 0, None, 0, None
        slices = K.text_slices(batches, "_text")
        first = next(slices, None)
        if first is None:
            return
        with _Output(f"{root}/{shard_name(shard)}") as output:
            while first is not None:
                rows, data, off = first
                ids, count = coder(tokenizer).encode([t or "" for t in rows.column("_text").to_pylist()], data, off)
                output.write(np.insert(ids, np.cumsum(count), end_id).tobytes())
                count = count + 1
                place = offset + np.cumsum(count) - count
                offset += int(count.sum())
                nth = []
                for doc in rows.column("_doc").to_pylist():
                    ordinal = ordinal + 1 if doc == previous else 0
                    previous = doc
                    nth.append(ordinal)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_doc"), pa.array(nth, pa.int64()), pa.array([shard] * rows.num_rows, pa.int64()),
                     pa.array(place), pa.array(count)], names=["_doc", "_ordinal", "shard", "offset", "n_tokens"])
                first = next(slices, None)
    return run


def _by_part(batches):
    """(part, columns) of consecutive rows of one ``_part``; a part is bounded by ``INDEX_KEYS``."""
    held, key = [], None
    for batch in batches:
        part = batch.column("_part").to_numpy()
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and part[lo] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            if hi > lo:
                key = int(part[lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _build(root: str):
    def run(batches):
        for part, rows in _by_part(batches):
            x = {c: rows.column(c).to_numpy() for c in ("_key", "shard", "offset", "n_tokens")}
            index = PerfectIndex.build(x["_key"].view(np.uint64), {c: x[c] for c in ("shard", "offset", "n_tokens")})
            with _Output(f"{root}/{index_name(part)}") as out:
                out.write(index.dump())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([rows.num_rows], pa.int64())],
                                             names=["_part", "keys"])
    return run


class TokenShards:
    """Handle of a written set of shards: folder, number of index parts, ids before each shard, id width."""

    def __init__(self, spark: SparkSession, root: str, parts: int, before: list[int], width: int):
        self.spark, self.root, self.parts, self.before, self.width = spark, root, parts, before, width

    def part_of(self) -> Column:
        return F.pmod(F.shiftright("_key", 7), F.lit(self.parts))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(_doc, _ordinal, shard, offset, n_tokens) of the keys (_doc, _ordinal) that the indexes know."""
        root, fields = self.root, ("shard", "offset", "n_tokens")

        def run(batches):
            part, index = None, None
            for batch in batches:
                for at, rows in _by_part([batch]):
                    if at != part:
                        fs, path = _open(f"{root}/{index_name(at)}")
                        with fs.open_input_stream(path) as f:
                            part, index = at, PerfectIndex.load(f.read())
                    got = index.find(rows.column("_key").to_numpy().view(np.uint64))
                    ok = pa.array(got["known"])
                    out = pa.RecordBatch.from_arrays(
                        [rows.column(c).combine_chunks() for c in ("_doc", "_ordinal")] +
                        [pa.array(got[c]) for c in fields], names=["_doc", "_ordinal", *fields])
                    yield out.filter(ok)
        asked = keys.select("_doc", "_ordinal", key_hash().alias("_key")).withColumn("_part", self.part_of())
        return (asked.repartition("_part").sortWithinPartitions("_part")
                .mapInArrow(run, "_doc long, _ordinal long, shard long, offset long, n_tokens long"))

    def read(self, found: DataFrame, digest: bool = False) -> DataFrame:
        """(_doc, _ordinal, start, n_tokens, ids) of looked-up keys, read shard by shard in ascending order;
        with ``digest`` the unsigned checksum of the ids as 32-bit integers instead of the ids."""
        root, before, width = self.root, self.before, self.width
        kind = f"<u{width}"

        def run(batches):
            shard, file = None, None
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    rows = batch.slice(at, 500)
                    ids, start = [], []
                    for s, offset, count in zip(*(rows.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))):
                        if s != shard:
                            if file is not None:
                                file.close()
                            fs, path = _open(f"{root}/{shard_name(s)}")
                            shard, file = s, fs.open_input_file(path)
                        raw = np.frombuffer(file.read_at(count * width, offset * width), dtype=kind).astype("<u4")
                        ids.append(zlib.crc32(raw.tobytes()) if digest else raw.view("<i4"))
                        start.append(before[s] + offset)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("_doc"), rows.column("_ordinal"), pa.array(start, pa.int64()),
                         rows.column("n_tokens"), pa.array(ids, pa.int64() if digest else pa.list_(pa.int32()))],
                        names=["_doc", "_ordinal", "start", "n_tokens", "ids"])
        last = "ids long" if digest else "ids array<int>"
        return (found.repartition("shard").sortWithinPartitions("shard", "offset")
                .mapInArrow(run, f"_doc long, _ordinal long, start long, n_tokens long, {last}"))


def write_token_shards(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = END_ID,
                       id_col: str = "doc_id", text_col: str = "text", index_keys: int = INDEX_KEYS) -> TokenShards:
    """Encode, write shards in ascending id order, index them."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    fs, at = _open(root)
    fs.create_dir(at, recursive=True)
    ordered = keyed(docs, id_col, text_col).repartitionByRange("_doc").sortWithinPartitions("_doc", "_tv")
    rows = cut_lineage(ordered.mapInArrow(
        _write(root, path, end_id), "_doc long, _ordinal long, shard long, offset long, n_tokens long"))
    sizes = {r["shard"]: (r["t"], r["k"]) for r in rows.groupBy("shard").agg(
        F.sum("n_tokens").alias("t"), F.count("*").alias("k")).collect()}  # one row per shard
    before, total = [], 0
    for s in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(s, (0, 0))[0]
    parts = max(1, -(-sum(k for _, k in sizes.values()) // index_keys))
    out = TokenShards(spark, root, parts, before, coder(path).type.itemsize)
    keys = rows.withColumn("_key", key_hash()).withColumn("_part", out.part_of())
    cut_lineage(keys.repartition("_part").sortWithinPartitions("_part").mapInArrow(_build(root), "_part long, keys long"))
    return out


def document_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every key (_doc, _ordinal) of a table."""
    count = keyed(docs, id_col, text_col).groupBy("_doc").agg(F.count("*").alias("_c"))
    return count.select("_doc", F.explode(F.expr("sequence(0L, _c - 1)")).alias("_ordinal"))


def op1_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the whole documents table written, looked up key by key and read back."""
    docs = table(spark, sf_dir, "documents")
    shards = write_token_shards(docs, scratch_path(spark, "tokens"))
    back = shards.read(shards.lookup(document_keys(docs)), digest=True)
    return back.select(null_again("_doc").alias("doc_id"), "start", "n_tokens", F.col("ids").alias("ids_crc32"))
