"""Fuzzy search for short licence notices.

A text is reduced to its words, lower-cased and joined by one space.  A notice may be found with up to k edits of
characters; cut into k + 1 pieces, one piece must stand unchanged (pigeonhole).  One automaton over the pieces of all
notices finds these seeds in a pass over the text; the stretch that a match around a seed can cover is then given to
the regex library, whose bounded-error matching verifies the edits.  Of the matches in a stretch the one with the
fewest edits is taken, then those before and behind it.  A match may begin and end within a word; its words are all
that it touches.  Phrases that must stand exactly are notices of zero edits that begin and end with a word: one piece,
nothing to verify but word ends, and every place counts.

A hit has a label, its edits, and its span in words and in characters of the original text (first and last one).
Where hits of several labels meet, only the likeliest stays; exact phrases always do.  The score of a document is the
best ``1 - edits / length`` of its hits, 1 for an exact phrase, 0 without hits.

Defined results: null and empty texts have no words and no hits; null and repeated ids are rows of their own; empty
tables give no rows; other columns pass through ``scan_licenses`` unless they bear the names of its own, which
replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm import kernels as K
from meltgrid.llm.common import table

# The phrases of the base rules.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices that the fuzzy search adds, as words, and the share of a notice's characters that may be edited.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
)
EDITS = 0.08

#: Lower-cased byte of a word, a space for every other byte.
_WORD = np.full(256, 0x20, dtype=np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_c] = _c
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)

HIT = ("struct<label:string,edits:int,first_word:bigint,last_word:bigint,first_char:bigint,last_char:bigint,"
       "base:boolean>")
_HIT = pa.struct([("label", pa.string()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("first_char", pa.int64()), ("last_char", pa.int64()), ("base", pa.bool_())])


def allowed(notice: str, edits: float = EDITS) -> int:
    """Edits that a notice may have."""
    return int(len(notice) * edits)


def cut(notice: str, pieces: int) -> list[tuple[int, str]]:
    """(start, piece): the notice in pieces of nearly equal length."""
    at = [len(notice) * i // pieces for i in range(pieces + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


def joined_words(data: np.ndarray, off: np.ndarray):
    """(joined bytes, place of each in ``data``, row bounds in them): words by one space, a line break behind each row."""
    raw = _WORD[data]
    solid = raw != 0x20
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[off] = True
    # A space stays where a word ended just before it; each row gets one more byte for its end.
    keep = solid.copy()
    keep[1:] |= solid[:-1] & ~solid[1:] & ~first[1:len(raw)]
    at = np.flatnonzero(keep)
    ends = np.searchsorted(at, off[1:])
    place = np.insert(at, ends, off[1:])
    bounds = np.concatenate([[0], ends + np.arange(1, len(off))])
    joined = raw[np.minimum(place, max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(place), dtype=np.uint8)
    joined[bounds[1:] - 1] = 0x0A
    return joined, place, bounds


class Scanner:
    """Seeds of all notices in one automaton, and the expressions that verify them."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, edits: float = EDITS):
        import ahocorasick
        import regex

        self.rules, seeds = [], {}
        for label, notice, k, base in ([(label, n, 0, True) for label, n in phrases]
                                       + [(label, n, allowed(n, edits), False) for label, n in notices]):
            match = regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}")
            self.rules.append((label, len(notice), base, match))
            for start, piece in cut(notice, k + 1):
                # Bytes of a match before and behind the piece: each edit may bring a character of four bytes.
                before, behind = len(notice[:start].encode()) + 4 * k, len(notice[start:].encode()) + 4 * k
                raw = piece.encode()
                seeds.setdefault(raw.decode("latin-1"), set()).add((len(self.rules) - 1, before, behind, len(raw)))
        self.automaton = ahocorasick.Automaton()
        for piece, users in seeds.items():
            self.automaton.add_word(piece, sorted(users))
        self.automaton.make_automaton()

    def _stretches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(rule, first byte, last byte) to verify; stretches of a fuzzy notice that touch are one."""
        pending: dict[int, list[int]] = {}
        for end, users in self.automaton.iter(text):
            for rule, before, behind, size in users:
                at = end + 1 - size
                if self.rules[rule][2]:
                    yield rule, at, end + 1
                    continue
                span = pending.get(rule)
                if span is not None and at - before <= span[1]:
                    span[0] = min(span[0], at - before)
                    span[1] = max(span[1], at + behind)
                    continue
                if span is not None:
                    yield rule, *span
                pending[rule] = [at - before, at + behind]
        for rule, span in pending.items():
            yield rule, *span

    @staticmethod
    def _best(match, text: str) -> Iterator[tuple[int, int, int]]:
        """(first, last, edits): the match of fewest edits, then those on either side of it."""
        todo = [(0, len(text))]
        while todo:
            low, high = todo.pop()
            m = match.search(text, low, high)
            if m is not None and m.end() > m.start():
                yield m.start(), m.end(), sum(m.fuzzy_counts)
                todo += [(m.end(), high), (low, m.start())]

    def _verified(self, raw: bytes, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, rule, first byte, last byte, edits) of every match."""
        for rule, low, high in self._stretches(raw.decode("latin-1")):
            _, _, base, match = self.rules[rule]
            row = int(np.searchsorted(bounds, max(low, 0), "right")) - 1
            if base:
                if (low == 0 or raw[low - 1] in b" \n") and raw[high] in b" \n":
                    yield row, rule, low, high, 0
                continue
            while row < len(bounds) - 1 and bounds[row] < high:  # touching stretches may run over several rows
                first, last = max(low, int(bounds[row])), min(high, int(bounds[row + 1]) - 1)
                while raw[first] & 0xC0 == 0x80:  # whole characters
                    first += 1
                while raw[last] & 0xC0 == 0x80:
                    last += 1
                text = raw[first:max(first, last)].decode()
                for a, b, edits in self._best(match, text):
                    a, b = first + len(text[:a].encode()), first + len(text[:b].encode())
                    yield row, rule, a + (raw[a] == 0x20), b - (raw[b - 1] == 0x20), edits
                row += 1

    def hits(self, joined: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
        """Every match of every notice in each row of a slice; ``at`` are its first and last byte in ``joined``."""
        found: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        gap = np.flatnonzero((joined == 0x20) | (joined == 0x0A))
        for row, rule, a, b, edits in self._verified(joined.tobytes(), bounds):
            label, length, base, _ = self.rules[rule]
            none, first, last = np.searchsorted(gap, [bounds[row], a, b - 1]).tolist()
            found[row].append({"label": label, "edits": edits, "likeness": 1 - edits / length, "base": base,
                               "first_word": first - none, "last_word": last - none, "at": (a, b - 1)})
        return found


def contest(hits: list[dict]) -> list[dict]:
    """Hits in order of their place, without the fuzzy ones that meet a likelier hit of another label.

    Notices that differ in a few characters are found in each other's places; the likeliest is meant.
    """
    hits = sorted(hits, key=lambda h: (h["first_word"], h["last_word"], h["label"], h["edits"], not h["base"]))
    widest = max((h["last_word"] - h["first_word"] for h in hits), default=0)
    out = []
    for i, h in enumerate(hits):
        beaten = False
        for step in () if h["base"] else (1, -1):
            j = i + step
            while not beaten and 0 <= j < len(hits) and (
                    hits[j]["first_word"] <= h["last_word"] if step > 0 else hits[j]["first_word"] >= h["first_word"] - widest):
                o = hits[j]
                beaten = (o["last_word"] >= h["first_word"] and o["label"] != h["label"] and o["likeness"] > h["likeness"])
                j += step
        if not beaten:
            out.append(h)
    return out


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases=PHRASES, notices=NOTICES,
                  edits: float = EDITS) -> DataFrame:
    """``docs`` with ``n_words``, ``license_hits`` (label, edits, span in words and characters) and ``license_score``."""
    own = ("n_words", "license_hits", "license_score")
    docs = docs.drop(*own)

    def run(batches):
        scanner = Scanner(phrases, notices, edits)
        for rows, data, off in K.text_slices(batches, text_col):
            joined, place, bounds = joined_words(data, off)
            lead = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            solid = (joined != 0x20) & (joined != 0x0A)
            total = np.zeros(len(joined) + 1, dtype=np.int64)
            np.cumsum(solid & np.append(True, ~solid)[:len(solid)], out=total[1:])
            hits, scores = [], []
            for i, found in enumerate(scanner.hits(joined, bounds)):
                kept = contest(found)
                char = [[int(lead[place[x] + 1] - lead[off[i]]) for x in h["at"]] for h in kept]
                hits.append([{"label": h["label"], "edits": h["edits"], "first_word": h["first_word"],
                              "last_word": h["last_word"], "first_char": a - 1, "last_char": b - 1, "base": h["base"]}
                             for h, (a, b) in zip(kept, char)])
                scores.append(max((h["likeness"] for h in kept), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.diff(total[bounds]), pa.int64()), pa.array(hits, pa.list_(_HIT)),
                 pa.array(scores, pa.float64())], names=[*rows.schema.names, *own])
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, n_words long, license_hits array<{HIT}>, license_score double")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of every whole text of the documents table."""
    rows = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("license_hits", lambda h: h["base"])

    def names(hits):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    start = F.transform(base, lambda h: h["first_word"])
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                       F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
                       names(base).alias("base_labels"), names(F.col("license_hits")).alias("labels"),
                       F.col("license_score").alias("score"))
