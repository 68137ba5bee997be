"""Fuzzy notice search against plain edit distances."""

import random
import re

import numpy as np
from corpus import SF, empty, frame, same, stored
from pyspark.sql import functions as F

from meltgrid.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]


def base_row(doc, text):
    w = words(text)
    at = [(i, label) for label, phrase in L.PHRASES for i in places(w, phrase)]
    start = [i for i, _ in at]
    return doc, len(w), len(at), min(start, default=None), max(start, default=None), ",".join(sorted({b for _, b in at}))


def fewest_edits(w, notice):
    """Smallest edit distance between the notice and any part of the joined words."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in " ".join(w):
        new = [0]
        for j, x in enumerate(notice):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def slice_of(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), off


def noisy(rng, notice, n):
    text = list(notice)
    for _ in range(n):
        i = rng.randrange(len(text))
        text[i:i + rng.choice([0, 1, 1])] = rng.choice([[], ["x"], ["é"], ["日"], [" "], ["-"]])
    return "".join(text)


def test_every_notice_within_its_edits():
    rng = random.Random(3)
    scanner = L.Scanner()
    texts = []
    for _ in range(150):
        _, notice = rng.choice(L.NOTICES)
        filler = [rng.choice(["under", "the", "license", "ä", "licensed", "version", "x"]) for _ in range(rng.randint(0, 6))]
        text = noisy(rng, notice, rng.randint(0, L.allowed(notice) + 2))
        texts.append(" ".join(filler) + rng.choice([" ", ", ", "\n"]) + text.title() + rng.choice(["", ".", " " + " ".join(filler)]))
    texts += ["", "  ", "licensed under " * 40, "x".join(n for _, n in L.NOTICES)]
    joined, _, bounds = L.joined_words(*slice_of(texts))
    for text, found in zip(texts, scanner.hits(joined, bounds)):
        got = {}
        for h in found:
            if not h["base"]:
                got[(h["label"], h["likeness"])] = h["edits"]
        want = {}
        for label, notice in L.NOTICES:
            d = fewest_edits(words(text), notice)
            if d <= L.allowed(notice):
                want[(label, 1 - d / len(notice))] = d
        assert want.items() <= got.items() and {k[0] for k in got} == {k[0] for k in want}, text


def test_joined_words_and_spans(spark):
    text = "Ü: «Released under the  MIT-Licence» -- 日本 CC BY-NC, cc by nc"
    row = L.scan_licenses(frame(spark, [(1, text)]).withColumn("N_WORDS", F.lit("mine"))).first()
    assert row["n_words"] == len(words(text)) and "N_WORDS" not in row.asDict()
    spans = [(h["label"], h["edits"], text[h["first_char"]:h["last_char"] + 1]) for h in row["license_hits"]]
    assert spans == [("mit", 1, "Released under the  MIT-Licence"), ("cc-by-nc", 0, "CC BY-NC"), ("cc-by-nc", 0, "cc by nc")]
    assert words(text)[row["license_hits"][0]["first_word"]] == "«released" and row["license_score"] == 1.0


def test_the_likeliest_label_stays():
    scanner = L.Scanner()
    for text, label in (("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("licensed under the GNU General Public License, version 2", "gpl-2")):
        joined, _, bounds = L.joined_words(*slice_of([text]))
        found = scanner.hits(joined, bounds)[0]
        assert len({h["label"] for h in found}) > 1 and {h["label"] for h in L.contest(found)} == {label}


def test_base_columns_equal_brute_force(spark):
    rows = [(1, "Under the MIT license. " * 500), (1, "under the mit license"), (None, None), (2, ""), (3, "xunder the mit license"),
            (4, "cc by nc cc by ncx"), (5, "Apache License, Version 2.0 İ CC-BY-NC"), (6, "Apache License, Version 20"), (None, "CC BY NC")]
    out = L.scan_licenses(frame(spark, rows))
    got = [(r["doc_id"], r["n_words"], sum(h["base"] for h in r["license_hits"])) for r in out.collect()]
    assert same(got, [base_row(*r)[:3] for r in rows])
    assert L.scan_licenses(empty(spark)).count() == 0


def test_registered_query(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        got = L.op13_license_scan(spark, sf).collect()
        assert same([tuple(r)[:6] for r in got], [base_row(d, t) for d, t in stored(sf=sf)])
        for r in got:
            assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
            assert (r["score"] > 0) == (r["labels"] != "") and (r["score"] == 1 or not r["base_labels"])
