"""Small random corpora with copies, edits, shared passages, repeated ids, nulls and odd characters."""

import random


def documents(seed=1, n=200, vocabulary=60, ids=True):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "日本", "#x", "a|b"]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 120))] for _ in range(8)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        if w and rng.random() < 0.4:
            w[rng.randrange(len(w))] = "edit"
        text = rng.choice([" ", "\n", "  \t"]).join(w)
        rows.append((rng.choice([d, d, d, 5, None]) if ids else d, text if rng.random() > 0.04 else None))
    if ids:
        rows += rows[:12]
    return rows + [(9000, "a " * 400), (9001, "a " * 250), (9002, ""), (9003, " \n\t "), (9004, "ab" * 600)]


def frame(spark, rows, id_col="doc_id", parts=4):
    return spark.createDataFrame(rows, f"{id_col} long, text string").repartition(parts)


def empty(spark, id_col="doc_id"):
    return spark.createDataFrame([], f"{id_col} long, text string")


def same(got, want):
    return sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


SF = "/root/testdata/sf0.001"


def stored(name="documents", columns="doc_id, text", sf=SF):
    import duckdb

    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()
