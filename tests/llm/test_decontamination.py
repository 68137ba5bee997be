import random

import pytest
from corpus import SF, documents, empty, frame, same, stored

from meltgrid.llm import decontamination as D


def cases(seed=1):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    docs = []
    for j in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        for _, text in rng.sample(items, 2):
            x = text.split()
            if rng.random() < 0.5 and len(x) > 20:
                x[rng.randrange(len(x))] = "edit"
            cut = len(x) // 2 if rng.random() < 0.4 and len(x) > 30 else 0  # in two places
            for part in ([x[:cut + 4], x[cut:]] if cut else [x]):
                p = rng.randrange(len(w) + 1)
                w[p:p] = part
        docs.append((rng.choice([j, None]), " ".join(w)))
    return docs + [(1, None), (2, "")], items + [(None, "v1 v2 v3 v4 v5 v6"), (70, None), (71, " ")]


@pytest.mark.parametrize("most", [D.ITEM_SHINGLES, 50])
def test_contained_items_equal_brute_force(spark, monkeypatch, most):
    docs, items = cases()
    monkeypatch.setattr(D.item_blocks, "__defaults__", (most,))
    got = D.contained_items(frame(spark, docs), frame(spark, items, "item_id", 1)).collect()
    assert same([tuple(r)[:4] for r in got], D.brute_contained(docs, items))


def test_contaminated_documents_go(spark):
    docs, items = cases(2)
    bad = {i for i, _ in enumerate(docs) if D.brute_contained([docs[i]], items)}
    df = frame(spark, docs).withColumnRenamed("doc_id", "item_id")
    out = D.drop_contaminated(df, frame(spark, items, "item_id", 1))
    assert out.columns == ["item_id", "text"] and same(out.collect(), [d for i, d in enumerate(docs) if i not in bad])


def test_registered_query(spark):
    got = [tuple(r)[:4] for r in D.op2_decontamination(spark, SF).collect()]
    assert same(got, D.brute_contained(stored(), stored("benchmark", "item_id, text")))


def test_empty_tables(spark):
    docs = frame(spark, documents(1, 10))
    assert D.contained_items(docs, empty(spark, "item_id")).count() == 0
    assert D.contained_items(empty(spark), frame(spark, [(1, "a b c")], "item_id")).count() == 0
    assert D.drop_contaminated(docs, empty(spark, "item_id")).count() == docs.count()
