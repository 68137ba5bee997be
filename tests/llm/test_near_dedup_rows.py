"""Rows that share an id, or have none, are judged by their own texts."""

import random

from corpus import frame
from test_near_dedup import families

from meltgrid.llm import near_dedup as N


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))


def kept(spark, rows):
    return sorted((tuple(r) for r in N.drop_near_duplicates(frame(spark, rows)).collect()), key=repr)


def test_unrelated_texts_under_one_id_stay(spark):
    rows = [(None, words(i)) for i in range(30)] + [(5, words(40)), (5, words(41)), (5, None), (5, ""), (None, None)]
    assert kept(spark, rows) == sorted(rows, key=repr)


def test_null_ids_do_not_join_groups(spark):
    x, y, z = words(1), words(2), words(3)
    rows = [(None, x), (None, y), (None, z), (1, x + " more"), (2, y + " more"), (None, z), (7, words(4)), (7, x + " else")]
    assert kept(spark, rows) == sorted([(None, x), (None, y), (None, z), (7, rows[6][1])], key=repr)


def test_one_row_of_each_group_under_any_ids(spark):
    rng = random.Random(6)
    rows = [(rng.choice([d, None, 5, 6]), t) for d, t in families(3)]
    rows += rows[:20]
    distinct = list(dict.fromkeys(rows))
    groups = {}
    for i, _, root, _ in N.brute_components(list(enumerate(t for _, t in distinct)), 5, 80):
        groups.setdefault(root, []).append(distinct[i])
    got = kept(spark, rows)
    rank = lambda r: -1 if r[0] is None else r[0]
    assert len(got) == len(groups) and len(set(got)) == len(got)
    for group in groups.values():
        mine = [r for r in group if r in set(got)]
        assert len(mine) == 1 and rank(mine[0]) == min(map(rank, group))
