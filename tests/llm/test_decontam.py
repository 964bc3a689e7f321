import random

import messy
import pytest

from revlake.llm import decontam as D

r = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(4000)]


def prose(n):
    return [r.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(i, " ".join(prose(n)), "x") for i, n in enumerate([16, 20, 30, 60, 200, 13])]
    items += [(10, None, "x"), (11, "", "x"), (12, "one two three", "x"), (13, "alpha beta gamma delta epsilon zeta", "x"), (3, items[3][1], "x")]
    return spark.createDataFrame(items, "item_id long, text string, words string")


def test_planted_passages(spark, benchmark):
    items = {i.item_id: i.text.split() for i in benchmark.collect() if i.text}
    docs, want = [], set()
    for k in range(60):
        item = [1, 2, 3, 4][k % 4]
        words = list(items[item])
        for _ in range(len(words) // 12):  # substitutions, about 8 of 100
            words[r.randrange(len(words))] = "changed"
        docs.append((k, " ".join(prose(40) + words + prose(40)).upper().replace(" ", ", ")))
        want.add((k, item))
    docs += [(100 + k, " ".join(prose(300))) for k in range(60)]
    docs += [(200, "alpha beta GAMMA, delta epsilon-zeta"), (201, "alpha beta gamma delta epsilon"), (202, "one two three")]
    want.add((200, 13))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = D.find_overlaps(table, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want
    for x in rows:
        if x.doc_id < 100:
            assert x.equal_words >= 0.8 * (x.end - x.begin) and x.end - x.begin >= 12 and x.begin - 40 == x.item_begin
    kept = {x.doc_id for x in D.without_overlaps(table, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_messy_documents(spark, benchmark):
    odd = messy.documents(spark)
    text = [x.text for x in benchmark.collect() if x.item_id == 4][0]
    leak = spark.createDataFrame([(None, text), (9_000_000_001, text), (9_000_000_001, text)], "doc_id long, text string")
    both = odd.unionByName(leak, allowMissingColumns=True)
    assert {x.doc_id for x in D.find_overlaps(both, benchmark).collect()} == {None, 9_000_000_001}
    kept = D.without_overlaps(both, benchmark)
    assert kept.columns == both.columns and kept.count() == odd.count()
    assert all(x[c] == "z" for x in kept.collect() for c in messy.EXTRA)
    assert D.without_overlaps(messy.empty(spark), benchmark).count() == 0
    assert D.without_overlaps(odd, benchmark.limit(0)).count() == odd.count()


def test_best_stretch():
    import numpy as np

    same = np.array([0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1], bool)
    assert D.best_stretch(same) == (4, 7) and D.best_stretch(np.ones(5, bool)) == (0, 5)


def seeds_hit(same):
    return any(all(same[i + j] for j, c in enumerate(m) if c == "1") for m in D.MASKS for i in range(len(same) - len(m) + 1))


def test_stretches_of_all_substitution_places():
    from itertools import combinations

    import numpy as np

    for n in range(12, 26):
        places = [c for k in range(n // 5 + 1) for c in combinations(range(n), k)]
        same = np.ones((len(places), n), bool)
        for row, c in zip(same, places, strict=True):
            row[list(c)] = False
        sums = np.concatenate([np.zeros((len(same), 1), int), np.cumsum(5 * same - 4, axis=1)], axis=1)
        best = np.max([(sums[:, j] - sums[:, i]) for i in range(n + 1) for j in range(i + 12, n + 1)], axis=0)
        for row, total, most in zip(same, sums, best, strict=True):
            found = D.best_stretch(row, 12)
            assert (found is None) == (most < 0), row
            if found:
                assert found[1] - found[0] >= 12 and total[found[1]] - total[found[0]] == most


def test_edited_short_items_are_found(spark):
    from itertools import combinations

    table, docs, want = [], [], set()
    for n, k in ((12, 1), (15, 2), (16, 3)):
        item = prose(n)
        table.append((n, " ".join(item)))
        for places in combinations(range(n), k):
            words = ["changed" if i in places else w for i, w in enumerate(item)]
            same = [i not in places for i in range(n)]
            alike = any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(n) for j in range(i + 12, n + 1))
            docs.append((len(docs), " ".join(prose(30) + words + prose(30))))
            if alike and seeds_hit(same):
                want.add((len(docs) - 1, n))
    found = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(table, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want and len(want) > 500
    assert all(x.end - x.begin >= 12 and 5 * x.equal_words >= 4 * (x.end - x.begin) for x in found)


def test_two_overlaps_at_one_offset(spark):
    item = prose(70)
    words = item[:20] + [f"x{i}" for i in range(20)] + item[40:60] + ["y"] * 10
    docs = spark.createDataFrame([(1, " ".join(prose(30) + words + prose(30)))], "doc_id long, text string")
    found = D.find_overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((x.item_begin, x.begin, x.equal_words) for x in found) == [(0, 30, 20), (40, 70, 20)]
    assert all(x.end - x.begin == 20 for x in found)
