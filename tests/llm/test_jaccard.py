import random
from collections import Counter, defaultdict

import messy
import pytest

from revlake.llm import components as C
from revlake.llm import jaccard as J


def expected(rows):
    sets = [(r.doc_id, messy.shingles(r.text)) for r in rows if r.doc_id is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(sets):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((d, len(s), lowest[find(i)]) for i, (d, s) in enumerate(sets))


def check(docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect() if r.doc_id is not None)
    assert got == expected(docs.collect())


def near_copies(seed, groups=6, size=14, extra=30):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 5000)}"
    common = [word() for _ in range(12)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(5, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 16))):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w + (common if r.random() < 0.5 else [])))
    texts += [" ".join([word() for _ in range(r.randint(0, 60))] + common) for _ in range(extra)]
    r.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("way", ["as it is", "blocks", "cells"])
def test_near_copies(spark, monkeypatch, way):
    if way == "blocks":
        monkeypatch.setattr(J, "LEAF_PAIRS", 0)
        monkeypatch.setattr(J, "BLOCK", 5)
    if way == "cells":
        monkeypatch.setattr(J, "LEAF", 1)
        monkeypatch.setattr(J, "BLOCK", 5)
        monkeypatch.setattr(J, "PIVOTS", 2)
    check(spark.createDataFrame(near_copies(3), "doc_id long, text string"))


def test_a_region_of_many_groups_is_divided_into_cells(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: f"w{r.randint(0, 50000)}"
    rows, shared = [], [word() for _ in range(6)]
    for _ in range(8):
        base = [word() for _ in range(60)]
        for k in range(100):
            w = list(base)
            for _ in range(r.randint(1, 2)):
                w[r.randrange(60)] = word()
            rows.append((len(rows), " ".join(w + (shared if k < 10 else []))))
    seen, cells = [], J._cells

    def spied(regions, sets):
        links, members = cells(regions, sets)
        seen.append((regions.count(), members.filter("not whole").count(), members.filter("not whole").select("region").distinct().count()))
        return links, members

    monkeypatch.setattr(J, "_cells", spied)
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    # Documents of a region, places in cells (replicas included), and cells.
    assert seen and seen[0][0] > J.LEAF and seen[0][1] > J.LEAF and seen[0][2] > 1


def test_messy_documents(spark):
    docs = messy.documents(spark)
    check(docs)
    assert J.jaccard_components(docs).count() == docs.count()
    assert J.jaccard_components(messy.empty(spark)).count() == 0
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in expected(docs.collect()) if d == c}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_components_of_random_edges(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    parent = defaultdict(lambda: None)

    def find(x):
        while parent[x] not in (None, x):
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
            parent[min(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent)}
    got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x.key for x in got}) and {x.key: x.label for x in got} == want


def components_of(texts):
    """A label for each text, by brute force."""
    sets, labels = [messy.shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and labels[i] != labels[j] and 100 * len(a & b) >= 80 * len(a | b):
                labels = [labels[j] if x == labels[i] else x for x in labels]
    return labels


@pytest.mark.parametrize("log", [26, 6])
def test_rows_without_an_id_link_like_others(spark, monkeypatch, log):
    monkeypatch.setattr(J, "BITMAP_LOG", log)
    texts = near_copies(5, groups=5, size=8, extra=10)
    rows = [(i if k % 3 else None, t) for k, (i, t) in enumerate(texts)]
    labels = components_of([t for _, t in rows])
    lowest = {}
    for (i, _), c in zip(rows, labels, strict=True):
        lowest[c] = min((x for x in (i, lowest.get(c)) if x is not None), default=None)
    want = Counter((i, len(messy.shingles(t)), lowest[c]) for (i, t), c in zip(rows, labels, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()) == want


def test_one_row_of_each_component_stays(spark):
    texts = near_copies(6, groups=5, size=6, extra=8)
    rows = [(None if k % 3 == 0 else i, t, k) for k, (i, t) in enumerate(texts)]
    rows += [(None, "only rows without an id have this text", 900), (None, "only rows without an id have this text", 901)]
    rows += [(*rows[1][:2], 902), (rows[4][0], rows[4][1] + " more", 903), (None, None, 904), (None, "", 905), (None, "", 906), (7001, " ", 907)]
    labels = components_of([t for _, t, _ in rows])
    kept = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert Counter(labels[i] for r in kept for i, row in enumerate(rows) if row == tuple(r)) == dict.fromkeys(labels, 1)
    assert len(kept) == len(set(labels))
    for r in kept:
        mine = labels[[n for _, _, n in rows].index(r.n)]
        assert r.doc_id == min((i for (i, _, _), c in zip(rows, labels, strict=True) if c == mine and i is not None), default=None)
