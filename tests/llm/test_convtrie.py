import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from revlake.llm import convtrie as C
from revlake.llm.registered import SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ends string, shard string"


def rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    turns = {c: [((r[2] or ""), (r[3] or "")) for r in sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))] for c, rs in own.items()}
    out = {}
    for c, line in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + line[h:]
    return out


def expected(sequences):
    members = defaultdict(list)
    for c, line in sequences.items():
        for d in range(len(line) + 1):
            members[tuple(line[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[b] for b in below)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], sha(c for c in m if len(sequences[c]) == len(node)))
        for node, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    assert set(df.columns) == set(COLUMNS)
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def conversations(seed, count, most=9):
    r = random.Random(seed)
    rows = []
    for c in range(count):
        for t in range(r.randint(1, most)):
            text = r.choice(["a", "b", "é", None, "long text " * 3]) if r.random() < 0.8 else f"own {c}"
            rows.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", None]), text, "z", "z", "z"))
    rows += [(7, 3, "user", "again", "z", "z", "z")] * 2 + [(None, 1, "user", "lost", "z", "z", "z")]
    for c in (10**12, -3, -10):
        rows.append((c, 0, "user", "far", "z", "z", "z"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "width"), [(200_000, 32), (40, 2), (3, 3), (1, 1)])
def test_random_conversations(spark, monkeypatch, turns, width):
    monkeypatch.setattr(C, "SHARD_TURNS", turns)
    rows = conversations(turns, 90 if turns > 3 else 25)
    got = result(C.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == expected(rebuilt(rows))


def test_ties_and_nulls_have_an_order(spark):
    rows = [(1, 0, "b", "x", *"zzz"), (1, 0, "a", "yy", *"zzz"), (1, None, None, None, *"zzz"), (1, None, None, None, *"zzz")]
    nodes = C.prefix_nodes(C.turn_sequences(spark.createDataFrame(rows, SCHEMA)))
    assert result(nodes) == expected({1: [("", ""), ("", ""), ("a", "yy"), ("b", "x")]})


def test_empty_table(spark):
    assert C.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_conversation_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_TURNS", 300)
    base = [("user", "hello"), ("assistant", "same answer")]
    lines = {c: list(base) for c in range(3000)}
    lines |= {c: base + [("user", f"q{c % 7}"), ("assistant", f"r{c}")] for c in range(3000, 3400)}
    lines[5000] = base + [("user", f"turn {i}") for i in range(700)]
    lines[5001] = lines[5000][:650] + [("user", "other")]
    lines[5002] = lines[5000][:350]
    rows = [(c, i, *turn, *"zzz") for c, line in lines.items() for i, turn in enumerate(line)]
    got = result(C.prefix_nodes(C.turn_sequences(spark.createDataFrame(rows, SCHEMA))))
    assert got == expected(lines)


def test_sql_gives_the_same_rows(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    got = result(C.conversation_trie(spark.read.parquet(path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op13_conversation_trie']})").fetchall()
    assert got == sorted(want) and len(got) > 100
