from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import tries
from tickloom.operators.segments import SEGMENT_ROWS

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(conversations):
    """Nodes of ``{conv: [(role, text), ...]}``, by walking a trie of dictionaries."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    rows = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in own if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(own), len(node), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def drawn(seed, count=60):
    rng = random.Random(seed)
    pool = [("user", "a"), ("user", "b"), ("bot", "a"), ("", ""), ("bot", "é€"), ("user", "a" * 50)]
    made = {}
    for conv in range(-5, count):
        if made and rng.random() < 0.6:
            base = rng.choice(list(made.values()))
            base = base[: rng.randint(0, len(base))]
        else:
            base = []
        made[conv * 3] = base + [rng.choice(pool) for _ in range(rng.choice([0, 1, 1, 2, 5]))]
    long = [("user", f"turn {i}") for i in range(150)]
    made |= {1000: long, 1001: long, 1002: long[:90] + [("bot", "x")] * 40, 1003: [("bot", "y")] * 130, 10**12: long}
    return made


def frames(spark, made):
    rng = random.Random(1)
    rows = [(c, i * 7 - 20, role or None, text or None) for c, turns in made.items() for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as conv", "2 as place", "'x' as owner"), spark.createDataFrame([(c,) for c in made], "conv_id long")


@pytest.mark.parametrize("cells, bucket", [(tries.MOST_CELLS, 10**6), (64, 10**6), (2, 20), (tries.MOST_CELLS, 20)])
def test_nodes_equal_brute_force(spark, cells, bucket):
    """With sketches that tell all, some and no singletons, and with long conversations in one and in many buckets."""
    made = drawn(3)
    turns, ids = frames(spark, made)
    spark.conf.set(SEGMENT_ROWS, str(bucket))
    try:
        found = tries.prefix_trie(turns, ids, most_cells=cells)
        assert found.columns == COLUMNS
        assert sorted((tuple(row) for row in found.collect()), key=str) == plain(made)
    finally:
        spark.conf.unset(SEGMENT_ROWS)


def test_many_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tries, "IDS_PER_CHUNK", 7)
    made = {c: [("user", "same")] for c in range(0, 900, 9)} | {c: [] for c in range(1, 300, 7)}
    found = tries.prefix_trie(*frames(spark, made))
    assert sorted((tuple(row) for row in found.collect()), key=str) == plain(made)


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, 1, "a", "b"), (4, None, "u", "first"), (4, 2, None, None), (4, 2, "", ""), (4, 3, "u", "z"), (4, 3, "u", "z"), (9, 5, "u", "first"), (9, 5, "u", "z")]
    turns = spark.createDataFrame(rows, TURNS)
    got = sorted((tuple(row) for row in tries.prefix_trie(turns).collect()), key=str)
    texts = {True: ("u", "first"), False: ("u", "z")}
    options = [plain({4: [("u", "first"), ("", ""), ("", ""), ("u", "z"), ("u", "z")], 9: [texts[first], texts[not first]]}) for first in (True, False)]
    assert got in options
    assert tries.prefix_trie(turns.limit(0)).count() == 0
    alone = tries.prefix_trie(turns.limit(0), spark.createDataFrame([(7,), (7,), (None,), (3,)], "conv_id long")).collect()
    assert [tuple(row) for row in alone] == plain({3: [], 7: []})


def test_a_sketch_never_counts_too_little():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    cells = np.zeros((tries.SKETCH_ROWS, 1 << 13), np.uint8)
    tries.counted(cells, np.concatenate([digests, digests[:1000]])[:2000])
    tries.counted(cells, np.concatenate([digests, digests[:1000]])[2000:])
    found = tries.estimates(cells, digests)
    assert (found[:1000] == tries.MANY).all() and (found[1000:] >= 1).all() and (found[1000:] == 1).mean() > 0.9


def test_rebuilding_equals_its_definition(spark):
    rng = random.Random(6)
    own = {c: [(f"r{rng.randint(0, 2)}", f"t{i}") for i in range(rng.randint(1, 14))] for c in rng.sample(range(-30, 120), 90)}
    rows = [(c, None if i == 0 else i, role, text) for c, turns in own.items() for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    turns, ids = tries.rebuilt_conversations(spark.createDataFrame(rows + [(None, 1, "a", "b")], TURNS))
    want = {}
    for c, turns_of in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c - 5 * int(c / 5))
        want[c] = own.get(base, [])[:h] + turns_of[h:]
    got = {r.conv_id: [] for r in ids.collect()}
    for r in sorted(turns.collect(), key=lambda r: r.turn):
        got[r.conv_id].append((r.role, r.text))
    assert got == want and any(not turns for turns in want.values())
