"""The prefix trie against a brute-force version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import queries, trie


def brute(rows):
    """Nodes of the rebuilt conversations; ``rows`` has conv_id, turn, role, text."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, trie_id(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + t[zlib.crc32(str(c).encode()) % 6 :] for c, t in own.items()}
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def sums(p):
        leaves, saved = 0, (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            a, b = sums(k)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        sums(())
    return sorted(out, key=repr)


def trie_id(role, text):
    return f"{len(text):08x}" + hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def rows_of(seed, n, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(420), n):
        some = rng.choice([0, 1, 3, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(some)]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_against_brute_force(spark):
    """Few texts make deep shared prefixes; nulls, ties, equal rows, turnless rebuilds, a long conversation,
    equal conversations; small blocks, pieces and groups give the same."""
    rows = rows_of(1, 120, ["a", "b", "", "école", "x" * 3000])
    rows += [(None, 1, "user", "lost"), (500, None, None, None), (500, 2, "user", "z"), (500, 2, "user", "z"), (500, 2, "user", "y")]
    rows += [(c, 0, "system", "hot") for c in range(1000, 1090)] + [(7000, t, "user", str(t % 3)) for t in range(700)]
    want = brute(rows)
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"of": F.lit(1), "key": F.lit("k"), "h": F.lit(2)}).repartition(5)
    assert got(trie.prefix_trie(turns)) == want
    keys = trie.shared_starts(trie.conversation_keys(turns))
    assert got(trie.prefix_nodes(keys, parts=9, block_keys=3, piece_chars=30, fan_in=2)) == want
    assert got(trie.prefix_nodes(keys, parts=1, block_keys=1)) == want
    assert trie.prefix_trie(turns.limit(0)).count() == 0


@pytest.mark.parametrize("kinds", [3, 30, 300])
def test_node_layouts(kinds):
    """Nodes of 4, 16, 48 and 256 children hold what was put in, in order, with compressed paths."""
    rng = random.Random(kinds)
    keys = {bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 20, 40]))) for _ in range(kinds)} | {bytes([k % 256]) for k in range(kinds)}
    root = trie.Node(b"")
    for key in sorted(keys, key=lambda k: hashlib.sha256(k).digest()):
        trie.insert(root, key, key)
    found, sizes = [], set()

    def walk(node, path):
        sizes.add(node.size)
        assert node.value is None or node.value == path
        if node.value is not None:
            found.append(path)
        for b, kid in node.children():
            walk(kid, path + bytes([b]) + kid.prefix)

    walk(root, b"")
    assert found == sorted(keys)
    assert root.size == min(x for x in (4, 16, 48, 256) if x >= len(root.children()))
    assert kinds < 300 or sizes == {4, 256}


def test_query_has_a_node_for_each_prefix(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, sf)) == brute(rows)
