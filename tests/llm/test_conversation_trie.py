"""The conversation trie against a plain one built in memory, with the awkward cases."""

import hashlib
import random
import zlib

import pytest

from quillspan.llm import conversation_trie
from quillspan.llm.conversation_trie import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows, family=100, heads=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % heads
        turns = own.get(c - c % family, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), [[], []])[0].append(c)
        nodes[tuple(turns)][1].append(c)
    out = []
    for k, (members, ends) in nodes.items():
        under = [q for q in nodes if q[: len(k)] == k]
        kids = [q for q in under if len(q) == len(k) + 1]
        leaves = [q for q in under if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in under)]
        saved = sum((len(nodes[q][0]) - 1) * len(q[-1][1]) for q in under if q)
        parent = nodes[k[:-1]][0][0] if k else None
        out.append((members[0], len(k), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, n int")
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(df, **kw).select(*COLUMNS).collect()), key=str)


def talks(rng, ids, turns, texts):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in ids for t in rng.sample(range(-3, turns), rng.randint(0, turns))]


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_trie(spark, seed):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(-120, 420), 60) + [0, 100])
    rows = talks(rng, [c for c in ids if c != 300], 9, ["a", "b", "", None, "Zażółć 😀"])
    rows += [(c, None, "user", "a") for c in ids[::9]] + [(None, 1, "user", "x"), (None, None, None, None)]
    rows += [(17, 5, "user", "tie"), (17, 5, "user", "bow"), (17, 5, "user", "bow"), (17, 5, None, None)]
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("held", [1, 3])
def test_tries_in_parts(spark, held):
    """A family handed on in many parts gives the same nodes."""
    rng = random.Random(held)
    rows = talks(rng, range(95, 140), 8, ["a", "b"])
    assert run(spark, rows, held=held) == plain(rows)


def test_many_families_with_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 2000, 7) for t in range(7)] + [(c, 0, "user", "hello") for c in range(1, 2000, 50)]
    assert run(spark, rows) == plain(rows)


def test_one_long_conversation(spark):
    rows = [(7, t, "user", "again" if t % 2 else str(t)) for t in range(400)] + [(0, t, "user", str(t)) for t in range(300)] + [(8, 0, "user", "x" * 100_000)]
    assert run(spark, rows, held=50) == plain(rows)


def test_absent_base_and_turnless(spark):
    ids = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2]
    rows = [(c, t, "user", "t") for c in ids for t in range(2)]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 1 and got[0][1] == 0 and got[0][3] == len(ids)


def test_other_families(spark):
    rows = talks(random.Random(9), range(40), 6, ["a", "b", "c"])
    assert run(spark, rows, family=10, heads=3) == plain(rows, 10, 3)


def test_empty(spark):
    assert run(spark, []) == []


def test_turn_of_a_node(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "r"), (1, 0, "user", "q"), (1, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    nodes = prefix_trie(df, heads=1).collect()
    own = {c: [r for r in rows if r[0] == c] for c in (0, 1)}
    keys = {conversation_trie.ROOT: ()}
    for n in sorted(nodes, key=lambda n: n.depth):
        if n.depth:
            keys[bytes(n.key)] = (*keys[bytes(n.parent)], own[n.turn_conv][n.turn_place - 1][3])
    assert sorted(keys.values()) == [(), ("q",), ("q", "r"), ("q", "z")]
