"""Prefix trie of conversations, merged family by family.

A family is the conversations whose ids share a base id. One shuffle brings a family's turns together (as digests, not
texts) behind its base conversation; each task rebuilds the conversations of its families in order, combines them into one
small trie for each family, and hands on only the combined nodes. Those are merged over all families by key. What is summed
over subtrees is rolled up inside the families again: each merged node is counted by one family only, its owner, so the sums
of the families add up. No step depends on the trie's depth, and neither a family nor a node's members are held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

HELD = 50_000  # nodes of a family that a task holds before it hands them on in parts
_OUT = 8192
_NODES = "key binary, parent binary, base bigint, part int, depth bigint, chars bigint, n bigint, first bigint, inner boolean, ends string, turn_conv bigint, turn_place bigint"
_SUMS = "key binary, leaves bigint, saved bigint, children bigint"
ROOT = bytes(16)


def _chain(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _node_schema() -> pa.Schema:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _NODES.split(", ")])


class _Family:
    """The trie of one family, handed on in parts of at most ``held`` nodes."""

    def __init__(self, base: int, held: int) -> None:
        self.base, self.held, self.part = base, held, 0
        self.head: list[tuple[bytes, int]] = []  # the first turns of the base conversation
        self.nodes: dict[bytes, list] = {}
        self.conv: int | None = None

    def begin(self, conv: int, shared: int) -> None:
        self.conv, self.shared, self.place = conv, shared, 0
        self.key, self.depth = ROOT, 0
        self._visit(ROOT, None, 0, 0, None, None)
        if conv != self.base:
            for place, (turn, chars) in enumerate(self.head[:shared], 1):
                self._step(turn, chars, self.base, place)

    def add(self, turn: bytes, chars: int, most_shared: int) -> None:
        self.place += 1
        if self.conv == self.base and self.place <= most_shared:
            self.head.append((turn, chars))
        if self.conv == self.base or self.place > self.shared:
            self._step(turn, chars, self.conv, self.place)

    def _step(self, turn: bytes, chars: int, conv: int, place: int) -> None:
        parent, self.key = self.key, _chain(self.key, turn)
        self.depth += 1
        self.nodes[parent][6] = True
        self._visit(self.key, parent, self.depth, chars, conv, place)

    def _visit(self, key: bytes, parent: bytes | None, depth: int, chars: int, conv: int | None, place: int | None) -> None:
        if (node := self.nodes.get(key)) is None:
            self.nodes[key] = [parent, depth, chars, 1, self.conv, [], False, conv, place]
        else:
            node[3] += 1

    def end(self) -> None:
        if self.conv is not None:
            self.nodes[self.key][5].append(self.conv)

    def full(self) -> bool:
        return len(self.nodes) > self.held

    def hand_on(self, again: bool) -> Iterator[tuple]:
        """All nodes so far; with ``again`` the node just reached stays, without members, to take children and its end."""
        for key, (parent, depth, chars, n, first, ends, inner, conv, place) in self.nodes.items():
            yield key, parent, self.base, self.part, depth, chars, n, first, inner, ",".join(map(str, ends)) if ends else None, conv, place
        last = self.nodes.get(self.key) if again else None
        self.nodes = {self.key: [*last[:3], 0, self.conv, [], False, *last[7:]]} if last else {}
        self.part += 1


def _family_tries(most_shared: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = _node_schema(), []
        family: _Family | None = None
        for batch in batches:
            for base, conv, shared, turn, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if family is None or base != family.base:
                    if family is not None:
                        family.end()
                        out += family.hand_on(False)
                    family = _Family(base, held)
                if conv != family.conv:
                    family.end()
                    family.begin(conv, shared)
                family.add(turn, chars, most_shared)
                if family.full():
                    out += family.hand_on(True)
                while len(out) >= _OUT:
                    yield _batch(out[:_OUT], schema)
                    del out[:_OUT]
        if family is not None:
            family.end()
            out += family.hand_on(False)
        for i in range(0, len(out), _OUT):
            yield _batch(out[i : i + _OUT], schema)

    return run


def _roll_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the subtrees of each family; rows come by family, deepest first, so that two levels are held: 100 nodes each."""
    schema = pa.schema([("key", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64())])
    out: list[tuple] = []
    at: tuple | None = None
    level: dict[bytes, list] = {}  # key: parent, leaves, saved, children
    below: dict[bytes, list] = {}  # what the level below gives its parents

    def close(next_below: dict[bytes, list]) -> None:
        for key, (parent, leaves, saved, children, own) in level.items():
            out.append((key, leaves, saved, children))
            if parent is not None:
                up = next_below.setdefault(parent, [0, 0, 0])
                up[0] += leaves
                up[1] += saved
                up[2] += own

    for batch in batches:
        for base, depth, key, parent, leaf, saved, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (base, depth) != at:
                gathered: dict[bytes, list] = {}
                close(gathered)
                below = gathered if at is not None and at[0] == base else {}
                at, level = (base, depth), {}
            if (node := level.get(key)) is None:
                got = below.get(key, (0, 0, 0))
                node = level[key] = [parent, got[0], got[1], got[2], 0]
            node[1] += leaf
            node[2] += saved
            node[4] += own
            if len(out) >= _OUT:
                yield _batch(out, schema)
                out.clear()
    close({})
    if out:
        yield _batch(out, schema)


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lists, comma-joined in the order they come: only the hash's state is held."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, state, out = None, None, []
    for batch in batches:
        for own, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if out:
            yield _batch(out, schema)
            out = []
    if key is not None:
        yield _batch([(key, state.hexdigest())], schema)


def rebuilt_turns(conversations: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Turns in the order of the families: ``base``, ``conv_id``, ``shared``, ``turn`` (digest of role and text), ``chars``.

    ``shared`` is how many first turns a conversation takes from its base: crc32 of its decimal id, modulo ``heads``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    c = F.col("conv_id").cast("bigint")
    rows = conversations.where(F.col("conv_id").isNotNull()).select((c - F.pmod(c, F.lit(family))).alias("base"), c.alias("conv_id"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("shared"), digest.alias("_digest"), F.length(text).cast("bigint").alias("chars"), F.col("turn").alias("_turn"))
    rows = rows.repartition("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("_turn"), "_digest")
    return rows.select("base", "conv_id", "shared", F.col("_digest").alias("turn"), "chars")


def prefix_trie(conversations: DataFrame, family: int = 100, heads: int = 6, held: int = HELD) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations, the empty one included.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``, and the node's ``key`` and ``parent`` (16 bytes each) with the conversation and place
    (from 1) of an original turn that is its last: ``turn_conv``, ``turn_place``.

    Turns are ordered by ``turn``, nulls first; equal ones by a digest of role and text, so that results don't depend on how
    rows are dealt; repeated rows are turns of their own. Null roles and texts are empty; rows without a conv_id belong to no
    conversation. The base of a negative id is the multiple of ``family`` at or below it. Conversations whose turns are all
    replaced by an absent base are members of the root. An empty table gives no rows, not even a root. Columns beyond conv_id,
    turn, role and text aren't read. A family of any length streams through one task, since each prefix needs the one before.
    """
    nodes = staged(rebuilt_turns(conversations, family, heads).mapInArrow(_family_tries(heads - 1, held), _NODES), "family-nodes")
    last = F.min(F.struct("first", "turn_conv", "turn_place"))
    merged = nodes.groupBy("key").agg(
        F.min("first").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"), F.max("inner").alias("inner"),
        F.min(F.struct("base", "part")).alias("owner"), last.alias("_last"), F.count("ends").alias("_lists"), F.min("ends").alias("_ends"),
    )
    merged = staged(merged, "merged-nodes")

    mine = (F.col("base") == F.col("owner.base")) & (F.col("part") == F.col("owner.part"))
    once = lambda c: F.when(mine, c).otherwise(F.lit(0)).cast("bigint")
    owned = nodes.select("key", "parent", "base", "part", "depth").join(merged.select("key", "n_convs", "inner", "owner", "chars"), "key")
    owned = owned.select("base", "depth", "key", "parent", once(F.when(F.col("inner"), 0).otherwise(1)).alias("leaf"), once((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), once(F.lit(1)).alias("own"))
    sums = owned.repartition("base").sortWithinPartitions("base", F.desc("depth")).mapInArrow(_roll_up, _SUMS)
    sums = sums.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children"))

    # members of families come in ascending order, so the lists of a node's families in order are one ascending list
    shared = merged.where(F.col("_lists") > 1).select("key")
    lists = nodes.where(F.col("ends").isNotNull()).join(shared, "key").select("key", "base", "part", "ends")
    digests = lists.repartition("key").sortWithinPartitions("key", "base", "part").select("key", "ends").mapInArrow(_joined_digests, "key binary, ends_sha256 string")

    parents = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    met = merged.join(sums, "key").join(digests, "key", "left").join(parents, "parent", "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.coalesce("_ends", F.lit("")).cast("binary"), 256))
    return met.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"), F.col("_last.turn_conv").alias("turn_conv"), F.col("_last.turn_place").alias("turn_place"))
