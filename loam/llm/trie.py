"""Operator 13: a prefix trie of conversations, merged family by family.

Conversations that share a base id are a family. A family's conversations are
rebuilt and its own trie is built in one task, so what many of them share is one
node before anything travels; only these nodes are shuffled by key and merged.
A node's key is its depth and two sums modulo a prime, one term for each turn,
so it can be carried along a path turn by turn, or be taken as a running sum
over ranges of turns: conversations of more than LONG turns go that way, spread
over all tasks, and are families of their own. Every other family has bounded
rows: 199 ids of LONG turns at most.

Sums over subtrees are taken inside families too. A node belongs to the family
that holds its smallest member, and only there does it count for its ancestors;
adding a node's sums over the families that have it counts each descendant once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.analytics import running
from ..session import ship_code
from .common import as_bytes, joined_by_weight, stored

#: Ids of a family, and most turns that a conversation can owe to its base.
FAMILY, SHARED = 100, 5
#: Turns from which a conversation is spread over tasks.
LONG = 2_000
#: Fixed values of node keys: the modulus and the base of each sum.
PRIME = (1 << 61) - 1
BASES = (0x1C2F0A5B3D4E6F71, 0x0B7A9D8C6E5F4031)

NODE = "long boolean, unit long, depth long, key1 long, key2 long, up1 long, up2 long, first long, n_convs long, size long, has_child boolean, ends array<long>"
KEY = ["depth", "key1", "key2"]
#: The order of a conversation's turns.
ORDER = ["has_turn", "turn", "role", "text"]


def head_turns(conv_id: int) -> int:
    """h: how many first turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % (SHARED + 1)


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % F.lit(FAMILY)


def heads(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(SHARED + 1)


def turn_hashes(role: str, text: str) -> tuple[int, int]:
    name = as_bytes(role)
    raw = hashlib.md5(len(name).to_bytes(8, "little") + name + as_bytes(text)).digest()
    return int.from_bytes(raw[:8], "little") % PRIME, int.from_bytes(raw[8:], "little") % PRIME


def terms(depth: int, hashes: tuple[int, int]) -> tuple[int, int]:
    """What the turn at a depth adds to the two sums of its node's key."""
    return hashes[0] * pow(BASES[0], depth, PRIME) % PRIME, hashes[1] * pow(BASES[1], depth, PRIME) % PRIME


def family_nodes(base: int, turns: Iterator[tuple[int, str, str]], head: list[tuple[str, str]]) -> list[tuple]:
    """The nodes (NODE) of one family: turns (conv_id, role, text), by conversation and in order, and the base's first turns."""
    own: dict[int, list[tuple[str, str]]] = {}
    for c, role, text in turns:
        own.setdefault(c, []).append((role, text))
    nodes: dict[tuple, list] = {}
    for c in sorted(own):
        h = head_turns(c)
        path = [*head[:h], *own[c][h:]]
        key, up = (0, 0, 0), (0, 0, 0)
        for depth in range(len(path) + 1):
            if depth:
                a, b = terms(depth, turn_hashes(*path[depth - 1]))
                up, key = key, (depth, (key[1] + a) % PRIME, (key[2] + b) % PRIME)
            if key not in nodes:
                nodes[key] = [False, base, *key, up[1], up[2], c, 0, len(path[depth - 1][1]) if depth else 0, False, []]
            node = nodes[key]
            node[8] += 1
            node[10] |= depth < len(path)
        nodes[key][11].append(c)
    return list(nodes.values())


def ordinary(turns: DataFrame, head: DataFrame) -> DataFrame:
    """NODE rows of the families of conversations of bounded length."""
    schema = pa.schema([("long", pa.bool_()), *((c, pa.int64()) for c in ("unit", "depth", "key1", "key2", "up1", "up2", "first", "n_convs", "size")), ("has_child", pa.bool_()), ("ends", pa.list_(pa.int64()))])

    def in_order(t: pa.Table) -> pa.Table:
        return t.sort_by([(c, "ascending") for c in ("conv_id", *ORDER)])

    def build(t: pa.Table, head: pa.Table) -> pa.Table:
        if not t.num_rows:  # a base whose family has no rows here
            return schema.empty_table()
        t, head = in_order(t), in_order(head)
        rows = zip(*(t.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
        found = family_nodes(t.column("base")[0].as_py(), rows, list(zip(head.column("role").to_pylist(), head.column("text").to_pylist(), strict=True)))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return turns.groupBy("base").cogroup(head.groupBy("base")).applyInArrow(build, NODE)


def modulo(value: Column) -> Column:
    return F.pmod(value, F.lit(PRIME).cast("decimal(38,0)")).cast("long")


def spread(turns: DataFrame, head: DataFrame) -> DataFrame:
    """NODE rows of long conversations, each a family of its own: places and keys are running sums over ranges of turns."""
    one_term = F.udf(lambda depth, role, text: terms(depth, turn_hashes(role, text)), "struct<a:long,b:long>", useArrow=True)
    numbered = stored(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = running(numbered, ["conv_id"], [F.col(c) for c in (*ORDER, "row")], {"place": F.lit(1)})
    placed = placed.withColumn("h", heads(F.col("conv_id")))
    given = placed.where("place = 1").select(F.col("conv_id").alias("_conv_id"), "base", "h").join(head, "base").where("at <= h")
    given = given.select(F.col("_conv_id").alias("conv_id"), F.col("at").cast("long").alias("depth"), "role", "text")
    counted = placed.where("place > h").join(head.groupBy("base").agg(F.count("*").alias("n_head")), "base", "left")
    depth = F.col("place") - F.col("h") + F.least("h", F.coalesce("n_head", F.lit(0)))
    path = given.unionByName(counted.select("conv_id", depth.alias("depth"), "role", "text"))
    path = path.select("conv_id", "depth", F.length("text").cast("long").alias("size"), one_term("depth", "role", "text").alias("t"))
    path = path.select("conv_id", "depth", "size", F.col("t.a").cast("decimal(38,0)").alias("a"), F.col("t.b").cast("decimal(38,0)").alias("b"))
    summed = running(path, ["conv_id"], [F.col("depth")], {"s1": F.col("a"), "s2": F.col("b")})
    keys = summed.select(
        "conv_id", "depth", modulo(F.col("s1")).alias("key1"), modulo(F.col("s2")).alias("key2"),
        modulo(F.col("s1") - F.col("a")).alias("up1"), modulo(F.col("s2") - F.col("b")).alias("up2"), "size",
    )
    lengths = keys.groupBy("conv_id").agg(F.max("depth").alias("length"))
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", *[zero.alias(c) for c in ("depth", "key1", "key2", "up1", "up2", "size")])
    # the number of long conversations is bounded by rows / LONG; adaptive execution picks how to join their lengths
    rows = keys.unionByName(roots).join(lengths, "conv_id")
    ends = F.when(F.col("depth") == F.col("length"), F.array("conv_id")).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1).cast("long")
    return rows.select(
        F.lit(True).alias("long"), F.col("conv_id").alias("unit"), "depth", "key1", "key2", "up1", "up2", F.col("conv_id").alias("first"),
        one.alias("n_convs"), "size", (F.col("depth") < F.col("length")).alias("has_child"), ends.alias("ends"),
    )


#: What a family adds to a node: children, leaves and saved tokens below it, and its parent's smallest member.
SUMS = "depth long, key1 long, key2 long, children long, leaves long, saved long, parent long"


def family_sums(nodes: DataFrame) -> DataFrame:
    """SUMS of each family of ordinary conversations; nodes has own, value, leaf and least of each node."""
    schema = pa.schema([(c, pa.int64()) for c in ("depth", "key1", "key2", "children", "leaves", "saved", "parent")])

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in (*KEY, "up1", "up2", "own", "value", "leaf", "least")), strict=True), reverse=True)
        sums = {r[:3]: [0, int(r[7]), r[6], None] for r in rows}
        least = {r[:3]: r[8] for r in rows}
        for depth, key1, key2, up1, up2, own, *_ in rows:  # deepest first
            if depth:
                mine, up = sums[depth, key1, key2], sums[depth - 1, up1, up2]
                up[0] += own
                up[1] += mine[1]
                up[2] += mine[2]
                mine[3] = least[depth - 1, up1, up2]
        return pa.Table.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*((*k, *v) for k, v in sums.items()), strict=True)], schema=schema)

    return nodes.where("not long").groupBy("unit").applyInArrow(add, SUMS)


def path_sums(nodes: DataFrame) -> DataFrame:
    """SUMS of long conversations: sums from each turn to the end, as running sums over ranges."""
    path = nodes.where("long").select("unit", *KEY, "own", "value", "leaf", "least")
    sums = running(path, ["unit"], [F.desc("depth")], {"leaves": F.col("leaf").cast("long"), "saved": F.col("value")})
    below = path.select("unit", (F.col("depth") - 1).alias("depth"), F.col("own").cast("long").alias("children"))
    above = path.select("unit", (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    met = sums.join(below, ["unit", "depth"], "left").join(above, ["unit", "depth"], "left")
    return met.select(*KEY, F.coalesce("children", F.lit(0).cast("long")).alias("children"), "leaves", "saved", "parent")


def ends_hashes(nodes: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of nodes at which conversations end; ids are sorted by Spark and hashed as they stream by."""
    ended = nodes.select(*KEY, F.explode("ends").alias("id")).repartition(*KEY).sortWithinPartitions(*KEY, "id")
    names = [*KEY, "ends_sha256"]
    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *own, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != key:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = own, hashlib.sha256(b"%d" % c)
                else:
                    state.update(b",%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], names=names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, state.hexdigest()), schema, strict=True)], names=names)

    return ended.mapInArrow(digest, "depth long, key1 long, key2 long, ends_sha256 string")


def prefix_trie(df: DataFrame, long: int = LONG) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; one row per node.

    Columns, long: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens; ends_sha256. df has conv_id, turn, role
    and text; turns go by turn (null first), equal ones by role and text, and a
    turn that is there twice counts twice. A null role or text is an empty one.
    Rows without a conv_id belong to no conversation and are left out; so are
    other columns. An empty table has no nodes.

    Conversations of more than long turns are spread over tasks.
    """
    ship_code(df.sparkSession)
    turns = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), base_of(F.col("conv_id").cast("long")).alias("base"), F.col("turn").isNotNull().alias("has_turn"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER))
    head = turns.where("conv_id = base").withColumn("at", first).where(F.col("at") <= SHARED)
    lengthy = turns.groupBy("conv_id").count().where(F.col("count") > long).select("conv_id")
    if lengthy.isEmpty():
        nodes = ordinary(turns, head)
    else:
        lengthy = stored(lengthy, "long-conversations")
        head = stored(head, "heads")
        nodes = ordinary(turns.join(lengthy, "conv_id", "left_anti"), head).unionByName(spread(turns.join(lengthy, "conv_id", "left_semi"), head))
    nodes = stored(nodes, "family-nodes")
    merged = nodes.groupBy(*KEY).agg(
        F.sum("n_convs").alias("members"), F.min("first").alias("least"), F.max("has_child").alias("inner"), F.count("*").alias("families")
    )
    merged = stored(merged, "trie-nodes")
    whole = joined_by_weight(nodes.drop("ends"), merged, KEY, "families").withColumn("own", F.col("first") == F.col("least"))
    value = F.when(F.col("own"), (F.col("members") - 1) * F.col("size")).otherwise(F.lit(0).cast("long"))
    whole = whole.select("long", "unit", *KEY, "up1", "up2", "own", value.alias("value"), (F.col("own") & ~F.col("inner")).alias("leaf"), "least")
    sums = family_sums(whole)
    if nodes.where("long").limit(1).count():
        whole = stored(whole, "owned-nodes")
        sums = family_sums(whole).unionByName(path_sums(whole))
    total = sums.groupBy(*KEY).agg(
        F.max("parent").alias("parent_conv_id"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    out = merged.join(total, KEY).join(ends_hashes(nodes), KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
