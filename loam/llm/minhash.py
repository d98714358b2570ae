"""Operator 3: near-duplicate groups by b-bit MinHash and exact confirmation.

Steps: signatures of every row; one class per distinct shingle set; buckets of
classes that share a band; candidate pairs within buckets; packed signatures
drop pairs that are surely apart; full sets confirm the rest; confirmed links
become components. Pairs in a bucket are found by stars around three classes
first, so that a group of near copies costs its size. Links between classes
that stars have not joined are found bucket by bucket: in small buckets by
comparison, in large ones by rare elements of each set's difference from what
is usual there, which copies of one original share only if they are copies of
each other. Large buckets of much the same members are one family and cost the
work of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .blocks import grams, mixed, word_hashes
from .common import as_bytes, discard, map_texts, stored

#: Minima, rows in a band, and low bits kept of each minimum.
MINIMA, ROWS, BITS = 96, 4, 4
BANDS = MINIMA // ROWS
PER_LONG = 64 // BITS
#: Pairs whose estimate lies this far below the threshold are dropped: over five deviations of it.
SLACK = 0.22
#: Pairs of a centre compared in one cell, and members of a bucket in one cell of the last comparison.
GROUP, CELL = 256, 2048
#: Places over which the members of a bucket are dealt where they meet something of the bucket.
SALTS = 8
#: Most members of a bucket that are all held against each other, and members that tell what is usual in a larger one.
PATIENCE, TELLING = 64, 32
#: Large buckets that the centres of two buckets share if the buckets fall into one family.
ALIKE = 6
#: 64-bit words of a difference's parities.
PARITIES = 16

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1 << 62, (1 << 63) - 1, MINIMA, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
SHIFTS = _rng.integers(0, (1 << 63) - 1, MINIMA, dtype=np.uint64) << np.uint64(1)

SIGNATURE = "n_shingles long, set_1 long, set_2 long, packed array<long>, bands array<long>"


def shingles(text: str, k: int) -> np.ndarray:
    """Hashes, sorted and distinct, of a text's k-word shingles; fewer words are one shingle."""
    words = as_bytes(text).lower().split()  # A-Z only, and the six separators, as bytes are
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    # a shorter sequence must not equal a shingle, so its length goes into the base
    return np.unique(mixed(grams(h, k, 0x8CB92BA72F3D8DD7) if len(h) >= k else grams(h, len(h), 0x8CB92BA72F3D8DD7 + 2 * len(h) + 2)))


def signatures(texts: list[str], k: int) -> list[list]:
    sets = [shingles(t, k) for t in texts]
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    low = np.zeros((MINIMA, len(full)), np.uint64)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        space = np.empty_like(every)
        for j in range(MINIMA):
            np.multiply(every, FACTORS[j], out=space)
            np.add(space, SHIFTS[j], out=space)
            low[j] = np.minimum.reduceat(space, starts)
    bands = np.zeros((BANDS, len(full)), np.uint64)
    for j in range(MINIMA):
        bands[j // ROWS] = mixed(bands[j // ROWS] + low[j] + np.uint64(j))
    bits = mixed(low) >> np.uint64(64 - BITS)
    packed = np.zeros((MINIMA // PER_LONG, len(full)), np.uint64)
    for j in range(MINIMA):
        packed[j // PER_LONG] |= bits[j] << np.uint64(BITS * (j % PER_LONG))
    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    none = np.zeros(0, np.int64)
    rows_packed, rows_bands = [none] * len(texts), [none] * len(texts)
    for column, i in enumerate(full.tolist()):
        rows_packed[i] = packed[:, column].view(np.int64)
        rows_bands[i] = bands[:, column].view(np.int64)
    return [sizes.tolist(), halves[:, 0].tolist(), halves[:, 1].tolist(), rows_packed, rows_bands]


def matching(a: Column, b: Column) -> Column:
    """How many of the low-bit lanes of two packed signatures agree."""
    different = F.lit(0)
    lanes = sum(1 << BITS * i for i in range(PER_LONG))
    lanes = lanes - (1 << 64) if lanes >= 1 << 63 else lanes
    for i in range(MINIMA // PER_LONG):
        x = a[i].bitwiseXOR(b[i])
        width = BITS
        while width > 1:
            width //= 2
            x = x.bitwiseOR(F.shiftrightunsigned(x, width))
        different = different + F.bit_count(x.bitwiseAND(F.lit(lanes)))
    return F.lit(MINIMA) - different


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of agreeing lanes, less what agrees by chance."""
    chance = 2.0**-BITS
    return (matching(a, b) / MINIMA - chance) / (1 - chance)


def likely(percent: int, slack: float | None) -> Column:
    """Whether a pair of rows with n_a, n_b, packed_a and packed_b can be linked.

    Sizes decide exactly; low bits drop what lies slack below the threshold.
    None: no pair is dropped by its estimate.
    """
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    if slack is None:
        return sizes
    return sizes & (estimate(F.col("packed_a"), F.col("packed_b")) >= percent / 100 - slack)


def described(classes: DataFrame, node: str, side: str) -> DataFrame:
    """Size and packed signature of each class, as columns of one side of a pair."""
    return classes.select(F.col("node").alias(node), F.col("n_shingles").alias(f"n_{side}"), F.col("packed").alias(f"packed_{side}"))


def load_of(n: Column) -> Column:
    """The power of two from n on: few different values, so that it can be part of a key."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("long")


def cells(load: Column) -> Column:
    return F.ceil(load / GROUP).cast("int")


def dealt(pairs: DataFrame) -> DataFrame:
    """Pairs with the cell of their centre in which they are compared."""
    return pairs.withColumn("cell", F.pmod(F.xxhash64("leaf"), cells(F.col("load"))).cast("int"))


def centre_copies(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of table (by centre), once for each cell of a centre that pairs name."""
    named = pairs.select("centre", "load").distinct().join(table, "centre")
    return named.withColumn("cell", F.explode(F.sequence(F.lit(0), cells(F.col("load")) - 1)))


def by_bucket(members: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """members joined with a table of one row a key, or some; members of a large bucket are dealt over SALTS places."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["key", "_salt"], how).drop("_salt")


def star_pairs(members: DataFrame) -> DataFrame:
    """(leaf, centre, load): each member of a bucket with the bucket's three centres.

    Centres are least or greatest by a hash of the class, so that buckets of the
    same classes have the same centres and their pairs fall together. load is
    the bucket's size, rounded up.
    """
    first, second = (F.struct(F.xxhash64("node", F.lit(i)), "node") for i in (0, 1))
    centres = members.groupBy("key").agg(F.min(first).alias("x"), F.max(first).alias("y"), F.min(second).alias("z"), load_of(F.count("*")).alias("load"))
    centres = centres.select("key", "load", F.explode(F.array_distinct(F.array("x.node", "y.node", "z.node"))).alias("centre"))
    pairs = by_bucket(members, centres).where("node <> centre")
    return pairs.groupBy(F.col("node").alias("leaf"), "centre").agg(F.max("load").alias("load"))


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int, slack: float | None) -> DataFrame:
    """The pairs whose sizes and low bits allow a link."""
    left = dealt(pairs).join(described(classes, "leaf", "a"), "leaf")
    right = centre_copies(pairs, described(classes, "centre", "b"))
    return left.join(right, ["centre", "load", "cell"]).where(likely(percent, slack)).select("leaf", "centre", "load")


def with_component(nodes: DataFrame, component: DataFrame) -> DataFrame:
    return nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_members(members: DataFrame, component: DataFrame) -> DataFrame:
    """key, node, component of the buckets that hold several components."""
    placed = with_component(members.select("key", "node"), component)
    apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return by_bucket(placed, apart, "left_semi")


def cross_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, slack: float | None) -> DataFrame:
    """Links (a, b) between different components of a bucket, each found in the first bucket that both share.

    A bucket is split into cells of about CELL members, and each cell meets each
    other one in a place of its own, so no bucket is one task. Members that meet
    nobody whose size and low bits allow a link are left out first; the full
    sets of the others are compared inside the join, so that only links come
    out of it.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    cell = F.ceil(F.col("n") / CELL).cast("int")
    placed = by_bucket(members, sizes).select("key", "node", "component", cell.alias("cells"), F.pmod(F.xxhash64("node"), cell).cast("int").alias("own"))
    placed = stored(placed.join(classes.select("node", "n_shingles", "packed", "bands"), "node"), "placed")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))

    def sides(df: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        names = ["node", "component", "packed", "bands", *more]
        left = df.select("key", F.col("own").alias("row"), every.alias("column"), F.col("n_shingles").alias("n_a"), *[F.col(x).alias(f"{x}_a") for x in names])
        right = df.select(F.col("key").alias("key_b"), F.col("own").alias("column_b"), every.alias("row_b"), F.col("n_shingles").alias("n_b"), *[F.col(x).alias(f"{x}_b") for x in names])
        return left, right

    here = (F.col("key") == F.col("key_b")) & (F.col("row") == F.col("row_b")) & (F.col("column") == F.col("column_b"))
    first = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("key")
    near = likely(percent, slack) & first
    left, right = sides(placed)
    kept = left.join(right, here & (F.col("component_a") != F.col("component_b")) & near, "left_semi").select("key", F.col("node_a").alias("node")).distinct()
    left, right = sides(stored(placed.join(kept, ["key", "node"], "left_semi").join(sets, "node"), "full"), "items")
    common = F.size(F.array_intersect("items_a", "items_b"))
    linked = common * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    pairs = left.join(right, here & (F.col("component_a") < F.col("component_b")) & near & linked)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def families(members: DataFrame) -> DataFrame:
    """members with the family of each bucket as key, each class once a family.

    Near copies share many buckets, so most of a bucket's members are those of
    others too. A bucket's centre is its class that is in most buckets, ties by
    a hash; its family is the first centre in that order, of the buckets that
    hold its own, with which that one shares ALIKE of them (its own centre
    shares all). So two members of one bucket always meet in its family, and a
    family is about one text.
    """
    known = members.groupBy("node").agg(F.struct((-F.count("*")).alias("few"), F.xxhash64("node").alias("hash"), "node").alias("one"))
    led = stored(members.join(known, "node").groupBy("key").agg(F.min("one").alias("centre")), "centres")
    own = members.join(led.select(F.col("centre.node").alias("node")).distinct(), "node", "left_semi").select("key", "node")
    keys = own.groupBy("node").agg(F.collect_list("key").alias("keys"))
    pairs = own.join(led, "key").select("node", "centre").distinct().join(keys, "node")
    pairs = pairs.join(keys.select(F.col("node").alias("other"), F.col("keys").alias("others")), F.col("centre.node") == F.col("other"))
    alike = (F.size(F.array_intersect("keys", "others")) >= ALIKE) | (F.col("node") == F.col("other"))
    family = pairs.where(alike).groupBy("node").agg(F.min("centre").alias("first")).select("node", F.col("first.node").alias("family"))
    named = led.select("key", F.col("centre.node").alias("node")).join(family, "node").select("key", "family")
    return by_bucket(members, named).select(F.col("family").alias("key"), "node", "component").distinct()


def usual(members: pa.Table) -> pa.Table:
    """key, told (rows), items that several rows of one bucket have, sorted, and counts of them."""
    items, counts = np.unique(members.column("items").combine_chunks().flatten().to_numpy(), return_counts=True)
    several = counts > 1
    columns = [[members.column("key")[0].as_py()], [members.num_rows], [items[several]], [counts[several]]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["key", "told", "items", "counts"])


def differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node, component, size, z, drift and parities: how each member's set differs from what is usual in its bucket.

    The usual set U holds what over half of some TELLING members have; drift is
    the symmetric difference D of the member's set S and U, in one order for the
    bucket, rarest first. Any U and any order give the same links, better ones
    fewer candidates. z is (100 + percent) |D| - (100 - percent) |S|: two
    members are linked if and only if 2 (100 + percent) |D and D'| >= z + z'.
    parities tell of each residue of hashes whether D has an odd number of them:
    two members have at least as many different elements as different parities.
    """
    sizes = members.groupBy("key").agg(load_of(F.count("*")).alias("load"))
    placed = by_bucket(members, sizes).withColumn("cell", F.pmod(F.xxhash64("node"), cells(F.col("load"))).cast("int"))
    telling = placed.where(F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("load") / TELLING)) == 0)
    table = telling.select("key", "node").join(sets, "node").groupBy("key").applyInArrow(usual, "key long, told long, items array<long>, counts array<long>")
    copies = sizes.join(table, "key").select(F.col("key").alias("own"), F.explode(F.sequence(F.lit(0), cells(F.col("load")) - 1)).alias("own_cell"), "told", F.col("items").alias("known"), "counts")

    def differ(rows: pa.Table, telling: pa.Table) -> pa.Table:
        known, counts, told = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if telling.num_rows:
            known, counts = (telling.column(c).combine_chunks().flatten().to_numpy() for c in ("known", "counts"))
            told = telling.column("told")[0].as_py()
        common = 2 * counts > told
        sizes, z, drift, parities = [], [], [], []
        for own in rows.column("items").combine_chunks():
            own = own.values.to_numpy()
            at = np.searchsorted(known, own)
            met = at < len(known)
            met[met] = known[at[met]] == own[met]
            often = np.ones(len(own), np.int64)
            often[met] = counts[at[met]]
            extra = ~met
            extra[met] = ~common[at[met]]
            missing = common.copy()
            missing[at[met]] = False
            found = np.concatenate([own[extra], known[missing]])
            order = np.lexsort((found, np.concatenate([often[extra], told - counts[missing]])))
            drift.append(found[order])
            sizes.append(len(own))
            z.append((100 + percent) * len(found) - (100 - percent) * len(own))
            odd = np.bincount(found & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
            parities.append(np.packbits(odd.astype(bool)).view(np.int64))
        made = [pa.array(sizes, pa.int64()), pa.array(z, pa.int64()), pa.array(drift, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))]
        return pa.table([*(rows.column(c) for c in ("key", "node", "component")), *made], names=["key", "node", "component", "size", "z", "drift", "parities"])

    rows = placed.select("key", "cell", "node", "component").join(sets, "node").groupBy("key", "cell")
    return rows.cogroup(copies.groupBy("own", "own_cell")).applyInArrow(differ, "key long, node long, component long, size long, z long, drift array<long>, parities array<long>")


def rare_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a family or bucket, key, without comparing all its members.

    Those whose z is at most the negative of the bucket's least one are linked
    with its owner and need no pair among themselves. Every other pair needs a
    common element of the differences; the first of them stands, in both, before
    as many elements as must be common. So members meet at such elements only,
    and only pairs whose parities allow a link are compared on full sets.
    """
    drifts = stored(differences(members, sets, percent), "drifts")
    low = drifts.groupBy("key").agg(F.min(F.struct("z", "node", "component")).alias("low"))
    told = by_bucket(drifts, low.select("key", F.col("low.z").alias("least"), F.col("low.node").alias("owner"), F.col("low.component").alias("owned")))
    sure = told.where("z + least <= 0 and component <> owned").select(F.col("node").alias("a"), F.col("owner").alias("b"))

    step = 2 * (100 + percent)
    apart = F.col("z") + F.col("least") > 0
    limit = F.greatest(1 - F.col("least"), "least")  # no z of a member apart is less
    n = F.size("drift")
    first = n - F.ceil((F.col("z") + F.when(apart, F.col("least")).otherwise(limit)) / step) + 1
    places = told.select("key", "node", "component", "z", n.alias("n"), apart.alias("apart"), limit.alias("limit"), F.posexplode(F.slice("drift", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("place", "item"))
    # reach: the greatest z of a member with which this can be the first common element
    reach = step * (F.col("n") - F.col("place")) - F.col("z")
    places = stored(places.select(F.xxhash64("key", "item").alias("slot"), "key", "node", "component", "z", "apart", reach.alias("reach"), (reach >= F.col("limit")).alias("near")), "rare")
    meeting = places.groupBy("slot").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("apart").alias("apart"), F.max("near").alias("near"))
    met = places.join(meeting.where("x <> y and apart and near").select("slot"), "slot", "left_semi")
    rare, places = places, stored(met.join(drifts.select("key", "node", "size", "parities"), ["key", "node"]), "places")
    discard(rare)
    one, other = (places.where(c).select("slot", *[F.col(x).alias(f"{x}_{side}") for x in ("node", "component", "size", "z", "parities", "reach")]) for c, side in (("near", "a"), ("apart", "b")))
    odd = sum((F.bit_count(F.col("parities_a")[i].bitwiseXOR(F.col("parities_b")[i])) for i in range(PARITIES)), F.lit(0))
    allowed = odd * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    met = one.join(other, "slot").where("component_a <> component_b and reach_a >= z_b and reach_b >= z_a").where(allowed)
    pairs = stored(met.select(F.least("node_a", "node_b").alias("centre"), F.greatest("node_a", "node_b").alias("leaf")).distinct(), "pairs")
    loads = pairs.groupBy("centre").agg(load_of(F.count("*")).alias("load"))
    return confirmed(pairs.join(loads, "centre"), sets, percent).union(sure)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): pairs with 100 * intersection >= percent * union on full sets.

    A centre of many pairs has its set copied to cells of about GROUP pairs.
    """
    left = dealt(pairs).join(sets.select(F.col("node").alias("leaf"), F.col("items").alias("items_b")), "leaf")
    right = centre_copies(pairs, sets.select(F.col("node").alias("centre"), "items")).select(F.col("centre").alias("own"), F.col("load").alias("own_load"), F.col("cell").alias("own_cell"), "items")

    def check(pairs: pa.Table, own: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if pairs.num_rows and own.num_rows:
            mine = own.column("items").combine_chunks().flatten().to_numpy()
            lists = pairs.column("items_b").combine_chunks()
            others, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for i, (a, b) in enumerate(zip(pairs.column("leaf").to_pylist(), pairs.column("centre").to_pylist(), strict=True)):
                both = np.concatenate([mine, others[edges[i] : edges[i + 1]]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    out_a.append(a)
                    out_b.append(b)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return left.groupBy("centre", "load", "cell").cogroup(right.groupBy("own", "own_load", "own_cell")).applyInArrow(check, "a long, b long")


def linked(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, slack: float | None) -> DataFrame:
    """node and component of every class that has a link.

    Stars first: each costs a bucket's size. Then all links between different
    components of a bucket, so that none is lost: by comparison of all members
    of a small bucket, by rare elements in a family of large ones.
    """
    component = components(confirmed(stored(near_pairs(star_pairs(members), classes, percent, slack), "pairs"), sets, percent))
    held = stored(open_members(members, component), "open")
    large = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PATIENCE).select("key")
    family = stored(families(by_bucket(held, large, "left_semi")), "families")
    links = cross_links(by_bucket(held, large, "left_anti"), classes, sets, percent, slack)
    links = stored(links.union(rare_links(family, sets, percent)), "links")
    discard(held)
    if links.isEmpty():
        return component
    return components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node), by alternating large and small stars.

    Each star replaces edges by edges to a neighbourhood's least node; the edges
    are stored after each pair of stars, until nothing changes. A round's table
    is deleted when the next one is written.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "stars")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        old, edges = edges, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def row_key(text: str = "text") -> Column:
    """128 bits of a row's doc_id and text."""
    return F.struct(F.xxhash64("doc_id", F.col(text)).alias("x"), F.xxhash64(F.col(text), "doc_id").alias("y"))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", slack: float | None = SLACK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of df.

    Rows are linked when 100 * |A and B| >= percent * |A or B| over their sets
    of k-word shingles (words without A-Z case; fewer than k words are one
    shingle). component_id is the least doc_id reachable, kept means that it is
    the row's own. A null or empty text, or one without words, is linked with
    nothing. Repeated rows are linked and each kept if the first is; texts that
    only share a doc_id are not. A row without doc_id takes part, has no doc_id
    to give its component, and is not kept if that has one (component_id null:
    no row there has one, kept). An empty table gives no rows. doc_id is an
    integer; other columns of df are left out, so none can clash.

    A pair at the threshold shares no band with probability
    (1 - 0.8 ** ROWS) ** BANDS, 3 in a million; candidates are never capped.
    slack None confirms every candidate on full sets, whatever its low bits say.
    """
    return judged(df, k, percent, text, slack).select("doc_id", "n_shingles", "component_id", "kept")


def judged(df: DataFrame, k: int, percent: int, text: str = "text", slack: float | None = SLACK) -> DataFrame:
    """near_duplicates with the row_key of each row, and whether it is the first of its component.

    The first has the least doc_id, rows without one last, then the least key;
    rows of equal doc_id and text are first together.
    """
    keyed = df.select("doc_id", text, row_key(text).alias("row"))
    rows = stored(map_texts(keyed, lambda texts: signatures(texts, k), SIGNATURE, ("doc_id", "row"), text), "signatures")
    one = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").cast(LongType()).alias("doc"), "row")
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("set_1", "set_2")
        .agg(F.min(one).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("packed").alias("packed"), F.first("bands").alias("bands"))
        .select("set_1", "set_2", F.xxhash64("set_1", "set_2").alias("node"), "one", "n_shingles", "packed", "bands")
    )
    classes = stored(classes, "classes")
    every = classes.select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(by_bucket(every, shared, "left_semi"), "members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("one.row", "node")
    texts = keyed.join(wanted, "row").select("node", F.col(text).alias("text"))
    sets = stored(map_texts(texts, lambda found: [[shingles(t, k).view(np.int64) for t in found]], "items array<long>", ("node",)).dropDuplicates(["node"]), "sets")

    placed = with_component(classes.select("set_1", "set_2", "node", "one"), linked(members, classes, sets, percent, slack))
    least = placed.groupBy("component").agg(F.min("one").alias("least"))
    placed = placed.join(least, "component").select("set_1", "set_2", F.col("least.doc").alias("component_id"), F.col("least.row").alias("first_row"), F.lit(True).alias("placed"))
    out = rows.select("doc_id", "row", "n_shingles", "set_1", "set_2").join(placed, ["set_1", "set_2"], "left")
    joined = F.coalesce(F.col("placed") & (F.col("n_shingles") > 0), F.lit(False))
    component_id = F.when(joined, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), (~joined | (F.col("row") == F.col("first_row"))).alias("first"))
