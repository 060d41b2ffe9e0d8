"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees.

A document's words are lower-cased (A-Z) and joined to shingles; a fingerprint bit is set
when it is set in over half of the shingles' XXH64 values. Equal fingerprints are one node.

Two fingerprints that differ in at most three of 64 bits agree in at least one of four 16-bit
blocks, so a tree over the fingerprints that share a block value finds every link. Shards
hold the trees of many block values; they are dealt by a shuffle rather than broadcast,
because all trees together grow with the data. A node's children are keyed by their distance
to it, and a search with radius r at distance d follows only the edges d - r to d + r. A block
value shared by more than ``CROWD`` fingerprints is divided by the blocks of the remaining
bits, which is exact for the same reason; of a key that is crowded even then, every slice of
fingerprints is searched in the tree of every other slice, each pair in a part of its own. That
bounds a part, not the work, which grows with the square of such a key. A tree reports links as edges to one member of each
linked set, never as all its pairs.

Links are closed over shards by exchanging smallest labels until none changes.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; rows without id keep their row, and their component is
the smallest id in it, null if it has none; repeated rows share a component; extra columns are
ignored by ``components`` and kept by ``representatives``; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.common import map_rows, settled, table

SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCKS = 4
#: Fingerprints that may share a block value before it is divided.
CROWD = 2048
#: Fingerprints of one key searched in one tree; a key with more is cut into slices.
SLICE_ROWS = 2048
#: Entries of a shard, about.
SHARD_ROWS = 8_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= width:
        values = [hashed(b" ".join(words), seed)]
    else:
        values = [hashed(b" ".join(s), seed) for s in zip(*[words[i:] for i in range(width)])]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(values), 4096):  # one byte per bit, so a bounded part at a time
        part = np.array(values[start : start + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def make():
        return lambda ids, texts: [(i, signed(fingerprint(t, width))) for i, t in zip(ids, texts)]

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), text_col), make, "doc_id long, fp long")


class BKTree:
    """Values under integer Hamming distance; children keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            d = (value ^ self.values[at]).bit_count()
            below = self.children[at]
            at = below.setdefault(d, new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        if not self.values:
            return []
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for e, c in children.items() if d - radius <= e <= d + radius]
                else:
                    stack += [children[e] for e in range(max(d - radius, 0), d + radius + 1) if e in children]
        return found


def linked(values: list[int], radius: int, searching: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges from every linked value to one member of its set, found with a BK-tree.

    With ``searching`` (0 or 1 per value, zeros first) the ones search the tree of the zeros only.
    """
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        mine = i
        for j in tree.within(v, radius) if searching is None or searching[i] else ():
            other = root(j)
            if other != mine:
                low, high = min(other, mine), max(other, mine)
                parent[high] = low
                mine = low
        if searching is None or not searching[i]:
            tree.add(v)
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def shard_links(batch: pa.Table, radius: int) -> pa.Table:
    """Links among the fingerprints of each key of a shard, or between two slices of a key."""
    keys, parts, sides, fps = (batch[c].to_numpy() for c in ("key", "part", "side", "fp"))
    order = np.lexsort((fps, sides, parts, keys))
    keys, parts, sides, fps = keys[order], parts[order], sides[order], fps[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])]) if len(keys) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(keys)] if len(keys) else starts
    unsigned = fps.view(np.uint64)
    edges: list[tuple[int, int]] = []
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        between = sides[a:b].tolist() if sides[b - 1] else None
        edges += linked(unsigned[a:b].tolist(), radius, between)
    columns = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": columns[:, 0], "b": columns[:, 1]})


def sliced(divided: DataFrame, slice_rows: int) -> tuple[DataFrame, int]:
    """(fp, key, part, side) and how many rows that adds: keys of more than ``slice_rows``
    fingerprints are cut into slices, and each pair of slices is a part of its own.

    So a part holds about two slices, however many fingerprints share a key; a fingerprint goes
    to as many parts as its key has slices. Side 1 searches the tree of side 0; a slice by
    itself has no side 1.
    """
    sizes = divided.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows)
    crowds = settled(sizes.select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"), "n"))
    added = crowds.agg(F.coalesce(F.sum(F.col("n") * F.col("slices")), F.lit(0))).first()[0]
    rows = divided.join(crowds.drop("n"), "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("other")
    pairs = rows.select("fp", "key", "own", other)
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    return pairs.select("fp", "key", F.shiftleft(low, 32).bitwiseOR(high).alias("part"), (F.col("own") > F.col("other")).cast("int").alias("side")), added


def links(nodes: DataFrame, count: int, radius: int = RADIUS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(a, b): edges whose closure is the closure of all pairs within the radius.

    ``nodes`` has each fingerprint once. Keys are block number and block value, and for
    crowded values the same of the other bits once more; what is crowded still is dealt in slices.
    """
    if radius >= BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find at most {BLOCKS - 1} differing bits")
    width = 64 // BLOCKS

    def bits(column, start: int, length: int):
        return F.shiftrightunsigned(column, start).bitwiseAND((1 << length) - 1)

    block = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), bits(F.col("fp"), i * width, width).alias("v")) for i in range(BLOCKS)]))
    keyed = nodes.select("fp", block.alias("k")).select("fp", "k.i", "k.v")
    crowds = keyed.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("i", "v", F.lit(True).alias("crowded"))
    keyed = keyed.join(crowds, ["i", "v"], "left")
    # The 48 other bits, closed up, in four blocks of 12.
    rest = F.lit(0).cast("long")
    for i in range(BLOCKS):
        below = bits(F.col("fp"), 0, i * width) if i else F.lit(0)
        above = F.shiftrightunsigned(F.col("fp"), (i + 1) * width) if i < BLOCKS - 1 else F.lit(0)
        rest = F.when(F.col("i") == i, F.shiftleft(above.cast("long"), i * width).bitwiseOR(below.cast("long"))).otherwise(rest)
    small = (64 - width) // BLOCKS
    plain = keyed.filter(F.col("crowded").isNull()).select("fp", F.shiftleft(F.col("v").cast("long"), 8).bitwiseOR(F.col("i").cast("long")).alias("key"))
    divided = keyed.filter(F.col("crowded")).withColumn("rest", rest)
    second = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), bits(F.col("rest"), j * small, small).alias("w")) for j in range(BLOCKS)]))
    divided = divided.select("fp", "i", "v", second.alias("s")).select(
        "fp", F.lit(1 << 62).bitwiseOR(F.shiftleft(F.col("v").cast("long"), 24)).bitwiseOR(F.shiftleft(F.col("s.w").cast("long"), 8)).bitwiseOR((F.col("i") * 16 + F.col("s.j")).cast("long")).alias("key"),
    )
    divided, added = sliced(divided, slice_rows)
    shards = max(1, -(-(count * BLOCKS + added) // SHARD_ROWS))
    whole = plain.select("fp", "key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"))
    placed = whole.unionByName(divided).withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInArrow(lambda t: shard_links(t, radius), "a long, b long")


def closed(edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest fingerprint reachable, for every fingerprint with an edge.

    Each round a node moves to its smallest neighbour, and then to that one's own; edges are
    drawn between the nodes moved to, each once, and those inside one node drop out. So a dense
    group leaves with the first rounds, and a round has no more edges than the one before. One number
    goes to the driver per round.
    """
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    left, steps = edges.filter("a <> b"), []
    while not left.isEmpty():
        # Only larger nodes move; the smallest of a component stays and is the last one left.
        up = left.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("label"))
        beyond = up.select(F.col("fp").alias("at"), F.col("label").alias("next"))
        steps.append(settled(up.join(beyond, F.col("label") == F.col("at"), "left").select("fp", F.coalesce("next", "label").alias("label"))))
        high = steps[-1].select(F.col("fp").alias("a"), F.col("label").alias("high"))
        low = steps[-1].select(F.col("fp").alias("b"), F.col("label").alias("low"))
        drawn = left.join(high, "a").join(low, "b", "left").select("high", F.coalesce("low", "b").alias("low")).filter("high <> low")
        left = settled(drawn.select(F.greatest("high", "low").alias("a"), F.least("high", "low").alias("b")).distinct())
    nodes = edges.select("a").union(edges.select("b")).distinct()
    labels = nodes.select(F.col("a").alias("fp"), F.col("a").alias("label"))
    for step in steps:
        moved = step.select(F.col("fp").alias("at"), F.col("label").alias("next"))
        labels = labels.join(moved, F.col("label") == F.col("at"), "left").select("fp", F.coalesce("next", "label").alias("label"))
    return settled(labels)


def labelled(prints: DataFrame, first: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, first, label): each fingerprint once, an aggregate of its rows, and its component's smallest fingerprint."""
    nodes = settled(prints.groupBy("fp").agg(first.alias("first")))
    labels = closed(links(nodes.select("fp"), nodes.count(), radius))
    return nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of fingerprinted documents; ``prints`` should be settled."""
    named = labelled(prints, F.min("doc_id"), radius)
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    found = components(settled(fingerprints(df, id_col, text_col, width)), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest id.

    Rows are told apart by id and text: an id on unrelated texts stands for each of them. Rows
    without id come after all others; of rows equal in both, or in id, one stays.
    """
    body = F.xxhash64(text_col)

    def make():
        return lambda ids, texts, digests: [(i, signed(fingerprint(t, width)), d) for i, t, d in zip(ids, texts, digests)]

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text_col, body.alias("digest"))
    prints = settled(map_rows(source, make, "doc_id long, fp long, digest long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    kept = labelled(prints, least, radius).groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    # Whole rows travel in one struct, so that no name of theirs can meet a helper's.
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), body.alias("digest"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    return rows.dropDuplicates(["id", "digest"]).select("row.*")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERY = op6_simhash
