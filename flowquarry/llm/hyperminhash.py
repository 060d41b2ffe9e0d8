"""HyperMinHash near-duplicates: documents linked at a Jaccard similarity of their shingle sets.

A document's words are lower-cased (A-Z) and joined to shingles; its set are the distinct ones,
as 64-bit hashes of the word sequence. Documents with equal sets are one node.

**Registers.** Every shingle falls into one of ``REGISTERS`` buckets and a bucket keeps its
smallest hash; a bucket without a shingle takes the smallest hash of the whole set under the
bucket's own seed, so that short texts fill all registers too. Either way two sets agree in a
register with probability J. A register is compressed to 16 bits: the count of leading zeros
of its hash and the ten bits after the leading one.

**Bands.** Four compressed registers are a band. At J = 0.8 a pair misses all 40 bands with
probability 1e-9. First every node of a band value is compared with one of its nodes, the
pivot, which joins up a large group by stars. Of the values whose nodes are then still in more
than one component, those of at most ``CROWD`` nodes compare all pairs from different
components. Pairs pass the estimate of J, corrected for registers that agree by chance, and
are confirmed on the full sets.

**The rest of crowded values, exactly.** Nodes of larger values that the stars left in more
than one component are joined by prefixes: shingles ordered from rare to common, two sets with
the wanted overlap share one among the first fifth, at places that leave room for the overlap.
Only nodes of different components are compared, and a shingle whose nodes are all in one
component drops out, so a group that is already joined costs nothing and the edits that are
peculiar to a text rule it out at once.
Pairs also differ in at least as many shingles as their parities differ in bits (whether a set
holds an odd number of hashes in each of 512 ranges), which rules out near copies just below
the similarity before a pair is made. No link between different components is lost; links
inside one change nothing.

Components are closed by exchanging smallest labels until none changes.

Defined cases: a null or empty text, or one of white space, has the empty set, is its own
component and linked with nothing; fewer words than a shingle make one shingle; rows without
id keep their row, their component is the smallest id in it (null if it has none) and they are
never kept; repeated rows share a component, and all rows of the id that names a component are
kept; very long texts are whole, one at a time; extra columns are ignored; an empty table gives
none. Two different sets share a node with probability 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.common import arrow_schema, map_rows, settled, table
from flowquarry.llm.simhash import closed, signed

SHINGLE = 4
PERCENT = 80
REGISTERS = 160
BAND = 4
MANTISSA_BITS = 10
#: Nodes of a band value of which all pairs may be compared.
CROWD = 16
#: Pairs estimated this far below the wanted similarity are not confirmed; over seven standard deviations.
MARGIN = 0.25

#: Bits of a set's parities; a power of two and a multiple of 64.
PARITIES = 512

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: 64 well-stirred bits of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; one for fewer words, none without words."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = len(words) - width + 1
    value = word[:count]
    for i in range(1, width):
        value = mixed(value + GOLDEN) + word[i : i + count]
    return np.unique(mixed(value))


def compressed(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the leading one, 16 bits in all."""
    fraction, exponent = np.frexp((hashes >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 63)
    bits = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    return (zeros * (1 << MANTISSA_BITS) + np.maximum(bits, 0)).astype(np.uint16)


def registers(values: np.ndarray) -> np.ndarray:
    """The compressed registers of a set that is not empty."""
    stirred = mixed(values + GOLDEN)
    bucket = ((stirred >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, mixed(stirred ^ GOLDEN))
    empty = np.setdiff1d(np.arange(REGISTERS), bucket)
    if len(empty):
        least[empty] = mixed(values[None, :] ^ SEEDS[empty][:, None]).min(1)
    return compressed(least)


def band_keys(sketch: bytes) -> np.ndarray:
    bands = np.frombuffer(sketch, "<u8")  # four registers of 16 bits each
    return mixed(bands + SEEDS[: len(bands)])


@lru_cache(maxsize=None)
def chance(bits: int) -> float:
    """Probability that registers of two unrelated sets of about 2**bits shingles agree."""
    zeros = np.arange(40)[:, None]
    low = np.exp2(-(zeros + 1.0)) * (1 + np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS))
    high = low + np.exp2(-(zeros + 1.0)) / (1 << MANTISSA_BITS)

    def of_minima(share: float) -> float:  # both the least of so many hashes
        return float((((1 - low) ** share - (1 - high) ** share) ** 2).sum())

    size = 2.0**bits
    empty = (1 - 1 / REGISTERS) ** size
    return empty * of_minima(size) + (1 - empty) * of_minima(max(1.0, size / REGISTERS))


def estimate(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """J of pairs of register rows, less what agrees by chance."""
    agree = (a == b).mean(1)
    by_chance = np.array([chance(int(n).bit_length()) for n in size.tolist()])
    return (agree - by_chance) / (1 - by_chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the wanted share of their union in common."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, digest, node, n, sketch) of every row; no node and no sketch for an empty set."""

    def make():
        def rows(ids, texts, digests):
            out = []
            for i, text, digest in zip(ids, texts, digests):
                values = shingle_set(text, width)
                if len(values):
                    out.append((i, digest, signed(xxhash.xxh64_intdigest(values.tobytes())), len(values), registers(values).tobytes()))
                else:
                    out.append((i, digest, None, 0, None))
            return out

        return rows

    source = df.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col))
    return map_rows(source.toDF("doc_id", "text", "digest"), make, "doc_id long, digest long, node long, n long, sketch binary")


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(key, node) of every band of every node."""

    out = arrow_schema("key long, node long")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keys = [band_keys(s.as_py()) for s in part["sketch"]]
                node = np.repeat(part["node"].to_numpy(), REGISTERS // BAND)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node)], schema=out)

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long")


def filtered_pairs(pairs: DataFrame, test, columns: list[str]) -> DataFrame:
    """The pairs (a, b) that a test of Arrow columns holds true of."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array(test(*[part[c] for c in columns]), pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", *columns).mapInArrow(run, "a long, b long")


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose registers make it likely."""
    floor = percent / 100 - MARGIN

    def test(n, sketch_a, sketch_b):
        a, b = (np.frombuffer(b"".join(s.to_pylist()), "<u2").reshape(-1, REGISTERS) for s in (sketch_a, sketch_b))
        return estimate(a, b, n.to_numpy()) >= floor

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sized = F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")
    met = pairs.join(left, "a").join(right, "b").filter(sized).withColumn("n", F.least("n_a", "n_b"))
    return filtered_pairs(met, test, ["n", "sketch_a", "sketch_b"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with the wanted similarity on their full sets."""

    def test(set_a, set_b):
        return [similar(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8"), percent) for a, b in zip(set_a, set_b)]

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return filtered_pairs(pairs.join(left, "a").join(right, "b"), test, ["set_a", "set_b"])


def full_sets(df: DataFrame, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted (node, digest), from one text of each."""
    texts = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest")).join(wanted, "digest")
    texts = texts.dropDuplicates(["digest"])

    def make():
        return lambda texts, nodes: [(n, shingle_set(t, width).tobytes()) for t, n in zip(texts, nodes)]

    return map_rows(texts.select("text", "node"), make, "node long, shingles binary")


def parities(values: np.ndarray) -> list[int]:
    """A bit for each of ``PARITIES`` ranges of the hashes: whether the set holds an odd number there."""
    odd = np.bincount((values >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


MARKS = [f"mark_{i}" for i in range(PARITIES // 64)]


def prefixes(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, place, label, marks) of the shingles of which similar sets share one.

    Shingles go from rare to common; ``place`` is a shingle's place in its set, and any common
    shingle of two sets is at or after the first one that both have among these.
    """
    out = arrow_schema("node long, n long, shingle long")

    def run(batches):
        for batch in batches:
            for node, held in zip(batch["node"].to_pylist(), batch["shingles"]):
                values = np.frombuffer(held.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c, np.int64)) for c in (node, len(values))] + [pa.array(values)], schema=out)

    def make():
        return lambda nodes, held: [(n, *parities(np.frombuffer(h, "<u8"))) for n, h in zip(nodes, held)]

    marks = map_rows(sets.select("node", "shingles"), make, ", ".join(f"{c} long" for c in ["node", *MARKS]))
    held = sets.select("node", "shingles").mapInArrow(run, "node long, n long, shingle long")
    common = held.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    # A document's own shingles come together again; shingles of one node only count as places.
    ordered = held.join(common, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    last = F.col("n") - F.ceil(F.col("n") * percent / 100)
    placed = ordered.select("node", "n", F.posexplode("s").alias("i", "s"), (F.col("n") - F.size("s")).alias("rare"))
    placed = placed.withColumn("place", F.col("rare") + F.col("i")).filter(F.col("place") <= last)
    return settled(placed.join(labels.join(marks, "node"), "node").select(F.col("s.shingle").alias("shingle"), "node", "n", "place", "label", *MARKS))


def may_link(percent: int) -> Column:
    """Of rows x and y of one shingle: different components, and nothing rules the similarity out.

    Exact: the places leave room for the overlap, and a range of hashes of which one set holds an
    odd and the other an even number has a shingle that only one of them has.
    """
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    need = F.ceil(percent * (x("n") + y("n")) / (100 + percent))
    room = (x("n") - x("place") >= need) & (y("n") - y("place") >= need)
    apart = sum((F.bit_count(x(m).bitwiseXOR(y(m))) for m in MARKS[1:]), F.bit_count(x(MARKS[0]).bitwiseXOR(y(MARKS[0]))))
    return (x("label") != y("label")) & room & (apart <= x("n") + y("n") - 2 * need)


def crossing(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes in different components that may have the wanted similarity."""
    sizes = posted.select("node", "label").distinct().groupBy("label").agg(F.count("*").alias("size"))
    largest = posted.join(sizes, "label").groupBy("shingle").agg(
        F.max(F.struct("size", "label"))["label"].alias("main"), (F.min("label") != F.max("label")).alias("mixed")
    )
    mixed_lists = largest.filter("mixed").select("shingle", "main")
    few = posted.join(mixed_lists, "shingle").filter(F.col("label") != F.col("main")).alias("x")
    many = posted.join(mixed_lists.select("shingle"), "shingle", "left_semi").alias("y")
    met = few.join(many, (F.col("x.shingle") == F.col("y.shingle")) & may_link(percent))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def torn_values(entries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, node, label, count) of the band values whose nodes are still in several components."""
    labels = nodes.select("node").join(closed(edges).withColumnRenamed("fp", "node"), "node", "left")
    named = settled(entries.join(labels.select("node", F.coalesce("label", "node").alias("label")), "node"))
    torn = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return settled(named.join(torn.select("key"), "key", "left_semi").select("key", "node", "label", "count"))


def links(df: DataFrame, nodes: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(a, b): edges whose closure is the closure of all pairs with the wanted similarity."""
    entries = shared_bands(nodes)
    shared = entries.groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot"))
    entries = settled(entries.join(shared.filter("count > 1"), "key"))
    meeting = settled(nodes.join(entries.select("node").distinct(), "node", "left_semi"))
    sets = settled(full_sets(df, text_col, meeting.select("node", "digest"), width))

    # A group's nodes have much the same pivot in all their bands: few pairs, most of the links.
    stars = entries.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    edges = settled(confirmed(estimated(stars, meeting, percent), sets, percent))

    torn = torn_values(entries.select("key", "node", "count"), meeting, edges)
    small = torn.filter(F.col("count") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("all"))
    each = small.select(F.posexplode("all").alias("i", "x"), "all")
    each = each.select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y")).filter("x.label <> y.label")
    pairs = each.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    found = confirmed(estimated(pairs, meeting, percent), sets, percent)
    labels = settled(torn.filter(F.col("count") > CROWD).select("node", "label").distinct())
    if not labels.isEmpty():
        posted = prefixes(sets.join(labels.select("node"), "node", "left_semi"), labels, percent)
        found = found.union(confirmed(crossing(posted, percent), sets, percent))
    return edges.union(found)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    prints = settled(sketches(df, id_col, text_col, width))
    nodes = prints.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min("digest").alias("digest"), F.max("n").alias("n"), F.first("sketch").alias("sketch")
    )
    nodes = settled(nodes)
    labels = closed(links(df, nodes, text_col, width, percent))
    named = nodes.select("node", "least").join(labels.withColumnRenamed("fp", "node"), "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    found = prints.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, at four words and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERY = op11_hyperminhash
