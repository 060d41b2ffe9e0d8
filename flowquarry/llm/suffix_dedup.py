"""Exact substring dedup: suffix arrays of shards, merged by binary search.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts in a
document with a smaller id. Nothing is compared that cannot be equal, and nothing equal is
missed:

1. Each string of ``LENGTH`` bytes has an anchor: among the ``GRAM``-byte grams inside it the
   one with the least hash, the leftmost on ties. Equal strings have equal anchors at the same
   place. Runs of neighbouring strings with the same anchor form one stretch of text.
2. Document shards send the sorted distinct hashes of their anchors; the lists of all shards
   are merged range by range by binary search, and each shard learns which of its anchors
   occur in another document. Only their stretches go on.
3. Stretches meet by anchor. Of equal stretches the one from the smallest document stands for
   all. Shards of bounded size are suffix-sorted by Larsson-Sadakane refinement (groups not
   yet told apart are sorted by the rank of the suffix h places on, h doubling), Kasai's rule
   gives the common prefixes, and a run of prefixes of at least ``LENGTH`` is a class of equal
   strings with its least document. Classes of an anchor that a shard border has cut are
   merged by binary search in the other shard's sorted strings.
4. Documents gather which of their strings start earlier elsewhere and drop what these cover.

An anchor with more than ``HOT`` stretches (a phrase in a third of all documents, each time
after other words) would fill one task; its stretches are split into single strings, which
are dealt by their own hash. That is as exact as the rest.

Defined cases: a null text counts as the empty text; texts shorter than ``LENGTH`` stay whole;
rows with one id are one document to each other, so they remove nothing from one another;
rows without id come after all others, likewise as one document; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.common import arrow_schema, table

LENGTH = 50
GRAM = 24
HOT = 20_000
#: Bytes of text in a document shard, of stretches in a suffix array; anchors merged in a task.
SHARD_BYTES = 8 << 20
ARRAY_BYTES = 1 << 18
MERGED_KEYS = 2_000_000
#: Positions looked at together when anchors are sought; at most 2**24.
PIECE = 1 << 18
LAST = np.iinfo(np.int64).max
#: Anchors are told apart by 48 bits; two that share them are compared in vain, no more.
KEY_BITS, HEADS = np.uint64((1 << 48) - 1), 1 << 16
ODD = [np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; ``data`` ends with 8 bytes of padding."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 8
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * ODD[0]
    for k, at in enumerate(range(8, GRAM, 8), 1):
        h ^= h >> np.uint64(29)
        h += words[at : at + n] * ODD[k]
    h ^= h >> np.uint64(32)
    h *= ODD[3]
    return h ^ (h >> np.uint64(29))


class Anchored:
    """Texts of a shard end to end, and the stretch of every anchor: from ``low`` to ``stop``."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.data = np.frombuffer(b"".join(texts) + bytes(GRAM + 8), np.uint8)
        words = words_at(self.data)
        total = int(self.starts[-1])
        many = np.maximum(sizes - LENGTH + 1, 0)
        first = np.repeat(self.starts[:-1] - np.r_[0, np.cumsum(many)[:-1]], many)
        at = first + np.arange(int(many.sum()))  # where strings start, in order
        lows, stops, keys = [], [], []
        mask, window = np.uint64((1 << 24) - 1), LENGTH - GRAM + 1
        last = -1
        for start in range(0, total, PIECE):
            a, b = np.searchsorted(at, [start, start + PIECE])
            if a == b:
                continue
            mine = at[a:b] - start
            h = gram_hashes(words[start : start + PIECE + LENGTH])
            low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while size * 2 <= window:
                low = np.minimum(low[: len(low) - size], low[size:])
                size *= 2
            low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
            anchor = (low[mine] & mask).astype(np.int64)
            new = np.r_[True, anchor[1:] != anchor[:-1]]
            if anchor[0] + start == last:
                new[0] = False  # goes on from the piece before
            where = np.flatnonzero(new)
            if not new[0]:
                stops[-1][-1] = mine[(where[0] if len(where) else len(mine)) - 1] + start + LENGTH
            if len(where):
                ends = np.r_[where[1:], len(mine)] - 1
                lows.append(mine[where] + start)
                stops.append(mine[ends] + start + LENGTH)
                keys.append(h[anchor[where]])
            last = int(anchor[-1]) + start
        self.low = np.concatenate(lows) if lows else np.zeros(0, np.int64)
        self.stop = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        key = (key ^ (key >> np.uint64(31))) * ODD[4]  # least hashes are not even; these are
        self.key = (key ^ (key >> np.uint64(33))) & KEY_BITS
        self.doc = np.searchsorted(self.starts, self.low, side="right") - 1

    def stretches(self, rows: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.low[rows].tolist(), self.stop[rows].tolist())]

    def alike(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each stretch, row that first has it), equal stretches numbered alike.

        A stretch has at most 2 * LENGTH - GRAM bytes; its first 48 and last 32 cover it. They
        are sorted by a hash and then compared in full.
        """
        words = words_at(self.data)
        low, stop = self.low[rows], self.stop[rows]
        parts = [words[low + k] for k in range(0, 48, 8)] + [words[stop - k] for k in range(8, 40, 8)] + [(stop - low).astype(np.uint64)]
        h = np.zeros(len(rows), np.uint64)
        for k, part in enumerate(parts):
            h = (h ^ part) * ODD[k % 5]
            h ^= h >> np.uint64(32)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(rows), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        if any((part[order] != part[first]).any() for part in parts):  # two texts of one hash
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(t, len(known)) for t in self.stretches(rows)], np.int64)
            return number, rows[np.unique(number, return_index=True)[1]]
        number = np.empty(len(rows), np.int64)
        number[order] = np.cumsum(new) - 1
        return number, rows[order[new]]


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Even parts by the key's value, so that sorted keys fall into parts in order."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def heads(r: int, ranges: int) -> tuple[int, int]:
    """The upper 16 bits of keys in a range: from, to (excluded)."""
    return -(-r * HEADS // ranges), -(-(r + 1) * HEADS // ranges)


def suffix_array(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in suffix order, symbols, end of each position's stretch).

    Symbols are bytes plus one; each stretch ends with a sentinel 0, which sorts below all
    bytes and by the number of its stretch, so that no two suffixes are equal.
    """
    sizes = np.array([len(s) + 1 for s in stretches], np.int32)
    data = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8)
    end = np.repeat(np.cumsum(sizes, dtype=np.int32) - 1, sizes)
    at = np.arange(len(data), dtype=np.int32)
    symbols = data.astype(np.int16)
    symbols += 1
    sentinel = at == end
    symbols[sentinel] = 0
    depth = 7
    word = np.zeros(len(data), np.int64)
    for t in range(depth):  # nine bits a symbol
        word <<= 9
        word |= symbols[np.minimum(at + t, end)]
    word[sentinel] = np.arange(len(stretches))
    order = np.argsort(word).astype(np.int32)
    ordered = word[order]
    new = np.ones(len(data), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(data), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    left = np.flatnonzero(~(new & np.r_[new[1:], True])).astype(np.int32)  # groups not yet told apart
    while len(left):
        p = order[left]
        group, beyond = rank[p], rank[np.minimum(p + depth, end[p])]
        word = group.astype(np.int64) << 32 | beyond
        turn = np.argsort(word)
        p, word = p[turn], word[turn]
        order[left] = p
        starts = np.ones(len(left), bool)
        starts[1:] = word[1:] != word[:-1]
        rank[p] = left[np.maximum.accumulate(np.where(starts, np.arange(len(left), dtype=np.int32), 0))]
        left = left[~(starts & np.r_[starts[1:], True])]
        depth *= 2
    return order, symbols, end


def common_prefixes(order: np.ndarray, symbols: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order.

    Going one place on in the text loses at most one letter of the prefix. All stretches are
    gone through at once, a place at a time.
    """
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    before = np.empty(len(order), np.int32)  # of each position, the one before it in order
    before[order[1:]] = order[:-1]
    before[order[0]] = len(order) - 1  # a sentinel: nothing in common
    lcp = np.zeros(len(order), np.int32)
    size = end[starts] - starts
    lane = np.flatnonzero(size > 0)
    held = np.zeros(len(lane), np.int32)
    place, size = starts[lane].astype(np.int32), size[lane]
    t = 0
    while len(place):
        i = place + t
        j = before[i]
        h = np.maximum(held - 1, 0)
        x, y, go = i + h, j + h, np.arange(len(i))
        while len(go):
            a = symbols[x]
            more = (a != 0) & (a == symbols[y])
            x, y, go = x[more] + 1, y[more] + 1, go[more]
            h[go] += 1
        lcp[rank[i]] = h
        t += 1
        stay = size > t
        held, place, size = h[stay], place[stay], size[stay]
    return lcp


def least_documents(stretches: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of LENGTH bytes, stretch by stretch: the least document of its class."""
    order, symbols, end = suffix_array(stretches)
    sizes = np.array([len(s) + 1 for s in stretches], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    lcp = common_prefixes(order, symbols, end, starts)
    owner = np.repeat(np.arange(len(stretches)), sizes)
    whole = end[order] - order >= LENGTH
    doc = np.where(whole, docs[owner[order]], LAST)
    new = np.flatnonzero(lcp < LENGTH)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc, new), np.diff(np.r_[new, len(order)]))
    strings = np.flatnonzero(end - np.arange(len(end)) >= LENGTH)
    return least[strings], owner[strings]


def sorted_strings(stretches: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of some stretches in order, and the least document of each."""
    strings = np.array([s[i : i + LENGTH] for s in stretches for i in range(len(s) - LENGTH + 1)], f"S{LENGTH}")
    distinct, place = np.unique(strings, return_inverse=True)
    low = np.full(len(distinct), LAST)
    np.minimum.at(low, place, least)
    return distinct, low


def resolve(keys: np.ndarray, stretches: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least document of every string, with stretches ordered by key and cut into arrays."""
    sizes = np.cumsum([len(s) for s in stretches])
    least, owner = [], []
    cut, borders = 0, [0]
    while cut < len(stretches):
        done = sizes[cut - 1] if cut else 0
        cut = max(cut + 1, int(np.searchsorted(sizes, done + ARRAY_BYTES, side="right")))
        borders.append(cut)
    for a, b in zip(borders, borders[1:]):
        low, own = least_documents(stretches[a:b], docs[a:b])
        least.append(low)
        owner.append(own + a)
    least, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (least, owner))
    # Keys whose stretches lie on both sides of a border: merge their sorted strings.
    split = {int(keys[b]) for b in borders[1:-1] if keys[b] == keys[b - 1]}
    for key in split:
        rows = np.flatnonzero(keys == np.uint64(key))
        parts = []
        for a, b in zip(borders, borders[1:]):
            mine = rows[(rows >= a) & (rows < b)]
            if len(mine):
                at = np.flatnonzero((owner >= mine[0]) & (owner <= mine[-1]))
                strings, low = sorted_strings([stretches[i] for i in mine], least[at])
                parts.append((mine, at, strings, low))
        for mine, at, _, _ in parts:
            own = np.array([stretches[i][k : k + LENGTH] for i in mine for k in range(len(stretches[i]) - LENGTH + 1)], f"S{LENGTH}")
            for _, _, strings, low in parts:
                place = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
                same = strings[place] == own
                least[at[same]] = np.minimum(least[at[same]], low[place[same]])
    return least, owner


def shard_rows(part: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids, ids as numbers with null last, and texts, in an order that reruns repeat."""
    ids, texts = part["id"].to_pylist(), part["text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    return ids, np.array([LAST if i is None else i for i in ids], np.int64), texts


KEYS = "range int, shard int, heads binary, tails binary, at binary, n binary"
REPLY = "shard int, range int, repeated binary, hot binary"
STRETCHES = "bucket int, shard int, facts binary, sizes binary, text binary"
FOUND = "shard int, head binary, bits binary"
RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = "id long, kept binary, spans array<struct<start:long,end:long>>"


def send_keys(key: tuple, part: pa.Table, ranges: int) -> pa.Table:
    """The sorted distinct anchors of a shard by range, with their numbers of documents."""
    _, docs, texts = shard_rows(part)
    found = Anchored(texts)
    order = np.argsort(found.key, kind="stable")  # anchors come by document already
    keys, owner = found.key[order], docs[found.doc][order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    fresh = first.copy()
    fresh[1:] |= owner[1:] != owner[:-1]
    distinct = keys[first]
    count = np.bincount(np.cumsum(first) - 1, fresh, len(distinct)).astype(np.uint32)
    rows = []
    cuts = np.searchsorted(part_of(distinct, ranges), np.arange(ranges + 1))
    for r in range(ranges):
        a, b = cuts[r], cuts[r + 1]
        if a < b:
            low, high = heads(r, ranges)
            first = np.bincount((distinct[a:b] >> np.uint64(32)).astype(np.int64) - low, minlength=high - low)
            many = np.flatnonzero(count[a:b] > 1).astype(np.uint32)
            tails = distinct[a:b].astype(np.uint32)  # the lower 32 bits
            rows.append((r, key[0].as_py(), first.astype(np.uint32).tobytes(), tails.tobytes(), many.tobytes(), count[a:b][many].tobytes()))
    schema = arrow_schema_of(KEYS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)


def merge_keys(part: pa.Table, hot: int) -> pa.Table:
    """Which anchors of each shard occur in two documents, and which in very many."""
    lists = []
    for head, tail in zip(part["heads"].to_pylist(), part["tails"].to_pylist()):
        head, tail = np.frombuffer(head, np.uint32), np.frombuffer(tail, np.uint32)
        lists.append(np.repeat(np.arange(len(head), dtype=np.uint64) << np.uint64(32), head) | tail)
    counts = []
    for keys, at, n in zip(lists, part["at"].to_pylist(), part["n"].to_pylist()):
        count = np.ones(len(keys), np.int64)
        count[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
        counts.append(count)
    merged = np.sort(np.concatenate(lists))
    merged = merged[np.r_[True, merged[1:] != merged[:-1]]]
    total = np.zeros(len(merged), np.int64)
    places = [np.searchsorted(merged, keys) for keys in lists]
    for place, count in zip(places, counts):
        total[place] += count
    rows = []
    for shard, r, place in zip(part["shard"].to_pylist(), part["range"].to_pylist(), places):
        repeated = total[place] > 1
        if repeated.any():
            rows.append((shard, r, np.packbits(repeated).tobytes(), np.flatnonzero(total[place] > hot).astype(np.uint32).tobytes()))
    schema = arrow_schema_of(REPLY)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, schema)], schema=schema)


class Shard:
    """The documents of a shard with their anchors; equal stretches are numbered alike."""

    def __init__(self, part: pa.Table):
        self.ids, self.docs, self.texts = shard_rows(part)
        self.anchored = Anchored(self.texts)

    def group(self, rows: np.ndarray) -> None:
        """Take up some anchors: their stretches' numbers, first rows and least documents."""
        self.rows = rows
        self.number, self.firsts = self.anchored.alike(rows)
        self.least = np.full(len(self.firsts), LAST)
        np.minimum.at(self.least, self.number, self.docs[self.anchored.doc[rows]])


def contested(key: np.ndarray, reply: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors occur in another document, and which in very many, by the replies."""
    distinct, place = np.unique(key, return_inverse=True)
    repeated, hot = np.zeros(len(distinct) + 1, bool), np.zeros(len(distinct) + 1, bool)
    cuts = np.searchsorted(part_of(distinct, ranges), np.arange(ranges + 1))
    for r, bits, very in zip(reply["range"].to_pylist(), reply["repeated"].to_pylist(), reply["hot"].to_pylist()):
        a, b = cuts[r], cuts[r + 1]
        repeated[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        hot[a + np.frombuffer(very, np.uint32).astype(np.int64)] = True
    return repeated[place], hot[place]


def send_stretches(key: tuple, part: pa.Table, reply: pa.Table, ranges: int, buckets: int) -> pa.Table:
    schema = arrow_schema_of(STRETCHES)
    if not part.num_rows or not reply.num_rows:
        return schema.empty_table()
    mine = Shard(part)
    repeated, hot = contested(mine.anchored.key, reply, ranges)
    mine.group(np.flatnonzero(repeated))
    hot, all_keys = hot[mine.firsts], mine.anchored.key[mine.firsts]
    whole, split = np.flatnonzero(~hot), np.flatnonzero(hot)
    keys, numbers, shifts = [all_keys[whole]], [whole], [np.zeros(len(whole), np.int64)]
    texts = mine.anchored.stretches(mine.firsts[whole])
    for i, s in zip(split, mine.anchored.stretches(mine.firsts[split])):
        strings = [s[k : k + LENGTH] for k in range(len(s) - LENGTH + 1)]
        keys.append(np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in strings]), np.uint64) & KEY_BITS)
        numbers.append(np.full(len(strings), i))
        shifts.append(np.arange(len(strings)))
        texts += strings
    keys, numbers, shifts = np.concatenate(keys), np.concatenate(numbers).astype(np.int64), np.concatenate(shifts)
    facts = np.stack([keys.view(np.int64), mine.firsts[numbers], shifts, mine.least[numbers]])
    sizes = np.array([len(t) for t in texts], np.uint8)
    bucket, rows, codec = part_of(keys, buckets), [], pa.Codec("zstd", 1)
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        text = codec.compress(b"".join([texts[i] for i in at.tolist()]), asbytes=True)
        rows.append((int(bucket[at[0]]), key[0].as_py(), codec.compress(facts[:, at].tobytes(), asbytes=True), sizes[at].tobytes(), text))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)


def received(part: pa.Table) -> tuple[np.ndarray, ...]:
    """(shards, keys, numbers, shifts, documents, texts) of the stretches of a bucket."""
    codec = pa.Codec("zstd", 1)
    shards, facts, texts = [], [np.zeros((4, 0), np.int64)], []
    for shard, fact, size, text in zip(*(part[c].to_pylist() for c in ("shard", "facts", "sizes", "text"))):
        size = np.frombuffer(size, np.uint8).astype(np.int64)
        facts.append(np.frombuffer(codec.decompress(fact, 32 * len(size), asbytes=True), np.int64).reshape(4, -1))
        whole = codec.decompress(text, int(size.sum()), asbytes=True)
        ends = np.cumsum(size)
        texts += [whole[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
        shards.append(np.full(len(size), shard))
    return np.concatenate(shards), *np.concatenate(facts, axis=1), texts


def many_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from ``starts``, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def find_classes(part: pa.Table) -> pa.Table:
    """For the least document of each stretch in each shard: its strings found earlier.

    One row per shard: numbers of stretches, shifts and sizes, and the strings' bits in turn.
    """
    shard, keys, stretch, shift, docs, texts = received(part)
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(t, len(known)) for t in texts], np.int64)
    distinct = list(known)
    stands, key = np.full(len(known), LAST), np.empty(len(known), np.uint64)
    np.minimum.at(stands, number, docs)
    key[number] = keys.view(np.uint64)
    order = np.argsort(key, kind="stable")
    least, _ = resolve(key[order], [distinct[i] for i in order.tolist()], stands[order])
    sizes = np.array([len(t) for t in distinct], np.int64) - LENGTH + 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts = np.cumsum(sizes[order]) - sizes[order]
    rows = []
    by_shard = np.argsort(shard, kind="stable")
    for mine in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1):
        size = sizes[number[mine]]
        earlier = least[many_ranges(starts[place[number[mine]]], size)] < np.repeat(docs[mine], size)
        some = np.logical_or.reduceat(earlier, np.cumsum(size) - size)
        if some.any():
            sent = mine[some]
            columns = [np.stack([stretch[sent], shift[sent], size[some]]).astype(np.uint32), np.packbits(earlier[np.repeat(some, size)])]
            rows.append((int(shard[mine[0]]), *[c.tobytes() for c in columns]))
    schema = arrow_schema_of(FOUND)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, schema)], schema=schema)


def removed_runs(part: pa.Table, found: pa.Table):
    """(id, text, starts and ends of removed runs) of every document of a shard."""
    mine = Shard(part)
    told = []
    for head, bits in zip(found["head"].to_pylist(), found["bits"].to_pylist()):
        stretch, shift, size = np.frombuffer(head, np.uint32).reshape(3, -1).astype(np.int64)
        told.append((stretch, shift, size, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(size.sum())).astype(bool)))
    # Anchors that are here more than once, and those that classes speak of.
    key = mine.anchored.key
    order = np.argsort(key, kind="stable")
    twice = np.zeros(len(key), bool)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    twice[order[same]] = twice[order[same + 1]] = True
    for stretch, *_ in told:
        twice[stretch] = True
    mine.group(np.flatnonzero(twice))
    starts = mine.anchored.starts
    total = int(starts[-1])
    low, stop = mine.anchored.low[mine.rows], mine.anchored.stop[mine.rows]
    later = mine.docs[mine.anchored.doc[mine.rows]] > mine.least[mine.number]
    # Whole stretches, in a smaller document of this shard: all their bytes.
    cover = np.zeros(total + 1, np.int32)
    cover += np.bincount(low[later], minlength=total + 1).astype(np.int32)
    cover -= np.bincount(stop[later], minlength=total + 1).astype(np.int32)
    # The others' strings, as told by the classes; a split stretch is told string by string.
    rest = np.flatnonzero(~later)
    by_number = rest[np.argsort(mine.number[rest], kind="stable")]
    numbers = mine.number[by_number]
    strings = [np.zeros(0, np.int64)]
    for stretch, shift, size, flags in told:
        stretch = mine.number[np.searchsorted(mine.rows, stretch)]
        a, b = np.searchsorted(numbers, stretch, side="left"), np.searchsorted(numbers, stretch, side="right")
        answer = np.repeat(np.arange(len(stretch)), b - a)
        begin = low[by_number[many_ranges(a, b - a)]] + shift[answer]
        strings.append(many_ranges(begin, size[answer])[flags[many_ranges((np.cumsum(size) - size)[answer], size[answer])]])
    string = np.concatenate(strings)
    cover += np.bincount(string, minlength=total + 1).astype(np.int32)
    cover -= np.bincount(string + LENGTH, minlength=total + 1).astype(np.int32)
    gone = np.cumsum(cover)[:total] > 0
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False) if total else gone)
    # Runs must not go on into the next document.
    for d, (i, text) in enumerate(zip(mine.ids, mine.texts)):
        x, y = starts[d], starts[d + 1]
        p, q = np.searchsorted(edge, [x, y], side="right")
        own = edge[p:q]
        if x < y and gone[x]:
            own = np.r_[x, own]
        if len(own) and own[-1] == y:
            own = own[:-1]
        if len(own) % 2:
            own = np.r_[own, y]
        yield i, text, own[::2] - x, own[1::2] - x


def kept_bytes(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    if not len(a):
        return text
    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
    return b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2])])


_SCHEMAS: dict[str, pa.Schema] = {}


def arrow_schema_of(ddl: str) -> pa.Schema:
    """Flat schemas are read without a session, since tasks have none."""
    if ddl not in _SCHEMAS:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        _SCHEMAS[ddl] = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])
    return _SCHEMAS[ddl]


def sharded(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Documents dealt to shards of about SHARD_BYTES, and all their bytes."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    # Rows without id are dealt by their text, or they would all be one shard's.
    docs = docs.withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.xxhash64("text"))), F.lit(shards)).cast("int"))
    return docs.repartition(shards, "shard"), total


def earlier_strings(docs: DataFrame, total: int, hot: int = HOT) -> DataFrame:
    """Which strings of a shard's stretches start in an earlier document."""
    ranges = min(HEADS, max(1, -(-total // (MERGED_KEYS * 12))))
    buckets = max(1, -(-total // SHARD_BYTES))
    keys = docs.groupBy("shard").applyInArrow(lambda k, t: send_keys(k, t, ranges), KEYS)
    # Not settled: one plan shuffles the documents once and uses that exchange three times.
    replies = keys.groupBy("range").applyInArrow(lambda t: merge_keys(t, hot), REPLY)
    stretches = docs.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(
        lambda k, left, right: send_stretches(k, left, right, ranges, buckets), STRETCHES
    )
    return stretches.groupBy("bucket").applyInArrow(find_classes, FOUND)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, digests: bool = True) -> DataFrame:
    """Per document what is left: digests, or with ``digests`` off the bytes and removed spans."""
    docs, total = sharded(df, id_col, text_col)
    found = earlier_strings(docs, total, hot)
    schema = RESULT if digests else KEPT
    out = arrow_schema(schema)

    def finish(key, part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return out.empty_table()
        rows = []
        for i, text, a, b in removed_runs(part, answers):
            kept = kept_bytes(text, a, b)
            if digests:
                rows.append((i, len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            else:
                rows.append((i, kept, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    result = docs.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(finish, schema)
    return result.withColumnRenamed("id", "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that start in earlier ones."""
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERY = op3_suffix_dedup
