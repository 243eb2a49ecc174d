"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints meet in buckets that share 3 of 5 bit fields; two fingerprints that differ in at most 2 bits
agree in at least 3 fields, so no link is lost. Inside a task the sorted buckets are compared vertically: bit plane p
of all fingerprints is one long integer, a shift lines every fingerprint up with its s-th neighbour, and the planes'
differences run into carry-save counters that hold all distances at once. Buckets of like size form blocks, and a
block's comparison is abandoned as soon as every lane exceeds the radius. Large buckets are first divided by further
fields, again without losing a link. Only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .choose import one_of_each
from .common import settled, slices
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
FIELDS = 5
#: Buckets beyond this are divided by further fields.
DIVIDE_BEYOND = 512
#: Lanes of a block, if no bucket is larger.
BLOCK = 1 << 12
#: Fingerprints of more than this part of the rows are joined by broadcast; there are fewer than its inverse.
HEAVY = 1 / 512
_CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned SimHash: a bit is 1 if it is set in over half of the shingles' XXH64; 0 for no words."""
    # bytes.lower() and bytes.split() know exactly A-Z and the six white bytes.
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
        return hashes[0]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for part in slices(batches):
            prints = np.array([fingerprint(t, words, seed) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long): one row for each input row; null text has no words."""
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(_fingerprints(words, seed), "doc_id long, print long")


def _planes(prints: np.ndarray) -> list[int]:
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _mask(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _lanes(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n])


def near_lanes(planes: list[int], shift: int, live: int, radius: int) -> int:
    """Mask of the live lanes i whose distance to lane i + shift is radius or less."""
    width = max(1, radius.bit_length())
    counters, over = [0] * width, 0
    for at, plane in enumerate(planes, 1):
        carry = (plane ^ (plane >> shift)) & live
        for w in range(width):
            counters[w], carry = counters[w] ^ carry, counters[w] & carry
        over |= carry
        if at % 8 == 0:
            beyond, equal = 0, live
            for w in reversed(range(width)):
                if radius >> w & 1:
                    equal &= counters[w]
                else:
                    beyond |= equal & counters[w]
                    equal &= ~counters[w]
            if not live & ~(over | beyond):
                return 0
    return live & ~(over | beyond)


class _Forest:
    """Components of the links seen so far; add() returns the links that joined two of them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        new = self.parent[i] != self.parent[j]
        kept = []
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            ra, rb = self._root(a), self._root(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
        return kept


def links_in_buckets(prints: np.ndarray, bucket: np.ndarray, free: list[int], radius: int = RADIUS, forest: _Forest | None = None, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links within the buckets; bucket numbers come sorted.

    free: bits in which members of a bucket may still differ.
    """
    n = len(prints)
    forest = forest or _Forest(n)
    names = np.arange(n) if names is None else names
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    out: list[tuple[int, int]] = []
    if len(free) > radius + 1:
        for s, m in zip(start[size > DIVIDE_BEYOND].tolist(), size[size > DIVIDE_BEYOND].tolist(), strict=True):
            own = np.arange(s, s + m)
            fields = [free[k :: radius + 1] for k in range(radius + 1)]
            for field in fields:
                bits = np.uint64(sum(1 << b for b in field))
                order = own[np.argsort(prints[own] & bits, kind="stable")]
                key = prints[order] & bits
                out += links_in_buckets(prints[order], key, [b for b in free if b not in field], radius, forest, names[order])
    in_pairs = np.repeat((size > 1) & ((size <= DIVIDE_BEYOND) | (len(free) <= radius + 1)), size)
    if not in_pairs.any():
        return out
    own = np.repeat(size, size)[in_pairs]
    bucket = np.repeat(np.arange(len(size)), size)[in_pairs]
    order = np.lexsort((np.arange(len(own)), bucket, own))
    prints, names, bucket, own = prints[in_pairs][order], names[in_pairs][order], bucket[order], own[order]
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
    at = 0
    while at < len(prints):
        end = int(ends[min(int(np.searchsorted(ends, at + BLOCK)), len(ends) - 1)])
        planes, block = _planes(prints[at:end]), bucket[at:end]
        for shift in range(1, int(own[end - 1])):
            near = near_lanes(planes, shift, _mask(block[shift:] == block[:-shift]), radius)
            if near:
                i = at + _lanes(near, end - at)
                out += forest.add(names[i], names[i + shift])
        at = end
    return out


def _fields() -> list[list[int]]:
    cuts = [round(k * BITS / FIELDS) for k in range(FIELDS + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bucket_masks(radius: int) -> list[int]:
    fields = _fields()
    return [sum(1 << b for f in pick for b in fields[f]) for pick in combinations(range(FIELDS), FIELDS - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linker(radius: int):
    masks = _bucket_masks(radius)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pick = None

        def flush(which, prints, keys):
            free = [b for b in range(BITS) if not masks[which] >> b & 1]
            pairs = links_in_buckets(prints, keys, free, radius)
            a, b = (prints[np.array([p[k] for p in pairs], np.int64)].view(np.int64) for k in (0, 1))
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        def whole():
            return (np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            picks = batch.column(0).to_numpy()
            keys, prints = (batch.column(c).to_numpy().view(np.uint64) for c in (1, 2))
            for at, end in _runs(picks):
                if held and pick != picks[at]:
                    yield flush(pick, *whole())
                    held = []
                pick = int(picks[at])
                p, k = prints[at:end], keys[at:end]
                # The last bucket may go on in the next batch; what lies before it is compared now.
                tail = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1]))
                if tail or (held and held[-1][1][-1] != k[0]):
                    held.append((p[:tail], k[:tail]))
                    yield flush(pick, *whole())
                    held = []
                held.append((p[tail:], k[tail:]))
        if held:
            yield flush(pick, *whole())

    return run


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return list(zip(starts.tolist(), np.r_[starts[1:], len(x)].tolist(), strict=True))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that span the components of distinct fingerprints (print long) at radius bits or less."""
    if not 0 <= radius < FIELDS:
        raise ValueError(f"the bucket fields serve a radius of 0 to {FIELDS - 1}")
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("pick"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_bucket_masks(radius))]))
    rows = distinct.select("print", keyed.alias("k")).select("k.pick", "k.key", "print")
    met = rows.repartition("pick", "key").sortWithinPartitions("pick", "key", "print")
    return met.mapInArrow(_linker(radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each input row.

    Documents link when their fingerprints differ in radius bits or less; component_id is the smallest id reachable.
    Texts without words (null and empty ones too) have fingerprint zero and link like any other. A null id never names
    a component unless all ids in it are null. Repeated rows are rows of one component. No rows give no rows.
    """
    out = _grouped(docs, id_col, text_col, words, radius, seed)
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, seed: int) -> DataFrame:
    """doc_id, print, root (the group's smallest print), component_id for each input row."""
    prints = settled(fingerprints(docs, id_col, text_col, words, seed))
    distinct = settled(prints.groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(fingerprint_links(distinct.select("print"), radius))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "low", "n", F.coalesce("root", "print").alias("root"))
    rooted = settled(rooted)
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = settled(rooted.join(low, "root").select(F.col("print").alias("p"), "n", "root", "component_id"))
    # A fingerprint that very many rows share is told to all tasks, so that its rows meet in none.
    often = F.col("n") > F.lit(prints.count() * HEAVY)
    heavy = F.broadcast(named.where(often).drop("n"))
    same = prints["print"] == heavy["p"]
    rest = prints.join(heavy, same, "left_anti")
    rest = rest.join(named.where(~often).drop("n"), F.col("print") == F.col("p"))
    return prints.join(heavy, same).unionByName(rest).select("doc_id", "print", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The input's rows with one of each near-duplicate group: the smallest id; of rows that share it, the smallest print.

    Rows that share an id but not a group are each judged in their own. A row without an id stays only where its whole
    group has none, and then one of them. Null and empty texts are alike and form a group with all texts of fingerprint
    zero. The columns are the input's, whatever their names; no rows give no rows.
    """
    groups = _grouped(docs, id_col, text_col, words, radius, seed).select("doc_id", F.col("print").alias("mark"), "root")
    return one_of_each(docs, groups, id_col, text_col, lambda text: _signed(fingerprint(text, words, seed)))
