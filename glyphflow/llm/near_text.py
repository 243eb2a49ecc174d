"""Near copies by exact word-set similarity: pairs proposed by minimum hashes, each checked before it links.

A text is the set of its five-word shingles. Two texts of similarity s agree in all ROWS minima of one of BANDS bands with
probability 1 - (1 - s ** ROWS) ** BANDS, which is over 0.999 at 0.8. What meets in a band is only proposed: the
similarity of each proposed pair is computed from the whole sets.

Texts that meet in a bucket of a band are all proposed with each other where they are few. A crowded bucket goes by
rounds: each text is proposed with the bucket's first and with the ones before it, what is found like another text leaves
the buckets, and what stays there meets again, each time with four times as many, until all are with each other.
Buckets are read as streams, so no task holds one whole.

Each text goes to its buckets with a bitmap of its set. An element that sets a bit which the other's bitmap lacks isn't in
the other, so two bitmaps bound what their sets share: pairs that can't be similar are left out where they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .choose import BROADCAST_ROWS, one_of_each
from .common import counted, name_of, settled, slices
from .components import components

SHINGLE, SEED = 5, 42
BANDS, ROWS = 24, 6
#: Least similarity as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: The first texts of a bucket, which are all proposed with each other in every round.
FEW = 8
#: Texts before it with which each other text of a bucket is proposed in the first round.
NEXT = 2
#: Bits of a set's bitmap.
BITS = 1024
#: Words of which a task remembers that it has told their keys.
_TOLD = 1 << 20
_CHUNK = 1 << 11
_rng = np.random.default_rng(SEED)
_FACTORS = (_rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | 1).astype(np.uint32)
_SHIFTS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _node(tokens: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(tokens))
    return h - (1 << 64) if h >> 63 else h


#: Odd factors of the words' places in a run, and of the last mixing.
_PLACES = (np.random.default_rng(SEED + 1).integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingles(tokens: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of so many words; a shorter text is one run, no words are none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    words = min(words, len(tokens))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = len(tokens) - words + 1
    with np.errstate(over="ignore"):
        runs = np.full(n, words, np.uint64)
        for k in range(words):
            x = hashes[k : k + n] * _PLACES[k]
            runs = (runs ^ (x >> np.uint64(32)) ^ x) * _MIX
        runs ^= runs >> np.uint64(33)
    return np.unique(runs)


def bands(hashes: np.ndarray) -> list[int]:
    """The signed key of each band."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_FACTORS), ~np.uint32(0))
    for at in range(0, len(high), _CHUNK):
        low = np.minimum(low, (high[None, at : at + _CHUNK] * _FACTORS + _SHIFTS).min(1))
    digests = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def node_of(text: str | None) -> int | None:
    """The hash of a text's words; None for no words."""
    tokens = _tokens(text)
    return _node(tokens) if tokens else None


def _marked(batches):
    """The hash of each text's words, and its bands' keys where this task hasn't told them lately."""
    told: set[int] = set()
    for part in slices(batches):
        nodes, keys = [], []
        for tokens in map(_tokens, part.column(1).to_pylist()):
            node = _node(tokens) if tokens else None
            nodes.append(node)
            new = node is not None and node not in told
            keys.append(bands(shingles(tokens)) if new else [])
            if new:
                if len(told) >= _TOLD:
                    told.clear()
                told.add(node)
        yield pa.record_batch([part.column(0), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "keys"])


def _placed(batches):
    """Keys, nodes, and places in their buckets, without repeats; rows come sorted, a bucket may go on in the next batch."""
    last, told = None, 0
    for batch in batches:
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        if not len(key):
            continue
        own = np.r_[last != (key[0], node[0]), (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[own], node[own]
        if not len(key):
            continue
        at = np.arange(len(key))
        start = np.r_[True, key[1:] != key[:-1]]
        place = at - np.maximum.accumulate(np.where(start, at, 0))
        if last and last[0] == key[0]:
            place[: np.searchsorted(key, key[0], "right")] += told
        last, told = (key[-1], node[-1]), int(place[-1]) + 1
        yield key, node, place


def _batch(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)


_NONE = (np.zeros(0, np.int64),) * 3


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits by the hashes' remainders, as 64-bit words."""
    bits = np.zeros(BITS, bool)
    bits[(hashes.view(np.uint64) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def may_be_alike(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be similar enough: no set shares what sets a bit that the other lacks."""
    shared = np.minimum(n_a - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    return shared * WHOLE >= (n_a + n_b - shared) * PART


def _bitmaps(batches):
    for part in slices(batches):
        sets = [np.array(x, np.int64) for x in part.column(1).to_pylist()]
        yield pa.record_batch([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary())], ["node", "n", "bits"])


def _known(batches, told: dict):
    """The batches as they come; told gets the size and bitmap of their nodes, where they have them, while they're needed."""
    for batch in batches:
        if batch.num_columns > 2 and batch.num_rows:
            node, n = (batch.column(c).to_numpy() for c in ("node", "n"))
            node, at = np.unique(node, return_index=True)
            told |= {"node": node, "n": n[at], "bits": np.frombuffer(b"".join(batch.column("bits").take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)}
        yield batch


def _pairs(near: int):
    """Pairs of each bucket: every text with the first and the near ones before it, the FEW first with each other.

    Where rows have sizes and bitmaps (n, bits) beside key and node, less those that can't be similar enough.
    """

    def run(batches):
        held, head, back = _NONE, 0, max(FEW - 1, near)
        new: dict = {}
        own, first_own = None, None
        for rows in _placed(_known(batches, new)):
            known = len(held[0])
            key, node, place = (np.concatenate(x) for x in zip(held, rows, strict=True))
            if new:
                at = np.searchsorted(new["node"], rows[1])
                fresh_own = new["n"][at], new["bits"][at]
                own = fresh_own if own is None else tuple(np.concatenate(x) for x in zip(own, fresh_own, strict=True))
            at = np.arange(len(key))
            opened = np.maximum.accumulate(np.where(place == 0, at, -1))
            fresh = at >= known
            # The first row of the bucket that goes on stands before the others.
            node_, own_ = np.r_[head, node], own and tuple(np.concatenate([x[:1] if first_own is None else f, x]) for f, x in zip(first_own or own, own, strict=True))
            pairs = [np.zeros((0, 2), np.int64)]

            def meet(i, j):
                """Rows by their places in what has the head before it."""
                if own_:
                    for_good = may_be_alike(own_[0][i], own_[1][i], own_[0][j], own_[1][j])
                    i, j = i[for_good], j[for_good]
                pairs.append(np.stack([node_[i], node_[j]], 1))

            met = np.flatnonzero(fresh & (place > 0))
            meet(opened[met] + 1, met + 1)
            for shift in range(1, min(back, len(key) - 1) + 1):
                j = shift + np.flatnonzero((key[shift:] == key[:-shift]) & fresh[shift:] & ((place[shift:] < FEW) | (shift <= near)))
                meet(j - shift + 1, j + 1)
            found = np.unique(np.concatenate(pairs), axis=0)
            yield _batch(found[:, 0], found[:, 1], ["a", "b"])
            last = opened[-1] + 1
            head, first_own = node_[last], own_ and tuple(x[last : last + 1] for x in own_)
            tail = max(int(np.searchsorted(key, key[-1])), len(key) - back)
            held, own = (key[tail:], node[tail:], place[tail:]), own and tuple(x[tail:] for x in own)

    return run


def _crowded(few: int):
    """The rows of buckets of more than few texts."""

    def run(batches):
        held = _NONE
        for rows in _placed(batches):
            key, node, place = (np.concatenate(x) for x in zip(held, rows, strict=True))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[start[1:], len(key)]
            crowded = place[ends - 1] >= few
            goes = np.repeat(crowded, ends - start)
            yield _batch(key[goes], node[goes], ["key", "node"])
            held = _NONE if crowded[-1] else (key[start[-1] :], node[start[-1] :], place[start[-1] :])

    return run


def _sets(batches):
    for part in slices(batches):
        texts = [_tokens(t) for t in part.column(1).to_pylist()]
        nodes = pa.array([_node(t) if t else None for t in texts], pa.int64())
        yield pa.record_batch([part.column(0), nodes, pa.array([shingles(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["id", "node", "set"])


def _near(frame: DataFrame, rows: int) -> DataFrame:
    """A frame of ids and marks for a join: told to all tasks where its rows are few."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def _sets_of(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """node, set, n (its size) of the n chosen texts, each out of one of its rows."""
    # Few ids go to the texts; the texts of many go to them.
    wanted = rows.join(_near(chosen.select("of").distinct(), n), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    sets = wanted.mapInArrow(_sets, "id long, node long, set array<long>")
    own = sets.join(_near(chosen.withColumnRenamed("node", "named"), n), F.col("id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("named")), "left_semi")
    return settled(own.select("node", "set", F.size("set").alias("n")).dropDuplicates(["node"]))


def _alike(pairs: DataFrame, n: int, sets: DataFrame) -> DataFrame:
    """Those of n pairs whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in ("a", "b"))
    both = _near(pairs, n).join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared * WHOLE >= (F.size("set_a") + F.size("set_b") - shared) * PART).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEXT) -> DataFrame:
    """doc_id, mark (the hash of the words) and root (the group) of every row that has words.

    Groups are what similar pairs link; rows of the same words are one text. In crowded buckets the texts that are like a
    text of smaller id, or like one that is, no longer meet others, so a chain that only they would close may stay open;
    of what stays no two texts that meet in a bucket are similar.
    """
    rows = docs.select(F.col(name_of(id_col)).cast("long").alias("id"), F.col(name_of(text_col)).cast("string").alias("text"))
    marked = settled(rows.mapInArrow(_marked, "id long, node long, keys array<long>").where("node IS NOT NULL"))
    known = marked.select("id", "node")
    keys = marked.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    # Only texts that meet another go on.
    met = settled(keys.mapInArrow(_crowded(1), "key long, node long"))
    # Each with its smallest id, null where it has none.
    chosen, n = counted(known.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("of")))
    sets = _sets_of(rows, chosen, n)
    bitmaps = settled(sets.select("node", "set").mapInArrow(_bitmaps, "node long, n long, bits binary"))
    rank = F.struct(F.col("of").isNull().alias("none"), "of", "node")
    links, linked = None, 0
    while True:
        beside = met.join(bitmaps, "node").select("key", "node", "n", "bits").repartition("key").sortWithinPartitions("key", "node")
        pairs, n = counted(beside.mapInArrow(_pairs(near), "a long, b long").distinct())
        found, n = counted(_alike(pairs, n, sets))
        links, linked = found if links is None else links.unionByName(found), linked + n
        met, left = counted(met.mapInArrow(_crowded(max(FEW, near + 2)), "key long, node long"))
        if not left:
            break
        roots, n = counted(components(found, n))
        heads = _near(roots, n).join(chosen, "node").groupBy("root").agg(F.min(rank)["node"].alias("node"))
        gone = roots.select("node").join(_near(heads, n), "node", "left_anti")
        near *= 4
        met = settled(met.join(_near(gone, n), "node", "left_anti").repartition("key").sortWithinPartitions("key", "node").select("key", "node"))
    roots, n = counted(components(links, linked))
    joined = known.join(_near(roots, n), "node", "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("node").alias("mark"), F.coalesce("root", "node").alias("root"))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with one of each group of similar texts: the smallest id, a row without an id last.

    Null texts and texts without words are like no other and stay. Of rows that share id and words one stays. Texts are
    compared whole, however long. The columns are the input's, whatever their names; an empty table gives no rows.
    """
    return one_of_each(docs, similar_groups(docs, id_col, text_col), id_col, text_col, node_of)
