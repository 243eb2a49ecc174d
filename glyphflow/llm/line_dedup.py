"""Line dedup through a sharded minimal perfect hash.

Every document's distinct line keys are hashed to 128 bits and counted (map-side combined). The keys that reach
``min_docs`` are dealt into shards; each shard is a minimal perfect hash with a fingerprint, a count and a keeper array.
Documents probe these arrays. While all shards together stay under ``broadcast_bytes`` every task gets them; beyond
that the documents' line hashes are dealt to the shards and only the hits travel back; the most frequent lines, of which
there are few, are then known to all tasks and answered where they stand.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, slices
from .mphf import PerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
#: Lines that make up more than one in so many occurrences are known to all tasks; there are fewer of them than that.
OFTEN = 4_096
WHITE = " \t\n\x0b\x0c\r"
NOBODY = -(2**63)


def key_hash(line: str, min_chars: int) -> bytes | None:
    """16 bytes for the stripped, A-Z lower-cased line; None for a short one."""
    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return pairs[:, 0], pairs[:, 1]


def _distinct_keys(min_chars: int):
    def run(batches):
        for part in slices(batches):
            digests, owners = [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = {key_hash(x, min_chars) for x in (text or "").split("\n")} - {None}
                digests += own
                owners += [doc_id] * len(own)
            a, b = _halves(digests)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(owners, pa.int64())], ["a", "b", "doc_id"])

    return run


def _build(key, table):  # hints would be strings here, which applyInArrow can't read
    a, b = (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    keeper, count = table.column("keeper").to_numpy(), table.column("n").to_numpy()
    index = PerfectHash(a, b)
    at = index.find(a, b)
    prints, counts, keepers = np.zeros(index.n, np.uint64), np.zeros(index.n, np.uint32), np.zeros(index.n, np.int64)
    prints[at], counts[at], keepers[at] = a, np.minimum(count, 2**32 - 1), keeper
    blob = pickle.dumps((index, prints, counts, keepers), protocol=5)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})


class LineIndex:
    """All shards, or the one that a task holds."""

    def __init__(self, shards: int, blobs: dict[int, bytes]):
        self.shards, self.parts = shards, {k: pickle.loads(v) for k, v in blobs.items()}

    def keepers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is in the index, and the document that keeps its lines."""
        known, keeper = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        shard = (a >> np.uint64(1)) % np.uint64(self.shards)
        for k, (index, prints, _, keepers) in self.parts.items():
            own = np.flatnonzero(shard == np.uint64(k))
            at = index.find(a[own], b[own])
            hit = (at >= 0) & (prints[np.maximum(at, 0)] == a[own])
            known[own[hit]], keeper[own[hit]] = True, keepers[at[hit]]
        return known, keeper


def _dropped(texts: list[str], ids: list, index: LineIndex, min_chars: int) -> list[list[int]]:
    """Numbers of the lines that each text loses."""
    digests, where = [], []
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split("\n")):
            if (h := key_hash(line, min_chars)) is not None:
                digests.append(h)
                where.append((i, j))
    out: list[list[int]] = [[] for _ in texts]
    known, keeper = index.keepers(*_halves(digests))
    for at in np.flatnonzero(known):
        i, j = where[at]
        if keeper[at] != NOBODY and ids[i] != keeper[at]:
            out[i].append(j)
    return out


def _cut(text: str, gone: list[int]) -> tuple[str, int]:
    lines = text.split("\n")
    if not gone:
        return text, len(lines)
    drop = set(gone)
    return "\n".join(x for j, x in enumerate(lines) if j not in drop), len(lines)


def _rewriter(names: list[str], text_at: int, start):
    """start() is called once a task and returns (batch, texts) -> the line numbers that each text loses."""

    def run(batches):
        gone_of = start()
        for part in slices(batches):
            texts = [t or "" for t in part.column(text_at).to_pylist()]
            gone = gone_of(part, texts)
            cut = [_cut(t, g) for t, g in zip(texts, gone, strict=True)]
            columns = [pa.array([c for c, _ in cut], pa.string()) if i == text_at else part.column(i) for i in range(len(names))]
            yield pa.record_batch([*columns, pa.array([n for _, n in cut], pa.int64()), pa.array([len(g) for g in gone], pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The input's columns with the text less its dropped lines, and n_lines (before) and n_dropped.

    A line's key is the line stripped of space, tab and \\x0A-\\x0D at both ends, with A-Z lower-cased. Lines whose key
    has min_chars code points or more and stands in min_docs rows or more go everywhere except in the largest id that
    holds the key. Null text counts as empty (one empty line). A null id ranks below all others; where all holders of a
    line have none, it stays. Rows that share an id are counted as rows and all keep what their id keeps. Columns of
    the input named n_lines or n_dropped are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = pair.mapInArrow(_distinct_keys(min_chars), "a long, b long, doc_id long")
    common = keys.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).fillna({"keeper": NOBODY})
    common = settled(common)
    shards = max(1, -(-common.count() // SHARD_KEYS))
    shard_of = F.expr(f"pmod(shiftrightunsigned(a, 1), {shards}L)")
    blobs = settled(common.withColumn("shard", shard_of).groupBy("shard").applyInArrow(_build, "shard long, blob binary"))
    size = blobs.agg(F.sum(F.length("blob"))).first()[0] or 0
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if size <= broadcast_bytes:
        handle = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["blob"] for r in blobs.collect()})

        def start():
            index = LineIndex(shards, handle.value)
            return lambda part, texts: _dropped(texts, part.column(id_at).to_pylist(), index, min_chars)

        return docs.mapInArrow(_rewriter(names, text_at, start), out)
    total = common.agg(F.sum("n")).first()[0] or 0
    often = {(r["a"], r["b"]): r["keeper"] for r in common.where(F.col("n") * OFTEN > F.lit(total)).collect()}
    return _shuffled(docs, pair, blobs, docs.sparkSession.sparkContext.broadcast(often), shards, min_chars, names, id_at, text_at, out)


def _probes(min_chars: int, shards: int, often):
    def run(batches):
        known = often.value
        for part in slices(batches):
            digests, rows = [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                print_ = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                for j, line in enumerate(text.split("\n")):
                    if (h := key_hash(line, min_chars)) is not None:
                        digests.append(h)
                        rows.append((doc_id, print_, j))
            a, b = _halves(digests)
            ids, prints, lines = zip(*rows, strict=True) if rows else ((), (), ())
            told = [known.get(k) for k in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)] if known else [None] * len(a)
            hit = np.array([k is not None and k != NOBODY and k != i for k, i in zip(told, ids, strict=True)], bool)
            stays = np.array([k is not None for k in told], bool) & ~hit
            # What is answered here goes to any shard's task, only to come along.
            spread = np.fromiter((p[0] + 256 * p[1] + j for p, j in zip(prints, lines, strict=True)), np.uint64, len(a))
            shard = (np.where(hit, spread, a >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
            out = pa.record_batch([pa.array(shard), pa.nulls(len(a), pa.binary()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(lines, pa.int32()), pa.array(hit)], _PROBE)
            yield out.filter(pa.array(~stays))

    return run


_PROBE = ["shard", "blob", "a", "b", "doc_id", "print", "line", "hit"]


def _hits(shards: int):
    def run(batches):
        held, index = None, LineIndex(shards, {})
        for batch in batches:
            shard, blobs = batch.column("shard").to_numpy(), batch.column("blob")
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
            for i, at in enumerate(starts):
                run_ = batch.slice(at, (starts[i + 1] if i + 1 < len(starts) else len(shard)) - at)
                if shard[at] != held:
                    held, index = shard[at], LineIndex(shards, {})
                if (blob := blobs[int(at)].as_py()) is not None:
                    index = LineIndex(shards, {int(shard[at]): blob})
                    run_ = run_.slice(1)
                answered = run_.column("hit").cast(pa.bool_())
                yield run_.filter(answered).select(["doc_id", "print", "line"])
                run_ = run_.filter(pc.invert(answered))
                a, b = (run_.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("a", "b"))
                known, keeper = index.keepers(a, b)
                ids = run_.column("doc_id").to_pylist()
                gone = [k for k in np.flatnonzero(known).tolist() if keeper[k] != NOBODY and ids[k] != keeper[k]]
                yield run_.take(pa.array(gone, pa.int64())).select(["doc_id", "print", "line"])

    return run


def _shuffled(docs, pair, blobs, often, shards, min_chars, names, id_at, text_at, out) -> DataFrame:
    """Beyond the broadcast bound: line hashes go to their shard, hits come back per document."""
    probes = pair.mapInArrow(_probes(min_chars, shards, often), "shard long, blob binary, a long, b long, doc_id long, print binary, line int, hit boolean")
    both = blobs.select("shard", "blob", *(F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("doc_id", "long"), ("print", "binary"), ("line", "int"))), F.lit(False).alias("hit")).unionByName(probes)
    met = both.repartition("shard").sortWithinPartitions("shard", F.col("blob").isNull())
    # Rows that share both id and text lose the same lines, so a line number is told once.
    gone = met.mapInArrow(_hits(shards), "doc_id long, print binary, line int").groupBy("doc_id", "print").agg(F.collect_set("line").alias("gone"))
    struct = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{names[id_at]}`").cast("long").alias("k"), F.col(f"`{names[text_at]}`").alias("t"))
    tagged = struct.mapInArrow(_printer, T.StructType([struct.schema["doc"], T.StructField("k", T.LongType()), T.StructField("p", T.BinaryType())]))
    joined = tagged.join(gone, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("p") == F.col("print")), "left").select("doc.*", F.col("gone").alias("__gone"))

    def start():
        return lambda part, texts: [g or [] for g in part.column(len(names)).to_pylist()]

    return joined.mapInArrow(_rewriter(names, text_at, start), out)


def _printer(batches):
    for part in slices(batches):
        prints = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
        yield pa.record_batch([part.column(0), part.column(1), pa.array(prints, pa.binary())], ["doc", "k", "p"])
