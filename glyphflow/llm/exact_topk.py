"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors lie in blocks of neighbouring ids. A block keeps a forward index (its rows) and, per term (dimension), the
largest and smallest weight. A query orders the blocks by the sum of its terms' best products, an upper bound of any
score in the block, and reads block after block until the next bound falls below its k-th best score.

Blocks are dealt into shards of bounded size, whose largest and smallest weights all tasks get (neighbouring shards share
them where they would be too many). A query first visits the shard with the highest bound; its k-th best score there goes
with it, and it visits only the shards whose bound still reaches that score. Each task holds one shard and streams the
queries past it, so memory doesn't grow with the queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

BLOCK_ROWS = 256
GROUP_ROWS = 512
MIN_SHARD_ROWS, MAX_SHARD_ROWS = 8_192, 131_072
#: Bytes of the shards' extremes that go to all tasks.
SUMMARY_BYTES = 64 << 20
#: Sums of doubles that hold whole numbers are exact below this.
EXACT = 2.0**53
_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1

_PACKED = "shard long, seq long, kind int, n int, dim int, ids binary, weights binary, high binary, low binary"
_ASKED = "shard long, seq long, kind int, n int, dim int, ids binary, weights binary, high binary, low binary, least binary"
_FOUND = "query_seq long, query_row int, query_id long, vec_id long, score long"


def _dense(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled rows of the usable vectors, short ones padded with zeros."""
    ids, lists = batch.column(0), batch.column(1)
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = lists.flatten()
    values = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64) * scale)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    ok = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    ok[rows[~np.isfinite(values)]] = False
    dim = int(lengths[ok].max()) if ok.any() else 0
    dense = np.zeros((len(lengths), dim))
    starts = np.cumsum(lengths) - lengths
    use = ok[rows]
    dense[rows[use], (np.arange(len(values)) - starts[rows])[use]] = values[use]
    return np.asarray(ids.fill_null(0), dtype=np.int64)[ok], dense[ok]


def _packer(scale: float, kind: int, rows: int):
    def pack(batches):
        shard, seq = TaskContext.get().partitionId(), 0
        held_ids, held, count = [], [], 0

        def blocks(final: bool):
            nonlocal held_ids, held, count, seq
            dim = max((m.shape[1] for m in held), default=0)
            ids = np.concatenate(held_ids) if held else np.zeros(0, np.int64)
            rest = np.concatenate([np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in held]) if held else np.zeros((0, 0))
            out, at = [], 0
            while len(ids) - at >= rows or (final and at < len(ids)):
                part, own = rest[at : at + rows], ids[at : at + rows]
                out.append((shard, (shard << 32) + seq, kind, len(own), dim, own.tobytes(), part.tobytes(), part.max(0).tobytes(), part.min(0).tobytes()))
                seq, at = seq + 1, at + rows
            held_ids, held, count = [ids[at:]], [rest[at:]], len(ids) - at
            return out

        for batch in batches:
            ids, dense = _dense(batch, scale)
            held_ids.append(ids), held.append(dense)
            count += len(ids)
            if count >= rows and (out := blocks(False)):
                yield _batch(out)
        if out := blocks(True):
            yield _batch(out)

    return pack


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["shard", "seq", "kind", "n", "dim", "ids", "weights", "high", "low"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m


def _whole(m: np.ndarray) -> np.ndarray:
    """Python's integers, which don't overflow."""
    out = np.empty(m.shape, object)
    out[...] = [[int(x) for x in row] for row in m.tolist()]
    return out


def search_blocks(blocks: list[dict], queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of these blocks for each query; ties to the smaller id.

    least: a score that each query has k others of, so that only as good ones matter. count, a list of two, is added the
    blocks that were scored and those that were not.
    """
    dim = max([queries.shape[1], *(b["m"].shape[1] for b in blocks)])
    queries = _wide(queries, dim)
    high, low = (np.stack([np.pad(b[x], (0, dim - len(b[x]))) for b in blocks]) for x in ("high", "low"))
    top = float(np.maximum(np.abs(high), np.abs(low)).max(initial=0)) * float(np.abs(queries).sum(1).max(initial=0))
    safe = top < EXACT
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T if safe else np.full((len(queries), len(blocks)), np.inf)
    order = np.argsort(-bounds, axis=1, kind="stable")
    nq = len(queries)
    row, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth, alive = np.full(nq, -np.inf) if least is None or not safe else least.copy(), np.ones(nq, bool)
    for step in range(len(blocks)):
        now = order[:, step]
        alive &= bounds[np.arange(nq), now] >= kth
        if not alive.any():
            break
        found = [(row, ids, scores)]
        if count is not None:
            count[0] += int(alive.sum())
        for at in np.unique(now[alive]):
            block, own = blocks[at], np.flatnonzero(alive & (now == at))
            m = _wide(block["m"], dim)
            if safe:
                s = queries[own] @ m.T
                floor = kth[own]
                if s.shape[1] > k + 1:  # one more, as the query's own row may be among them
                    floor = np.maximum(floor, np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1])
                r, c = np.nonzero(s >= floor[:, None])
                s = s[r, c].astype(np.int64)
            else:
                exact = _whole(queries[own]) @ _whole(m).T
                s = np.array([min(max(int(x), _LONG_MIN), _LONG_MAX) for x in exact.ravel()], np.int64)
                r, c = np.divmod(np.arange(len(s)), m.shape[0])
            other = block["ids"][c] != query_ids[own[r]]
            found.append((own[r][other], block["ids"][c][other], s[other]))
        row, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[best], ids[best], scores[best]
        first = np.searchsorted(row, np.arange(nq))
        keep = np.arange(len(row)) - first[row] < k
        row, ids, scores = row[keep], ids[keep], scores[keep]
        full = np.bincount(row, minlength=nq) >= k
        last = np.searchsorted(row, np.arange(nq), side="right") - 1
        if safe:
            kth[full] = np.maximum(kth[full], scores[last[full]].astype(np.float64))
    if count is not None:
        count[1] += nq * len(blocks)
    return row, ids, scores


def _searcher(k: int):
    def run(batches):
        shard, blocks = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, blocks = r["shard"], []
                matrix = np.frombuffer(r["weights"]).reshape(r["n"], r["dim"])
                ids = np.frombuffer(r["ids"], np.int64)
                if r["kind"] == 0:
                    blocks.append({"ids": ids, "m": matrix, "high": np.frombuffer(r["high"]), "low": np.frombuffer(r["low"])})
                elif blocks:
                    # The rows of a query group that came here.
                    rows, least = np.frombuffer(r["high"], np.int64), np.frombuffer(r["least"])
                    row, vec, score = search_blocks(blocks, matrix, ids, k, least)
                    columns = [np.full(len(row), r["seq"]), rows[row].astype(np.int32), ids[row], vec, score]
                    yield pa.record_batch([pa.array(c) for c in columns], ["query_seq", "query_row", "query_id", "vec_id", "score"])

    return run


def _extremes(key, table):
    """The largest and smallest weights of a shard."""
    dim = max(table.column("dim").to_pylist())
    high, low = (np.stack([np.pad(np.frombuffer(x), (0, dim - len(x) // 8)) for x in table.column(c).to_pylist()]) for c in ("high", "low"))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "high": pa.array([high.max(0).tobytes()]), "low": pa.array([low.min(0).tobytes()])})


class Extremes:
    """Bounds of a query's scores in every shard; neighbours share theirs where all would take more than so many bytes."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], most_bytes: int = SUMMARY_BYTES):
        rows = sorted(rows)
        dim = max((len(h) // 8 for _, h, _ in rows), default=0)
        self.shards = np.array([s for s, _, _ in rows], np.int64)
        high, low = (np.stack([np.pad(np.frombuffer(r[i]), (0, dim - len(r[i]) // 8)) for r in rows]) if rows else np.zeros((0, dim)) for i in (1, 2))
        each = max(1, math.ceil(len(rows) * dim * 16 / most_bytes))
        starts = np.arange(0, len(rows), each)
        self.high, self.low = (f.reduceat(m, starts, axis=0) if len(rows) else m for f, m in ((np.maximum, high), (np.minimum, low)))
        self.group = np.arange(len(rows)) // each

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        dim = max(queries.shape[1], self.high.shape[1])
        queries, high, low = (_wide(m, dim) for m in (queries, self.high, self.low))
        if float(np.maximum(np.abs(high), np.abs(low)).max(initial=0)) * float(np.abs(queries).sum(1).max(initial=0)) >= EXACT:
            return np.full((len(queries), len(self.shards)), np.inf)
        return (np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)[:, self.group]


def _visits(handle, first: bool):
    """Query groups, split by the shards that their queries visit: the one with the highest bound, or the others that can
    still hold one of a query's k best."""

    def run(batches):
        extremes = handle.value
        for batch in batches:
            for r in batch.to_pylist():
                matrix, ids = np.frombuffer(r["weights"]).reshape(r["n"], r["dim"]), np.frombuffer(r["ids"], np.int64)
                bounds, least = extremes.bounds(matrix), np.full(r["n"], -np.inf)
                home = bounds.argmax(1)
                goes = np.zeros(bounds.shape, bool)
                goes[np.arange(r["n"]), home] = True
                if not first:
                    for row, score in zip(r["rows"] or [], r["scores"] or [], strict=True):
                        least[row] = score
                    goes = ~goes & (bounds >= least[:, None])
                for s in np.flatnonzero(goes.any(0)).tolist():
                    own = np.flatnonzero(goes[:, s])
                    columns = [int(extremes.shards[s]), r["seq"], 1, len(own), r["dim"], ids[own].tobytes(), matrix[own].tobytes(), own.astype(np.int64).tobytes(), b"", least[own].tobytes()]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
                    yield pa.record_batch([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], _ASKED_NAMES)

    return run


_ASKED_NAMES = [x.split()[0] for x in _ASKED.split(", ")]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, query_modulus: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of floor(scale * component).

    Queries are the rows whose id is divisible by query_modulus; candidates are all rows with another id. Fewer
    candidates than k: all of them. Rows with a null id, a null vector, or a null or non-finite component take no part.
    Vectors of unequal length meet as if padded with zeros; an empty one scores 0. Rows that repeat an id are ranked
    as rows of their own. Scores beyond the range of a long stop at its ends. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    shard_rows = min(max(n // 32, MIN_SHARD_ROWS), MAX_SHARD_ROWS)
    shards = max(1, math.ceil(n / shard_rows))
    # The second key parts rows that share an id.
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(shards, "id", "at").sortWithinPartitions("id", "at").select("id", "v")
    blocks = settled(dealt.mapInArrow(_packer(scale, 0, BLOCK_ROWS), _PACKED))
    asked = rows.where(F.col("id") % query_modulus == 0)
    groups = settled(asked.coalesce(max(1, shards)).mapInArrow(_packer(scale, 1, GROUP_ROWS), _PACKED))
    # However many partitions the blocks came in, neighbours share a shard of about shard_rows rows.
    parts = max(1, blocks.rdd.getNumPartitions())
    blocks = blocks.withColumn("shard", F.floor(F.col("shard") * min(shards, parts) / parts))
    blocks = blocks.withColumn("least", F.lit(None).cast("binary"))
    told = blocks.select("shard", "dim", "high", "low").groupBy("shard").applyInArrow(_extremes, "shard long, high binary, low binary").collect()
    handle = vectors.sparkSession.sparkContext.broadcast(Extremes([(r["shard"], bytes(r["high"]), bytes(r["low"])) for r in told]))

    def search(asked: DataFrame) -> DataFrame:
        met = blocks.unionByName(asked).repartition(F.col("shard")).sortWithinPartitions("shard", "kind", "seq")
        return met.mapInArrow(_searcher(k), _FOUND)

    home = settled(search(groups.mapInArrow(_visits(handle, True), _ASKED)))
    # A query that has its k scores takes the last of them along.
    kth = home.groupBy("query_seq", "query_row").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
    kth = kth.groupBy(F.col("query_seq").alias("seq")).agg(F.collect_list(F.struct("query_row", "score")).alias("x")).select("seq", F.col("x.query_row").alias("rows"), F.col("x.score").alias("scores"))
    found = home.unionByName(search(groups.join(kth, "seq", "left").mapInArrow(_visits(handle, False), _ASKED)))
    ranked = Window.partitionBy("query_seq", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
