"""Best-fit packing of documents into sequences by linear grouping.

Pieces are dealt evenly into shards of at most ``SHARD_PIECES`` rows, each packed by one task. Within a shard the large
lengths are sorted and cut into groups of equal cardinality, and each is rounded up to its group's largest. Over the few
sizes left, configurations (which sizes a sequence holds) are optimised twice: a search for the fullest, and the linear
program over all configurations by column generation from there, rounded down, its rest searched again. Their places are
filled with actual pieces, and the room that rounding left goes, best fit first, to the small pieces; the set of
configurations that ends in fewer sequences stands.
"""

from __future__ import annotations

import json
import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, slices

CAPACITY, END_ID = 1024, 2
SHARD_PIECES = 1 << 16
GROUPS = 512
#: Lengths of at most this part of the capacity count as small.
SMALL_PART = 4
#: Columns that the linear program of a shard may take in.
LP_STEPS, SEED = 4_000, 3


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the vocabulary file's own library gives them.

    A byte-level vocabulary whose ids follow the order of its merges is read into the faster merging library, which
    then gives the same ids; any other file, and any text in which one of the file's added tokens is written out, is left
    to its own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        spec = json.loads(self.own.to_str())
        self.fast = _merged_by_rank(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._own(texts)
        out = [None if any(a in t for a in self.added) else self.fast.encode_ordinary(t) for t in texts]
        left = iter(self._own([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(left) if ids is None else ids for ids in out]

    def _own(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]


#: Fixed value: the pattern by which byte-level vocabularies part a text before merging.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _merged_by_rank(spec: dict):
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters = _byte_letters()
    try:
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    except KeyError:
        return None
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        return None
    import tiktoken

    return tiktoken.Encoding("read from file", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all are full but the first, which may be shorter."""
    first = total % capacity or capacity
    return [(0, min(first, total)), *((at, capacity) for at in range(first, total, capacity))]


def _tokenise(path: str | None, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(path or default_tokenizer())
        for part in slices(batches):
            rows = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, found in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                ids = np.array([*found, end_id], "<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start : start + length].tobytes()
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own if keep_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], _PIECE)

    return run


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def group_sizes(lengths: np.ndarray, groups: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths that come in falling order, cut into groups of equal cardinality: each group's largest, and its positions."""
    parts = [p for p in np.array_split(np.arange(len(lengths)), min(groups, len(lengths))) if len(p)]
    sizes, members = [], []
    for p in parts:
        if sizes and sizes[-1] == lengths[p[0]]:
            members[-1] = np.r_[members[-1], p]
        else:
            sizes.append(int(lengths[p[0]]))
            members.append(p)
    return np.array(sizes, np.int64), members


def _completion(room: int, sizes: np.ndarray, left: np.ndarray, fits: np.ndarray) -> list[int]:
    """Positions of the one or two sizes that fill the room best; fits[x] is the first position of a size up to x."""
    one = fits[room]
    if one == len(sizes):
        return []
    first = np.flatnonzero((sizes <= room) & (left > 0))
    rest = room - sizes[first]
    second = fits[rest]
    # A size that is needed twice must be there twice; else its neighbour below has to do.
    short = (second == first) & (left[first] < 2)
    second = np.where(short, fits[np.maximum(np.minimum(rest, sizes[first] - 1), 0)], second)
    padded = np.r_[sizes, 0]
    filled = sizes[first] + padded[second]
    at = int(filled.argmax())
    if filled[at] == sizes[one]:
        return [int(one)]
    return [int(first[at]), int(second[at])] if second[at] < len(sizes) else [int(first[at])]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (positions of falling sizes) and how often each is used; together they meet the demand.

    A configuration starts with the largest size that is left, takes the largest that fit while the room is wide, and
    ends with the one or two sizes that fill it best. It is used as often as the demand allows, which uses up a size,
    so there are no more configurations than sizes.
    """
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        there = np.flatnonzero(left)
        picked, room = [int(there[0])], capacity - int(sizes[there[0]])
        spare = left.copy()
        spare[there[0]] -= 1
        while room >= 3 * sizes[there[-1]]:
            fitting = np.flatnonzero((sizes <= room) & (spare > 0))
            if not len(fitting) or room - sizes[fitting[0]] < sizes[there[-1]] * 2:
                break
            picked.append(int(fitting[0]))
            spare[fitting[0]] -= 1
            room -= int(sizes[fitting[0]])
        there = np.flatnonzero(spare)
        if len(there):
            fits = there[np.minimum(np.searchsorted(-sizes[there], -np.arange(capacity + 1), side="left"), len(there) - 1)]
            fits[: sizes[there[-1]]] = len(sizes)
            picked += _completion(room, sizes, spare, fits)
        need = np.bincount(picked, minlength=len(sizes))
        times = int((left[need > 0] // need[need > 0]).min())
        out.append((picked, times))
        left -= need * times
    return out


def _priced(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration of up to three sizes that is worth most, and its worth; sizes fall."""
    worth = np.maximum(price, 0.0)
    # one[r]: the best single size up to r; m stands for none.
    m = len(sizes)
    one, at = np.zeros(capacity + 1), np.full(capacity + 1, m)
    one[sizes], at[sizes] = worth, np.arange(m)
    best = np.maximum.accumulate(one)
    at = at[np.maximum.accumulate(np.where(one == best, np.arange(capacity + 1), 0))]
    rest = capacity - sizes
    room = rest[:, None] - sizes[None, :]
    two = np.where(room >= 0, worth[None, :] + best[np.maximum(room, 0)], -1.0)
    second = two.argmax(1)
    two = two[np.arange(m), second]
    three = worth + np.maximum(two, 0.0)
    first = int(three.argmax())
    picked = [first]
    if two[first] >= 0:
        j = int(second[first])
        picked += [j, int(at[room[first, j]])]
    return float(three[first]), [p for p in picked if p < m]


def optimised(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = LP_STEPS) -> list[tuple[list[int], int]]:
    """Configurations of the linear program that meets the demand with the fewest sequences, rounded down; the rest by search.

    Sizes fall and lie above capacity / SMALL_PART, so a configuration holds at most three. The basis starts with what the
    search finds, a column for each size it uses up; columns enter while one is worth more than a sequence. After
    ``steps`` columns the program stands as it is, which is still a valid packing.
    """
    m = len(sizes)
    alone = [[i] * (capacity // int(sizes[i])) for i in range(m)]
    columns, left = list(alone), demand.astype(np.int64).copy()
    for picked, times in configurations(sizes, demand, capacity):
        left -= np.bincount(picked, minlength=m) * times
        if (spent := next((i for i in picked if not left[i]), -1)) >= 0:
            columns[spent] = picked
    # A little more of each size than is asked for keeps the steps from going in circles.
    asked = demand + np.random.default_rng(SEED).uniform(1e-7, 2e-7, m)
    for columns in (columns, alone):
        base = np.stack([np.bincount(c, minlength=m) for c in columns], 1).astype(float)
        inverse = np.linalg.pinv(base) if np.linalg.matrix_rank(base) < m else np.linalg.inv(base)
        amount = inverse @ asked
        if amount.min() >= 0 and np.allclose(base @ amount, asked):
            break
    for _ in range(steps):
        worth, picked = _priced(sizes, inverse.sum(0), capacity)
        if worth <= 1 + 1e-7:
            break
        enters = np.bincount(picked, minlength=m).astype(float)
        change = inverse @ enters
        falls = change > 1e-9
        if not falls.any():
            break
        ratio = np.where(falls, amount / np.where(falls, change, 1.0), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * change
        amount[out] = ratio[out]
        pivot = inverse[out] / change[out]
        inverse -= change[:, None] * pivot[None, :]
        inverse[out] = pivot
        columns[out] = picked
    found, left = [], demand.astype(np.int64).copy()
    for picked, x in zip(columns, amount.tolist(), strict=True):
        need = np.bincount(picked, minlength=m)
        times = min(int(x + 1e-5), int((left[need > 0] // need[need > 0]).min()))
        if times > 0:
            found.append((picked, times))
            left -= need * times
    return found + configurations(sizes, left, capacity)


class _Rooms:
    """Sequences by the room they have left."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0

    def put(self, room: int, sequence: int) -> None:
        self.by_room[room].append(sequence)
        self.some |= 1 << room

    def best(self, length: int) -> tuple[int, int] | None:
        """Takes the sequence with the least room that fits."""
        fits = self.some >> length
        if not fits:
            return None
        room = length + (fits & -fits).bit_length() - 1
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            self.some &= ~(1 << room)
        return room, sequence


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; lengths are 1 to capacity."""
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    full = int(np.searchsorted(-ranked, -(capacity - 1), side="left"))
    large = int(np.searchsorted(-ranked, -(capacity // SMALL_PART), side="left"))
    if large == full:
        return _placed(lengths, order, full, large, [], [], capacity)[1:]
    sizes, members = group_sizes(ranked[full:large], groups)
    demand = np.array([len(m) for m in members])
    found = [_placed(lengths, order, full, large, how(sizes, demand, capacity), members, capacity) for how in (configurations, optimised)]
    return min(found, key=lambda x: x[0])[1:]


def _placed(lengths: np.ndarray, order: np.ndarray, full: int, large_end: int, chosen: list[tuple[list[int], int]], members: list[np.ndarray], capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Sequences used, and where each length goes: full ones alone, large ones by configuration, then best fit."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    sequence[order[:full]] = np.arange(full)
    count = full
    rooms = _Rooms(capacity)
    large, lens = order[full:large_end].tolist(), lengths.tolist()
    taken = [0] * len(members)
    places = [m.tolist() for m in members]
    for slots, times in chosen:
        for _ in range(times):
            at = 0
            for g in slots:
                item = large[places[g][taken[g]]]
                taken[g] += 1
                sequence[item], offset[item] = count, at
                at += lens[item]
            if at < capacity:
                rooms.put(capacity - at, count)
            count += 1
    for item in order[large_end:].tolist():
        length = lens[item]
        room, where = rooms.best(length) or (capacity, -1)
        if where < 0:
            where, count = count, count + 1
        sequence[item], offset[item] = where, capacity - room
        if room > length:
            rooms.put(room - length, where)
    return count, sequence, offset


def _packer(capacity: int, groups: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        sequence, offset = pack_lengths(rows.column("length").to_numpy(), capacity, groups)
        base = TaskContext.get().partitionId() << 32
        rows = rows.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID, keep_ids: bool = False, shard_pieces: int = SHARD_PIECES, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: one row for each piece of each input row.

    A document is its text's ids and end_id; null text counts as empty, so every row has a piece. Longer documents than
    capacity are cut into full pieces, the first of which may be shorter. Sequences hold their pieces without gaps from
    0. ids (little-endian unsigned 32-bit) is null unless keep_ids. Rows that repeat an id, or have none, are packed as
    documents of their own. tokenizer_path is read where the tasks run; None means the installed byte-level vocabulary.
    An empty table gives no rows.
    """
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = settled(pair.mapInArrow(_tokenise(tokenizer_path, capacity, end_id, keep_ids), _PIECE_DDL))
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    dealt = pieces.repartition(shards)
    return dealt.mapInArrow(_packer(capacity, groups), f"{_PIECE_DDL}, sequence_id long, offset long")
