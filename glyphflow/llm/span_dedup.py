"""Substring dedup over sliding sentence spans.

From every sentence on, the shortest run of at least two sentences and MIN_WORDS words is hashed to 128 bits. All runs
meet by hash; every occurrence but the first (smallest id, then position) is repeated, and the sentences it covers go.

Within a map task only one occurrence of a hash can be the first, so all others are settled there and travel as known
repeats: a passage that stands in a third of all documents sends one row for each task to its hash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, name_of, slices, together

MIN_SENTENCES, MIN_WORDS = 2, 24
#: Sentences of more words are cut, so that equal passages cut alike: after the word with the least checksum (the last of
#: such) of every CUT_WINDOW words that follow each other. From its first cut to its last a passage of n words cuts the same
#: anywhere; these are n - 2 * CUT_WINDOW + 1 words at least, so 51 words hold a whole run.
LONG_SENTENCE = 24
CUT_WINDOW = 12
#: Occurrences that a map task holds before it sends them on.
HELD = 1 << 20
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_WORD = re.compile(r"\S+\s*")


def _cuts(words: list[str]) -> list[int]:
    """Positions of the words after which a long sentence is cut."""
    n = len(words)
    if n < CUT_WINDOW:
        return []
    sums = np.fromiter(map(zlib.crc32, " ".join(words).lower().encode("utf-8", "surrogatepass").split(b" ")), np.uint64, n)
    # The least checksum, of equal ones the last: windows of 2, 4 and so on, and two that overlap at the end.
    low, width = (sums << _HALF) | np.arange(n, 0, -1, np.uint64), 1
    while 2 * width <= CUT_WINDOW:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < CUT_WINDOW:
        low = np.minimum(low[: width - CUT_WINDOW], low[CUT_WINDOW - width :])
    at = n - (low & _LOW).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])].tolist()


def _pieces(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences; together they are the whole text."""
    out, at = [], 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[at:end].split()
        if len(words) <= LONG_SENTENCE:
            out.append((at, end, words))
        else:
            after = [m.end() for m in _WORD.finditer(text, at, end)]
            start, first = at, 0
            for last in _cuts(words):
                out.append((start, after[last], words[first : last + 1]))
                start, first = after[last], last + 1
            if start < end:
                out.append((start, end, words[first:]))
        at = end
    return out


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, key, words) of the sentences; together they are the whole text."""
    return [(start, end, " ".join(words).lower(), len(words)) for start, end, words in _pieces(text)]


def runs(parts: list[tuple[int, int, str, int]], min_sentences: int, min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest run from every sentence that has words, where one is long enough."""
    full = [i for i, p in enumerate(parts) if p[3]]
    out, last, words = [], 0, 0
    for k in range(len(full)):
        while last < len(full) and (last - k < min_sentences or words < min_words):
            words += parts[full[last]][3]
            last += 1
        if last - k < min_sentences or words < min_words:
            break
        out.append((full[k], full[last - 1]))
        words -= parts[full[k]][3]
    return out


def _print(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


_NAMES = ["deal", "known", "hash", "low", "doc_id", "print", "at"]
_DDL = "deal long, known boolean, hash long, low long, doc_id long, print long, at int"
#: Odd, so that it has an inverse in the whole numbers modulo 2 ** 64.
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)


def _run_hashes(digests: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits (two columns) of the sequences of digests from first to last: polynomials modulo 2 ** 64."""
    n = len(digests)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones((1, 2), np.uint64), np.broadcast_to(_BASE, (n, 2))]), axis=0)
        back = np.multiply.accumulate(np.concatenate([np.ones((1, 2), np.uint64), np.broadcast_to(_INVERSE, (n, 2))]), axis=0)
        upto = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(digests * power[:n], axis=0, dtype=np.uint64)])
        return (upto[last + 1] - upto[first]) * back[first]


def _occurrences(min_sentences: int, min_words: int):
    def spans(ids: list, texts: list) -> list[np.ndarray]:
        """hash, low, doc_id, print, at of the runs of some documents."""
        words, digests, sizes, owners = [], [], [], []
        for doc_id, text in zip(ids, texts, strict=True):
            parts = _pieces(text) if text else []
            words += [len(w) for _, _, w in parts]
            digests += [xxhash.xxh3_128_digest(" ".join(w).lower().encode("utf-8", "surrogatepass")) for _, _, w in parts]
            sizes.append(len(parts))
            owners.append((-(2**63) if doc_id is None else doc_id, _print(text) if text else 0))
        count, size = np.array(words, np.int64), np.array(sizes, np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(count)) - np.repeat(np.cumsum(size) - size, size)
        full = np.flatnonzero(count)
        count, owner, at = count[full], owner[full], at[full]
        digest = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[full]
        upto, first = np.cumsum(count), np.arange(len(count))
        last = np.maximum(np.searchsorted(upto, upto - count + min_words), first + min_sentences - 1)
        whole = np.flatnonzero(last < len(count))
        whole = whole[owner[last[whole]] == owner[whole]]
        found = _run_hashes(digest, first[whole], last[whole]).view(np.int64)
        doc, print_ = np.array(owners, np.int64).reshape(-1, 2)[owner[whole]].T
        return [found[:, 0], found[:, 1], doc, print_, at[whole]]

    def run(batches):
        held, count = [], 0
        for part in slices(batches):
            held.append(spans(part.column(0).to_pylist(), part.column(1).to_pylist()))
            count += len(held[-1][0])
            if count >= HELD:
                yield from _settle(held)
                held, count = [], 0
        if count:
            yield from _settle(held)

    return run


def _settle(held: list[list[np.ndarray]]):
    """Marks what can't be a first occurrence, and deals such rows out evenly."""
    h, low, doc, print_, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    some = order[np.r_[False, same] | np.r_[same, False]]
    some = some[np.lexsort((at[some], print_[some], doc[some], low[some], h[some]))]
    known = np.zeros(len(h), bool)
    known[some] = _later(h[some], low[some], doc[some], print_[some], at[some], None)[0]
    with np.errstate(over="ignore"):
        deal = np.where(known, (doc * 0x9E3779B1 + at) ^ print_, h)
    yield from pa.table([pa.array(deal), pa.array(known), pa.array(h), pa.array(low), pa.array(doc), pa.array(print_), pa.array(at.astype(np.int32))], _NAMES).to_batches(max_chunksize=50_000)


def _later(h, low, doc, print_, at, first: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Of sorted occurrences: which aren't their hash's first (one occurrence told twice is still one); the last first."""
    if not len(h):
        return np.zeros(0, bool), first
    fresh = np.r_[first is None or (h[0], low[0]) != first[:2], (h[1:] != h[:-1]) | (low[1:] != low[:-1])]
    group = np.cumsum(fresh)
    starts = np.flatnonzero(fresh)
    heads = np.stack([x[starts] for x in (h, low, doc, print_, at)], 1)
    if not fresh[0]:
        heads = np.concatenate([np.array([first], np.int64), heads])
    else:
        group -= 1
    own = heads[group]
    return (own[:, 2] != doc) | (own[:, 3] != print_) | (own[:, 4] != at), tuple(int(x) for x in heads[-1])


def _repeats(batches):
    first = None
    for batch in batches:
        known = batch.column(1).to_numpy(zero_copy_only=False)
        later = known.copy()
        open_ = np.flatnonzero(~known)
        h, low, doc, print_, at = (batch.column(c).to_numpy()[open_] for c in ("hash", "low", "doc_id", "print", "at"))
        later[open_], first = _later(h, low, doc, print_, at.astype(np.int64), first)
        yield batch.filter(pa.array(later)).select(["doc_id", "print", "at"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, print (of the text), at: the starting sentences of all spans that aren't a first occurrence."""
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    met = pair.mapInArrow(_occurrences(min_sentences, min_words), _DDL).repartition("deal").sortWithinPartitions("known", "hash", "low", "doc_id", "print", "at")
    return met.mapInArrow(_repeats, "doc_id long, print long, at int")


def _keyed(batches):
    for part in slices(batches):
        ids = [-(2**63) if x is None else x for x in part.column(1).to_pylist()]
        prints = [_print(t) if t else 0 for t in part.column(2).to_pylist()]
        yield pa.record_batch([*part.columns, pa.array(ids, pa.int64()), pa.array(prints, pa.int64())], [*part.schema.names, "k", "p"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns, the text less its repeated sentences, and n_sentences (before), n_removed, removed.

    removed holds the [start, end) code points that went. First occurrences are those with the smallest id, then place;
    a null id ranks first. Rows that repeat both id and text are one document and keep or lose the same. Null and empty
    texts have no sentence and come back empty; texts are read whole, however long. Columns of the input with the added
    names are replaced, others keep their name, whatever it is. An empty table gives no rows.
    """
    added = ["n_sentences", "n_removed", "removed"]
    names = [c for c in docs.columns if c.lower() not in added]
    spans = repeated_spans(docs, id_col, text_col, min_sentences, min_words)
    starts = spans.groupBy("doc_id", "print").agg(F.collect_set("at").alias("gone"))
    plain = docs.select(*[F.col(name_of(c)) for c in names]).withColumn(text_col, F.col(name_of(text_col)).cast("string"))
    rows = apart(plain, text=text_col).select("doc", F.col("doc").getField(id_col).cast("long").alias("id"), "text")
    keyed = rows.mapInArrow(_keyed, T.StructType([*rows.schema.fields, T.StructField("k", T.LongType()), T.StructField("p", T.LongType())]))
    joined = keyed.join(starts, (F.col("k") == F.col("doc_id")) & (F.col("p") == F.col("print")), "left").select("doc", "text", "gone")

    def cut(batches):
        for part in slices(batches):
            texts, counts, gone = [], [], []
            for text, at in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                parts = _pieces(text) if text else []
                counts.append(len(parts))
                if not at:
                    texts.append(text or "")
                    gone.append([])
                    continue
                drop = np.zeros(len(parts), bool)
                last = dict(runs([(*p[:2], "", len(p[2])) for p in parts], min_sentences, min_words))
                for a in at:
                    drop[a : last[a] + 1] = True
                texts.append("".join(text[s:e] for (s, e, _), d in zip(parts, drop.tolist(), strict=True) if not d))
                gone.append([[parts[i][0], parts[i][1]] for i in np.flatnonzero(drop)])
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64())))], ["doc", "new", *added])

    kinds = [T.StructField("new", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))]
    out = joined.mapInArrow(cut, T.StructType([rows.schema["doc"], *kinds]))
    return out.select(*together(plain, **{text_col: F.col("new")}), *added)
