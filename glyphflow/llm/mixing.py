"""Temperature mixing of sources, with DataFrame functions only.

Source s with token share p_s gets weight w_s = p_s^a / sum p^a. The exponent a is bisected until the mix meets a
target: an entropy of at least ``target_entropy``, or no source repeated more than ``max_repeats`` times. Against a
token budget each source then has a number of whole passes and a part of one more. The part is taken from a block
permutation: documents fall into blocks by hash, blocks are permuted by hash, whole blocks are taken while the budget
lasts, and the block at the boundary is cut by the permuted order of its documents. So a source's decision is a few
numbers, which are broadcast while the sources are few, and no text moves. What is told about all sources together are
sums, which Spark takes; the driver sees no list of sources.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, name_of, settled

MAX_REPEATS, SEED = 2.0, 7
#: Mean documents of a block in the largest source.
BLOCK_DOCS = 512
STEPS = 60
#: Exponents whose sums over all sources one job takes.
GRID = 31
#: More sources than this are joined without a broadcast.
BROADCAST_SOURCES = 10_000
EXTRA = ["copy", "tokens", "block", "place"]


def entropy(shares: list[float], exponent: float) -> float:
    w = weights(shares, exponent)
    return -sum(x * math.log(x) for x in w if x > 0)


def weights(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    total = sum(raised)
    return [x / total for x in raised] if total else raised


def repeats(shares: list[float], exponent: float) -> float:
    """Passes over the most repeated source when every source has one pass at least."""
    some = [p for p in shares if p > 0]
    return (max(some) / min(some)) ** (1 - exponent) if some else 1.0


def _boundary(rises: Callable[[list[float]], list[bool]], points: int = 1) -> tuple[float, float]:
    """The two ends of the narrowest interval in [0, 1] at whose lower end the exponent still has to rise.

    rises is true below some exponent and false above; it is asked for ``points`` exponents at a time.
    """
    low, high, width = 0.0, 1.0, 1.0
    while width > 2.0**-STEPS:
        grid = [low + (high - low) * k / (points + 1) for k in range(1, points + 1)] if points > 1 else [(low + high) / 2]
        told = rises(grid)
        under = [x for x, up in zip(grid, told, strict=True) if up]
        over = [x for x, up in zip(grid, told, strict=True) if not up]
        low, high = max([low, *under]), min([high, *over])
        width /= points + 1
    return low, high


def bisect_exponent(shares: list[float], target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent in [0, 1] nearest to 0 that keeps max_repeats, or nearest to 1 that reaches target_entropy.

    Where no exponent meets the target, the nearer end.
    """
    if target_entropy is not None:
        if entropy(shares, 1.0) >= target_entropy:
            return 1.0
        return _boundary(lambda grid: [entropy(shares, x) >= target_entropy for x in grid])[0]
    if max_repeats is None or repeats(shares, 0.0) <= max_repeats:
        return 0.0
    return _boundary(lambda grid: [repeats(shares, x) > max_repeats for x in grid])[1]


def _entropies(sources: DataFrame, exponents: list[float]) -> list[float]:
    """The mix's entropy under each exponent, of the shares' sums of p^a and p^a ln p."""
    some = sources.where("share > 0")
    sums = [x for i, a in enumerate(exponents) for x in (F.sum(F.pow("share", F.lit(a))).alias(f"r{i}"), F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"l{i}"))]
    got = some.agg(*sums).first()
    return [math.log(got[f"r{i}"]) - a * got[f"l{i}"] / got[f"r{i}"] if got[f"r{i}"] else 0.0 for i, a in enumerate(exponents)]


def _number(*parts: Column) -> Column:
    """60 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget_tokens: int | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The input's columns and copy (from 0), tokens, block, place: a row for each time that a row is in the mix.

    Tokens are runs of other characters than white space. budget_tokens defaults to the least budget in which every
    source is passed once, so that no row is left out. Under a given budget no source has more than max_repeats passes
    (None: any number); what the limit takes from a source goes to the others by their weights, and where all are at
    their limit the rest of the budget stays unspent. Rows of a copy are read in the order of (block, place). A null
    source is a source of its own; null text counts as empty. A source without tokens has each row once. Rows that
    repeat both id and text stand in the same place and are taken or left together; a boundary never parts them. Texts
    are counted whole, however long. Columns of the input named copy, tokens, block or place are replaced, others keep
    their name, whatever it is. An empty table gives no rows.
    """
    text = F.coalesce(F.col(name_of(text_col)).cast("string"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("s:"), F.col(name_of(source_col)).cast("string")), F.lit("n:"))
    facts = [F.col(name_of(id_col)).cast("string").alias("id"), source.alias("source"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.md5(text.cast("binary")).alias("print")]
    meta = settled(docs.select(*facts))
    plan, bits = _plan(meta, target_entropy, max_repeats, budget_tokens, seed, block_docs)
    plan = settled(plan)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    rows = docs.select(carried(docs), *facts).join(plan, "source")
    order, block = _order(seed, F.col("passes"), bits)
    cut = (F.col("cut_block") > _rank(seed, block)) | ((F.col("cut_block") == _rank(seed, block)) & (order <= F.col("cut_order")))
    copies = F.col("passes") + F.when(cut, 1).otherwise(0)
    rows = rows.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    order, block = _order(seed, F.col("copy"), bits)
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in EXTRA]
    return rows.withColumn("block", _rank(seed, block)).withColumn("place", order).select(*own, F.col("copy").cast("int").alias("copy"), "tokens", "block", "place")


def _order(seed: int, copy: Column, bits: int) -> tuple[Column, Column]:
    """A row's place in the permutation of a copy, and its block; needs source, id and print."""
    order = _number(F.lit(seed), copy, F.coalesce(F.col("id"), F.lit("")), F.col("print"))
    return order, F.shiftright(order, 60 - bits)


def _rank(seed: int, block: Column) -> Column:
    return _number(F.lit(seed), F.col("source"), block)


def _passes(meta: DataFrame, target_entropy, max_repeats, budget_tokens) -> tuple[DataFrame, int]:
    """source, passes, rest (tokens of one more pass), and the rows of the largest source."""
    sources = settled(meta.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n")))
    whole = sources.agg(F.sum("total").alias("all"), F.max("n").alias("n")).first()
    everything = float(whole["all"] or 0)
    share = F.col("total") / F.lit(everything) if everything else F.lit(0.0)
    sources = sources.withColumn("share", share)
    if target_entropy is not None:
        exponent = 1.0
        if everything and _entropies(sources, [1.0])[0] < target_entropy:
            exponent = _boundary(lambda grid: [x >= target_entropy for x in _entropies(sources, grid)], GRID)[0]
    else:
        ends = sources.where("share > 0").agg(F.max("share").alias("most"), F.min("share").alias("least")).first()
        exponent = bisect_exponent([ends["most"], ends["least"]] if ends["most"] else [], None, max_repeats)
    raised = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    sum_of = sources.agg(F.sum(raised)).first()[0] or 0.0
    sources = sources.withColumn("weight", raised / F.lit(sum_of) if sum_of else F.lit(0.0))
    if budget_tokens is None:
        budget = sources.where("weight > 0").agg(F.max(F.col("total") / F.col("weight"))).first()[0] or 0.0
        own = F.col("weight") * F.lit(float(budget))
    else:
        own = _limited(sources, float(budget_tokens), max_repeats)
    own = F.round(own).cast("long")
    some = F.col("total") > 0
    # Rows of a source without tokens have one pass.
    told = sources.select("source", F.when(some, F.expr("1")).otherwise(0).alias("some"), own.alias("own"), "total")
    return told.select("source", F.when(F.col("some") == 1, F.expr("own div total")).otherwise(F.lit(1)).cast("long").alias("passes"), F.when(F.col("some") == 1, F.col("own") % F.col("total")).otherwise(F.lit(0)).cast("long").alias("rest")), whole["n"] or 0


def _limited(sources: DataFrame, budget: float, max_repeats: float | None) -> Column:
    """A source's tokens under a budget: its weight's part, or its limit, the others sharing what limits leave."""
    if max_repeats is None:
        return F.col("weight") * F.lit(budget)
    limit, factor, held = F.col("total") * F.lit(float(max_repeats)), budget, -1
    while True:
        # Every round more sources are at their limit, or the round is the last.
        over = F.col("weight") * F.lit(factor) > limit
        got = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, limit)).alias("spent"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if got["n"] == held or not got["weight"]:
            return F.least(F.col("weight") * F.lit(factor), limit)
        held, factor = got["n"], (budget - (got["spent"] or 0.0)) / got["weight"]


def _plan(meta: DataFrame, target_entropy, max_repeats, budget_tokens, seed: int, block_docs: int) -> tuple[DataFrame, int]:
    """source, passes, cut_block, cut_order: whole passes over a source, and where one more pass ends."""
    told, largest = _passes(meta, target_entropy, max_repeats, budget_tokens)
    told = settled(told)
    small = F.broadcast if told.count() <= BROADCAST_SOURCES else lambda frame: frame
    bits = max(2, math.ceil(math.log2(max(1, largest) / block_docs + 1)))
    rows = meta.join(small(told), "source").where("rest > 0")
    order, block = _order(seed, F.col("passes"), bits)
    rows = rows.withColumn("order", order).withColumn("block", _rank(seed, block))
    blocks = settled(rows.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens")))
    # Blocks are summed in two levels, so that no task orders all blocks of a source.
    blocks = blocks.withColumn("range", F.shiftright("block", 60 - math.ceil(bits / 2)))
    ranges = blocks.groupBy("source", "range", "rest").agg(F.sum("tokens").alias("tokens"))
    at = _edge(ranges, "range", F.col("rest"))
    inner = blocks.join(small(at.select("source", "range", "room")), ["source", "range"])
    edge = settled(_edge(inner, "block", F.col("room")))
    inside = rows.join(small(edge.select("source", "block", "room")), ["source", "block"])
    # A range frame gives rows of one place the same sum, so they fall on one side of the cut.
    held = F.sum("tokens").over(Window.partitionBy("source").orderBy("order").rangeBetween(Window.unboundedPreceding, 0))
    cuts = inside.withColumn("held", held).where("held <= room").groupBy("source").agg(F.max("order").alias("last"))
    plan = told.join(edge.select("source", "block"), "source", "left").join(cuts, "source", "left")
    return plan.select("source", "passes", F.coalesce("block", F.lit(-1)).alias("cut_block"), F.coalesce("last", F.lit(-1)).alias("cut_order")), bits


def _edge(parts: DataFrame, key: str, rest: Column) -> DataFrame:
    """Of each source the first part that the rest of the budget can't hold whole, and the room that it finds.

    The rest is under the sum of a source's parts, so there is one.
    """
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    over = parts.withColumn("rest", rest).withColumn("upto", upto).where("upto > rest")
    first = over.groupBy("source").agg(F.min(F.struct(key, (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("edge"))
    return first.select("source", f"edge.{key}", "edge.room")
