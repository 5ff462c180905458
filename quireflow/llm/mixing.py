"""Mixing sources to target weights by a Pfair schedule of blocks.

Each source's texts, repeated as whole passes as far as needed and allowed, stand in one row in an order fixed by a
hash. The row is cut into blocks of `block_tokens`, a long text over as many as it needs; block k of a source with share
w is released at slot floor(k/w) and due at slot ceil((k+1)/w). Taking the released block that is due first, slot by slot,
keeps every source within one block of its share at every time. Shares are taken as the decimal fractions they are
written as, so that whole numbers of slots of a period meet them exactly; the schedule repeats after a period and is
worked out once, whatever the size of the corpus.

The size of the mixture is the largest one at which no source has to be used more often than allowed, so that the
shares are met; sources that have no texts have no share, and the others' are scaled up. Texts with no tokens, a null
source or a source without target take no part.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage, table
from .tokens import count_tokens

#: Texts of a source are summed up in so many parts before the running sum over them, so that no task holds a source.
PARTS = 512
#: A longer period than this is rounded: shares are then met to 1 in so many (or to 1 in as many as there are sources, if these are more).
LONGEST_PERIOD = 100_000


def whole_slots(shares: dict[str, float]) -> dict[str, int]:
    """Slots of a period (their sum) per source: exactly in proportion to the shares as written, unless that takes too long a period; then by largest remainders, at least one each, ties by name."""
    exact = {s: Fraction(str(w)) for s, w in shares.items()}
    scale = math.lcm(*[x.denominator for x in exact.values()]) if exact else 1
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values()) if whole else 1
    got = {s: n // common for s, n in whole.items()}
    period = max(LONGEST_PERIOD, 2 * len(got))
    if sum(got.values()) <= period:
        return got
    total = sum(exact.values())
    ideal = {s: x / total * period for s, x in exact.items()}
    got = {s: max(1, math.floor(x)) for s, x in ideal.items()}
    left = period - sum(got.values())
    for s in sorted(ideal, key=lambda s: (math.floor(ideal[s]) - ideal[s], s))[: max(0, left)]:
        got[s] += 1
    return got  # where many sources were raised to one slot, the period is longer by these


def pfair_period(slots: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, k, slot): the slot of the k-th block of each source within a period, by earliest deadline among the released."""
    waiting = sorted((k * period // n, s, k) for s, n in slots.items() for k in range(n))
    out: list[tuple[str, int, int]] = []
    ready: list[tuple[int, int, str, int]] = []
    i = 0
    for slot in range(period):
        while i < len(waiting) and waiting[i][0] <= slot:
            _, s, k = waiting[i]
            due = -(-(k + 1) * period // slots[s])
            # of two that are due together, the one whose next window overlaps more goes first
            after = (k + 1) * period // slots[s]
            heapq.heappush(ready, (due, after - due, s, k))
            i += 1
        _, _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
    return out


def mixture_plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, dict]:
    """Per source with texts and target: slots of a period, tokens wanted and taken. sizes: tokens of a source once."""
    shares = {s: w for s, (w, _) in targets.items() if sizes.get(s, 0) > 0 and w is not None and w > 0}
    if not shares:
        return {}
    slots = whole_slots(shares)
    period = sum(slots.values())
    most = {s: sizes[s] * max(1, targets[s][1] or 1) for s in shares}
    total = min(Fraction(most[s] * period, slots[s]) for s in shares) if total_tokens is None else Fraction(total_tokens)
    wanted = {s: math.floor(total * slots[s] / period) for s in shares}
    return {s: {"slots": slots[s], "wanted": wanted[s], "take": min(most[s], wanted[s])} for s in shares}


def mix_sources(texts: DataFrame, targets: DataFrame, block_tokens: int = 2000, total_tokens: int | None = None) -> DataFrame:
    """doc_id, source, use, slot, place, from_token, n_tokens, wanted: the mixture in order (slot, place).

    texts: doc_id, source, n_tokens, one row per text; targets: source, target_share, max_repeats. use counts a text's uses
    from 1. A row is a text's tokens from from_token on, n_tokens many, that stand in one block; a text longer than a block
    has several rows, and the last text of a source is cut where its share is full. wanted is what the source's share of
    the size comes to. total_tokens asks for another size than the largest that meets all shares; a source too small for
    its share then gives all it may, and its slots stay empty after.

    Only the sums per source that has a target (as many as targets has rows) and the schedule of one period come to the driver.
    """
    spark = texts.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    d = texts.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).join(wanted.select("source"), "source", "left_semi")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PARTS)).cast("int")
    d = d.select("doc_id", "source", "n_tokens", part.alias("part"))
    parts = d.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = cut_lineage(parts.withColumn("before", F.coalesce(F.sum("part_tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    sizes = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("part_tokens").alias("n")).collect()}
    plan = mixture_plan(sizes, {r["source"]: (r["w"], r["r"]) for r in wanted.collect()}, total_tokens)
    period = sum(p["slots"] for p in plan.values())
    schedule = pfair_period({s: p["slots"] for s, p in plan.items()}, period) if plan else []
    rules = spark.createDataFrame([(s, p["slots"], p["take"], p["wanted"], sizes[s]) for s, p in plan.items()], "source string, slots long, take long, wanted long, whole long")
    within = spark.createDataFrame(schedule, "source string, k long, at long")
    w = Window.partitionBy("source", "part").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    # the sums before each part meet the texts as these are partitioned by the window; rules and schedule are one period long
    d = d.join(parts.select("source", "part", "before"), ["source", "part"]).join(F.broadcast(rules), "source")
    first = F.col("before") + F.col("in_part")
    passes = F.ceil((F.col("take") - first) / F.col("whole")).cast("int")
    d = d.where(first < F.col("take")).withColumn("use", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
    d = d.withColumn("begin", first + (F.col("use") - 1) * F.col("whole")).withColumn("end", F.least(F.col("begin") + F.col("n_tokens"), F.col("take")))
    block = lambda c: F.floor(c / F.lit(block_tokens))
    d = d.withColumn("block", F.explode(F.sequence(block(F.col("begin")), block(F.col("end") - 1))))
    start, stop = F.greatest(F.col("begin"), F.col("block") * block_tokens), F.least(F.col("end"), (F.col("block") + 1) * block_tokens)
    d = d.withColumn("k", F.pmod("block", "slots")).withColumn("round", F.floor(F.col("block") / F.col("slots"))).join(F.broadcast(within), ["source", "k"])
    return d.select("doc_id", "source", "use", (F.col("round") * period + F.col("at")).alias("slot"), (start - F.col("block") * block_tokens).alias("place"), (start - F.col("begin")).alias("from_token"), (stop - start).alias("n_tokens"), "wanted")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(count_tokens(table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("source").isNotNull()), ["doc_id", "source"]))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_texts(spark, sf_dir), table(spark, sf_dir, "mix_targets")).drop("wanted")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: tokens taken, actual share, target share, tokens short of what its share comes to, most uses of a text, texts used."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed = mix_sources(_texts(spark, sf_dir), targets)
    sums = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("use").alias("most_uses"), F.count_distinct("doc_id").alias("texts"), F.max("wanted").alias("wanted"))
    sums = cut_lineage(sums)
    whole = sums.agg(F.sum("tokens").alias("all_tokens"))
    got = targets.select("source", "target_share", "max_repeats").join(sums, "source", "left").crossJoin(F.broadcast(whole))  # whole has one row
    n = lambda c: F.coalesce(c, F.lit(0))
    return got.select("source", "target_share", "max_repeats", n("tokens").alias("tokens"), (n("wanted") - n("tokens")).alias("short"), n("texts").alias("texts"), n("most_uses").alias("most_uses"), (n("tokens") / F.col("all_tokens")).alias("actual_share"))
