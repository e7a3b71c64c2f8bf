"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent. The exponent is bisected until the
normalised weights meet a target entropy or a limit of repetition. The weights are realised as
a token budget: every source is read in a permutation of its documents, as often as its budget
says, and the sources' permutations are dealt into blocks that each hold the whole mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_broadcast, once

SPACE = r"[\x20\x09-\x0D]+"
#: Exponents tried in one pass over the sources; each pass divides the interval by one more.
TRIALS = 15
#: Bits of a permutation's place decided in one pass over the documents.
STEP_BITS, STEPS = 12, 4
PLACES = 1 << (STEP_BITS * STEPS)
BLOCK_TOKENS = 1 << 20


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def identity(doc_id: Column, text: Column) -> Column:
    """What a document's place is drawn from: its id or, lacking one, its text."""
    return F.coalesce(doc_id.cast("string"), text)


def place_of(doc_id: Column, seed: int) -> Column:
    """A document's place in the permutation of its source, from 0 to PLACES - 1."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 64 - STEP_BITS * STEPS)


def source_shares(counted: DataFrame) -> DataFrame:
    """source, tokens, share of every source that has tokens."""
    by_source = cut(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 1
    return by_source.withColumn("share", F.col("tokens") / F.lit(float(total)))


def bisect_exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, tolerance: float = 1e-9) -> float:
    """The least exponent from 0 to 1 that keeps within every given target.

    With exponent 1 sources keep their shares; with 0 all weigh the same. ``target_entropy`` (nats)
    is the greatest entropy of the weights; ``max_repeats`` the greatest ratio between how
    often the most and the least repeated source is read. Both fall as the exponent rises, so a
    pass over the sources rates TRIALS exponents at once and keeps the interval where the targets
    begin to hold. Only those TRIALS rows reach the driver.
    """
    low, high = 0.0, 1.0

    def met(tried: list[float]) -> list[bool]:
        each = shares.select("share", F.explode(F.array(*map(F.lit, tried))).alias("a"))
        rated = each.withColumn("p", F.pow("share", "a")).groupBy("a").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(F.col("p") / F.col("share")).alias("most"), F.min(F.col("p") / F.col("share")).alias("least")
        )
        entropy = F.log("z") - F.col("plogp") / F.col("z")
        fits = F.lit(True)
        if target_entropy is not None:
            fits = fits & (entropy <= target_entropy + 1e-12)
        if max_repeats is not None:
            fits = fits & (F.col("most") <= F.col("least") * (max_repeats + 1e-12))
        found = {r["a"]: r["fits"] for r in rated.select("a", fits.alias("fits")).collect()}
        return [found.get(a, True) for a in tried]

    if met([0.0])[0]:
        return 0.0
    while high - low > tolerance:
        tried = [low + (high - low) * (k + 1) / (TRIALS + 1) for k in range(TRIALS)]
        ok = met(tried)
        first = ok.index(True) if True in ok else TRIALS
        low, high = ([low, *tried][first], [*tried, high][first])
    return high


def weights(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> tuple[DataFrame, float]:
    """Adds weight, wanted (tokens), full (whole readings) and rest (tokens of the last, partial one); returns them with the exponent.

    Without a ``budget`` it is the least that reads every document once.
    """
    a = bisect_exponent(shares, target_entropy, max_repeats)
    powered = shares.withColumn("p", F.pow("share", F.lit(a)))
    z, least = powered.agg(F.sum("p"), F.max(F.col("tokens") / F.col("p"))).first()
    z, least = z or 1.0, least or 0.0
    total = float(budget) if budget is not None else least * z
    out = powered.withColumn("weight", F.col("p") / F.lit(z)).withColumn("wanted", F.round(F.col("weight") * F.lit(total)).cast("long"))
    out = out.withColumn("full", F.expr("wanted div tokens"))
    return cut(out.select("source", "tokens", "share", "weight", "wanted", "full", (F.col("wanted") - F.col("full") * F.col("tokens")).alias("rest"))), a


def thresholds(counted: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source with a partial reading, the first place of its permutation that is left out.

    The greatest such place whose documents before it hold at most ``rest`` tokens, found by
    radix: each pass sums tokens by the next STEP_BITS of the place, within the bucket where
    the budget ran out before. So no window sees more than 2 ** STEP_BITS rows of a source.
    """
    open_ = plan.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("start"))
    for step in range(STEPS):
        width = PLACES >> (STEP_BITS * (step + 1))
        near = counted.join(maybe_broadcast(open_, open_.count()), counted["source"].eqNullSafe(open_["source"])).select(counted["source"], "place", "tokens", "rest", "start")
        near = near.where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + width * (1 << STEP_BITS)))
        sums = near.groupBy("source", "rest", "start", F.expr(f"(place - start) div {width}").alias("bucket")).agg(F.sum("tokens").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        # The first bucket that runs over; a partial reading is less than a whole one, so there is one.
        over = run.where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", F.col("start"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("x"))
        open_ = cut(over.select("source", F.col("x.left").alias("rest"), (F.col("x.start") + F.col("x.bucket") * width).alias("start")))
    return open_.select("source", F.col("start").alias("until"))


def mixture_plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 11) -> DataFrame:
    """source, tokens, share, weight, wanted, full, until: a row for each source with tokens."""
    counted = cut(docs.select("source", token_count(F.col("text")).alias("tokens"), place_of(identity(F.col("doc_id"), F.col("text")), seed).alias("place")))
    plan, _ = weights(source_shares(counted), target_entropy, max_repeats, budget)
    until = thresholds(counted, plan).withColumnRenamed("source", "own")
    return cut(plan.join(until, plan["source"].eqNullSafe(until["own"]), "left").drop("own", "rest"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 11, block_tokens: int = BLOCK_TOKENS, carry: tuple[str, ...] = ("doc_id", "source"), bare: bool = False) -> DataFrame:
    """The mixture: a row for each reading of each document, with columns ``carry`` and, unless ``bare``, n_tokens, weight, epoch, block and turn.

    A source is read ``full`` times, and once more up to the place in its permutation where its
    budget ends. A reading's block follows from the place it has in its source's own
    sequence, so every block holds each source by its weight, in an order that differs from
    epoch to epoch. ``turn`` orders the readings of a block: sorted by it, a block is a
    permutation that mixes its sources. Null sources form a source of their own. A source without any token has no
    weight; its documents are read once, so nothing empty is lost. Repeated rows, and rows of
    equal doc_id or, lacking one, equal text, share a place and are read alike; the budget is kept to within the
    documents of one place. An empty table gives no rows. Texts are not shuffled: only the
    plan, of a row for each source, meets the documents, broadcast if it is small.
    """
    plan = mixture_plan(docs, target_entropy, max_repeats, budget, seed)
    n, wanted = plan.agg(F.count("*"), F.sum("wanted")).first()
    blocks = max(1, -(-(wanted or 0) // block_tokens))
    p = maybe_broadcast(plan.select(F.col("source").alias("own"), F.col("tokens").alias("of"), "weight", "wanted", "full", "until"), n)
    own = [F.col("d")[c].alias(c) for c in carry]
    read = once(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d")), n_tokens=token_count(F.col("d.text")), place=place_of(identity(F.col("d.doc_id"), F.col("d.text")), seed))
    met = read.join(p, F.col("d.source").eqNullSafe(p["own"]), "left")
    epochs = F.when(F.col("of").isNull(), F.lit(1)).otherwise(F.col("full") + F.coalesce(F.col("place") < F.col("until"), F.lit(False)).cast("long"))
    readings = F.when(epochs > 0, F.sequence(F.lit(1).cast("long"), epochs)).otherwise(F.array().cast("array<bigint>"))
    every = met.withColumn("epoch", F.explode(readings))
    if bare:
        return every.select(*own)
    # Where in its source's sequence a reading stands: whole readings go by a place of their own, the last by the common one.
    turned = F.when(F.col("epoch") > F.col("full"), F.col("place")).otherwise(F.shiftrightunsigned(F.xxhash64("place", "epoch"), 64 - STEP_BITS * STEPS))
    at = (F.col("epoch") - 1 + turned / F.lit(float(PLACES))) * F.col("of") / F.col("wanted")
    turn = F.xxhash64("place", "epoch", F.lit(seed))
    block = F.least(F.floor(F.coalesce(at, turned / F.lit(float(PLACES))) * blocks), F.lit(blocks - 1))
    return every.select(*own, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("epoch").cast("int").alias("epoch"), block.cast("long").alias("block"), turn.alias("turn"))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 1.5, budget: int | None = None, seed: int = 11) -> DataFrame:
    """The mixture with the columns of the documents alone."""
    return mix(docs, target_entropy, max_repeats, budget, seed, carry=tuple(docs.columns), bare=True)
