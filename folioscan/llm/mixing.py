"""Mixing sources to target sizes by entropy balancing.

Each document gets a rate, its expected number of copies. Among all rates up to
`most` that meet the sources' token targets, those of least relative entropy to
one copy each are exponentially tilted by size: rate = min(most, exp(lambda *
size / mean size)), with one lambda for each source. The dual is convex; Newton
iterations on a histogram of sizes, within a bracket that holds lambda, run until every
source's expected tokens are within a tolerance of its target. Rates are then rounded: a document takes floor(rate) copies and one more if a hash of it falls
under its fraction plus a shift, and the shift is set by two rounds of
histograms, and then one document flipped, so that each source's tokens meet its
target to within about a small document.

Sources are in code point order, null last, and weights repeat over them. Null
text has size 0 and is never taken; a document of an unknown (null) id is hashed
by its source and size alone. Repeated rows share their fate. A source whose
documents are all empty has target 0. Extra columns are kept by mix() and
ignored by taken_words(). An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, table, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: The dual is solved when each source's expected tokens are within this share of its target.
TOLERANCE = 1e-6
#: Values of lambda measured in a round for each source; rounds after which no solution is an error.
POINTS = 6
MOST_ROUNDS = 40
#: A table with a row a source is broadcast up to so many sources (about 5 MB); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000
BINS = 4096
SEED = 11


def size_of(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(r"[^\x20\x09-\x0D]++"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n): weighted shares, none above most * its size.

    What a source can't take is shared out again by weight. Filled sources leave in
    the order of most * size / weight: with sources in that order, source k is filled
    if it is below its share of what the earlier ones left. One window over the
    table of sources, which has a row for each: one task, a million sources in well under a minute.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))))
    per = per.withColumn("weight", weight).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    # running sums alone: a frame to the end would be summed anew for each row
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    rest = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / rest).withColumn("full", F.col("top") <= F.col("level") * F.col("weight"))
    # the level of the first source that isn't filled holds for all that follow
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("top") / F.col("weight"))).over(Window.partitionBy())
    return per.select("source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.least(F.col("top"), level * F.col("weight"))).alias("target"))


def _small(per_source: DataFrame) -> DataFrame:
    """per_source (a checkpointed table with a row a source), to be broadcast if its counted rows allow it."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _rate(lam: Column, tilt: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), lam * tilt)))


def solve(sizes: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, target, mean, lam) by Newton iterations on the histogram (source, size, n).

    With r = target / size of the source, |lam| is between |log r| over the largest and over
    the least tilt. A round measures the expected words and their slope at a few lam of
    each source, in one pass for all: the Newton step (on the logarithm of the words)
    from the best lam so far, and points at equal ratios within the bracket, so that the
    bracket closes even where a step fails. Rounds end when every source meets its target
    to within TOLERANCE of it; it is an error if one doesn't in MOST_ROUNDS.
    """
    key = F.col("source").eqNullSafe
    # decimals: a sum of doubles depends on the order in which rows come
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    shape = sizes.filter("size > 0").groupBy("source").agg(F.sum("n").alias("docs"), F.min("size").alias("least"), F.max("size").alias("largest"), exact(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"))
    mean = F.col("source_size") / F.col("docs")
    wanted = F.log(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    start = targets.join(shape.withColumnRenamed("source", "s"), key(F.col("s")), "left").select(
        "source", "source_size", "target", mean.alias("mean"), F.signum(wanted).alias("sign"),
        (F.abs(wanted) * mean / F.col("largest")).alias("low"), (F.abs(wanted) * mean / F.col("least")).alias("high"),
        # the Newton step from lam = 0
        (F.abs(wanted) * mean * F.col("source_size") / F.col("squares")).alias("step"),
    )
    # nothing is taken for a target of 0, and all at the upper rate for one of `most` times the size
    given = F.when(F.coalesce(F.col("target"), F.lit(0.0)) <= 0, F.lit(float("-inf"))).when(F.col("low") == 0, F.lit(0.0)).when(F.col("target") >= most * F.col("source_size"), F.lit(math.log(most)) * F.col("high") / F.abs(wanted))

    def points(step: Column) -> Column:
        """lam of the next round: the step, if it is within the bracket, and POINTS - 1 others."""
        low, high = F.col("low"), F.col("high")
        inside = F.when((step >= low) & (step <= high), step).otherwise(F.sqrt(low) * F.sqrt(high))
        return F.array(*[F.col("sign") * m for m in (inside, *(low * F.pow(high / F.nullif(low, F.lit(0.0)), F.lit(k / (POINTS - 2))) for k in range(POINTS - 1)))])

    state = start.withColumn("lam", given).withColumn("miss", F.when(F.col("lam").isNotNull(), F.lit(0.0)))
    state = durable(state.withColumn("points", points(F.col("step"))).drop("step"))
    counts = sizes.filter("size > 0").select(F.col("source").alias("s"), "size", "n")
    open_ = ~F.coalesce(F.col("miss") <= TOLERANCE * F.col("target"), F.col("lam").isNotNull())
    for _ in range(MOST_ROUNDS):
        unsolved = state.filter(open_).select(F.col("source").alias("p"), F.col("mean").alias("p_mean"), "points")
        n = unsolved.count()
        if not n:
            return state.select("source", "source_size", "target", "mean", "lam")
        tilt = F.col("size") / F.col("p_mean")
        joined = counts.join(F.broadcast(unsolved) if n <= BROADCAST_SOURCES else unsolved, F.col("s").eqNullSafe(F.col("p")))
        rates = joined.select("p", *[(F.col("size") * F.col("n") * _rate(F.col("points")[k], tilt, most)).alias(f"w{k}") for k in range(POINTS)], *[(F.col("points")[k] * tilt < math.log(most)).alias(f"free{k}") for k in range(POINTS)], tilt.alias("tilt"))
        sums = rates.groupBy("p").agg(F.array(*[exact(F.col(f"w{k}")) for k in range(POINTS)]).alias("got"), F.array(*[exact(F.when(F.col(f"free{k}"), F.col(f"w{k}") * F.col("tilt")).otherwise(0.0)) for k in range(POINTS)]).alias("slope"))
        every = state.join(sums, key(F.col("p")), "left").withColumn("tried", F.arrays_zip("points", "got", "slope"))
        # the rate of every document falls with |lam| if lam is negative
        past = lambda x: F.col("sign") * (x["got"] - F.col("target")) > 0
        best = F.array_min(F.transform("tried", lambda x: F.struct(F.abs(x["got"] - F.col("target")).alias("miss"), x["points"].alias("lam"), x["got"].alias("got"), x["slope"].alias("slope"))))
        low = F.array_max(F.transform(F.filter("tried", lambda x: ~past(x)), lambda x: F.abs(x["points"])))
        high = F.array_min(F.transform(F.filter("tried", past), lambda x: F.abs(x["points"])))
        kept = lambda new, old: F.coalesce(new, F.col(old)).alias(old)
        measured = every.withColumn("best", F.when(F.col("got").isNotNull(), best))
        state = measured.select("source", "source_size", "target", "mean", "sign", kept(low, "low"), kept(high, "high"), kept(F.col("best.lam"), "lam"), kept(F.col("best.miss"), "miss"), "best")
        step = F.col("sign") * (F.col("best.lam") - F.log(F.col("best.got") / F.nullif(F.col("target"), F.lit(0.0))) * F.col("best.got") / F.nullif(F.col("best.slope"), F.lit(0.0)))
        state = durable(state.withColumn("points", points(step)).drop("best"))
    raise ArithmeticError(f"targets aren't met to within {TOLERANCE} in {MOST_ROUNDS} rounds: {state.filter(open_).limit(5).collect()}")


def _plan(most: float) -> tuple[Column, Column]:
    """(whole, gap) of a row with doc_id, source, size, mean, lam: copies for sure, and hash less fraction."""
    rate = F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size") / F.col("mean"), most)).otherwise(F.lit(0.0))
    whole = F.least(F.floor(rate), F.lit(int(most))).cast("long")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "source", "size", F.lit(SEED)), 11) / F.lit(float(2**53))
    return whole, F.when((whole < most) & (F.col("size") > 0), u - (rate - whole))


def _rounded(docs: DataFrame, solved: DataFrame, most: float) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target, whole and gap."""
    whole, gap = _plan(most)
    s = solved.withColumnRenamed("source", "s")
    return docs.join(s, F.col("source").eqNullSafe(F.col("s"))).select(*docs.columns, "source_size", "target", whole.alias("whole"), gap.alias("gap"))


def _shifts(rounded: DataFrame, bins: int = BINS) -> DataFrame:
    """(s, cut): documents of source s with a gap under cut take one more copy.

    Two rounds of histograms of the gap: the first finds the bin where the tokens
    reach the target, the second a bin within it.
    """
    low, width = F.lit(-1.0), F.lit(2.0 / bins)
    wide = F.floor((F.col("gap") - low) / width)
    # one pass for the sure tokens (bin null) and the first histogram
    first = durable(rounded.groupBy("source", wide.alias("bin")).agg(F.sum(F.col("size") * F.col("whole")).alias("sure"), F.sum(F.when(F.col("gap").isNotNull(), F.col("size")).otherwise(0)).alias("extra"), F.first("target").alias("target")))
    all_sure = first.groupBy("source").agg(F.sum("sure").alias("sure"), F.first("target").alias("target"))

    def crossing(hist: DataFrame, need: DataFrame) -> DataFrame:
        """(source, bin, need): the bin in which the running sum passes the need, and what is needed within it."""
        w = Window.partitionBy("source").orderBy("bin")
        h = hist.select(F.col("source").alias("hs"), "bin", "extra").join(need, F.col("hs").eqNullSafe(F.col("source"))).drop("hs")
        run = h.withColumn("upto", F.sum("extra").over(w))
        hit = run.filter(F.col("upto") > F.col("need"))
        return hit.groupBy("source").agg(F.min_by(F.struct("bin", (F.col("need") - F.col("upto") + F.col("extra")).alias("need")), "bin").alias("x")).select("source", "x.bin", "x.need")

    need = all_sure.select("source", (F.col("target") - F.col("sure")).alias("need"))
    found = durable(crossing(first.filter("bin is not null"), need))
    narrow = width / bins
    inside = rounded.join(_small(found).select(F.col("source").alias("s"), F.col("bin").alias("at")), F.col("source").eqNullSafe(F.col("s"))).filter(wide == F.col("at"))
    fine = inside.groupBy("source", F.floor((F.col("gap") - low - F.col("at") * width) / narrow).alias("bin")).agg(F.sum("size").alias("extra"))
    second = crossing(fine, found.select("source", "need")).select(F.col("source").alias("s"), F.col("bin").alias("fine_bin"), F.col("need").alias("left_over"))
    half = fine.select(F.col("source").alias("fs"), F.col("bin").alias("fbin"), "extra")
    second = second.join(half, F.col("s").eqNullSafe(F.col("fs")) & (F.col("fine_bin") == F.col("fbin")))
    # the crossing bin is taken if that ends nearer to the target
    up = F.when(2 * F.col("left_over") >= F.col("extra"), F.lit(1)).otherwise(F.lit(0))
    cut = low + F.col("bin") * width + (F.col("fine_bin") + up) * narrow
    both = found.select("source", "bin").join(second, F.col("source").eqNullSafe(F.col("s")))
    passed = both.select("source", cut.alias("cut"))
    # where even all extra copies stay below the need, all are taken
    return all_sure.select(F.col("source").alias("t")).join(passed, F.col("t").eqNullSafe(F.col("source")), "left").select(F.col("t").alias("s"), F.coalesce("cut", F.lit(2.0)).alias("cut"))


def _flips(rounded: DataFrame, cuts: DataFrame) -> DataFrame:
    """(f, flip_gap, flip_size): for each source, the document whose other rounding ends nearest to the target.

    Only where it ends nearer than before; of documents that end equally near, the one of
    least gap, then size. Rows that repeat are flipped, and counted, together.
    """
    held = rounded.join(cuts, F.col("source").eqNullSafe(F.col("s"))).filter("gap is not null or whole > 0")
    extra = F.col("gap") < F.col("cut")
    delta = F.when(F.col("gap").isNotNull(), F.when(extra, -F.col("size")).otherwise(F.col("size")))
    held = held.select("source", "size", "gap", "target", delta.alias("delta"), (F.col("size") * (F.col("whole") + F.when(extra, 1).otherwise(0))).alias("taken"))
    miss = held.groupBy("source").agg((F.first("target") - F.sum("taken")).alias("miss")).withColumnRenamed("source", "m")
    aimed = held.filter("delta is not null").join(_small(durable(miss)), F.col("source").eqNullSafe(F.col("m")))
    best = durable(aimed.groupBy("source", "miss").agg(F.min(F.struct(F.abs(F.col("miss") - F.col("delta")).alias("left"), "gap", "size", "delta")).alias("b")).select(F.col("source").alias("f"), "miss", "b.*"))
    b = best.select("f", "miss", F.col("gap").alias("flip_gap"), F.col("size").alias("flip_size"), F.col("delta").alias("flip_delta"))
    same = F.col("source").eqNullSafe(F.col("f")) & (F.col("gap") == F.col("flip_gap")) & (F.col("size") == F.col("flip_size"))
    counted = held.join(_small(b), same).groupBy("f", "miss", "flip_gap", "flip_size", "flip_delta").agg(F.count("*").alias("n"))
    return counted.filter(F.abs(F.col("miss") - F.col("n") * F.col("flip_delta")) < F.abs("miss")).select("f", "flip_gap", "flip_size")


def balance(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and copies.

    ids, sources and sizes go to the checkpoint folder; all iterations are over a
    histogram of (source, size). Other columns of sized, as texts, are read once more
    at the end, and joined to the table of sources alone.
    """
    narrow = durable(sized.select("doc_id", "source", "size"))
    counts = durable(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = solve(counts, source_targets(counts, weights, share, most), most)
    rounded = _rounded(narrow, _small(solved), most)
    cuts = _small(durable(_shifts(rounded)))
    flips = _flips(rounded, cuts)
    final = solved.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    final = _small(durable(final.join(flips, F.col("s").eqNullSafe(F.col("f")), "left").drop("f")))
    rows = narrow if set(sized.columns) == set(narrow.columns) else sized
    whole, gap = _plan(most)
    flipped = (gap == F.col("flip_gap")) & (F.col("size") == F.col("flip_size"))
    more = F.coalesce(gap < F.col("cut"), F.lit(False)) != F.coalesce(flipped, F.lit(False))
    copies = whole + F.when(more, 1).otherwise(0)
    return rows.join(final, F.col("source").eqNullSafe(F.col("s"))).select(*rows.columns, "source_size", "target", copies.alias("copies"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_or_empty(text_col)).alias("size"), *more)


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row. The text is read once."""
    return balance(_sized(docs, id_col, text_col, source_col), **how).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs with all columns, each as often as the mix takes it. No text is shuffled."""
    taken = balance(_sized(docs, id_col, text_col, source_col, F.struct("*").alias("_row")), **how).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("_row.*")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = taken_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
