"""Mixing sources to target weights, in DataFrame functions alone: tempered shares, a bisected exponent, permuted blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import table, unused

BINS = 256  # of a factor of two in a source's size; a histogram has at most 64 * BINS bins, whatever the number of sources
STEPS = 50
CHUNK = 1000  # blocks whose tokens are summed together first


def tokens(text: Column) -> Column:
    """Words: runs without white space. Null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def source_weights(sized: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """source, n_docs, n_tokens, exponent, weight, repeats from rows of (source, n_tokens).

    weight is n_tokens^a over its sum. The exponent a in [0, 1] is bisected: to the smallest at which no source is
    repeated more than `max_repeats` times while the least repeated one is seen once, or, if `entropy` is given, to that
    fraction of the entropy of equal weights. The search runs over a histogram of source sizes, bounded in size; the
    weights are normalised over all sources. Null is a source of its own; sources without a token have weight 0.
    """
    size = F.col("n_tokens").cast("double")
    sources = table(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "sources")
    with_tokens = sources.where("n_tokens > 0")
    bins = with_tokens.groupBy(F.floor(F.log2(size) * BINS).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"), F.avg(size).alias("t"), F.min(size).alias("least"), F.max(size).alias("most"))
    one = bins.agg(F.collect_list(F.struct("c", "t")).alias("bins"), F.min("least").alias("least"), F.max("most").alias("most"))

    def total(f) -> Column:  # noqa: ANN001
        return F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + f(b))

    def share_entropy(a: Column) -> Column:
        z = total(lambda b: b["c"] * F.pow(b["t"] / F.col("most"), a))
        return total(lambda b: b["c"] * F.pow(b["t"] / F.col("most"), a) / z * (F.log(z) - a * F.log(b["t"] / F.col("most"))))

    if entropy is not None:  # falls as the exponent grows
        goal = F.lit(entropy) * F.log(total(lambda b: b["c"]))
        fits = lambda a: share_entropy(a) <= goal
    else:  # the smallest source is repeated (most / least)^(1 - a) times as often as the largest
        fits = lambda a: F.pow(F.col("most") / F.col("least"), 1 - a) <= F.lit(float(max_repeats or 1.0))
    state = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, s["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    found = F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, halve)["hi"])
    exponent = one.select(found.alias("exponent"), F.col("most"))  # one row
    tempered = sources.crossJoin(F.broadcast(exponent)).withColumn("w", F.when(F.col("n_tokens") > 0, F.pow(size / F.col("most"), F.col("exponent"))).otherwise(0.0))
    sums = tempered.agg(F.sum("w").alias("z"), F.min(F.when(F.col("n_tokens") > 0, F.col("w") / size)).alias("rarest"))  # one row
    out = tempered.crossJoin(F.broadcast(sums))
    return out.select("source", "n_docs", "n_tokens", "exponent", (F.col("w") / F.col("z")).alias("weight"), F.when(F.col("n_tokens") > 0, F.col("w") / size / F.col("rarest")).otherwise(1.0).alias("repeats"))


def _draw(seed: int, epoch: Column, key: Column) -> Column:
    """60 bits that put the rows of an epoch in its order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, key)), 1, 15), 16, 10).cast("bigint")


def _last(rows: DataFrame, unit: str) -> DataFrame:
    """Of each source's units, in order, the one in which its quota `left` is met, and what is left of the quota there."""
    sums = rows.groupBy("source", unit).agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("left", F.col("left") - before).where("left > 0 and left <= n").select(F.col("source").alias("s"), F.col(unit).alias("u"), F.col("left").alias("l"))


def _plan(slim: DataFrame, weights: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """For each source: whole epochs, blocks, and where its partial epoch ends (block and draw), null if it has none.

    Sums by chunks of blocks find the chunk at which the quota is met, sums by blocks the block in it, and the rows of
    that one block the last row: no window holds more than CHUNK blocks or the chunks of one source."""
    blocks = F.greatest(F.ceil(F.col("all") / block_tokens), F.lit(1)).cast("bigint")
    plan = table(weights.withColumn("whole", F.floor("times")).withColumn("blocks", blocks).withColumn("left", (F.col("times") - F.col("whole")) * F.col("all")).select(F.col("source").alias("s"), "whole", "blocks", "left"), "plan")
    rows = slim.join(plan.where("left > 0"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("draw", _draw(seed, F.col("whole") + 1, F.col("key"))).withColumn("block", F.pmod("draw", "blocks")).withColumn("chunk", F.floor(F.col("block") / CHUNK))

    def of(rows: DataFrame, edge: DataFrame, unit: str) -> DataFrame:
        edge = table(edge, unit)
        return rows.drop("left").join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("u"))).drop("s", "u").withColumnRenamed("l", "left")

    rows = of(rows, _last(rows, "chunk"), "chunk")
    rows = of(rows, _last(rows, "block"), "block")
    ends = _last(rows.withColumn("at", F.struct("block", "draw")), "at").select(F.col("s").alias("e"), F.col("u.block").alias("end_block"), F.col("u.draw").alias("end_draw"))
    return table(plan.join(ends, F.col("s").eqNullSafe(F.col("e")), "left").select("s", "whole", "blocks", "end_block", "end_draw"), "mixture")


def mix(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = 200_000, seed: int = 17, keep: list[str] | None = None, slots: bool = True) -> DataFrame:
    """Documents as often as the mixture asks for: `keep` columns with n_tokens, epoch, block and slot (without `slots`: alone).

    Budget in tokens; by default just what shows every document at least once, so nothing is lost. Each epoch of a source
    is a permutation by hash, dealt into blocks of about `block_tokens`; a last, partial epoch takes whole blocks in
    their order and from the block at the edge the first documents up to the quota, so it goes over it by less than one
    document. A remainder of less than half a token is none. Blocks bound every window but a source's sums by chunk: a
    source with a third of all rows is as many blocks as it needs. A row's repeats are made side by side.

    Ties and repeated rows: rows alike in doc_id, source and text have one place in the order and are shown together. Null
    source: a source of its own. Null or empty texts have no tokens and are shown once. Very long texts: whole, in a block
    of about their size. Empty tables give empty results. Columns of the table stay as they are; a new one whose name is
    taken has underscores behind it.
    """
    kept = keep or docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    key = F.md5(F.concat_ws(":", "doc_id", "source", F.md5(F.col("text").cast("binary"))))
    sized = docs.select(row, F.col("source"), tokens(F.col("text")).alias("n"), key.alias("key"))
    slim = table(sized.select("source", "n", "key"), "sized")
    weights = source_weights(slim.select("source", F.col("n").alias("n_tokens")), max_repeats, entropy)
    times = F.col("repeats") if budget is None else F.when(F.col("n_tokens") > 0, F.lit(float(budget)) * F.col("weight") / F.col("n_tokens")).otherwise(1.0)
    near = F.abs(times - F.round(times)) * F.col("n_tokens") < 0.5
    weights = weights.select("source", F.col("n_tokens").alias("all"), F.when(near, F.round(times)).otherwise(times).alias("times"))
    plan = _plan(slim, weights, block_tokens, seed)
    placed = lambda epoch: F.pmod(_draw(seed, epoch, F.col("key")), F.col("blocks"))
    last = F.col("whole") + 1
    more = (placed(last) < F.col("end_block")) | ((placed(last) == F.col("end_block")) & (_draw(seed, last, F.col("key")) <= F.col("end_draw")))
    epochs = F.col("whole") + F.when(more, 1).otherwise(0)
    shown = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("epochs", epochs).where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    if not slots:
        return shown.select("row.*")
    in_block = Window.partitionBy("source", "epoch", "block").orderBy("draw", "key")
    shown = shown.withColumn("draw", _draw(seed, F.col("epoch"), F.col("key"))).withColumn("block", F.pmod("draw", "blocks"))
    shown = shown.withColumn("slot", F.row_number().over(in_block).cast("bigint"))
    names = {c: unused(docs.select(*(f"`{k}`" for k in kept)), c) for c in ("n_tokens", "epoch", "block", "slot")}
    return shown.select("row.*", *(F.col("n" if c == "n_tokens" else c).alias(as_) for c, as_ in names.items()))


def mixture_table(docs: DataFrame) -> DataFrame:
    """The digest of op10: a row for each time that a document is shown."""
    return mix(docs, keep=["doc_id", "source"])
