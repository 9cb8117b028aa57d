"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; a target stops at
``max_copies`` times its source's size, and the excess is shared again by weight (water filling).

Rates: per source, minimise the entropy distance  sum w_i (r_i log r_i - r_i)  of the documents'
rates from 1 under the token constraint  sum size_i r_i = target  and r_i <= max_copies, with
w_i = sqrt(size_i * mean size).  The solution is the exponential tilt
r_i = min(max_copies, exp(lambda * sqrt(size_i / mean))); the one multiplier of each source comes
from Newton steps on the convex dual, kept inside a bracket.  All sources step together: an
iteration is one aggregation of the (source, size) histogram, and only one number comes back to the driver.

Copies: floor(rate) or one more.  Documents of over 1/128 of their source (there are fewer than 128
of them) are rounded from the largest down, each making up for what those before it took too much
or too little; the others take their extra copy in
the order of hash / fraction until the source's target is met.  That order is cut by a histogram of
its keys; only the bin at the cut is ever sorted, so no task holds a source's documents.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of its own; rows
that repeat an id are rounded each by id, size, text digest and a number among equal rows, so of many equal rows as many are
taken as the target needs; ties are cut by id, digest and number; an empty table gives an empty result; other columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, key_or

#: Rounds a source's largest documents in turn and carries the words they fall short.
DIFFUSE = """
aggregate(few, named_struct('owed', 0D, 'done', cast(array() as array<struct<id: bigint, digest: bigint, number: bigint, copies: bigint>>)),
  (acc, d) -> named_struct(
    'owed', acc.owed + (d.rate - greatest(floor(d.rate), least(ceil(d.rate), cast(round(d.rate - acc.owed / d.minus) as bigint)))) * -d.minus,
    'done', array_append(acc.done, named_struct('id', d.id, 'digest', d.digest, 'number', d.number,
      'copies', greatest(floor(d.rate), least(ceil(d.rate), cast(round(d.rate - acc.owed / d.minus) as bigint)))))),
  acc -> acc.done)
"""
#: Tables with a row per source that go to all tasks: at most so many rows, some 10 MB.
BROADCAST_ROWS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _if_small(df: DataFrame) -> DataFrame:
    """df, a table with a row per source, to go to all tasks if its rows are counted to be few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Ranks come from a range partitioning and the partitions' counts, the fill level from sums over all sources, repeated until
    no more source is full: no task holds all sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    s = cut(s.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    by_part = s.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))  # a row per partition
    s = s.join(F.broadcast(before), part == F.col("p"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("before") + place) % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_copies)) * F.col("source_size")).alias("cap"))
    s, level, full_before = cut(s, "sources"), 0.0, -1
    while True:
        # sources that can't take their share of the level are full; what they leave is shared by the others
        full = F.col("cap") < level * F.col("weight")
        everything, capped, weighing, n_full = s.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n_full == full_before or not weighing:
            break
        level, full_before = ((everything or 0) - (capped or 0.0)) / weighing, n_full
    return s.select("source", "source_size", F.least("cap", F.lit(float(level)) * F.col("weight")).alias("target"))


def _rate(lam: Column, x: Column, most: int) -> Column:
    return F.least(F.exp(F.least(lam * x, F.lit(50.0))), F.lit(float(most)))


def multipliers(hist: DataFrame, goal: DataFrame, max_copies: int = 3, tol: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """(key, mean, lam) per source from the histogram (key, size, n) and (key, target)."""
    words = F.sum(F.col("size") * F.col("n"))
    mean = hist.groupBy("key").agg((words / F.sum("n")).alias("mean"), words.alias("words"))
    at = goal.select("key", "target").join(mean, "key")
    at = at.select("key", "mean", "target", F.log(F.col("target") / F.col("words")).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(1.0).alias("off"))
    at = cut(at, "step")
    for _ in range(most_steps):
        h = hist.join(at, "key")
        x = F.sqrt(F.col("size") / F.col("mean"))
        r = _rate(F.col("lam"), x, max_copies)
        words = F.col("size") * F.col("n")
        g = h.groupBy("key").agg(
            F.first("mean").alias("mean"), F.first("target").alias("target"), F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
            F.sum(words * r).alias("got"), F.sum(F.when(r < max_copies, words * r * x).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        g = g.withColumn("lo", F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        inside = newton.between(F.col("lo"), F.col("hi")) & (newton != F.col("lam"))
        done = F.abs(gap) <= tol * F.col("target")
        step = F.when(done, F.col("lam")).when(inside, newton).otherwise(F.when(F.abs(F.col("lo") - F.col("hi")) > 1e3, F.col("lam") - F.signum(gap) * 2).otherwise((F.col("lo") + F.col("hi")) / 2))
        at = g.select("key", "mean", "target", step.alias("lam"), "lo", "hi", (F.abs(gap) / F.col("target")).alias("off"))
        at = cut(at, "step")
        if (at.agg(F.max("off")).first()[0] or 0.0) <= tol:
            break
    return at.select("key", "mean", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, bins: int = 4096) -> DataFrame:
    """(id, digest, size, source, source_size, target, rate, copies) per row of docs; see the module."""
    digest = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(1))
    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"), digest.alias("digest"))
    # rows that repeat are numbered by counting them, in blocks, so that each has a chance of its own
    d = d.groupBy("id", "source", "size", "digest").agg(F.count("*").alias("rows"))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / 4096))))
    d = d.withColumn("number", F.explode(F.sequence(F.col("block") * 4096, F.least(F.col("block") * 4096 + 4095, F.col("rows") - 1))))
    d = cut(d.drop("rows", "block"), "sizes")
    goal = targets(d.groupBy("source", "size").agg(F.count("*").alias("n")).select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_copies)
    # sources by a non-null text key
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    goal = cut(goal.withColumn("key", key), "targets")
    hist = d.where("size > 0").groupBy(key.alias("key"), "size").agg(F.count("*").alias("n"))
    hist = cut(hist, "histogram")
    lam = cut(multipliers(hist, goal.where("target > 0"), max_copies), "multipliers")
    per_source = goal.join(lam, "key", "left").select("key", "source_size", "target", "mean", "lam")
    x = d.withColumn("key", key).join(_if_small(per_source), "key", "left")
    rate = F.when(F.col("size") > 0, _rate(F.col("lam"), F.sqrt(F.col("size") / F.col("mean")), max_copies)).otherwise(0.0)
    unit = (F.pmod(F.xxhash64(F.lit("copies"), key_or(F.col("id")), "digest", "number"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    x = x.withColumn("rate", rate).withColumn("unit", unit).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    large = F.col("size") * 128 > F.col("source_size")
    few = x.where(large).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "unit", "id", "digest", "number", "rate"))).alias("few"))
    step = few.select(F.col("key").alias("k"), F.explode(F.expr(DIFFUSE)).alias("r")).select("k", F.col("r.id").alias("i"), F.col("r.digest").alias("g"), F.col("r.number").alias("m"), F.col("r.copies").alias("rounded"))
    same = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")) & (F.col("number") == F.col("m"))
    x = x.join(step, same, "left").drop("k", "i", "g", "m")
    x = x.withColumn("copies", F.coalesce("rounded", "whole"))
    x = x.withColumn("order", F.when(~large & (F.col("part") > 0), F.col("unit") / F.col("part")))
    x = x.withColumn("bin", F.least(F.floor(F.log2(F.col("order") + 1) * bins), F.lit(60 * bins)).cast("int"))
    x = cut(x.select("id", "digest", "number", "size", "source", "key", "source_size", "target", "rate", "copies", "order", "bin"), "rates")
    # words still to take in each source, and the bin in which they run out
    rest = x.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    by_bin = x.where("bin is not null").groupBy("key", "bin").agg(F.sum("size").alias("words")).join(rest, "key")
    upto = Window.partitionBy("key").orderBy("bin")
    by_bin = by_bin.withColumn("before", F.sum("words").over(upto) - F.col("words")).withColumn("left", F.col("rest") - F.col("before"))
    cut_bin = by_bin.where("left > 0 and words > left").select("key", F.col("bin").alias("cut_bin"), "left")
    all_in = by_bin.where("words <= left").groupBy("key").agg(F.max("bin").alias("full_bin"))
    edge = cut(rest.select("key").join(cut_bin, "key", "left").join(all_in, "key", "left"), "edges")
    y = x.join(_if_small(edge), "key", "left")
    at_edge = y.where("bin = cut_bin")
    w = Window.partitionBy("key").orderBy("order", "id", "digest", "number")
    run = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    chosen = at_edge.withColumn("take", run - F.col("size") / 2 <= F.col("left")).where("take").select(F.col("key").alias("k"), F.col("id").alias("i"), F.col("digest").alias("g"), F.col("number").alias("m"))
    out = y.join(chosen, same, "left")
    extra = (F.coalesce(F.col("bin") <= F.col("full_bin"), F.lit(False)) | (F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False)) & F.col("k").isNotNull())).cast("int")
    return out.select("id", "digest", "size", "source", "source_size", "target", "rate", F.least(F.col("copies") + extra, F.lit(max_copies)).cast("bigint").alias("copies"))


def op4(documents: DataFrame) -> DataFrame:
    m = mix(documents)
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.round("rate", 9).alias("rate"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, rows without copies left out.

    Rows with the same id, text and source are taken as often as they have copies together; of their other columns the least ones count.
    """
    digest = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(1))
    m = mix(docs).groupBy(key_or(F.col("id")).alias("i"), F.col("digest").alias("g"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("s"))
    m = m.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    # in a struct, so that no name clashes with ours
    keyed = docs.select(key_or(docs["doc_id"]).alias("i"), digest.alias("g"), F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n")).alias("s"), F.struct(*[docs[f"`{c}`"].alias(f"c{n}") for n, c in enumerate(docs.columns)]).alias("whole"))
    j = keyed.join(m, ["i", "g", "s"])
    several = j.where("rows > 1").groupBy("i", "g", "s").agg(F.min("whole").alias("whole"), F.first("copies").alias("copies"))
    j = j.where("rows = 1").select("whole", "copies").unionByName(several.select("whole", "copies"))
    j = j.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return j.select(*[F.col("whole")[f"c{n}"].alias(c) for n, c in enumerate(docs.columns)])
