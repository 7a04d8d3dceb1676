"""Brackets: draws that keep pairs together and byes apart, and boards from the events that set results, changed ones included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.operators import graph


def _shuffled(*by: Column) -> Column:
    """A number that looks random, the same for the same columns."""
    return F.xxhash64(*by)


def draw(entrants: DataFrame, pairs: DataFrame, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """(bracket, slot, entrant): a first round for each bracket, by chance that the seed fixes; a null entrant is a bye, which no two meet in a match.

    entrants: (bracket, entrant), distinct; pairs: (bracket, a, b), who meet in the first round, each entrant in one pair at most; sizes: (bracket, size), powers of two, with more than half and at most all seats taken.
    Matches are put in an order by chance: the first hold the pairs, the next one bye each. Where there are more pairs than matches without a bye, pairs are drawn as everyone else.
    """
    c = F.col
    count = entrants.groupBy("bracket").agg(F.count("*").cast("int").alias("n"))
    asked = pairs.groupBy("bracket").agg(F.count("*").cast("int").alias("u"))
    told = sizes.select("bracket", c("size").cast("int").alias("size")).join(count, "bracket").join(asked, "bracket", "left")
    told = told.withColumns({"half": (c("size") / 2).cast("int"), "byes": c("size") - c("n")}).withColumn("u", F.when(F.coalesce("u", F.lit(0)) <= c("half") - c("byes"), F.coalesce("u", F.lit(0))).otherwise(0))
    salt = F.lit(seed)
    order = lambda *by: F.row_number().over(Window.partitionBy("bracket").orderBy(*by))
    matches = told.select("*", F.explode(F.sequence(F.lit(0), c("half") - 1)).alias("match"))
    matches = matches.withColumn("k", order(_shuffled(salt, c("bracket"), F.lit("match"), c("match")), "match"))
    kept = pairs.join(told.filter("u > 0").select("bracket"), "bracket", "left_semi").withColumn("k", order(_shuffled(salt, c("bracket"), F.lit("pair"), c("a"), c("b")), "a", "b"))
    turned = _shuffled(salt, c("bracket"), F.lit("side"), c("a"), c("b")) % 2 == 0
    seated = matches.join(kept, ["bracket", "k"]).select("bracket", F.explode(F.array(*[F.struct((c("match") * 2 + s).alias("slot"), F.when(turned, c(x)).otherwise(c(y)).alias("entrant")) for s, (x, y) in enumerate((("a", "b"), ("b", "a")))])).alias("s")).select("bracket", "s.*")
    free = matches.filter("k > u").select("bracket", "match", (c("k") <= c("u") + c("byes")).alias("bye"), F.when(_shuffled(salt, c("bracket"), F.lit("bye"), c("match")) % 2 == 0, 0).otherwise(1).alias("side"), F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    free = free.select("bracket", (c("match") * 2 + c("s")).alias("slot"), (c("bye") & (c("s") == c("side"))).alias("empty"))
    paired = kept.select("bracket", F.explode(F.array("a", "b")).alias("entrant"))
    rest = entrants.join(paired, ["bracket", "entrant"], "left_anti").withColumn("k", order(_shuffled(salt, c("bracket"), F.lit("entrant"), c("entrant")), "entrant"))
    open_ = free.filter("NOT empty").withColumn("k", order("slot"))
    return seated.unionByName(open_.join(rest, ["bracket", "k"]).select("bracket", "slot", "entrant")).unionByName(free.filter("empty").select("bracket", "slot", F.lit(None).cast(entrants.schema["entrant"].dataType).alias("entrant")))


def boards(slots: DataFrame, events: DataFrame) -> DataFrame:
    """(bracket, round, match, a, b, winner, ready): every match after all events, its entrants null where they aren't decided, or are byes in round 0.

    slots: (bracket, slot, entrant), null for a bye; events: (bracket, seq, round, match, winner), in order of seq, which is unique in a bracket. An event counts if its winner is then one of the match's two known
    entrants. A result that changes clears the results that hang on it, one after the other as far as there are any. A first-round match with one bye is decided from the start.

    Round by round: what a match's two seats hold over time are the results of the round before, so entrants, what counts and what is cleared are windows over the match's
    own events and the changes of its seats.
    """
    c = F.col
    rounds = slots.agg(F.max("slot")).first()[0]
    held = slots.groupBy("bracket").agg((F.max("slot") + 1).alias("size"))
    seats = slots.select("bracket", c("slot").alias("seat"), F.lit(-1).cast("bigint").alias("seq"), c("entrant").alias("holds"), F.lit(False).alias("moved"))
    out = []
    for r in range((rounds or 0).bit_length()):
        if r:  # brackets that are over
            seats = seats.join(held.filter(c("size") >= 2 << r).select("bracket"), "bracket", "left_semi")
        changes = seats.select("bracket", F.floor(c("seat") / 2).cast("int").alias("match"), "seq", (c("seat") % 2).cast("int").alias("side"), "holds", "moved", F.lit(None).cast(slots.schema["entrant"].dataType).alias("picked"))
        own = events.filter(c("round") == r).select("bracket", c("match").cast("int").alias("match"), c("seq").cast("bigint").alias("seq"), F.lit(None).cast("int").alias("side"), F.lit(None).cast(slots.schema["entrant"].dataType).alias("holds"), F.lit(False).alias("moved"), c("winner").alias("picked"))
        known = changes.unionByName(own.join(changes.select("bracket", "match").distinct(), ["bracket", "match"], "left_semi"))
        until = Window.partitionBy("bracket", "match").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, 0)
        seat = lambda k: F.last(F.when(c("side") == k, F.struct("holds")), ignorenulls=True).over(until)["holds"]  # noqa: E731, B023
        rows = known.withColumns({"a": seat(0), "b": seat(1)})
        both = c("a").isNotNull() & c("b").isNotNull() if r else F.lit(True)
        counts = c("picked").isNotNull() & both & F.coalesce((c("picked") == c("a")) | (c("picked") == c("b")), F.lit(False))
        # a first-round match with one bye is decided as soon as both its seats are told
        bye = F.lit(r == 0) & (c("seq") == -1) & (c("side") == 1) & (c("a").isNull() != c("b").isNull())
        none = F.lit(None).cast(slots.schema["entrant"].dataType)
        mark = F.when(counts, F.struct(c("picked").alias("w"))).when(bye, F.struct(F.coalesce("a", "b").alias("w"))).when(c("moved"), F.struct(none.alias("w")))
        rows = rows.withColumn("winner", F.last(mark, ignorenulls=True).over(until)["w"])
        last = F.max_by(F.struct("a", "b", "winner"), F.struct("seq", "side"))
        ended = rows.groupBy("bracket", "match").agg(last.alias("s")).select("bracket", F.lit(r).alias("round"), "match", "s.*")
        ready = c("winner").isNull() & c("a").isNotNull() & c("b").isNotNull()
        out.append(ended.withColumn("ready", ready))
        before = F.lag("winner").over(Window.partitionBy("bracket", "match").orderBy("seq", "side"))
        told = rows.withColumn("before", before).filter(~c("winner").eqNullSafe(c("before")) | (c("seq") == -1) & (c("side") == 1) | F.lit(r > 0) & c("before").isNull() & c("winner").isNull())
        # of changes at one time, as both seats may change at once, the last; what was decided and no longer is so moves what hangs below
        moved = told.groupBy("bracket", "match", "seq").agg(F.max_by(c("winner"), F.coalesce("side", F.lit(2))).alias("holds"), F.bool_or(c("before").isNotNull() & ~c("winner").eqNullSafe(c("before"))).alias("moved"))
        seats = graph.settle(moved.select("bracket", c("match").alias("seat"), "seq", "holds", "moved"))
    return reduce(DataFrame.unionByName, out) if out else slots.select("bracket", F.lit(0).alias("round"), F.lit(0).alias("match"), c("entrant").alias("a"), c("entrant").alias("b"), c("entrant").alias("winner"), F.lit(False).alias("ready")).limit(0)
