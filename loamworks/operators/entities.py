"""Operators on entities and their facts: picking, matching, searching, redirects, cadence, revisions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions import scalar


def pick_fact(facts: DataFrame, entity: str, language: str, region: str, trust: str, position: str, asked_language: str, asked_region: str, neutral: tuple[str, ...] = ("*", "GLOBAL")) -> DataFrame:
    """The fact that stands for each entity.

    Languages rank asked, neutral, other. The first fact of the asked region by language and position wins; without one, of the best language's facts the
    most trusted, a neutral region before others.
    """
    lang = F.when(F.col(language) == asked_language, 0).when(F.col(language).isin(*neutral), 1).otherwise(2)
    own = F.col(region) == asked_region
    order = [F.when(own, 0).otherwise(1), lang, F.when(own, F.lit(0)).otherwise(scalar.rank_in(F.col(trust), scalar.TRUST)), F.when(own | F.col(region).isin(*neutral), 0).otherwise(1), F.col(position)]
    return facts.withColumn("_k", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter("_k = 1").drop("_k")


def search_names(aliases: DataFrame, query: str, boosts: dict[str, int]) -> DataFrame:
    """(entity_id, score) by alias prefixes: aliases are (entity_id, norm, type).

    The whole query weighs 1, each of its words of two or more characters 0.6 if there are several; an exact alias scores 100, a prefix 60 less the
    extra length up to 40. An entity keeps its best score, gains 15 for each further word that it matched, and its type's boost.
    """
    words = [w for w in query.lower().split() if len(w) >= 2]
    terms = [(query.lower().replace(" ", ""), 1.0)] + ([(w, 0.6) for w in dict.fromkeys(words)] if len(words) > 1 else [])
    norm = F.col("norm")
    base = lambda t: F.when(norm == t, 100.0).otherwise(60.0 - F.least(F.lit(40), F.length(norm) - len(t)))
    hits = F.array_compact(F.array(*[F.when(norm.startswith(t), F.struct(F.lit(i).alias("term"), (base(t) * w).alias("s"))) for i, (t, w) in enumerate(terms)]))
    rows = aliases.select("entity_id", "type", F.explode(hits).alias("h")).select("entity_id", "type", "h.*")
    extra = F.greatest(F.count_distinct(F.when(F.col("term") > 0, F.col("term"))) - 1, F.lit(0))
    scored = rows.groupBy("entity_id", "type").agg(F.max("s").alias("best"), extra.alias("extra"))
    boost = reduce(lambda c, kv: F.when(F.col("type") == kv[0], kv[1]).otherwise(c), boosts.items(), F.lit(0))
    return scored.select("entity_id", (F.col("best") + 15 * F.col("extra") + boost).alias("score"))


def match_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(incoming_id, stored_id or null): which stored event each incoming one is.

    Both: id, url, kind, title, starts. First the same url, kind, title and start; else, the only one left of that title on both sides; else, if no stored row
    has the title, the only stored row of the url and kind when the url comes once. Each step leaves out what the one before matched.
    """
    key = ["url", "kind", "title"]
    left = incoming.withColumnRenamed("id", "incoming_id")
    right = stored.withColumnRenamed("id", "stored_id")
    exact = left.join(right, [*key, "starts"]).groupBy("incoming_id").agg(F.min("stored_id").alias("stored_id"))
    rest, free = left.join(exact, "incoming_id", "left_anti"), right.join(exact, "stored_id", "left_anti")
    single = lambda df, k, i: df.groupBy(*k).agg(F.min(i).alias(i), F.count("*").alias("n")).filter("n = 1").drop("n")
    titled = single(rest, key, "incoming_id").join(single(free, key, "stored_id"), key).select("incoming_id", "stored_id")
    rest = rest.join(titled, "incoming_id", "left_anti").join(right.select(*key).distinct(), key, "left_anti")
    free = free.join(titled, "stored_id", "left_anti")
    placed = single(rest, ["url", "kind"], "incoming_id").join(single(free, ["url", "kind"], "stored_id"), ["url", "kind"]).select("incoming_id", "stored_id")
    found = exact.unionByName(titled).unionByName(placed)
    return left.select("incoming_id").join(found, "incoming_id", "left")


def resolve(ids: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """Follows one redirect: merged is (id, merged_into)."""
    to = merged.select(F.col("id").alias(column), F.col("merged_into").alias("_to"))
    return ids.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def merge_locales(old: Column, new: Column) -> Column:
    """A map of texts with another laid over it; a null value removes its key, a null map changes nothing."""
    return F.when(new.isNull(), old).otherwise(F.map_filter(F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k)), new), lambda _, v: v.isNotNull()))


def cadence(rows: DataFrame, key: str, at: str, tie: str, gap_ms: int, span_ms: int, most: int) -> DataFrame:
    """Adds ``allowed``: no entry of the key within ``gap_ms`` before, and fewer than ``most`` within ``span_ms`` before."""
    order = Window.partitionBy(key).orderBy(at, tie)
    recent = Window.partitionBy(key).orderBy(at).rangeBetween(-span_ms, -1)
    gap = F.col(at) - F.lag(at).over(order)
    return rows.withColumn("allowed", (F.coalesce(gap, F.lit(gap_ms)) >= gap_ms) & (F.count("*").over(recent) < most))


def validate(rows: DataFrame, rules: list[tuple[Column, str]]) -> Column:
    """Messages of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(broken, message) for broken, message in rules]))


#: Bits of a tile's neighbours, clockwise from the one above.
NEIGHBOURS = ((0, -1, 1), (1, -1, 2), (1, 0, 4), (1, 1, 8), (0, 1, 16), (-1, 1, 32), (-1, 0, 64), (-1, -1, 128))


def tile_masks(cells: DataFrame) -> DataFrame:
    """(x, y, edges, blob) of distinct filled cells: bits of the four neighbours by edges, and of all eight, a corner counting only between two filled edges."""
    told = F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(w).alias("w")) for dx, dy, w in (*NEIGHBOURS, (0, 0, 0))])
    masks = cells.select(F.inline(told)).groupBy("x", "y").agg(F.sum("w").alias("m"), F.bool_or(F.col("w") == 0).alias("filled")).filter("filled")
    edges = F.col("m").bitwiseAND(85)
    corner = lambda bit, both: F.when(F.col("m").bitwiseAND(both) == both, bit).otherwise(0)
    return masks.select("x", "y", edges.alias("edges"), (edges + corner(2, 7) + corner(8, 28) + corner(32, 112) + corner(128, 193)).alias("blob"))


def near_signatures(signatures: DataFrame, id_col: str, signature: str, radius: int, bits: int = 64, shared: int = 3) -> DataFrame:
    """(a, b) of the ids of distinct signatures that differ in at most ``radius`` bits, least ids standing for equal signatures.

    Of radius + ``shared`` blocks of bits, at least ``shared`` are equal: pairs meet by each choice of so many blocks, here half of all bits, so that few meet by chance however many there
    are, and are compared in full. A pair is told by the first of its equal blocks alone. Both sides are shuffled: a plan's estimate doesn't see that each row becomes many, and would send one side to all tasks.
    """
    n = radius + shared
    edges = [i * bits // n for i in range(n + 1)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    one = signatures.groupBy(signature).agg(F.min(id_col).alias("id")).withColumnRenamed(signature, "s")
    choices = [(sum(1 << j for j in c), 1 << (c[-1] + 1), signed(sum(masks[j] for j in c))) for c in combinations(range(n), shared)]
    at = F.explode(F.array(*[F.struct(F.lit(m).alias("blocks"), F.lit(top).alias("top"), F.col("s").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")) for m, top, mask in choices])).alias("k")
    keyed = one.select("id", "s", at).select("id", "s", "k.*")
    pairs = keyed.alias("x").hint("merge").join(keyed.alias("y"), F.expr("x.blocks = y.blocks AND x.bits = y.bits AND x.id < y.id"))
    away = F.col("x.s").bitwiseXOR(F.col("y.s"))
    near = pairs.filter(F.bit_count(away) <= radius)
    equal = sum(F.when(away.bitwiseAND(F.lit(signed(mask)).cast("bigint")) == 0, 1 << j).otherwise(0) for j, mask in enumerate(masks))
    return near.filter(equal % F.col("x.top") == F.col("x.blocks")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
