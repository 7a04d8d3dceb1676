"""Removal of lines that many documents share, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.shared import LOWER, SPACES, UPPER, materialize

#: Common lines are sent to all tasks up to so many (24 bytes each); beyond, those that stand in most lines still are, at least in so many lines each, and the others are joined.
SENT, HOT_LINES = 200_000, 2_000_000


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    key = F.btrim(line, F.lit(SPACES))
    # of lines in ASCII, lower() changes A-Z alone, and is fast
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _hash(key: Column) -> Column:
    """128 bits: two 64-bit hashes with unlike seeds."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def long_lines(docs: DataFrame, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, pos, h, g) of each line whose key has ``least_chars`` code points: its document, the hash of that text, its place from 0, the key's hash."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("own", _hash(F.col("text")))
    lines = texts.select("id", "own", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.char_length("line") >= least_chars)
    keys = lines.select("id", "own", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return keys.select("id", "own", "pos", _hash(F.col("key")).alias("k")).select("id", "own", "pos", "k.h", "k.g")


def common_lines(lines: DataFrame, least_docs: int = 5) -> DataFrame:
    """(h, g, keeper, lines): hashes of the keys in ``least_docs`` or more documents, the largest id of these, and how many lines they are. Rows without an id are no document."""
    seen = lines.filter("id IS NOT NULL").groupBy("h", "g", "id").agg(F.count("*").alias("lines"))
    found = seen.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("keeper"), F.sum("lines").alias("lines"))
    return found.filter(F.col("n") >= least_docs).select("h", "g", "keeper", "lines")


def matched(lines: DataFrame, common: DataFrame, sent: int = SENT, hot_lines: int = HOT_LINES) -> DataFrame:
    """The lines whose keys are common, with the keeper.

    Few common keys are sent to all tasks. Of many, only the hot ones are, each once: those of ``hot_lines`` lines or more, and of a ``sent``-th of all lines, so that
    there are no more than ``sent``. A key of the rest has fewer lines than that, so none fills a task of their join.
    """
    keys = common.select("h", "g", "keeper")
    if common.count() <= sent:
        return lines.join(F.broadcast(keys), ["h", "g"])
    least = max(hot_lines, lines.count() // max(1, sent))
    hot = F.col("lines") >= least
    return lines.join(F.broadcast(common.filter(hot).select("h", "g", "keeper")), ["h", "g"]).unionByName(lines.join(common.filter(~hot).select("h", "g", "keeper"), ["h", "g"]))


def _stays(lost: Column) -> Column:
    """Flags of lines up to the last lost one, from the lost lines' places in ascending order."""
    gap = lambda i: F.get(lost, i) - F.coalesce(F.get(lost, i - 1), F.lit(-1)) - 1
    runs = F.transform(F.sequence(F.lit(0), F.size(lost) - 1), lambda i: F.concat(F.array_repeat(F.lit(True), gap(i)), F.array(F.lit(False))))
    return F.flatten(runs)


def drop_common_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``text_col`` holding the lines that stay, and n_lines (before) and n_dropped, both bigint.

    A line whose key (``line_key``) has ``least_chars`` code points or more and is found in ``least_docs`` or more documents goes, except
    from the document with the largest id that holds it. A null text is an empty one: one empty line. Rows that repeat an id are one
    document to the counts, and each loses its lines. Rows with a null id are no document to the counts, and lose every line that is
    common. No rows give no rows. Columns of ``docs`` called n_lines or n_dropped are replaced.

    Lines are exploded and hashed once, and what is written of them is their place and hashes; the places that a text loses, at most its lines, go
    back to it, and it is put together from the others by position.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = materialize(long_lines(docs, least_chars, id_col, text_col))
    common = materialize(common_lines(lines, least_docs))
    found = matched(lines, common, SENT, HOT_LINES)
    lost = found.filter("id IS NULL OR id <> keeper").groupBy(F.col("id").alias("_id"), F.col("own").alias("_own")).agg(F.sort_array(F.collect_set("pos")).alias("_lost"))
    lost = lost.select("_id", "_own", _stays(F.col("_lost")).alias("_stays"), F.size("_lost").alias("_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.select(*rest, _hash(text).alias("_hash")).join(lost, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_own")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.get("_stays", i), F.lit(True))), "\n")
    kept = F.when(F.col("_stays").isNull(), text).otherwise(kept)
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in rest], F.size(F.split(text, "\n", -1)).cast("bigint").alias("n_lines"), F.coalesce("_gone", F.lit(0)).cast("bigint").alias("n_dropped")
    )
