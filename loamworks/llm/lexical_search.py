"""Ranked lexical search: a threshold-seeded join of a table of queries with all documents, exact to the last tie."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loamworks.llm.shared import Memo, materialize, release, terms_of
from loamworks.operators.relational import top_per_key

#: Hash buckets of query terms, a bit each: 0.5 MB are sent to all tasks, however many queries there are. Other terms in a query term's bucket are dropped by the joins.
BUCKETS = 1 << 22
#: Terms of queries that are held against the documents at once, about; what is sent to the tasks grows with this, not with the queries.
BLOCK_TERMS = 200_000
#: Pairs of a posting and a query that a task adds up at once.
AT_ONCE = 2_000_000


def _bucket(term: bytes) -> int:
    return xxh64_intdigest(term) % BUCKETS


def query_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(query, term, times, bucket): the distinct terms of each query and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, t, n) for q, text in zip(batch.column(0).to_pylist(), batch.column(1)) for t, n in Counter(terms_of(text.as_py())).items()]
            columns = [[q for q, _, _ in found], [t.decode("utf-8", "surrogatepass") for _, t, _ in found], [n for _, _, n in found], [_bucket(t) for _, t, _ in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["query", "term", "times", "bucket"])

    return items.select("query", text_col).mapInArrow(run, "query bigint, term string, times bigint, bucket bigint")


def document_vectors(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, found) for every row with a term: how many terms it has, repeats included, and (term, tf) of those that queries may hold."""
    # a row for 64 buckets: at most BUCKETS / 64
    signs = wanted.groupBy(F.expr("bucket div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(bucket % 64 AS INT)))").alias("bits")).collect()
    words = np.zeros(BUCKETS // 64, np.int64)
    words[[r["w"] for r in signs]] = [r["bits"] for r in signs]
    held = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value.view(np.uint8)  # little-endian: bit b of the whole is bit b % 8 of byte b // 8
        known = Memo(lambda t: t.decode("utf-8", "surrogatepass") if bits[(b := _bucket(t)) >> 3] >> (b & 7) & 1 else "", 200_000)
        for batch in batches:
            rows, size, ends, names, counts = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = terms_of(text.as_py())
                if not tokens:
                    continue
                for term, n in Counter(tokens).items():
                    if name := known[term]:
                        names.append(name)
                        counts.append(n)
                rows.append(i)
                size.append(len(tokens))
                ends.append(len(names))
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["id", "n", "found"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, found array<struct<term: string, tf: bigint>>")


def _unit(n_docs: int, n_terms: int) -> Column:
    """A posting's impact but for its term's weight, from columns tf and n, in whole numbers."""
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {n_docs}L) div {max(1, n_terms)}L))")


def _exact(pairs: DataFrame, postings: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, row, score) of the given pairs of query and row."""
    return postings.join(pairs, "row").join(asked, ["query", "term"]).groupBy("query", "row").agg(F.sum(F.col("gain") * F.col("unit")).alias("score"))


def thresholds(asked: DataFrame, best: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query, least): a score that k documents reach for sure.

    For each term, the kth of its stored impacts is one: k documents hold it and at least that. Then the documents whose impacts are stored for
    the query's terms are scored exactly; the kth of these scores is the better bound.
    """
    kth = best.groupBy("term").agg(F.count("*").alias("stored"), F.min("unit").alias("kth")).filter(F.col("stored") >= k)
    single = asked.join(kth, "term").select("query", (F.col("gain") * F.col("kth")).alias("least"))
    pairs = asked.join(best, "term").select("query", "row").distinct()
    scored = top_per_key(_exact(pairs, postings, asked), ["query"], [F.desc("score"), F.col("row")], k)
    seeded = scored.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query", "least")
    return single.unionByName(seeded).groupBy("query").agg(F.max("least").alias("least"))


def suffix_bounds(asked: DataFrame, known: DataFrame, least: DataFrame) -> DataFrame:
    """(query, term, gain, needed, least, rest): which terms generate candidates, and what the others can add at most.

    Terms come in order of their largest impact by document; from the first on whose suffix of largest impacts stays below the threshold, a
    document that holds only those can't reach it, so they generate none.
    """
    bounded = asked.join(known.select("term", "top", "df"), "term").withColumn("most", F.col("gain") * F.col("top"))
    order = Window.partitionBy("query").orderBy(F.desc(F.col("most") / F.col("df")), "term")
    suffix = bounded.withColumn("suffix", F.sum("most").over(order.rowsBetween(0, Window.unboundedFollowing)))
    told = suffix.join(least, "query", "left").withColumn("least", F.greatest(F.lit(1), "least")).withColumn("needed", F.col("suffix") >= F.col("least"))
    rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))).over(Window.partitionBy("query")), F.lit(0))
    return told.withColumn("rest", rest).select("query", "term", "gain", "needed", "least", "rest")


class Block:
    """A block of queries, as postings by term: what a task holds against documents."""

    def __init__(self, plan, k: int):
        self.k = k
        self.queries, at = np.unique(plan["query"].to_numpy(), return_inverse=True)
        self.least, self.rest = np.zeros(len(self.queries), np.int64), np.zeros(len(self.queries), np.int64)
        self.least[at], self.rest[at] = plan["least"].to_numpy(), plan["rest"].to_numpy()
        names, term = np.unique(plan["term"].to_numpy(object).astype(object), return_inverse=True)
        self.terms = pa.array(names, pa.string())
        gain, needed = plan["gain"].to_numpy(np.int64), plan["needed"].to_numpy(bool)
        self.sides = []
        for side in (needed, ~needed):
            order = np.flatnonzero(side)[np.argsort(term[side], kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(term[order], minlength=len(names)))]).astype(np.int64)
            self.sides.append((ends, at[order].astype(np.int64), gain[order]))

    def _spread(self, side: int, doc: np.ndarray, term: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, score) of every query that holds a posting's term on that side; a key is document * queries + query."""
        ends, query, gain = self.sides[side]
        n = ends[term + 1] - ends[term]
        post = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(post)) - np.repeat(np.cumsum(n) - n, n) + ends[term][post]
        return doc[post] * len(self.queries) + query[at], gain[at] * unit[post]

    def scores(self, doc: np.ndarray, term: np.ndarray, unit: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, score) of all pairs that reach ``least``, exactly: candidates by their generating terms and the rest's bound, then the rest added."""
        key, value = self._spread(0, doc, term, unit)
        key, back = np.unique(key, return_inverse=True)
        score = np.zeros(len(key), np.int64)
        np.add.at(score, back, value)
        query = key % len(self.queries)
        may = score + self.rest[query] >= least[query]
        key, score = key[may], score[may]
        if len(key):
            among = np.isin(doc, key // len(self.queries))
            more, value = self._spread(1, doc[among], term[among], unit[among])
            at = np.minimum(np.searchsorted(key, more), len(key) - 1)
            same = key[at] == more
            np.add.at(score, at[same], value[same])
        query = key % len(self.queries)
        stays = score >= least[query]
        return key[stays] // len(self.queries), query[stays], score[stays]

    def cost(self, term: np.ndarray) -> np.ndarray:
        return sum(ends[term + 1] - ends[term] for ends, _, _ in self.sides)


def search_block(vectors: DataFrame, plan: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, id, score): of each task's documents the k best of each query of a block, all that may be among the k best of all."""
    held = vectors.sparkSession.sparkContext.broadcast(Block(plan.toPandas(), k))  # bounded by BLOCK_TERMS
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, id_type = held.value, None
        least = block.least.copy()
        best = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, whether the id is null, id
        for batch in batches:
            id_type = batch.schema.field(0).type
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n, found = batch.column(1).to_numpy(), batch.column(2)
            pairs = found.flatten()
            term = pc.fill_null(pc.index_in(pairs.field(0), value_set=block.terms), -1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), found.value_lengths().to_numpy())
            tf = pairs.field(1).to_numpy()
            known = term >= 0
            doc, term, tf = doc[known], term[known], tf[known]
            unit = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n[doc] * n_docs // max(1, n_terms)))
            total = np.cumsum(np.bincount(doc, block.cost(term), len(ids)))  # a document costs a block's terms at most
            cuts = np.searchsorted(doc, np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, AT_ONCE)))
            for a, b in zip(cuts, [*cuts[1:], len(doc)]):
                at, query, score = block.scores(doc[a:b], term[a:b], unit[a:b], least)
                if not len(at):
                    continue
                all_ = [np.concatenate(x) for x in zip(best, (query, score, null[at], ids[at]))]
                order = np.lexsort((all_[3], all_[2], -all_[1], all_[0]))
                first = np.searchsorted(all_[0][order], all_[0][order])
                kept = order[np.arange(len(order)) - first < block.k]
                best = [x[kept] for x in all_]
                full = np.arange(len(kept)) - np.searchsorted(best[0], best[0]) == block.k - 1
                least[best[0][full]] = np.maximum(least[best[0][full]], best[1][full])
        if id_type is not None and len(best[0]):
            ids = pa.array(best[3], pa.int64(), mask=best[2].astype(bool)).cast(id_type)
            yield pa.RecordBatch.from_arrays([pa.array(block.queries[best[0]], pa.int64()), ids, pa.array(best[1], pa.int64())], names=["query", "id", "score"])

    return vectors.select("id", "n", "found").mapInArrow(run, f"query bigint, id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_col, rank int, id_col, score bigint): the k documents of the highest scores above 0 for each row of ``items``, equal scores by ascending id.

    Scores are whole numbers, from term weights floor(1000 ln((2 N + 2) / (2 df + 1))) and impacts of at most 1,000,000 that saturate with a term's frequency
    and fall with the document's length. A null text has no terms: such a document counts nowhere and such an item has no rows. Rows that repeat an id
    are each a document, or a query with rows of its own; null ids come after all others. Ids of documents are whole numbers. Other columns are not
    read. No documents or no items give no rows.

    Documents are read once; what is written of them are their frequencies of query terms. The k largest impacts of each term are stored, and seed a threshold for each
    query (``thresholds``); suffix bounds tell which terms generate candidates (``suffix_bounds``); a pass over the written vectors for each block of queries
    finds the candidates and scores them exactly (``Block``), keeping k a query and task. No posting is shuffled for that pass.
    """
    spark = docs.sparkSession
    asked_rows = materialize(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).withColumn("query", F.monotonically_increasing_id()))
    wanted = materialize(query_terms(asked_rows, "text"))
    vectors = materialize(document_vectors(docs, wanted, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = vectors.select("row", "n", F.inline("found")).select("row", "term", _unit(n_docs, n_terms).alias("unit"))
    best = materialize(top_per_key(postings, ["term"], [F.desc("unit"), F.col("row")], k))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    known = materialize(frequencies.join(best.groupBy("term").agg(F.max("unit").alias("top")), "term").withColumn("weight", weight))
    asked = materialize(wanted.join(known, "term").select("query", "term", (F.col("times") * F.col("weight")).alias("gain")))
    plan = materialize(suffix_bounds(asked, known, materialize(thresholds(asked, best, postings, k))))
    blocks = -(-plan.count() // block_terms)
    parts = []
    for b in range(blocks):
        part = plan.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        parts.append(materialize(search_block(vectors, part, n_docs, n_terms, k)))
    kind = docs.schema[id_col].dataType.simpleString()
    found = spark.createDataFrame([], f"query bigint, id {kind}, score bigint")
    for part in parts:
        found = found.unionByName(part)
    for used in (wanted, vectors, best, known, asked, plan):
        release(used)
    ranked = top_per_key(found, ["query"], [F.desc("score"), F.asc_nulls_last("id")], k, "rank")
    return ranked.join(asked_rows, "query").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
