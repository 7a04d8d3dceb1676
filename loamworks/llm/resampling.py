"""Resampling of documents towards a target distribution: hashed n-gram counts in CSR blocks, column sums, and a sparse matrix-vector product with the gains."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.shared import materialize, release, terms_of
from loamworks.operators.relational import places

#: Words of a block of the matrix, about; a longer document is a block of its own, counted in slices of so many.
BLOCK_WORDS = 100_000
BLOCK = "words array<int>, features array<bigint>, ends array<int>, buckets binary, counts binary"


class Shifts:
    """crc32 of joined strings from the crc32 of their parts: what appending bytes does to a crc32 is linear, so four look-ups in tables for their number."""

    def __init__(self) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, np.uint32(0xEDB88320) ^ (one >> 1), one >> 1)
        start = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.powers = [(start >> 8) ^ one[start & 255]]
        self.start, self.known = start, {}

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]

    def _tables(self, n: int) -> np.ndarray:
        found = self.known.get(n)
        if found is None:
            found, bit = self.start, 0
            while n >> bit:
                if bit == len(self.powers):
                    self.powers.append(self._apply(self.powers[-1], self.powers[-1]))
                if n >> bit & 1:
                    found = self._apply(self.powers[bit], found)
                bit += 1
            if len(self.known) < 4096:
                self.known[n] = found
        return found

    def append(self, crc: np.ndarray, tail: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc32 of strings with the given crc32, followed by strings of n bytes with crc32 ``tail``."""
        sizes, at = np.unique(n, return_inverse=True)
        tables = np.stack([self._tables(int(x)) for x in sizes]).reshape(-1) if len(sizes) else np.zeros(0, np.uint32)
        at = at * 1024
        return tables[at + (crc & 255)] ^ tables[at + 256 + ((crc >> 8) & 255)] ^ tables[at + 512 + ((crc >> 16) & 255)] ^ tables[at + 768 + (crc >> 24)] ^ tail


def gram_hashes(words: list[bytes], longest: int, shifts: Shifts) -> list[np.ndarray]:
    """For 1 to ``longest`` words: crc32 of the words from each place on, joined by one space."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    spaced = shifts.append(np.full(len(words), zlib.crc32(b" "), np.uint32), crc, size)
    out = [crc]
    for k in range(1, longest):
        out.append(shifts.append(out[-1][:-1], spaced[k:], size[k:] + 1) if len(words) > k else crc[:0])
    return out


def _count(texts: list[list[bytes]], longest: int, buckets: int, shifts: Shifts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, buckets, counts): for each text the place after its last entry, and the entries by text and bucket."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(texts) == 1 and sizes[0] > BLOCK_WORDS:
        dense = np.zeros(buckets, np.int64)
        for a in range(0, int(sizes[0]), BLOCK_WORDS):
            for crc in gram_hashes(texts[0][a : a + BLOCK_WORDS + longest - 1], longest, shifts):
                dense += np.bincount(crc[:BLOCK_WORDS] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(dense)
        return np.array([len(at)]), at, dense[at]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys = []
    for k, crc in enumerate(gram_hashes([w for t in texts for w in t], longest, shifts)):
        own = owner[: len(crc)]
        inside = own == owner[k:]
        keys.append(own[inside] * buckets + crc[inside] % np.uint32(buckets))
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    return np.searchsorted(key, (np.arange(len(texts)) + 1) * buckets), key % buckets, counts


def count_matrix(docs: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """Blocks of the documents' sparse matrix of counts by bucket, in compressed sparse rows.

    A row of the frame is a block: ids, words and features hold a value for each of its documents, ends the place after its last entry; buckets and counts are the
    entries as compressed unsigned 32-bit numbers, the former as steps from the entry before.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, pack = Shifts(), zstandard.ZstdCompressor(3)
        for batch in batches:
            texts, first, held = [], 0, 0

            def block() -> pa.RecordBatch:
                ends, at, counts = _count(texts, longest, buckets, shifts)
                sums = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])]
                steps = np.diff(at, prepend=0).astype(np.int32).tobytes()  # below 0 where a document begins
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
                ids = batch.column(0).slice(first, len(texts))
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids])), one([len(t) for t in texts], pa.int32()), one(np.diff(sums), pa.int64()), one(ends, pa.int32()),
                    pa.array([pack.compress(steps)], pa.binary()), pa.array([pack.compress(counts.astype(np.uint32).tobytes())], pa.binary()),
                ]
                return pa.RecordBatch.from_arrays(columns, names=["ids", "words", "features", "ends", "buckets", "counts"])

            for i, text in enumerate(batch.column(1)):
                tokens = terms_of(text.as_py())
                if texts and held + len(tokens) > BLOCK_WORDS:
                    yield block()
                    texts, first, held = [], i, 0
                texts.append(tokens)
                held += len(tokens)
            if texts:
                yield block()

    return docs.select(id_col, text_col).mapInArrow(run, f"ids array<{kind}>, {BLOCK}")


def _entries(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a block's entries."""
    steps, counts = (zstandard.ZstdDecompressor().decompress(batch.column(c)[i].as_py()) for c in ("buckets", "counts"))
    return np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """The count of each bucket over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, counts = _entries(batch, i)
                np.add.at(sums, at, counts)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # a row a bucket
    for r in matrix.select("buckets", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more frequent each bucket is in the target, each count plus one."""
    m, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = ((float(t + 1) * float(all_source + m)) / (float(s + 1) * float(all_target + m)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([floor(1000 * log(x)) for x in ratio], np.int64)


def weigh(matrix: DataFrame, gains: np.ndarray, id_col: str) -> DataFrame:
    """(id_col, words, n_features, weight) for each document: the matrix times the gains."""
    held = matrix.sparkSession.sparkContext.broadcast(gains)  # a number a bucket
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, counts = _entries(batch, i)
                sums = np.concatenate([[0], np.cumsum(counts * held.value[at])])
                ends = np.concatenate([[0], batch.column("ends")[i].values.to_numpy()])
                columns = [batch.column(c)[i].values for c in ("ids", "words", "features")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(sums[ends]), pa.int64())], names=[id_col, "words", "n_features", "weight"])

    return matrix.mapInArrow(run, f"`{id_col}` {kind}, words int, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, longest: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """(id_col, n_features, weight, score, rank, all else bigint) for every row of ``docs``; those with a rank are drawn, in its order from 1.

    Features are all runs of 1 to ``longest`` words, hashed into ``buckets``. A document's weight is the sum of its features' gains, see ``gains_of``, over the two
    tables' distributions. Of the N documents with ``least_words`` words or more, floor(percent N / 100) with the highest scores are drawn without replacement: a
    score is the weight plus Gumbel noise, all in thousandths, that the seed and the id fix. Ties go to smaller ids, null ids come last (their noise is that of an
    empty id). Rows that repeat an id are scored, and drawn, each. A null text has no words: its weight is 0. Other columns are not read. No rows give no
    rows; without a target all buckets gain as if it were even.

    Documents are read once: their count matrix is written in blocks, read for the sums and again for the product.
    """
    matrix = materialize(count_matrix(docs, id_col, text_col, longest, buckets))
    wanted = materialize(count_matrix(target.select(F.lit(0).cast("bigint").alias("id"), F.col(target_text_col).alias("text")), "id", "text", longest, buckets))
    gains = gains_of(column_sums(matrix, buckets), column_sums(wanted, buckets))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weigh(matrix, gains, id_col).withColumn("score", F.col("weight") + noise))
    for used in (matrix, wanted):
        release(used)
    fit = F.col("words") >= least_words
    drawn = percent * scored.filter(fit).count() // 100
    order = {"_short": ~fit, "_down": -F.col("score"), "_null": F.col(id_col).isNull()}
    ranked = places(scored.withColumns(order), [*order, id_col], "_place")
    rank = F.when(fit & (F.col("_place") <= drawn), F.col("_place").cast("bigint"))
    return ranked.select(id_col, "n_features", "weight", "score", rank.alias("rank"))
