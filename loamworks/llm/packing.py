"""Packing tokenised documents into sequences: large pieces matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm.shared import Memo, materialize, worker_store

#: Rows of one length are ranked in so many groups at least, more where there are more than so many rows for each, so that a length that many rows
#: share is no single task's.
SALTS, SALT_ROWS = 256, 500_000
MEMO, LONGEST = 200_000, 64
#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")
#: Runs of Unicode's white space too long for the pattern's look-ahead, which steps back over a whole run.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


def byte_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary in the tokenizers library's JSON; special tokens are left out."""
    parsed = json.loads(vocabulary)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in parsed["added_tokens"]}
    return {bytes(char[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in special}


def added_tokens(vocabulary: bytes) -> dict[str, bytes]:
    """Ids, as in ``ByteEncoder``, of added tokens by their strings; those that take neighbouring space or stand only alone are not supported."""
    found = json.loads(vocabulary)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens with single_word, lstrip or rstrip are not supported")
    return {t["content"]: int(t["id"]).to_bytes(4, "little") for t in found}


class ByteEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers; words are remembered.

    No token spans the place before a space that a character other than white space follows, so parts between such places are
    encoded on their own. ``encode`` takes strings of added tokens as ordinary text; ``encode_added`` gives each its one id, as the tokenizers library
    does by default.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_ranks(vocabulary), special_tokens={})
        self.words = Memo(lambda w: self._ids(" " + w), MEMO)
        self.added = added_tokens(vocabulary)
        # of tokens that start at one place, the longest
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _ids(self, text: str) -> bytes:
        """Ids of a text; a long run of white space is one word up to its last character, or its end where the text ends there."""
        ids: list[int] = []
        at = 0
        for run in _LONG_SPACE.finditer(text) if len(text) >= 256 else ():
            end = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return np.array(ids + self.encoding.encode_ordinary(text[at:] if at else text), "<u4").tobytes()

    def encode_added(self, text: str) -> bytes:
        if self._added is None:
            return self.encode(text)
        plain, *rest = self._added.split(text)
        out = [self.encode(plain)]
        for token, plain in zip(rest[::2], rest[1::2]):
            out += [self.added[token], self.encode(plain)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or text[0] == " ":
            out = []
            for part in _BEFORE_WORD.split(text):
                out.append(self.words[part[1:]] if part[:1] == " " and len(part) <= LONGEST else self._ids(part))
            return b"".join(out)
        first, *words = text.split(" ")
        if len(text) > 100_000 and max(map(len, words), default=0) > LONGEST:  # keeps the memory of words small
            return self._ids(first) + b"".join([self.words[w] if len(w) <= LONGEST else self._ids(" " + w) for w in words])
        return self._ids(first) + b"".join(map(self.words.__getitem__, words))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit; else full pieces after a first one that holds what is left over."""
    head = n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def tokenized_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece int, start bigint, length bigint, ids_crc32 bigint[, ids array<int>]): each document's ids and ``end_id``, cut to the capacity."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if (at := f"bytes {vocabulary_path}") not in store:
            store[at] = ByteEncoder(vocabulary.value)
        encoder, end = store[at], int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            lists = []
            for i, x in enumerate(batch.column(1)):
                ids = encoder.encode_added(x.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        lists.append(np.frombuffer(part, "<u4").astype(np.int32))
            of, k, start, length, crc = zip(*rows) if rows else ((),) * 5
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(k, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces of each length go: rows (length, low, high, per_bin, bin, offset), see ``place_of``.

    counts: pieces by length, 1 to capacity: the plan works on at most ``capacity`` numbers, however many pieces there are, and gives a
    few rows for each. Pieces over a third of the capacity are taken from the largest down, and each is paired with the largest other
    that fits; two at most go into a bin. Smaller ones, from the largest down, go into the bin with the smallest gap that takes them, and
    into new bins only if none does.
    """
    left = {n: c for n, c in counts.items() if c}
    rows: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)
    open_gaps: list[int] = []  # ascending
    bins = 0

    def put(n: int, items: int, per_bin: int, first: int, offset: int) -> None:
        rows.append((n, used[n], used[n] + items, per_bin, first, offset))
        used[n] += items
        left[n] -= items

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] > (a == b)), None)
            if b is None:
                many = left[a]
                put(a, many, 1, bins, 0)
                leave(capacity - a, bins, many)
            else:
                many = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, many, 1, bins, 0)
                put(b, many, 1, bins, a)
                leave(capacity - a - b, bins, many)
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):
                many = -(-left[n] // (capacity // n))
                leave(capacity, bins, many)
                bins += many
                continue
            gap = open_gaps[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            each = min(gap // n, left[n])
            filled = min(many, left[n] // each)
            put(n, filled * each, each, first, capacity - gap)
            leave(gap - each * n, first, filled)
            leave(gap, first + filled, many - filled)
    return rows


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece int, start, length, ids_crc32, sequence_id, offset, all bigint[, ids array<int>]) of every piece of every row.

    A null or empty text is the end id alone. Repeated rows are packed each. Null ids are passed on. Other columns are not read. No rows
    give no rows. Only the count of pieces of each length reaches the driver; pieces find their place by their rank among those of their length,
    counted within groups of each length and offset by the groups before.
    """
    pieces = materialize(tokenized_pieces(docs, vocabulary_path, capacity, end_id, id_col, text_col, with_ids))
    salts = max(SALTS, -(-pieces.count() // SALT_ROWS))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = materialize(pieces.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = docs.sparkSession.createDataFrame(plan(counts, capacity), "length bigint, low bigint, high bigint, per_bin bigint, bin bigint, place bigint")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "_salt").orderBy("ids_crc32", id_col, "piece", "start")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("before"))
    placed = ranked.join(F.broadcast(rows), "length").filter("_rank >= low AND _rank < high")  # a few rows a length
    nth = F.col("_rank") - F.col("low")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(nth / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"), *["ids"] * with_ids,
    )
