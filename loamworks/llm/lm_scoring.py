"""Language-model scores by a weighted backoff automaton whose parts are gathered for each block of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from loamworks.llm.shared import materialize, release

#: Tokens of the longest n-grams, and the weights of a shorter context that are tried, in tokens.
ORDER, GRID = 4, tuple(4.0**k for k in range(-2, 7))
#: Tokens in a block of documents and, about, for each bucket of n-grams.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 20
#: The end of a text as a token, and its start as a context: numbers of their own among the words' hashes.
END, START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's start, of its words, A-Z lower-cased, and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.concatenate([[START], np.frombuffer(b"".join(map(xxh64_digest, words)), ">u8").astype(np.uint64), [END]])


def arc_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A 64-bit key of each (context, token)."""
    h = (before * _A ^ (before >> np.uint64(31))) + token
    return (h ^ (h >> np.uint64(29))) * _B


class Automaton:
    """States are the contexts seen in training, up to order - 1 tokens; arcs carry probabilities, failure arcs lead to the context without its first token.

    With c the counts in training, state h has an arc on w if hw was seen: p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), where h' is h without its first token and
    m the prior of that length. Any other w takes h's failure arc, of weight m / (c(h) + m), to h', so that what follows each state sums to 1. The
    empty context, where no failure arc leads on, has an arc on every token: p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). An arc leads to the longest
    state that ends what was read.
    """

    def __init__(self, total: int, kinds: int, priors: tuple):
        self.total, self.kinds, self.priors = total, kinds, priors

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def walk(self, seen: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """log10 probability of every token, 0 of starts, of all texts of a block in one traversal.

        The state before a token is the longest context that was seen, which is where the arcs lead: it is taken from the counts of the tokens' n-grams, all
        tokens at once, and so carries from each token to the next what a walk along the arcs would.

        seen[k]: count in training of the k + 1 tokens that end at each token, 0 where they reach beyond the text's start; place: each token's place in
        its text, 0 for the start.
        """
        n, order = len(place), len(seen)
        # the state that the tokens before lead to: its length, and the counts of it and all its suffixes
        context = [np.full(n, self.total), *(np.where(place >= k, np.roll(seen[k - 1], 1), 0) for k in range(1, order))]
        state = np.zeros(n, np.int64)
        for k in range(1, order):
            state[context[k] > 0] = k  # a context is seen only if its suffixes are
        # arcs' probabilities, from the empty context up
        arc = [self.base(seen[0])]
        for k, prior in zip(range(1, order), self.priors):
            arc.append(np.where(context[k] > 0, (seen[k] + prior * arc[-1]) / (context[k] + prior), arc[-1]))
        # failure arcs, from the state on until there is an arc on the token
        out = np.zeros(n)
        for k in range(order - 1, 0, -1):
            fails = (state == k) & (seen[k] == 0)
            out[fails] += np.log10(self.priors[k - 1] / (context[k][fails] + self.priors[k - 1]))
            state[fails] -= 1
        for k in range(order):
            here = state == k
            out[here] += np.log10(arc[k][here])
        return np.where(place > 0, out, 0.0)


class Block:
    """The tokens of a block's documents, starts and ends included, as places in its sorted distinct words, and their n-grams."""

    def __init__(self, words: np.ndarray, word_at: np.ndarray, lengths: np.ndarray, held: np.ndarray):
        self.words, self.word_at, self.lengths = words, word_at, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.train = np.repeat(~held, lengths)
        self.place = np.arange(len(word_at)) - np.repeat(self.starts, lengths)
        self.tokens = words[word_at]

    @staticmethod
    def read(row: dict) -> Block:
        return Block(np.cumsum(_numbers(row["words"], np.uint64), dtype=np.uint64), _numbers(row["word_at"], np.uint32), _numbers(row["lengths"], np.uint32).astype(np.int64), np.frombuffer(row["held"], bool))

    def grams(self, order: int) -> np.ndarray:
        """Keys of the n-grams that end at each token; without meaning where ``place`` is less than order - 1."""
        keys = np.roll(self.tokens, order - 1)
        for k in range(order - 2, -1, -1):
            keys = arc_keys(keys, np.roll(self.tokens, k))
        return keys


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: small where their high bytes are alike. Their count comes first."""
    raw = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(packed[:8], "little")
    raw = pa.Codec("zstd").decompress(packed[8:], n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 1; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 1, F.lit(False))


def _count_of(packed: str) -> Column:
    """How many numbers ``_planes`` packed: its first bytes, the lowest first."""
    byte = lambda i: F.conv(F.hex(F.substring(packed, i + 1, 1)), 16, 10).cast("bigint")
    return byte(0) + byte(1) * 2**8 + byte(2) * 2**16 + byte(3) * 2**24


def blocks_of(rows: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, ids, held, lengths, words, word_at, n) from (id, held, text): a row for each run of documents with about so many tokens, or one longer text.

    Documents stay in the order in which they are read, so equal ones don't meet. Words are sorted hashes, word_at the tokens' places among them.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, docs, size, block = [], [], [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate(docs), return_inverse=True)
            parts = [np.array(held, bool).tobytes(), _planes(np.array([len(d) for d in docs], np.uint32)), _planes(np.diff(words, prepend=np.uint64(0))), _planes(at.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), *(pa.array([p], pa.binary()) for p in parts), pa.array([size], pa.int64())], names=names)

        names = ["block", "ids", "held", "lengths", "words", "word_at", "n"]
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, h, text in zip(*(c for c in batch.columns)):
                doc = token_hashes(text.as_py())
                if docs and size + len(doc) > tokens:
                    yield row()
                    ids, held, docs, size, block = [], [], [], 0, block + 1
                ids.append(i.as_py())
                held.append(h.as_py())
                docs.append(doc)
                size += len(doc)
        if docs:
            yield row()

    return rows.select("id", "held", "text").mapInArrow(cut, f"block bigint, ids array<{kind}>, held binary, lengths binary, words binary, word_at binary, n bigint")


_MESSAGE = "bucket bigint, block bigint, gram int, keys binary, counts binary, held binary"
_ANSWER = "block bigint, bucket bigint, gram int, totals binary, places binary, tokens bigint, kinds bigint"


def _message(block: int, order: int, keys: np.ndarray, train: np.ndarray, bits: int, last: bool) -> pa.Table:
    """What a block tells each bucket: its distinct n-grams, how many of each it holds in training texts and, but of the last order, in others."""
    keys, at = np.unique(keys, return_inverse=True)
    counts, other = (np.bincount(at[v], minlength=len(keys)).astype(np.uint32) for v in (train, ~train))
    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    out: list[tuple] = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        out.append((b, block, order, _planes(np.diff(keys[part], prepend=np.uint64(0))), _planes(counts[part]), None if last else _planes(other[part])))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["bucket", "block", "gram", "keys", "counts", "held"])


def _add_up(key: tuple, asked: pa.Table) -> pa.Table:
    """A bucket's answers to each block, its n-grams in the order in which it sent them: counts in training, and whether at two places or more of all texts.

    Of words, the tokens and kinds learned are told too, as order 0.
    """
    out: list[tuple] = []
    order, last = asked.column("gram")[0].as_py(), asked.column("held")[0].as_py() is None
    keys = [np.cumsum(_numbers(x.as_py(), np.uint64), dtype=np.uint64) for x in asked.column("keys")]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    # exact: sums stay far below 2^53
    add = lambda c: np.bincount(back, np.concatenate([_numbers(x.as_py(), np.uint32) for x in asked.column(c)]), len(distinct)).astype(np.uint64)
    total = add("counts")
    twice = None if last else total + add("held") >= 2
    lo = 0
    for block, k in zip(asked.column("block").to_pylist(), keys):
        mine = back[lo : lo + len(k)]
        out.append((block, key[0].as_py(), order, _planes(total[mine]), None if last else np.packbits(twice[mine]).tobytes(), None, None))
        lo += len(k)
    if order == 1:
        word = distinct != START
        out.append((-1, key[0].as_py(), 0, None, None, int(total[word].sum()), int((total[word] > 0).sum())))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["block", "bucket", "gram", "totals", "places", "tokens", "kinds"])


def _climb(block: Block, known: pa.Table, order: int, counts: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which tokens end an n-gram of order + 1 to ask for, counts in training of the n-grams up to ``order`` that end at each token).

    An n-gram is asked for only if both its n-grams of an order less stand at two places or more of all texts. Else its place is the only
    one there is: its count is 1 in a training text and 0 elsewhere. All blocks judge so by the same counts, so whoever holds an n-gram that is asked for tells of it.
    """
    gram = known.column("gram").to_numpy()
    ask, seen = np.ones(len(block.place), bool), []
    for k in range(1, order + 1):
        own = known.filter(pa.array(gram == k)).sort_by("bucket")
        back = block.word_at if k == 1 else np.unique(block.grams(k)[ask], return_inverse=True)[1]
        if counts:
            c = np.where(block.place >= k - 1, block.train, 0).astype(np.float64)
            totals = [_numbers(x.as_py(), np.uint64) for x in own.column("totals")]
            c[ask] = np.concatenate(totals)[back] if totals else 0
            seen.append(c)
        if k == order and counts:
            return ask, seen
        sizes = own.column("n").to_pylist()
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(own.column("places"), sizes)]
        twice = np.zeros(len(block.place), bool)
        twice[ask] = np.concatenate(bits)[back] if bits else False
        ask = (block.place >= k) & twice & np.roll(twice, 1)
    return ask, seen


def own_counts(block: Block, seen: list[np.ndarray]) -> list[np.ndarray]:
    """How many of its n-gram each token's own text holds, for each order; 0 in texts that teach nothing. What is counted once in all is the text's own."""
    owner = np.repeat(np.arange(len(block.lengths), dtype=np.uint64), block.lengths)
    out = []
    for k, counts in enumerate(seen, 1):
        own = (block.train & (block.place >= k - 1)).astype(np.uint32)
        many = (own > 0) & (counts > 1)
        _, back, n = np.unique(arc_keys(block.grams(k)[many], owner[many]), return_inverse=True, return_counts=True)
        own[many] = n[back]
        out.append(own)
    return out


class Known:
    """What is known of a block's documents: the counts in training of the n-grams that end at each of their tokens."""

    def __init__(self, row: dict):
        self.held, self.lengths = np.frombuffer(row["held"], bool), _numbers(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(self.lengths.sum()) - np.repeat(self.starts, self.lengths)
        self.seen = [_numbers(x, np.uint64).astype(np.float64) for x in row["seen"]]
        self.own = [_numbers(x, np.uint32) for x in row["own"]]

    def try_weights(self, found: tuple, tokens: int, kinds: int, grid: tuple = GRID) -> list[tuple[float, float]]:
        """(weight, log10 likelihood) for each weight of the grid of the next longer context, on top of those found for shorter ones.

        Likelihoods are of the training texts, each by what is learned from all others, and of the tokens alone whose context is known: the others' don't depend on the weight.
        """
        real = np.repeat(~self.held, self.lengths) & (self.place > 0)
        if not real.any():
            return []
        left = [seen - own for seen, own in zip(self.seen, self.own)]  # counts without the text itself
        p = ((left[0] + 0.5) / (tokens - np.repeat(self.lengths - 1, self.lengths) + 0.5 * (kinds + 1)))[real]
        for k, weight in enumerate((*found, None), 1):
            context = np.where(self.place >= k, np.roll(left[k - 1], 1), 0)[real]
            here = context > 0
            c, n = left[k][real][here], context[here]
            if weight is None:
                return [(w, float(np.log10((c + w * p[here]) / (n + w)).sum())) for w in grid]
            p[here] = (c + weight * p[here]) / (n + weight)


def score(docs: DataFrame, held: Column | None = None, priors: tuple | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, order: int = ORDER) -> DataFrame:
    """(id_col, held_out boolean, n_tokens, n_known, train_tokens, all bigint, base_score double, score double) for every row of ``docs``.

    The model learns from rows that are not ``held`` (default: ``held_out``). Its longest n-grams have ``order`` tokens, and the weights of its failure arcs are those of ``GRID`` under which
    all training texts are likeliest, each by the counts of all others, one length of context after the other; or they are ``priors``, one fewer than the order. base_score is
    the unigram model's log10 probability of the text, score that of the backoff automaton. Null and empty texts are the end token alone. Repeated
    rows teach and are scored each. With nothing to learn from, all counts are 0. Other columns are not read. No rows give no rows.

    Nothing of the model is sent whole anywhere: each block of documents asks for the counts of its own distinct n-grams, a bucket of n-grams adds up what
    all blocks hold of them, and its answers go back to the blocks. Orders are asked for one after the other, as what is known of one makes most of the
    next unnecessary, see ``_climb``. Messages are at most one for each block and n-gram, however many blocks and buckets there are.
    """
    order = order if priors is None else len(priors) + 1
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (held_out(id_col) if held is None else held).alias("held"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = materialize(blocks_of(rows, block_tokens))
    bits = max(2, int((blocks.agg(F.sum("n")).first()[0] or 0) // bucket_tokens).bit_length())

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                yield from _message(row["block"], 1, block.tokens, block.train, bits, order == 1).to_batches()

    def ask_longer(k: int):
        def ask(key: tuple, some: pa.Table, known: pa.Table) -> pa.Table:
            if not some.num_rows:
                return _message(0, k, np.zeros(0, np.uint64), np.zeros(0, bool), bits, k == order)
            block = Block.read(some.to_pylist()[0])
            at, _ = _climb(block, known, k - 1, False)
            return _message(key[0].as_py(), k, block.grams(k)[at], block.train[at], bits, k == order)

        return ask

    def gather(key: tuple, some: pa.Table, known: pa.Table) -> pa.Table:
        kinds_of = (pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        ids, told = some.column("ids").combine_chunks(), []
        if some.num_rows:
            row = some.drop_columns("ids").to_pylist()[0]
            block = Block.read(row)
            seen = _climb(block, known, order, True)[1]
            own = own_counts(block, seen) if priors is None else []
            told = [(row["held"], row["lengths"], [_planes(c.astype(np.uint64)) for c in seen], [_planes(c) for c in own])]
        return pa.table([ids, *(pa.array([t[k] for t in told], kind) for k, kind in enumerate(kinds_of))], names=["ids", "held", "lengths", "seen", "own"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tried = Known(row.to_pylist()[0]).try_weights(weights, tokens, kinds)
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in tried], pa.float64()) for k in range(2)], names=["weight", "likelihood"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Automaton(tokens, kinds, weights)
        for row in rows_of(batches):
            known = Known(row.select(["held", "lengths", "seen"]).to_pylist()[0] | {"own": []})
            real = known.place > 0
            sums = [np.add.reduceat(np.where(real, v, 0), known.starts) for v in ((known.seen[0] > 0).astype(np.int64), np.log10(model.base(known.seen[0])), model.walk(known.seen, known.place))]
            columns = [row.column("ids").flatten(), pa.array(known.held), pa.array(known.lengths - 1), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held", "n_tokens", "n_known", "base_score", "score"])

    asked, answers = blocks.drop("ids", "n").mapInArrow(ask_words, _MESSAGE), None
    written = [blocks]
    for k in range(1, order + 1):
        if k > 1:
            bare = answers.withColumn("totals", F.lit(None).cast("binary"))
            asked = blocks.drop("ids", "n").groupBy("block").cogroup(bare.groupBy("block")).applyInArrow(ask_longer(k), _MESSAGE)
        more = materialize(asked.groupBy("bucket").applyInArrow(_add_up, _ANSWER))
        written.append(more)
        if k == 1:
            sums = more.filter("gram = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
            tokens, kinds = int(sums[0]), int(sums[1])
        more = more.filter("gram > 0").select("block", "bucket", "gram", "totals", "places", _count_of("totals").alias("n"))
        answers = more if answers is None else answers.unionByName(more)
    # from here on nothing is shuffled: the weights are fitted, and texts scored, by what each block has gathered
    gathered = materialize(
        blocks.drop("n").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, f"ids array<{id_type}>, held binary, lengths binary, seen array<binary>, own array<binary>")
    )
    for done in written:
        release(done)
    weights = priors or ()
    while len(weights) < order - 1:
        found = gathered.drop("ids").mapInArrow(fit, "weight double, likelihood double").groupBy("weight").agg(F.sum("likelihood").alias("likelihood"))
        best = found.agg(F.max_by("weight", F.struct("likelihood", -F.col("weight")))).first()[0]
        weights = (*weights, 1.0 if best is None else best)
    told = gathered.mapInArrow(tell, f"id {id_type}, held boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return told.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
