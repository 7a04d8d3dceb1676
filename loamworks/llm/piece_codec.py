"""Exact encoding with SentencePiece models of the merge type by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from loamworks.llm.shared import Memo, worker_store

MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model's format
MEMO, PAIRS, LONGEST = 300_000, 200_000, 64


def read_model(path: str) -> dict:
    """The parts of a model file that encoding and decoding need. Raises ValueError for models that are not of the merge type with plain normalisation."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only merge-type models with identity normalisation and escaped spaces")
    if model.trainer_spec.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
        raise ValueError("only models with byte fallback, spaces as prefixes and no user-defined pieces")
    return {"pieces": [(p.piece, p.score, p.type) for p in model.pieces], "prefix": norm.add_dummy_prefix}


class PieceCodec:
    """Encodes and decodes as the library does, without begin and end ids and without sampling."""

    def __init__(self, model: dict):
        self.pieces, self.prefix = model["pieces"], model["prefix"]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = {p: (i, s) for i, (p, s, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.runs = {len(p): i for p, (i, _) in normal.items() if set(p) == {MARK}}
        self.chars = set("".join(normal))
        merged = {p: s for p, (_, s) in normal.items() if len(p) > 1 and set(p) != {MARK}}
        if any(MARK in p[1:] for p in merged) or len(set(merged.values())) < len(merged) or any(normal["".join([MARK] * n)][1] >= min(merged.values()) for n in self.runs if n > 1):
            raise ValueError("spaces inside pieces, equal scores, or runs of spaces that merge before words")
        # tokens: single characters first (rank -1), then merged pieces in the order in which they merge
        order = sorted(merged, key=lambda p: -merged[p])
        self.text = [*sorted(self.chars), *order]
        n = len(self.chars)
        self.rank = [-1] * n + list(range(len(order)))
        token = {t: k for k, t in enumerate(self.text)}
        self.left, self.right, self.pair = list(range(len(self.text))), list(range(len(self.text))), {}
        reachable = [True] * n + [False] * len(order)
        for k in range(n, len(self.text)):
            parts = self._merge_all([token[c] for c in self.text[k]], token, stop=k)
            if len(parts) == 2 and self.text[parts[0]] + self.text[parts[1]] == self.text[k]:
                self.left[k], self.right[k] = parts
                self.pair[parts[0], parts[1]] = self.rank[k]
                reachable[k] = True
        self.auto = ahocorasick.Automaton()
        for k, t in enumerate(self.text):
            if reachable[k]:
                self.auto.add_word(t, (k, len(t)))
        self.auto.make_automaton()
        self.shorter = [-1] * len(self.text)
        for k, t in enumerate(self.text):
            self.shorter[k] = next((token[t[:m]] for m in range(len(t) - 1, 0, -1) if t[:m] in token and reachable[token[t[:m]]]), -1)
        self.size = [len(t) for t in self.text]
        self.ids = [[normal[t][0]] if t in normal else [self.bytes[b] for b in t.encode()] for t in self.text]
        self.listed = [",".join(map(str, ids)) for ids in self.ids]
        self.spelled = [self.decode_marked(ids).replace(MARK, " ") for ids in self.ids]
        self.fits = Memo(lambda ab: self.compatible(*ab), PAIRS)
        self.spaced = Memo(lambda w: self._render(MARK + w), MEMO)
        self.plain = Memo(self._render, MEMO // 4)

    def _merge_all(self, parts: list[int], token: dict[str, int], stop: int) -> list[int]:
        """Merges by rank, leftmost first, of pieces that rank before ``stop``: how a piece comes about."""
        while True:
            best = min(((k, i) for i in range(len(parts) - 1) if (k := token.get(self.text[parts[i]] + self.text[parts[i + 1]], stop)) < stop), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [best[0]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: re-merging never joins anything across their boundary."""
        rank, limit = self.rank, len(self.text)
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:  # a was merged last: go back to its right part
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _word(self, text: str) -> list[int]:
        """Tokens of a text of known characters without runs of spaces, by backtracking over longest matches."""
        size, shorter, fits, n = self.size, self.shorter, self.fits, len(text)
        longest = [-1] * n
        for end, (k, length) in self.auto.iter(text):
            longest[end - length + 1] = k  # ends ascend, so the longest match from a place is the last
        failed = bytearray((n >> 3) + 1)  # bit i: no way on from place i
        out: list[int] = []
        at, k = 0, longest[0] if n else -1
        while at < n:
            while k >= 0:
                end = at + size[k]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1], k]):
                    break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at = end
                k = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                k = out.pop()
                at -= size[k]
        return out

    def _run(self, n: int) -> list[int]:
        """Ids of n spaces in a row: equal scores merge leftmost first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[k] for k in stack] if self.runs else [self.bytes[b] for b in (MARK * n).encode()]

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already marked."""
        ids: list[int] = []
        for part in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text):
            word = part.lstrip(MARK)
            spaces = len(part) - len(word)
            known, run = [], []  # runs of known characters with an unknown one between each two
            for c in MARK[: min(spaces, 1)] + word:
                if c in self.chars:
                    run.append(c)
                else:
                    known += ["".join(run), c]
                    run = []
            known.append("".join(run))
            first = self._word(known[0]) if known[0] else []
            if spaces > 1:  # the words' merges come first; the spaces that they leave merge among themselves
                free = spaces if first and self.text[first[0]] == MARK else spaces - 1
                ids += self._run(free)
                first = first[1:] if free == spaces else first
            elif spaces and first and self.text[first[0]] == MARK:
                ids += self._run(1)
                first = first[1:]
            for k in first:
                ids += self.ids[k]
            for c, more in zip(known[1::2], known[2::2]):
                ids += [self.bytes[b] for b in c.encode()]
                for k in self._word(more) if more else ():
                    ids += self.ids[k]
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return self.encode_marked((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def decode_marked(self, ids: list[int]) -> str:
        """The text of ids, marks for spaces; bytes that form no character become U+FFFD each."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del raw[:n]
            if i is not None and self.pieces[i][2] != CONTROL:
                out.append(self.pieces[i][0] if self.pieces[i][2] == NORMAL else " ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_marked(ids).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def _render(self, marked: str) -> tuple[str, str]:
        if self.chars.issuperset(marked) and marked.rfind(MARK) <= 0 and marked != MARK:
            tokens = self._word(marked)
            return ",".join([self.listed[k] for k in tokens]), "".join([self.spelled[k] for k in tokens])
        ids = self.encode_marked(marked)
        return ",".join(map(str, ids)), self.decode_marked(ids).replace(MARK, " ")

    def rendered(self, text: str) -> list[tuple[str, str]]:
        """(comma-joined ids, decoded text) of parts of a text that no piece spans; words are remembered.

        Pieces hold a mark only at their start, and no piece holds a line feed: parts end before spaces and around line feeds.
        """
        if not text:
            return []
        if "\n" in self.chars or not self.prefix:
            return [self._render((MARK if self.prefix else "") + text.replace(" ", MARK))]
        out: list[tuple[str, int, str]] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.plain["\n"])
            if not i and line[:1] == " " or "  " in line or MARK in line or len(line) > LONGEST and " " not in line:
                out += map(self._render, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK[i:] + line.replace(" ", MARK)))
                continue
            first, *words = line.split(" ")
            if not i:
                out.append(self.spaced[first])
            elif first:
                out.append(self.plain[first])
            if len(line) > 100_000 and max(map(len, words), default=0) > LONGEST:  # keeps the memory of words small
                out += [self.spaced[w] if len(w) <= LONGEST else self._render(MARK + w) for w in words]
            else:
                out += map(self.spaced.__getitem__, words)
        return out


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens bigint, ids_sha256, decoded_sha256[, ids array<int>]) for every row of ``docs``.

    Whole texts are encoded; a null text is an empty one, which has no ids. ids_sha256 digests the decimal ids joined by commas, and
    decoded_sha256 the text that decoding those ids gives, in UTF-8. The model is read once, on the driver: its size is bounded. Null
    and repeated ids are passed on; other columns are not read. No rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if (at := f"pieces {model_path}") not in store:
            store[at] = PieceCodec(model.value)
        codec = store[at]
        for batch in batches:
            n, ids, back, lists = [], [], [], []
            for x in batch.column(1):
                parts = codec.rendered(x.as_py() or "")
                joined = ",".join([p[0] for p in parts])
                text = "".join([p[1] for p in parts])
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256((text[1:] if codec.prefix and text[:1] == " " else text).encode()).hexdigest())
                if with_ids:
                    lists.append([int(v) for v in joined.split(",")] if joined else [])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
