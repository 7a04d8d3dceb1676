"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm.shared import materialize

#: n-grams kept of a language and of a document, and the labelled documents of each language that the profiles are fitted on, about.
PROFILE, DOC_GRAMS, SAMPLE = 500, 400, 4000
#: Labels whose profiles are sent to the tasks at once, about; more are compared block after block.
LABELS = 2000
#: Shares of labels are sent to all tasks up to so many labels (some 30 bytes each); more are joined.
SENT = 100_000
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_SPACE = ord(" ")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the 1- to 3-grams of a text, lower-cased, with runs of anything but letters as one space and a space at both ends.

    A code holds up to three code points of 21 bits. N-grams that are only a space, or have one between letters, are left out.
    """
    clean = f" {_OTHER.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    gap = c == _SPACE
    two = (c[:-1] << 21 | c[1:])[~(gap[:-1] & gap[1:])]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[~gap[1:-1]]
    return np.unique(np.concatenate([c[~gap], two, three]), return_counts=True)


def top_grams(text: str, n: int) -> np.ndarray:
    """Codes of the n most frequent n-grams, ties by code."""
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:n]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profiles(docs: DataFrame, size: int = PROFILE, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(label, code, place): the most frequent n-grams of each label, from place 1 on; rows with a null text or label teach nothing.

    Fitted on about ``sample`` documents of each label, all if there are fewer: those whose hashed id falls below a share. So what is counted is bounded.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    share = materialize(known.groupBy("label").agg((F.lit(float(sample)) / F.count("*")).alias("share")))
    chance = F.pmod(F.xxhash64("id", F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(F.broadcast(share) if share.count() <= SENT else share, "label").filter(chance < F.col("share")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums.setdefault(label, []).append(grams(text.as_py()))
            for label, found in sums.items():
                codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes)), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["label", "code", "n"])

    totals = picked.mapInArrow(count, "label string, code bigint, n bigint").groupBy("label", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "code"))
    return totals.withColumn("place", place).filter(F.col("place") <= size).select("label", "code", "place")


class Ranks:
    """Out-of-place distances of documents to the profiles of some labels at once."""

    def __init__(self, found: dict[str, np.ndarray], most: int | None = None):
        """found: codes by label, from the most frequent on; most: the length of the longest profile of all labels, of these by default."""
        self.labels = sorted(found)
        self.most = most or max(map(len, found.values()), default=0)
        self.codes = np.unique(np.concatenate([*found.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.labels), len(self.codes) + 1), -1, np.int64)
        for i, label in enumerate(self.labels):
            self.rank[i, np.searchsorted(self.codes, found[label])] = np.arange(len(found[label]))

    def predict(self, text: str | None, n: int = DOC_GRAMS, best: tuple[str, float] = (UNKNOWN, 0.0)) -> tuple[str, float]:
        """(label, score): the nearest profile, the first by name if several are; score 1 - distance / largest possible distance. ``best``: what other labels gave."""
        if not self.labels or not has_letter(text):
            return best
        own = top_grams(text, n)
        if not len(own):
            return best
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        rank = self.rank[:, at]
        away = np.where(rank < 0, self.most, np.minimum(np.abs(rank - np.arange(len(own))), self.most)).sum(1)
        nearest = int(away.argmin())
        found = self.labels[nearest], float(1 - away[nearest] / (self.most * len(own)))
        return found if best[0] == UNKNOWN else min(best, found, key=lambda x: (-x[1], x[0]))


def held_out(id_col: str = "doc_id", folds: int = 3) -> Column:
    """Whether crc32 of the id as text leaves 1; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 1, F.lit(False))


def predict(docs: DataFrame, teach: DataFrame | None = None, size: int = PROFILE, sample: int = SAMPLE, n: int = DOC_GRAMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id_col, held_out boolean, lang_pred, score double) for every row, or, with ``keep``, all columns of ``docs`` with lang_pred and score, called ``names``.

    Profiles are learned from ``teach``, or else from the rows of ``docs`` that are not held out. Only the text is used to predict. A text that
    is null, empty or without letters is `und` with score 0, as is every text if nothing teaches. Repeated rows are predicted each.
    Columns called as ``names`` are replaced. No rows give no rows.
    """
    learned = materialize(profiles(docs.filter(~held_out(id_col)) if teach is None else teach, size, sample, id_col, text_col, label_col))
    labels, most = learned.agg(F.count_distinct("label"), F.max("place")).first()
    if keep:
        rows = docs.select(*[c for c in docs.columns if c not in names])
    else:
        rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    rows = rows.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    blocks = max(1, -(-labels // LABELS))
    for b in range(blocks):
        found: dict[str, list] = {}
        for row in learned.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b).orderBy("label", "place").collect():  # LABELS profiles, about
            found.setdefault(row["label"], []).append(row["code"])
        rows = _nearest(rows, {k: np.array(v, np.int64) for k, v in found.items()}, most, n, text_col, names)
    return rows if keep else rows.drop(text_col)


def _nearest(rows: DataFrame, found: dict[str, np.ndarray], most: int | None, n: int, text_col: str, names: tuple[str, str]) -> DataFrame:
    """``rows`` with the columns ``names`` as they are after these profiles are compared too."""
    known = rows.sparkSession.sparkContext.broadcast((found, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ranks(*known.value)
        for batch in batches:
            text, best = batch.column(batch.schema.get_field_index(text_col)), [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            told = [model.predict(x.as_py(), n, tuple(was)) for x, *was in zip(text, *best)]
            more = {names[0]: pa.array([k for k, _ in told], pa.string()), names[1]: pa.array([s for _, s in told], pa.float64())}
            yield pa.RecordBatch.from_arrays([more.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
