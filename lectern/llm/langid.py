"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the counts
of the bytes that follow. The code length of a byte is that of the longest
known context; where the byte hasn't followed it, the escape's cost is added
and the next shorter context is tried, down to 8 bits for any byte (escape
method C). The counts are frozen after learning, so a byte's cost depends on
itself and its context alone, and every distinct (context, byte) is priced once
in a worker. The language whose code for the whole text is shortest wins.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded, extended, sliced, tidy, utf8

ORDER = 3
#: Bounds of the learning sample: texts of a language, and bytes of a text that may be one of them.
SAMPLE_TEXTS = 300
SAMPLE_BYTES = 65_536
SHARES = 64
#: A text counts as no language if its bits a byte exceed TIMES those of texts held out from its language's sample,
#: and that by SIGMAS standard errors of a text of its length.
#: One whose code is shorter than its bytes as they are is never noise.
TIMES, SIGMAS, RAW = 3.0, 8.0, 8.0
PIECE = 1 << 20
#: Distinct byte pairs that a worker's price table is made for.
PAIRS = 4096

Model = list[tuple[np.ndarray, ...]]


def _grams(data: bytes, k: int) -> np.ndarray:
    """Every k-gram of the bytes as a number, one ending at each byte from the ORDER-th on."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(x) - ORDER
    out = np.zeros(n, np.uint32)
    for i in range(ORDER + 1 - k, ORDER + 1):
        out = out << np.uint32(8) | x[i : i + n]
    return out


def learn(texts: list[bytes]) -> Model:
    """For each context length: grams and their counts, contexts with occurrences and distinct followers."""
    padded = [b" " * ORDER + t.lower() for t in texts]
    model = []
    for k in range(ORDER + 1):
        grams, counts = np.unique(np.concatenate([_grams(p, k + 1) for p in padded]), return_counts=True)
        contexts, first, followers = np.unique(grams >> np.uint32(8), return_index=True, return_counts=True)
        model.append((grams, counts, contexts, np.add.reduceat(counts, first), followers))
    return model


def price(model: Model, grams: np.ndarray) -> np.ndarray:
    """Bits of each gram's last byte after its other bytes."""
    bits = np.full(len(grams), 8.0)
    for k, (known, counts, contexts, total, followers) in enumerate(model):
        g = grams & np.uint32((1 << 8 * (k + 1)) - 1)
        c = g >> np.uint32(8)
        at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
        seen = contexts[at] == c
        n, u = total[at], followers[at]
        to = np.minimum(np.searchsorted(known, g), len(known) - 1)
        hit = known[to] == g
        bits = np.where(seen, np.log2(n + u) - np.log2(np.where(hit, counts[to], u)) + np.where(hit, 0.0, bits), bits)
    return bits


class Scorer:
    """Code lengths of texts under several models."""

    def __init__(self, models: list[Model]):
        self.models = models
        self._reset()

    def _reset(self) -> None:
        self.pair = np.full(1 << 16, -1, np.int32)
        self.pairs = 0
        self.at = np.zeros(PAIRS * PAIRS, np.int32)  # rows from 1; untouched pages take no memory
        self.rows = np.zeros((1, len(self.models)))

    def _prices(self, grams: np.ndarray) -> np.ndarray:
        """Row of prices for each gram, by a table over pairs of byte pairs."""
        high, low = grams >> np.uint32(16), grams & np.uint32(0xFFFF)
        seen = np.zeros(1 << 16, bool)
        seen[high] = seen[low] = True
        new = np.flatnonzero(seen & (self.pair < 0))
        if self.pairs + len(new) > PAIRS:
            self._reset()
            new = np.flatnonzero(seen)
            if len(new) > PAIRS:
                distinct, back = np.unique(grams, return_inverse=True)
                return np.stack([price(m, distinct) for m in self.models], axis=1)[back]
        self.pair[new] = np.arange(self.pairs, self.pairs + len(new))
        self.pairs += len(new)
        cell = self.pair[high] * np.int32(PAIRS) + self.pair[low]
        row = self.at[cell]
        lacking = row == 0
        if lacking.any():
            cells, first = np.unique(cell[lacking], return_index=True)
            fresh = grams[lacking][first]
            self.at[cells] = np.arange(len(self.rows), len(self.rows) + len(cells))
            self.rows = np.concatenate([self.rows, np.stack([price(m, fresh) for m in self.models], axis=1)])
            row = self.at[cell]
        return self.rows[row]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """One row of total bits for each text, one column for each model."""
        out = np.zeros((len(texts), len(self.models)))
        held, size = [], 0
        for k, t in enumerate(texts):
            t = b" " * ORDER + t.lower()
            for a in range(0, len(t) - ORDER, PIECE):
                piece = t[a : a + PIECE + ORDER]
                held.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    self._add(out, held)
                    held, size = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, bytes]]) -> None:
        grams = np.concatenate([_grams(p, ORDER + 1) for _, p in held])
        starts = np.cumsum([0, *[len(p) - ORDER for _, p in held[:-1]]])
        np.add.at(out, [k for k, _ in held], np.add.reduceat(self._prices(grams), starts, axis=0))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 4


def without_noise(texts: list[bytes], times: float = TIMES) -> tuple[list[bytes], tuple[float, float] | None]:
    """(texts that are no noise, mean and variance of the bits of their bytes).

    Each half of the texts is priced by a model of the other. A text is noise if
    its bits a byte are more than `times` the texts' median. One text alone
    can't be judged.
    """
    halves = [texts[0::2], texts[1::2]]
    if not halves[1]:
        return texts, None
    priced = []
    for model, own in ((learn(halves[0]), halves[1]), (learn(halves[1]), halves[0])):
        priced += [(t, price(model, _grams(b" " * ORDER + t.lower(), ORDER + 1))) for t in own]
    most = times * float(np.median([bits.mean() for _, bits in priced]))
    kept = [(t, bits) for t, bits in priced if bits.mean() <= most]
    bits = np.concatenate([b for _, b in kept])
    return [t for t, _ in kept], (float(bits.mean()), float(bits.var()))


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> dict[str, Model]:
    """A model for each lang, from `texts` documents of it with the smallest hashes.

    Documents without text, lang or doc_id, and those held out don't count. Of a
    text of more than most_bytes bytes a window of most_bytes // 4 characters
    counts, from a place that the hash gives.
    """
    return {lang: model for lang, (model, _) in _fit(docs, texts, most_bytes).items()}


def _fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES, judge: bool = False) -> dict[str, tuple[Model, tuple[float, float] | None]]:
    """fit()'s models; or, if the samples are to be judged, models without their noise, and the rates of held-out texts."""
    known = docs.where((_remainder() != 2) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    # first within shares of a language, so that no task ranks more than its share of a common one
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    for share in (["lang", F.pmod("h", F.lit(SHARES))], ["lang"]):
        order = Window.partitionBy(*share).orderBy("h", "doc_id")
        ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= texts).drop("r")
    ids = ids.select("doc_id", "lang")
    # `texts` ids of each language, and as many models come to the driver anyway
    width = most_bytes // 4
    start = F.pmod(F.xxhash64("doc_id"), F.length("text") - width + 1).cast("int") + 1
    text = F.when(F.octet_length("text") <= most_bytes, F.col("text")).otherwise(F.substring("text", F.when(F.length("text") > width, start).otherwise(1), F.lit(width)))
    sample = known.select("doc_id", "lang", text.alias("text")).join(F.broadcast(ids.distinct()), ["doc_id", "lang"], "left_semi")

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        own, rate = sorted(map(utf8, pdf["text"])), None
        if judge:
            own, rate = without_noise(own)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "model": [pickle.dumps((learn(own), rate))]})

    rows = sample.groupBy("lang").applyInPandas(learned, "lang string, model binary").collect()
    return {r.lang: pickle.loads(bytes(r.model)) for r in sorted(rows, key=lambda r: r.lang)}


def predict(docs: DataFrame, models: dict[str, Model], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for each row of docs, and as __name the columns in `keep`.

    lang_pred is the language with the shortest code, of equals the one that
    sorts first; score is its probability if all are as likely beforehand. A
    text that is null or has no letter, or any text if nothing was learned, is
    `und` with score 0. held_out is false for a null doc_id. Whole texts count.
    """
    names = sorted(models)
    shared = docs.sparkSession.sparkContext.broadcast([models[n] for n in names])
    held = F.coalesce(_remainder() == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", *[F.col(c).alias(f"__{c}") for c in keep])
    types = dict(rows.dtypes)
    passed = ["doc_id", "held_out", *[f"__{c}" for c in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if names else None
        for part, texts in sliced(batches):
            own = [utf8(t) for t in texts]
            some = [k for k, t in enumerate(texts) if names and has_letter(t)]
            lang, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            bits = scorer.bits([own[k] for k in some]) if some else []
            for k, b in zip(some, bits, strict=True):
                best = int(np.argmin(b))
                lang[k] = names[best]
                score[k] = 1.0 / float(np.exp2(np.maximum(b[best] - b, -1000.0)).sum())
                rate[k] = float(b[best]) / len(own[k])
            yield extended(part, passed, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()), bits_per_byte=pa.array(rate, pa.float64()))

    schema = ", ".join(f"`{c}` {types[c]}" for c in passed) + ", lang_pred string, score double, bits_per_byte double"
    return bounded(rows).mapInArrow(tidy(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """fit() and predict() on the same docs."""
    return predict(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def reject_unknown(docs: DataFrame, least_score: float = 0.5, times: float = TIMES, sigmas: float = SIGMAS) -> DataFrame:
    """The rows of docs in a language learned from docs: not `und`, not doubtful, not noise by its code length.

    What is noise follows from texts held out from each language's sample: a
    text of n bytes is if its bits a byte exceed `times` their mean by `sigmas`
    times the square root of (variance of a byte's bits / n), so that a short
    text with a number or an address in it stays; so does one coded in fewer
    than RAW bits a byte. With one learned text of a language there is nothing
    to compare with, and only the score decides.
    """
    fitted = _fit(docs, judge=True)
    found = predict(docs, {lang: model for lang, (model, _) in fitted.items()}, keep=tuple(docs.columns))
    most = F.lit(float("inf"))
    for lang, (_, rate) in fitted.items():
        if rate:
            bound = rate[0] * times + sigmas * F.sqrt(F.lit(rate[1]) / F.octet_length("__text"))
            most = F.when(F.col("lang_pred") == lang, F.greatest(bound, F.lit(RAW))).otherwise(most)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score) & (F.col("bits_per_byte") <= most))
    return found.select(*[F.col(f"__{c}").alias(c) for c in docs.columns])
