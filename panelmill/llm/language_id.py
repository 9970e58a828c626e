"""Language identification by multilingual mixture inference (operator 4).

A text is a bag of byte trigrams of its lower-cased letters (runs of anything else are one
space), hashed to ``grams`` places. The model is one smoothed trigram distribution per
language, from counts over all training rows. A document's language proportions come from
expectation-maximisation over its trigrams. The language set is grown from the proportions of the
full mixture, largest first, and chosen by likelihood less ``penalty`` * log(trigrams) per language
beyond the first. The prediction is the largest proportion of the chosen mixture; that is the score.

Counting is one pass with one sparse row per task, language and trigram, summed by Spark. The driver and every
task hold languages x ``grams`` numbers, whatever the size of the corpus. Scoring is one pass without a shuffle.

A null text, or one without letters, is ``und`` with score 0; so is every text where nothing was
learned. Rows without language or text teach nothing. A null doc_id counts as the empty id. Repeated
rows are counted and scored each on their own; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import map_rows

#: Every ASCII byte that is no letter becomes a space.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def letters(text: str | None) -> bytes:
    """The text's letters, lower-cased, words set apart by single spaces, with one at each end."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "


def trigrams(data: bytes, grams: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = ((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - grams.bit_length() + 1)).astype(np.int64)


def count_grams(docs: DataFrame, grams: int) -> pa.Table:
    """(lang, gram, n) over all rows of ``docs`` that have text and language."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(letters(text))
            for lang, own in by_lang.items():
                # texts end and begin with a space, so the trigrams across two texts hold two spaces and are left out
                for data in own:
                    if lang not in counts:
                        counts[lang] = np.zeros(grams, np.int64)
                    counts[lang] += np.bincount(trigrams(data, grams), minlength=grams)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                ["lang", "gram", "n"])

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return (map_rows(rows, run, "lang string, gram int, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())


class Mixtures:
    """Smoothed trigram probabilities of the languages, and the mixture of a document."""

    def __init__(self, counts: pa.Table, grams: int, smoothing: float, penalty: float, steps: int):
        self.langs = sorted(set(counts.column("lang").to_pylist()))
        number = {x: i for i, x in enumerate(self.langs)}
        table = np.zeros((len(self.langs), grams))
        if counts.num_rows:
            rows = [number[x] for x in counts.column("lang").to_pylist()]
            table[rows, counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
        table += smoothing
        self.prob = (table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        self.grams, self.penalty, self.steps = grams, penalty, steps

    def fit(self, prob, count, doc, first, total, share, steps):
        """EM for all documents at once; share is (languages, documents), a zero stays zero."""
        for _ in range(steps):
            own = prob * share[:, doc]
            own *= count / own.sum(axis=0)
            share = np.add.reduceat(own, first, axis=1) / total
        likelihood = np.add.reduceat(count * np.log((prob * share[:, doc]).sum(axis=0)), first)
        return share, likelihood

    def infer(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and proportion of each text (every text has at least one trigram)."""
        grams = [trigrams(t, self.grams) for t in texts]
        n, sizes = len(texts), np.array([len(g) for g in grams], np.int64)
        owner = np.repeat(np.arange(n), sizes)
        key, count = _distinct(owner, np.concatenate(grams), n, self.grams)
        doc = key // self.grams
        count = count.astype(np.float32)
        prob = self.prob[:, key % self.grams]
        first = np.searchsorted(doc, np.arange(n))
        total = sizes.astype(np.float32)
        k = len(self.langs)
        share, _ = self.fit(prob, count, doc, first, total, np.full((k, n), 1 / k, np.float32), self.steps)
        rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
        price = self.penalty * np.log(np.maximum(total, 2))
        best, value = None, None
        for size in range(1, k + 1):
            start = np.where(rank < size, np.maximum(share, 1e-6), 0).astype(np.float32)
            start /= start.sum(axis=0)
            own, likelihood = self.fit(prob, count, doc, first, total, start, 0 if size == 1 else self.steps)
            worth = likelihood - (size - 1) * price
            if best is None:
                best, value = own, worth
                continue
            better = worth > value
            best[:, better], value[better] = own[:, better], worth[better]
        top = best.argmax(axis=0)
        return [self.langs[i] for i in top], np.clip(best[top, np.arange(n)], 0, 1).astype(float).tolist()


def _distinct(owner: np.ndarray, gram: np.ndarray, n: int, grams: int):
    """Distinct (text, gram) as one sorted key, with counts; bounded counting tables."""
    keys, counts = [], []
    at = np.searchsorted(owner, np.arange(0, n + 64, 64))
    for i in range(len(at) - 1):
        part = (owner[at[i]:at[i + 1]] - 64 * i) * grams + gram[at[i]:at[i + 1]]
        c = np.bincount(part, minlength=1)
        where = np.flatnonzero(c)
        keys.append(where + 64 * i * grams)
        counts.append(c[where])
    return np.concatenate(keys), np.concatenate(counts)


def predict(docs: DataFrame, grams: int = 1 << 14, smoothing: float = 0.5, penalty: float = 4.0,
            steps: int = 12) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    own = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    counts = count_grams(own.where("not held_out"), grams)
    model = docs.sparkSession.sparkContext.broadcast(Mixtures(counts, grams, smoothing, penalty, steps))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        mixtures = model.value
        for batch in batches:
            texts, has = batch.column("text").to_pylist(), batch.column("has_letter").to_pylist()
            data = [letters(t) if h else b"" for t, h in zip(texts, has)]
            mine = [i for i, d in enumerate(data) if len(d) >= 3] if mixtures.langs else []
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(mine), 256):
                part = mine[at:at + 256]
                for i, x, s in zip(part, *mixtures.infer([data[i] for i in part])):
                    lang[i], score[i] = x, s
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = own.select("doc_id", "held_out", "text",
                      F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return map_rows(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
