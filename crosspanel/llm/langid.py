"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the share of n-grams (1 to ``MAX_N`` bytes of the UTF-8 text,
ASCII letters lower-cased) that both contain: ``|X & Y| / sqrt(|X| |Y|)`` over presence
vectors of ``1 << BITS`` hashed n-grams.  Landmark texts span a Nystroem subspace; one
ridge regression per language is solved in it.  As the kernel is linear in the presence
vectors, the landmarks and their weights fold into one ``n-grams x languages`` matrix, and
a batch of texts is scored by one matrix product.

A presence vector fills with the length of a text, so every text is cut into equal blocks of
at most ``BLOCK`` bytes, and its outputs are the averages over all of its blocks.

Learning uses a documented bounded sample (``per_lang`` rows a language, ``max_rows``
altogether, chosen by a hash, and ``TEXT_BLOCKS`` evenly spaced blocks of a longer text); only
fixed-size bit vectors of it reach the driver.  One text in five of a language is kept out of
training; the margins of the winner in them set the unit of the score.
Prediction reads nothing but the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from crosspanel.llm.frames import map_batches, staged, with_fields
from crosspanel.llm.textbytes import LOWER, column_bytes, text_slices

MAX_N = 4
BITS = 15
ROWS_AT_ONCE = 128
BLOCK = 4096
TEXT_BLOCKS = 4
#: Share of the rightly named held-out texts whose margin is below the unit of the score.
UNIT_SHARE = 0.005
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def has_letter(raw: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter of any script."""
    if _LETTER[raw].any():
        return True
    return bool((raw > 127).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def mark_presence(raw: np.ndarray, row: np.ndarray) -> None:
    """Set the entries of ``row`` for every n-gram of the text."""
    low = LOWER[raw].astype(np.uint32)
    code = np.zeros(len(low), dtype=np.uint32)
    for n in range(1, MAX_N + 1):
        if len(low) < n:
            return
        code = code[: len(low) - n + 1] | (low[n - 1 :] << np.uint32(8 * (n - 1)))
        row[((code + np.uint32(n)) * _ODD[n - 1]) >> np.uint32(32 - BITS)] = 1


def blocks(raw: np.ndarray) -> list[np.ndarray]:
    """Equal blocks of a text, each with the first bytes of the next one, so that no n-gram is lost."""
    n = max(1, -(-len(raw) // BLOCK))
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a : b + MAX_N - 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def margins(out: np.ndarray) -> np.ndarray:
    """Distance of the largest output from the second, or from 0 with a single language."""
    top = np.sort(out, axis=1)
    return top[:, -1] - (top[:, -2] if out.shape[1] > 1 else 0)


@dataclass(frozen=True)
class KernelModel:
    """Languages, the folded weights (``1 << BITS`` rows, a column per language) and the unit of margins."""

    languages: list[str]
    weights: np.ndarray
    unit: float = 1.0

    def outputs(self, presence: np.ndarray) -> np.ndarray:
        size = np.maximum(presence.sum(axis=1), 1.0)
        return (presence @ self.weights) / np.sqrt(size)[:, None]

    def judge(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the best language and score of every text."""
        pieces = [(i, block) for i, raw in enumerate(texts) for block in blocks(raw)]
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at in range(0, len(pieces), ROWS_AT_ONCE):
            some = pieces[at : at + ROWS_AT_ONCE]
            presence = np.zeros((len(some), 1 << BITS), dtype=np.float32)
            for row, (_, block) in zip(presence, some, strict=True):
                mark_presence(block, row)
            owner = [i for i, _ in some]
            np.add.at(total, owner, self.outputs(presence))
            np.add.at(count, owner, 1)
        out = total / np.maximum(count, 1)[:, None]
        margin = margins(out)
        return out.argmax(axis=1), margin / (margin + self.unit)


def _presence_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        data, starts, ends = column_bytes(part.column("text"))
        out = []
        for a, b in zip(starts, ends, strict=True):
            if not has_letter(data[a:b]):
                out.append(None)
                continue
            every = blocks(data[a:b])
            few = min(len(every), TEXT_BLOCKS)
            bits = []
            for i in range(few):
                row = np.zeros(1 << BITS, dtype=np.uint8)
                mark_presence(every[len(every) * i // few], row)
                bits.append(np.packbits(row).tobytes())
            out.append(bits)
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["lang", "bits"])


def fit(labelled: DataFrame, per_lang: int = 300, max_rows: int = 2000, landmarks: int = 128, ridge: float = 1e-3) -> KernelModel:
    """Fit on rows ``(text, lang)``; rows without a language, a text or a letter don't count.

    Each language gives about ``per_lang`` rows, those with the smallest hash remainder.
    Without any usable row the model knows no language.
    """
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # Written first, so that its size is known and the texts aren't shuffled by language.
    counts = staged(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    picked = rows.join(counts, "lang").withColumn("h", F.xxhash64("text", "lang"))
    picked = picked.where(F.pmod(F.col("h"), F.col("n")) < per_lang).orderBy("h", "text").limit(max_rows).select("text", "lang")
    schema = StructType([StructField("lang", StringType()), StructField("bits", ArrayType(BinaryType()))])
    got = sorted(([bytes(x) for x in r.bits], r.lang) for r in map_batches(picked, _presence_bits, schema).where("bits IS NOT NULL").collect())
    names = sorted({lang for _, lang in got})
    if not names:
        return KernelModel([], np.zeros((1 << BITS, 0), dtype=np.float32))
    nth: Counter[str] = Counter()
    train, held = [], []
    for bits, lang in got:
        # Blocks of one text stay together; landmarks are first blocks of all languages in turn.
        if nth[lang] % 5 == 4:
            held.append((bits, lang))
        else:
            train += [(k, nth[lang], lang, x) for k, x in enumerate(bits)]
        nth[lang] += 1
    train.sort()
    unit = lambda bits: (x := np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.float32)) / np.sqrt(x.sum())
    land = np.stack([unit(x) for *_, x in train[:landmarks]])
    cross = np.stack([land @ unit(x) for *_, x in train]).astype(np.float64)
    gram = (land @ land.T).astype(np.float64)
    target = np.array([[lang == n for n in names] for _, _, lang, _ in train], dtype=np.float64)
    left = cross.T @ cross + ridge * len(train) * gram + 1e-8 * np.eye(len(gram))
    weights = (land.T @ np.linalg.solve(left, cross.T @ target)).astype(np.float32)
    # Few rows leave none for calibration; then those of the training stand in.
    judged = held or got
    out = np.stack([np.mean([unit(x) @ weights for x in bits], axis=0) for bits, _ in judged])
    right = margins(out)[out.argmax(axis=1) == [names.index(lang) for _, lang in judged]]
    return KernelModel(names, weights, max(float(np.quantile(right, UNIT_SHARE)) if len(right) else 1.0, 1e-6))


def predict(docs: DataFrame, model: KernelModel) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score``.

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without letters, or a model
    without languages.  The score is ``m / (m + unit)`` for the winner's margin ``m`` over the
    second language, 0.5 at the margin which nearly all held-out labelled texts reach; it
    depends on neither the length of a text nor the number of languages.  Input columns called like an output are replaced.  Ties go to the first name.
    """

    @F.arrow_udf("lang_pred string, score double")
    def judged(text: pa.Array) -> pa.Array:
        names, marks = [], []
        for part in text_slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
            data, starts, ends = column_bytes(part.column("text"))
            name, mark = [UNDETERMINED] * len(starts), [0.0] * len(starts)
            usable = [i for i in range(len(starts)) if model.languages and has_letter(data[starts[i] : ends[i]])]
            if usable:
                best, share = model.judge([data[starts[i] : ends[i]] for i in usable])
                for i, k, x in zip(usable, best, share, strict=True):
                    name[i], mark[i] = model.languages[k], float(x)
            names += name
            marks += mark
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.float64())], ["lang_pred", "score"])

    # Only texts go to Python and only verdicts come back.
    return with_fields(docs, judged(F.col("text")), {"lang_pred": "lang_pred", "score": "score"})


def fold(doc_id: str = "doc_id") -> Column:
    """The fold of a document, 0 to 4: crc32 of its id as text; null without an id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def identify(docs: DataFrame) -> DataFrame:
    """Learn on the documents outside fold 0 and predict all of them."""
    return predict(docs, fit(docs.where(fold() != 0).select("text", "lang")))
