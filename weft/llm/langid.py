"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is bound from its
letters' vectors, each permuted (rotated) by its place and multiplied
elementwise. A document is the bundle (sum) of its n-grams, a language the
bundle of its documents' unit vectors; a document goes to the language whose
prototype has the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import append_columns, forget_encoders, release_memory, small_batches

DIMENSIONS, GRAM, SEED = 1024, 3, 1
#: Letters a-z have slots of their own; all others share the rest by a hash.
SLOTS = 96
#: Vectors of n-grams that a task keeps (4 KB each), and characters bundled at once.
CACHED, TOGETHER = 16_384, 1 << 18
#: Resolution to which unit vectors are rounded, so that bundles are exact sums.
UNIT = 4096

UNDETERMINED = "und"


def _letter_slots() -> np.ndarray:
    """Slot of each code point of the basic plane; 0 for what is no letter."""
    points = np.arange(1 << 16, dtype=np.int64)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    slots = np.where(letter, 27 + (points * 2654435761 >> 16) % (SLOTS - 27), 0)
    slots[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return slots.astype(np.int32)


class Bundler:
    """Turns texts into document vectors; one for each task."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        letters = rng.integers(0, 2, (SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1
        #: Row i: every letter's vector rotated for place i of an n-gram.
        self._placed = [np.roll(letters, GRAM - 1 - i, axis=1) for i in range(GRAM)]
        self._slots = _letter_slots()
        self._row = np.full(SLOTS**GRAM, -1, np.int32)
        self._vectors = np.zeros((1024, DIMENSIONS), np.float32)
        self._used = 0

    def grams(self, text: str | None) -> np.ndarray:
        """Codes of the n-grams of a text: lower-case letters, other runs as one gap."""
        if not text:
            return np.zeros(0, np.int64)
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        slots = self._slots[np.minimum(points, 0xFFFF)]
        for p in np.unique(points[points > 0xFFFF]).tolist():
            slots[points == p] = 27 + (p * 2654435761 >> 16) % (SLOTS - 27) if chr(p).isalpha() else 0
        if not slots.any():
            return np.zeros(0, np.int64)
        slots = np.concatenate(([0], slots, [0]))
        slots = slots[np.r_[True, (slots[1:] != 0) | (slots[:-1] != 0)]]
        codes = np.zeros(len(slots) - GRAM + 1, np.int64)
        for i in range(GRAM):
            codes = codes * SLOTS + slots[i : len(slots) - GRAM + 1 + i]
        return codes

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of distinct codes in the cache of vectors; binds the new ones."""
        new = codes[self._row[codes] < 0]
        if self._used + len(new) > CACHED:
            self._row[:] = -1
            self._used = 0
            new = codes
        size = self._used + len(new)
        if size > len(self._vectors):
            grown = np.zeros((max(size, min(CACHED, 2 * len(self._vectors))), DIMENSIONS), np.float32)
            grown[: self._used] = self._vectors[: self._used]
            self._vectors = grown
        vectors = np.ones((len(new), DIMENSIONS), np.int8)
        for i in range(GRAM):
            vectors *= self._placed[i][new // SLOTS ** (GRAM - 1 - i) % SLOTS]
        self._vectors[self._used : size] = vectors
        self._row[new] = np.arange(self._used, size)
        self._used = size
        return self._row[codes]

    def _bundle(self, grams: list[np.ndarray]) -> np.ndarray:
        codes = np.concatenate(grams)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        seen = np.zeros(SLOTS**GRAM, bool)
        seen[codes] = True
        distinct = np.flatnonzero(seen)
        out = np.zeros((len(grams), DIMENSIONS), np.float32)
        for low in range(0, len(distinct), CACHED):  # one turn, but for texts of very many letters
            part = distinct[low : low + CACHED]
            self._rows(part)
            inside = (codes >= part[0]) & (codes <= part[-1])
            cells = owner[inside] * self._used + self._row[codes[inside]]
            counts = np.bincount(cells, minlength=len(grams) * self._used)
            counts = counts.reshape(len(grams), self._used).astype(np.float32)
            out += counts @ self._vectors[: self._used]
        return out

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the texts that have letters, and their positions."""
        where, vectors, held, size = [], [], [], 0
        for i, text in enumerate(texts):
            grams = self.grams(text)
            if len(grams):
                where.append(i)
                held.append(grams)
                size += len(grams)
            if held and (size >= TOGETHER or len(held) >= 64 or i == len(texts) - 1):
                vectors.append(self._bundle(held))
                held, size = [], 0
        if held:
            vectors.append(self._bundle(held))
        found = np.concatenate(vectors) if vectors else np.zeros((0, DIMENSIONS), np.float32)
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        return found / np.maximum(norms, 1e-9), np.array(where, np.int64)


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> unit prototype, from all rows of labelled.

    Rows with a null text or language, or without letters, teach nothing. Each
    task sends one integer vector for each language, and those are summed
    exactly, so prototypes don't depend on the order of rows. The result has
    one vector for each language.
    """

    def bundle(batches):
        forget_encoders()
        bundler, sums = Bundler(), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            units, where = bundler.units(texts)
            units = np.rint(units * UNIT).astype(np.int64)
            names = np.array([langs[i] for i in where], object)
            for name in set(names.tolist()):
                sums[name] = sums.get(name, 0) + units[names == name].sum(axis=0)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.int64()))],
            names=["lang", "bundle"],
        )
        del bundler
        release_memory()

    small_batches(labelled.sparkSession)
    rows = labelled.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    parts = rows.mapInArrow(bundle, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("bundle"))
    profiles = {}
    for row in packed.collect():
        vector = np.array([x.v for x in row.bundle], float)
        if (norm := np.linalg.norm(vector)) > 0:
            profiles[row.lang] = vector / norm
    return dict(sorted(profiles.items()))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double.

    score is the cosine with the best prototype, 0 to 1; of equal ones the
    first language in code point order wins. lang_pred is `und` with score 0
    if the text is null or has no letters, or if there are no profiles.
    Columns of those names in docs are replaced.
    """
    names = sorted(profiles)
    prototypes = np.array([profiles[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)

    def make():
        forget_encoders()
        bundler = Bundler()

        def predict(column):
            texts = column.to_pylist()
            best = np.array([UNDETERMINED] * len(texts), object)
            score = np.zeros(len(texts))
            units, where = bundler.units(texts)
            if len(names) and len(where):
                cosines = units @ prototypes.T
                top = cosines.argmax(axis=1)
                best[where] = np.array(names, object)[top]
                score[where] = np.clip(cosines[np.arange(len(top)), top], 0, 1)
            return [pa.array(best.tolist(), pa.string()), pa.array(score)]

        return predict

    return append_columns(docs, [text], make, "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: one in three, by a hash of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that prototypes may learn from: text and label known, not held out."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("text", "lang")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from prototypes of the others.

    Nothing but the text enters a prediction. Rows with a null doc_id are not
    held out and teach nothing; rows that repeat are predicted each. An empty
    table gives an empty result.
    """
    profiles = train_profiles(training_rows(docs))
    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(narrow, profiles).drop("text")
