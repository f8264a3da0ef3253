"""Language of whole texts in two steps: the language family, then the language in it.

A text is the frequency vector of its hashed letter trigrams. Linear support vector
machines, trained here by dual coordinate descent on a bounded sample of labelled
texts, separate the families one against the rest; inside the chosen family, one
machine for each pair of languages votes, and summed margins settle a draw."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, string_bytes

#: Members of language families by ISO 639-1 code. A language that is
#: not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 4096

#: Lower-case letters and bytes above ASCII as they are, everything else a blank.
_LETTER = np.full(256, 0x20, np.uint32)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def trigram_vectors(column: pa.Array, most: int = 1_000_000):
    """Yields (i, j, unit vectors of texts i to j - 1): square roots of hashed trigram
    counts. A long run of the same words only adds to counts."""
    data, offsets = string_bytes(pc.utf8_lower(column))
    for i, j in slices(offsets, most, 1024):
        n = j - i
        part = _LETTER[data[offsets[i] : offsets[j]]]
        offs = offsets[i : j + 1] - offsets[i]
        # A blank before and after each text, none doubled.
        padded = np.full(len(part) + 2 * n, 0x20, np.uint32)
        shift = 1 + 2 * np.arange(n)
        where = np.repeat(shift, np.diff(offs)) + np.arange(len(part))
        padded[where] = part
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs) + 2)
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != 0x20) | (padded[:-1] != 0x20) | (owner[1:] != owner[:-1])
        padded, owner = padded[keep], owner[keep]
        if len(padded) >= 3:
            gram = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
            slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
            inside = owner[:-2] == owner[2:]
            index = owner[:-2][inside].astype(np.int64) * DIMENSIONS + slot[inside]
            counts = np.bincount(index, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
        else:
            counts = np.zeros((n, DIMENSIONS), np.int64)
        x = np.sqrt(counts.astype(np.float32))
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        yield i, j, x


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights and bias (last) of the hinge-loss machine for labels -1 and 1."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    norms, alpha, w = np.einsum("ij,ij->i", x, x), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


class Model:
    """Family machines and, per family, the machines of its language pairs."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.families: dict[str, list[str]] = defaultdict(list)
        for lang in sorted(set(langs)):
            self.families[family_of(lang)].append(lang)
        self.names = sorted(self.families)
        home = np.asarray([family_of(x) for x in langs])
        self.outer = np.stack([linear_svm(x, np.where(home == f, 1.0, -1.0)) for f in self.names], 1) if len(self.names) > 1 else None
        self.inner = {}
        for f, members in self.families.items():
            pairs = list(combinations(range(len(members)), 2))
            if pairs:
                chosen = [np.isin(langs, [members[a], members[b]]) for a, b in pairs]
                self.inner[f] = (pairs, np.stack([linear_svm(x[m], np.where(langs[m] == members[a], 1.0, -1.0)) for m, (a, b) in zip(chosen, pairs)], 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages, and scores from 0 to 1: how clearly the family and the language
        are ahead of the next ones."""

        def sure(margins: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-2 * np.clip(margins, -20, 20)))

        n = len(x)
        if self.outer is None:
            family, score = np.zeros(n, int), np.ones(n)
        else:
            margins = x @ self.outer[:-1] + self.outer[-1]
            family, score = margins.argmax(1), sure(margins.max(1).astype(float))
        langs = np.empty(n, object)
        for k, f in enumerate(self.names):
            rows, members = np.flatnonzero(family == k), self.families[f]
            if f not in self.inner or not len(rows):
                langs[rows] = members[0]
                continue
            pairs, w = self.inner[f]
            margins = x[rows] @ w[:-1] + w[-1]
            votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (a, b), m in zip(pairs, margins.T):
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                sums[:, a] += m
                sums[:, b] -= m
            best = (votes + np.tanh(sums / 1e3) / 4).argmax(1)
            langs[rows] = np.asarray(members, object)[best]
            own = sums[np.arange(len(rows)), best] / max(1, len(members) - 1)
            score[rows] *= sure(own)
        return langs, score


def remainder(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def has_letter(text: str) -> Column:
    return F.col(text).rlike(r"\p{L}")


def train(docs: DataFrame, per_language: int = 400, in_all: int = 4096, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from labelled texts whose crc32(key) mod 4 is not 2.

    The sample is bounded: about ``per_language`` texts of each language (chosen by
    hash of key and text, one at least), and ``in_all`` together; with many languages each
    has fewer. Every language is learned: more languages than ``in_all`` are an error.
    None if nothing is labelled."""
    usable = docs.filter(F.col(lang).isNotNull() & (remainder(key) != 2) & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    draw = F.pmod(F.xxhash64("k", F.xxhash64("t"), F.lit("langid")), F.lit(1 << 30))
    counts = usable.filter(has_letter("t")).groupBy("l").agg(F.count("*").alias("n"), F.min(draw).alias("first")).limit(in_all + 1).collect()
    if not counts:
        return None
    if len(counts) > in_all:
        raise ValueError(f"more than {in_all} languages")
    each = max(1, min(per_language, in_all // len(counts)))
    up_to = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(max(r["first"], int(each / r["n"] * (1 << 30)))))])
    drawn = usable.filter((draw <= F.try_element_at(up_to, F.col("l"))) & has_letter("t"))

    def run(batches):
        for batch in batches:
            for i, j, x in trigram_vectors(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([row.tobytes() for row in x], pa.binary())], ["l", "x"])

    # About in_all rows, give or take the draw; rows repeated in full have one draw, and one of them is enough.
    rows = sorted(drawn.select("l", "t").mapInArrow(run, "l string, x binary").distinct().collect(), key=lambda r: (r["l"], r["x"]))
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.asarray([r["l"] for r in rows], object))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Null texts, texts without a letter, and all
    texts when there is no model, are ``und`` with score 0. Columns of those names are
    replaced; all others are kept."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select([F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors per pair of languages

    def run(batches):
        own = shared.value
        for batch in batches:
            column = batch.column(at)
            for i, j, x in trigram_vectors(column):
                has = np.asarray(pc.fill_null(pc.match_substring_regex(column.slice(i, j - i), r"\p{L}"), False).to_pylist(), bool)
                langs, score = own.predict(x) if own else (np.full(j - i, "und", object), np.zeros(j - i))
                langs[~has], score[~has] = "und", 0.0
                cols = [batch.column(c).slice(i, j - i) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs.tolist(), pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select([F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = train(docs, per_language)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "lang_pred", "score")
