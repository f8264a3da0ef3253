"""BPE encoding and decoding for the lower-casing vocabulary with word ends.

The merges of a word come off a priority queue of (rank, position) entries over a
doubly linked list of symbols; an entry whose symbols have changed since it was
pushed is stale and skipped. Decoding puts the vocabulary strings one after the
other, with the separator of a tokenizer file that names no decoder: one blank."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import string_bytes
from .token_files import default_path
from .wordtable import WordTable

_models: dict[tuple[str, bool], BPE] = {}


class BPE:
    """One vocabulary. ``specials``: whether the strings of added tokens in a text
    stand for those tokens, as in the tokenizers library by default."""

    def __init__(self, path: str, specials: bool = True, limit: int = 150_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = (rank, self.vocab[a + b])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.specials = added if specials else {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in added.items()}
        self.strings = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        # White space and case are folded, and a word cut into letters, digits and signs, by the rules in the file.
        frame = Tokenizer.from_file(path)
        self.normal, self.cut = frame.normalizer, frame.pre_tokenizer
        self.limit, self.known = limit, {}

    def merge(self, word: str) -> list[int]:
        """Ids of one piece whose characters stand for bytes."""
        last = len(word) - 1
        ids = [self.vocab[s] for i, c in enumerate(word) if (s := c + self.suffix if i == last else c) in self.vocab]
        n = len(ids)
        if n < 2:
            return ids
        merges, push, pop = self.merges.get, heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if m := merges(ids[i] << 32 | ids[i + 1]):
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, new = pop(queue)
            if ids[i] < 0 or (j := after[i]) < 0:
                continue
            m = merges(ids[i] << 32 | ids[j])
            if m is None or m[1] != new:  # stale
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges(new << 32 | ids[k]):
                    push(queue, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges(ids[h] << 32 | new)):
                push(queue, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text)):
            ids = self.known.get(word)
            if ids is None:
                if len(self.known) >= self.limit:
                    self.known.clear()
                ids = self.known[word] = self.merge(word)
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if self.special is None or "<" not in text and not self.special.search(text):
            return self._plain(text)
        out: list[int] = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids) -> str:
        return " ".join([self.strings[i] for i in ids])


def model(path: str, specials: bool = True) -> BPE:
    if (path, specials) not in _models:
        _models[path, specials] = BPE(path, specials)
    return _models[path, specials]


_tables: dict[tuple[str, bool], WordTable] = {}


def word_table(path: str, specials: bool = True) -> WordTable:
    if (path, specials) not in _tables:
        own = model(path, specials)
        _tables[path, specials] = WordTable(lambda words: [own.encode(w) for w in words], strip=True)
    return _tables[path, specials]


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", ids: bool = True, specials: bool = True) -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256, decoded_sha256 and, if
    ``ids``, the column token_ids. Null and empty texts have no ids; equal rows give
    equal rows; columns named like the new ones are replaced."""
    path = tokenizer or default_path("word_bpe_49k.json")
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
    kept = [c for c in docs.columns if c != text and c not in new]
    schema = docs.select([docs[c] for c in kept]).schema
    for c, t in zip(new, (T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()))):
        schema = schema.add(c, t)

    def run(batches):
        table, strings = word_table(path, specials), model(path, specials).strings
        numbers = [str(i) for i in range(len(strings))]
        for batch in batches:
            data, offsets = string_bytes(batch.column(len(kept)))
            for i, j, flat, bounds in table.texts(data, offsets):
                counts, id_sha, text_sha = [], [], []
                for k in range(j - i):
                    own = flat[bounds[k] : bounds[k + 1]].tolist()
                    counts.append(len(own))
                    id_sha.append(hashlib.sha256(" ".join([numbers[x] for x in own]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(" ".join([strings[x] for x in own]).encode()).hexdigest())
                cols = [batch.column(c).slice(i, j - i) for c in range(len(kept))] + [pa.array(counts, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, kept + new)

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
