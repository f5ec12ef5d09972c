"""Byte-level BPE: a backtracking encoder in linear time, and a decoder over an offset table.

A sequence of tokens is what the merges give exactly if every two tokens in a row are: a pair is compatible if the merges
would leave both apart. So the encoder takes at each place the longest token that an Aho-Corasick automaton has found there,
falls back to the next shorter one while the pair is not compatible, and gives a place up when nothing fits. Compatibility is
decided by undoing the later merge of the two at their border until both are bytes: no merge across the border may come
before the merge undone. Verdicts and encodings of frequent words are kept in bounded tables.

The decoder looks up each id's place in one byte string of all tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import Batches, map_batches

#: Fixed value: the pattern that splits a text before merging.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Bounds of the tables that a worker keeps: entries of a generation, and the longest word in characters that is kept at all.
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 200_000, 250_000, 64

_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class _Recent(dict):
    """A table that computes what it lacks, in two generations of at most ``most`` entries, keys of bounded length alone."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        if len(key) > KEPT_LENGTH:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one byte-level BPE file (the JSON text of the tokenizers library)."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, letters = spec["model"], _byte_letters()
        vocab = {bytes(letters[c] for c in t).decode("latin-1"): i for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        halves = [tuple(bytes(letters[c] for c in part).decode("latin-1") for part in m) for m in merges]
        self.halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in halves}
        if [vocab[a + b] for a, b in halves] != list(range(256, 256 + len(halves))):
            raise ValueError("ids are not in the order of the merges")
        self.merged = {pair: token for token, pair in self.halves.items()}
        self.length = {i: len(t) for t, i in vocab.items()}
        self.shorter = {i: next((vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in vocab), -1) for t, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, by_length))) if by_length else None
        texts = {i: t.encode("latin-1") for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        sizes = np.zeros(max(texts) + 2, np.int64)
        for i, t in texts.items():
            sizes[i + 1] = len(t)
        self.offsets, self.sizes = np.cumsum(sizes), sizes[1:]
        self.table = np.frombuffer(b"".join(texts[i] for i in sorted(texts)), np.uint8)
        self.words = _Recent(self._encode_word, KEPT_WORDS)
        self.pairs = _Recent(self._compatible, KEPT_PAIRS)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        limit = len(self.halves) + 256
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right and left in self.halves:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                # of two equal merges the one further left comes first, so an equal merge across the border counts
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def _encode_word(self, word: str) -> bytes:
        octets, pairs = word.encode().decode("latin-1"), self.pairs
        # mostly the longest tokens from left to right are compatible as they are
        greedy = [token for _, (token, _) in self.automaton.iter_long(octets)]
        for pair in zip(greedy, greedy[1:]):
            if not pairs[pair]:
                return self._backtrack(octets)
        return array("i", greedy).tobytes()

    def _backtrack(self, octets: str) -> bytes:
        longest = [-1] * len(octets)
        for end, (token, size) in self.automaton.iter(octets):
            longest[end - size + 1] = token  # at one start, a later end is a longer token
        length, shorter, pairs = self.length, self.shorter, self.pairs
        dead = bytearray(len(octets) + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < len(octets):
            end = at + length[token]
            if not dead[end] and (not taken or pairs[taken[-1], token]):
                taken.append(token)
                at = end
                if at < len(octets):
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= length[token]
        return array("i", taken).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens are those tokens."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, SPLIT.findall(text))), np.int32)
        parts, at = [], 0
        for m in self.special_pattern.finditer(text):
            parts += [*map(self.words.__getitem__, SPLIT.findall(text[at : m.start()])), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        parts += map(self.words.__getitem__, SPLIT.findall(text[at:]))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters. An id outside the table raises IndexError."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(total)
        return self.table[places].tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(definition: str) -> Codec:
    """One codec per worker and definition."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(definition)
    return _codecs[key]


def _batches(batches: Batches, definition) -> Batches:
    own = codec(definition.value)
    for rows in batches:
        for at in range(0, rows.num_rows, 256):
            part = rows.slice(at, 256)
            ids = [own.encode(t.as_py() or "") for t in part.column("text")]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
            decoded = pa.array([own.decode(i).encode() for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoded], schema=_TOKENS)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) with the vocabulary file at ``path`` on the driver.

    One row per row of ``docs`` (columns doc_id, text; others are not read). A null text counts as empty: no ids, empty
    text. Repeated rows come out as often as they go in; no rows in, no rows out.
    """
    with open(path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    tokens = map_batches(rows, partial(_batches, definition=definition), "doc_id bigint, ids array<int>, decoded binary")
    return tokens.withColumn("decoded", F.col("decoded").cast("string"))
