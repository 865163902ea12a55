"""Token ids of whole texts by a word-level BPE tokenizer (used inside Spark tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# chunks of these characters alone are stable under the tokenizer's normaliser, apart from case; its split of such a chunk
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
SLICE_BYTES = 8 << 20  # text that is encoded at once


class _Memory(dict):
    """A dictionary of two generations of bounded size; what is still in use moves to the younger one."""

    LIMIT, LONGEST = 300_000, 64

    def __init__(self):
        self.older: dict = {}

    def recall(self, key):
        value = self.get(key)
        return self.older.get(key) if value is None else value

    def store(self, key, value) -> None:
        if len(key) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.older = dict(self)
                self.clear()
            self[key] = value


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, from remembered ids of their white-space separated chunks.

    The tokenizer drops white space and never joins what stands on either side of it, so a text's ids are those of its
    chunks in order. Chunks are cut at ASCII white space only; each distinct chunk of a slice of texts is looked up once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks, self.units = _Memory(), _Memory()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """A word, digit or run of signs, which the merges see alone."""
        value = self.units.get(unit)
        if value is None:
            value = self.units.older.get(unit)
            if value is None:
                value = np.array([t.id for t in self.model.tokenize(unit)], dtype="<u4").tobytes() if unit.isascii() else self._ids(unit)
            self.units.store(unit, value)
        return value

    def _encoded(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._ids(text)
        return b"".join(map(self._unit, UNITS.findall(text.lower())))

    def chunk(self, chunk: bytes) -> bytes:
        value = self.chunks.get(chunk)
        if value is None:
            value = self.chunks.older.get(chunk)
            if value is None:
                value = self._encoded(chunk) if chunk else b""
            self.chunks.store(chunk, value)
        return value

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = [self.chunk(c) for c in coded.dictionary.cast(pa.binary()).to_pylist()]
        pool = np.frombuffer(b"".join(parts), dtype="<u4")
        many = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        first = np.cumsum(many) - many
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = many[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(first[at] - (ends - counts), counts) + np.arange(total)]
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        stops = np.concatenate([[0], ends])[np.cumsum(lengths)]
        begin = 0
        for stop in stops:
            yield ids[begin:stop]
            begin = stop

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = sizes[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            yield from self._slice(texts.slice(begin, stop - begin))
            begin = stop


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker and tokenizer file."""
    return ChunkIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
