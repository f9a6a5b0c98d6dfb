"""Byte-level BPE encoding by batched numpy merge rounds, and decoding.

The vocabulary is a tokenizers file (byte-level BPE, no normaliser). New words of a batch are encoded together:
their symbols lie in one flat array; the rank of each adjacent pair is found by binary search over the sorted
pair keys; in a round every word merges all occurrences of its lowest-ranked pair; then only pairs next to a
merge are searched again, and words without a mergeable pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import arrow_batches, lean, strings, table
from skein.llm.pieces import Pieces, by_text

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: New pieces encoded together.
WORDS_AT_ONCE = 50_000
NONE = np.int64(1) << 40

#: Up to here all versions of Unicode at hand agree on letters, numbers and spaces; above, on assigned characters.
_SETTLED = re.compile("[^\x00-՗]")
_SPACES = re.compile(r"\s\s")


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the
    next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Encodes and decodes as the tokenizers library does with the same file, without added special tokens. The
    strings of special tokens in a text become their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        self.byte_id = np.array([vocabulary[symbols[b]] for b in range(256)], np.int64)
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.rank_of = key[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        back = {c: b for b, c in symbols.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocabulary.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.path, self._library = path, None
        self.pieces = Pieces(self._encode_pieces)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (not empty) after all merges, flat, and the number for each word."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done_symbol, done_word = [], []
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            if (over := best == NONE).any():
                leave = np.repeat(over, size)
                done_symbol.append(symbol[leave])
                done_word.append(word[leave])
                symbol, word, rank, best, size = symbol[~leave], word[~leave], rank[~leave], best[~over], size[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            if len(at) > 1 and (np.diff(at) == 1).any():  # x x x: from the left, without overlap
                run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[nth % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            near = np.zeros(len(symbol), bool)
            near[at] = True
            near[np.maximum(at - 1, 0)] = True
            again = np.flatnonzero(near)
            rank[again] = NONE
            again = again[again < len(word) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self._ranks(symbol[again], symbol[again + 1])
        if not done_word:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbol)[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's words. Characters on which versions of Unicode differ leave it to the library."""
        if not text.isascii() and _SETTLED.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def _encode_pieces(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(keys), WORDS_AT_ONCE):
            split = [self.split(x[:-1] if x.endswith(" ") else f" {x}") for x in keys[k : k + WORDS_AT_ONCE]]
            flat, size = self.merge([w.encode() for words in split for w in words])
            ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, split)])]
            ids.append(flat)
            sizes.append(np.diff(ends))
        return np.concatenate(ids), np.concatenate(sizes)

    def keys_of(self, text: str) -> list[str]:
        """Keys of the text's pieces: a piece that is a space and a word without spaces is kept under the word,
        any other piece under itself and a space. Where white space never follows white space, words never span
        a space, so texts are cut at spaces; other texts by the pre-tokenizer's pattern."""
        if _SPACES.search(text) is None:
            keys = text.split(" ")
            keys[0] += " "
            return keys
        return [w[1:] if w[0] == " " and " " not in w[1:] else f"{w} " for w in self.split(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        keys: list[str] = []
        counts, marked = [], {}
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                marked[k] = text
                counts.append(0)
                continue
            own = self.keys_of(text)
            keys += own
            counts.append(len(own))
        out = by_text(*self.pieces.ids(keys), counts)
        for k, text in marked.items():
            out[k] = self._encode_marked(text)
        return out

    def _encode_marked(self, text: str) -> np.ndarray:
        parts, last = [], 0
        for m in self.special.finditer(text):
            parts += [self.encode([text[last : m.start()]])[0], np.array([self.added[m[0]]], np.uint32)]
            last = m.end()
        return np.concatenate([*parts, self.encode([text[last:]])[0]])

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()
        return out


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """This worker's tokenizer of a file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, a binary; only if `ids`), ids_sha256 and decoded_sha256
    of each row, the last of the text that the ids decode to.

    Null counts as the empty text, which has no ids. Repeated rows give repeated results. `path`: a vocabulary
    file that every executor has; the default is that of the package public_tokenizers."""
    arrow_batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for batch in rows:
            found = bpe.encode(strings(batch.column(1)))
            raw = [x.astype("<u4").tobytes() for x in found]
            columns = [batch.column(0), pa.array(map(len, found), pa.int64())]
            columns += [pa.array(raw, pa.binary())] * ids
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in found])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, {'ids binary, ' * ids}ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encode()'s rows."""
    arrow_batches(encoded.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for batch in rows:
            found = [bpe.decode(np.frombuffer(x, "<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
