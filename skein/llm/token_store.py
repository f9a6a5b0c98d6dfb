"""Token-id shards: documents encoded by the tokenizers library, written as wavelet-matrix files in ascending order
of the documents' identifiers, and read back.

A file holds the ids of consecutive documents and a table of them (identifier, number of ids). Its planes give
access to any token, counts and occurrences of an id without expanding the file.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import arrow_batches, cut, publish, read_file, table, work_dir
from skein.llm.pieces import Pieces, by_text, gather
from skein.llm.wavelet import WaveletMatrix

#: The id that ends each document.
END_ID = 1
#: Bytes of text dealt to one writer, and ids after which it begins a new file.
SHARD_BYTES = 24 << 20
SHARD_IDS = 8 << 20
#: Bytes of text encoded together, so that a word is looked up once for many documents.
ENCODE_BYTES = 8 << 20
#: Words, and pieces that aren't letters and marks, that a worker keeps with their ids.
MOST_WORDS, MOST_OTHERS = 1_000_000, 200_000

#: A piece between spaces, A-Z lower-cased, that is letters stable under NFC and then ASCII punctuation but for the
#: apostrophe: the tokenizer splits it there. RE2 syntax.
_LETTERS, _MARKS = "a-zß-öø-įıĲ-ſ", r"!-&(-/:-@\[-`{-~"
_PLAIN = f"^[{_LETTERS}]*[{_MARKS}]*$"
_WORD_PART, _MARK_PART = f"^[{_LETTERS}]+", f"[{_MARKS}]+$"
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: White space to Python, but not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


class WordBpe:
    """encode() gives what the tokenizers library gives for whole texts with this file. Words never span white
    space there, so a text is cut at white space, and the library is asked once for each new word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.bits = int(self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.words, self.others = Pieces(self._ask, MOST_WORDS), Pieces(self._split, MOST_OTHERS)

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for k in range(0, len(words), 20_000) for e in self.library.encode_batch_fast(words[k : k + 20_000], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _split(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For pieces of any kind: white space that isn't a space, digits, apostrophes, other scripts."""
        words, counts = [], []
        for piece in pieces:
            before = len(words)
            for part in [piece] if self._odd(piece) else piece.split():
                words += _ASCII_WORD.findall(part.lower()) if part.isascii() and not self._odd(part) else [part]
            counts.append(len(words) - before)
        ids, size = self.words.ids(words)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *counts])]
        return ids, np.diff(ends)

    def _odd(self, text: str) -> bool:
        return bool(self.special and self.special.search(text) or _ODD.search(text))

    def _pieces(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces between spaces, flat, and the number of each."""
        coded = flat.dictionary_encode()
        piece, at = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(piece, _PLAIN)
        where = [np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.flatnonzero(~plain.to_numpy(zero_copy_only=False))]
        letters_marks, other = piece.filter(plain), piece.filter(pc.invert(plain))
        letters = pc.replace_substring_regex(letters_marks, _MARK_PART, "")
        marks = pc.replace_substring_regex(letters_marks, _WORD_PART, "")
        parts = [(where[0], *self.words.ids_of(letters)), (where[0], *self.words.ids_of(marks)), (where[1], *self.others.ids(other.to_pylist()))]
        size = np.zeros(len(piece), np.int64)
        for own, _, n in parts:
            size[own] += n
        start = np.cumsum(size) - size
        pool, free = np.zeros(int(size.sum()), np.uint32), start.copy()
        for own, ids, n in parts:
            pool[np.repeat(free[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
            free[own] += n
        return gather(pool, start, size, at)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text of a string array without nulls."""
        odd = [self._odd(x) for x in texts.to_pylist()] if self._any_odd(texts) else [False] * len(texts)
        plain = texts.filter(pa.array([not x for x in odd])) if any(odd) else texts
        split = pc.split_pattern(pc.replace_substring(pc.ascii_lower(plain), "\n", " "), " ")
        found = iter(by_text(*self._pieces(split.flatten()), pc.list_value_length(split).to_numpy().tolist()))
        return [self._ask([texts[k].as_py()])[0] if strange else next(found) for k, strange in enumerate(odd)]

    def _any_odd(self, texts: pa.Array) -> bool:
        """Whether any of the texts needs the library as a whole; by Arrow, without Python strings."""
        pattern = "[\x1c-\x1f]" + (f"|{self.special.pattern}" if self.special else "")
        return bool(pc.any(pc.match_substring_regex(texts, pattern)).as_py())


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """This worker's tokenizer of a file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _shard(ids: list[np.ndarray], names: list[pa.Array], counts: list[int], bits: int) -> bytes:
    docs = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])
    stream = io.BytesIO()
    with pa.ipc.new_stream(stream, docs.schema) as writer:
        writer.write_batch(docs)
    return WaveletMatrix.build(np.concatenate(ids), bits).to_bytes(documents=stream.getvalue())


def write_shards(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Writes the shards and returns their index: path, n_docs, n_tokens and start (ids in all shards before).

    Documents are dealt to writers by ranges of their identifiers (null first; rows of one identifier by text, and
    never to two writers). Null texts count as empty; every document has the end id at least. An empty table gives
    no shard. A writer holds one shard in memory; a lost task's files are written again under the same names."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq = loaded(path or default_path()), TaskContext.get().partitionId(), 0
        ids, names, counts, held = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            name = f"{folder}/shard-{part:06d}-{seq:06d}.skwave"
            publish(name, _shard(ids, names, counts, bpe.bits))
            values = [[part], [seq], [name], [len(counts)], [held]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens"])

        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        def take(waiting: list[pa.RecordBatch]) -> None:
            nonlocal held
            found = bpe.encode(pa.concat_arrays([b.column(1) for b in waiting]))
            own = [len(x) + 1 for x in found]
            ids.append(np.concatenate([y for x in found for y in (x, end)]).astype(np.uint16 if bpe.bits <= 16 else np.uint32))
            names.extend(b.column(0) for b in waiting)
            counts.extend(own)
            held += sum(own)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= ENCODE_BYTES:
                take(waiting)
                waiting = []
            if held >= SHARD_IDS:
                yield flush()
                ids, names, counts, held, seq = [], [], [], 0, seq + 1
        if waiting:
            take(waiting)
        if counts:
            yield flush()

    index = cut(dealt.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return index.select("path", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def documents_of(data: bytes) -> tuple[WaveletMatrix, pa.RecordBatch]:
    """The matrix and the documents' table of a shard file."""
    matrix, sections = WaveletMatrix.from_bytes(data)
    return matrix, pa.ipc.open_stream(sections["documents"]).read_next_batch()


def read_shards(index: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the shards. `kind`: the identifiers' type."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix, docs = documents_of(read_file(path))
                size = docs.column(1).to_numpy()
                ends = np.cumsum(size)
                raw = memoryview(matrix.values().astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
                columns = [docs.column(0), pa.array(ends - size + first), docs.column(1), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = index.select("path", "start")
    return shards.repartition(max(1, shards.count()), "path").mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = write_shards(docs, work_dir(spark, "tokens"))
    return read_shards(cut(index), docs.schema["doc_id"].dataType.simpleString())
