"""BPE, token shards and the wavelet matrix against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, token_store
from skein.llm.common import read_file, work_dir
from skein.llm.pieces import Pieces
from skein.llm.wavelet import WaveletMatrix

from .conftest import TRICKY

PARTS = ["a", "b", "aa", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "1", "23", "!", "...", "é", "ß", "日", "́", " ", "\x1c", "\x85", "<|endoftext|>", "😀", "՘", "\U00010940", "ing", "A", "　", "\r\n", "²", "_", "İ", "Σ", "ΑΣ", "K", "\x00", "é,", "—", "(x)", "ŉ"]


def texts(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)] + ["a" * k for k in range(40)] + [" " * k for k in range(9)]


def test_byte_bpe_is_the_librarys():
    own, library = bpe.ByteBpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    some = texts(1, 4000)
    for text, ids, found in zip(some, library.encode_batch(some, add_special_tokens=False), own.encode(some), strict=True):
        assert found.tolist() == ids.ids, text
        assert own.decode(found).decode() == library.decode(ids.ids, skip_special_tokens=False)
    draw = random.Random(2)
    for _ in range(500):
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 9))]
        assert own.decode(np.array(ids, np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_word_bpe_is_the_librarys():
    own = token_store.WordBpe(token_store.default_path())
    some = texts(3, 4000)
    for text, ids, found in zip(some, own.library.encode_batch(some, add_special_tokens=False), own.encode(pa.array(some)), strict=True):
        assert found.tolist() == ids.ids, text


def test_pieces_forget_without_harm():
    asked = []
    store = Pieces(lambda new: (asked.extend(new), (np.array([len(x) for x in new], np.uint32), np.ones(len(new), np.int64)))[1], most=3)
    for _ in range(3):
        assert store.ids(["a", "bb", "ccc", "a", "dddd", "eeeee"])[0].tolist() == [1, 2, 3, 1, 4, 5]
    assert len(asked) == 15 and store.ids([])[0].tolist() == []


def test_bpe_frames(tricky, clashing):
    library = Tokenizer.from_file(bpe.default_path())
    expected = []
    for i, t in TRICKY:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append(repr((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    out = bpe.encode(tricky)
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in out.collect()) == sorted(expected)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(out).collect())
    assert back == sorted((str(i), t or "") for i, t in TRICKY)
    assert bpe.encode(tricky.limit(0)).count() == 0 and bpe.encode(clashing).count() == 4


def test_token_shards(spark, tricky, clashing, monkeypatch):
    library = Tokenizer.from_file(token_store.default_path())
    order = sorted(TRICKY, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = [], 0
    for i, t in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for size in (1 << 24, 20_000):
        monkeypatch.setattr(token_store, "SHARD_BYTES", size)
        index = token_store.write_shards(tricky, work_dir(spark, "t"))
        found = sorted(map(tuple, token_store.read_shards(index).collect()), key=lambda r: r[1])
        assert found == expected
    path = index.orderBy(F.desc("n_tokens")).first().path
    matrix, docs = token_store.documents_of(read_file(path))
    values = matrix.values()
    assert [matrix.access(k) for k in range(0, len(values), 997)] == values[::997].tolist()
    assert matrix.count(1) == docs.num_rows == int((values == 1).sum()) and matrix.occurrences(1) == np.flatnonzero(values == 1).tolist()
    empty = token_store.write_shards(tricky.limit(0), work_dir(spark, "t"))
    assert token_store.read_shards(empty).count() == 0
    assert token_store.read_shards(token_store.write_shards(clashing, work_dir(spark, "t"))).count() == 4


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 3000])
def test_wavelet_matrix(n, monkeypatch):
    import skein.llm.wavelet as w

    monkeypatch.setattr(w, "STEP", 512)
    values = np.random.default_rng(n).integers(0, 9 if n % 2 else 60_000, n)
    matrix, more = WaveletMatrix.from_bytes(WaveletMatrix.build(values, 16).to_bytes(x=b"more"))
    assert more == {"x": b"more"} and (matrix.values() == values).all()
    assert [matrix.access(i) for i in range(0, n, 13)] == values[::13].tolist()
    low, high = n // 5, n - n // 7
    for value in {*values[:4].tolist(), 3, 70_000}:
        at = np.flatnonzero(values[low:high] == value) + low
        assert matrix.count(value, low, high) == len(at) and matrix.occurrences(value, low, high) == at.tolist()
        assert matrix.occurrences(value, low, high, most=1) == at[:1].tolist()
    with pytest.raises(IndexError):
        matrix.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"SKWAVE01 cut short")
