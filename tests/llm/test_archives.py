"""WARC bundles, chat formatting, the queries' registration and the pipeline."""

import hashlib
import random

import pytest
import zstandard

from skein.llm import chat, warc
from skein.llm.common import read_file, work_dir

PAGES = "page_id long, url string, html string"
CHAT = "conv_id long, turn long, role string, text string"


def pages_rows():
    big, other = "x" * 1500, "é" * 500
    rows = [(k, f"http://a/{k}\r\nX: y", big) for k in range(40)] + [(50 + k, None, other) for k in range(5)]
    return [*rows, (60, "u", None), (61, "u", ""), (62, "u", "y" * 999), (63, "u", "y" * 999), (None, "u", big), (None, None, "z" * 2000), (39, "u", big), (70, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]


def brute_pages(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        keep = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        refers = keep if len(payload) >= 1000 and keep is not None and i != keep else None
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("bundle", "few"), [(1 << 25, 50_000), (300, 0)])
def test_bundles(spark, monkeypatch, bundle, few):
    import skein.llm.common as common

    monkeypatch.setattr(warc, "BUNDLE_BYTES", bundle)
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    rows = pages_rows()
    index = warc.write_bundles(spark.createDataFrame(rows, PAGES).repartition(4), work_dir(spark, "w"))
    found = warc.read_bundles(index)
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found.collect()) == brute_pages(rows)
    assert index.agg({"n_records": "sum"}).first()[0] == len(rows)
    path = index.orderBy("path").first().path
    reader = warc.Bundle(path)
    names = reader.index.column(0).to_pylist()
    whole = b"".join(reader.records())
    assert zstandard.ZstdDecompressor().stream_reader(read_file(path), read_across_frames=True).read() == whole
    fields, _ = warc.parsed(reader.record(names[-1]))
    assert fields["WARC-Record-ID"] == names[-1]


def test_bundles_of_no_pages(spark):
    index = warc.write_bundles(spark.createDataFrame([], PAGES), work_dir(spark, "w"))
    assert warc.read_bundles(index).count() == 0


def test_faulty_records():
    good = warc.record(1, "u", b"payload")
    assert warc.parsed(good)[1] == b"payload"
    for bad in (good.replace(b"payload", b"pAyload"), good[:-1], b"x" + good):
        with pytest.raises(ValueError):
            warc.parsed(bad)


PARTS = ["\\", "### ", "###", "#", " ", "</turn>", " </turn>\n", "</", "turn>", "\n", "a", "User: ", "### Assistant: ", ":", "=", "é", ""]


def test_chat_round_trip():
    draw = random.Random(3)
    text = lambda: "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 8)))
    for _ in range(4000):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "a:b", "", "x\ny", "\\", "User", "="]), text()) for _ in range(3)]
        whole, at, found = "".join(chat.render(*t)[0] for t in turns), 0, []
        while at < len(whole):
            role, start, end, at = chat.parse(whole, at)
            found.append((role, chat.unescape(whole[start:end])))
        assert found == turns
    with pytest.raises(chat.Unparsable):
        chat.parse("no turn")
    assert chat.parse("### User: cut") is None and chat.parse("##") is None and chat.parse("### Us") is None


def test_chat_frames(spark):
    draw = random.Random(4)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "tool"]), draw.choice([None, "", "x ###", chat.CONFLICT, "é" * 50])) for c in (1, 2, None) for t in range(30)]
    rows += [(3, None, "user", "first"), (3, 0, "assistant", "second"), (4, 0, "assistant", "y" * 100_000)]
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, CHAT).repartition(5))).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: -1 if r[1] is None else r[1])
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert found[conv].n_turns == len(own) and found[conv].loss_chars == len(loss)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        assert found[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], CHAT))).count() == 0


def test_registration_and_pipeline(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline

    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names) and "pipeline" in entry.queries()
    words = lambda k: " ".join(f"w{k}q{j}" for j in range(80))
    item = " ".join(f"item{j}" for j in range(20))
    docs = [(k, words(k)) for k in range(60)] + [(100, words(3).upper()), (101, f"{words(4)} more"), (102, item), (200, "idiot here")]
    docs += [(300 + k, f"{words(300 + k)} {'idiot' if k % 3 == 0 else 'fine'}") for k in range(150)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(300 + k, 0, int(k % 3 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == {k for k in range(60) if k != 3} | {100} | {300 + k for k in range(150) if k % 3}
