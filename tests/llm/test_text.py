"""Decontamination, toxicity, language, secrets against brute force and held-out accuracy."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import crf, decontaminate, language_id, secrets, toxicity

from . import plain_secrets
from .conftest import ITEM, TRICKY


def contamination_rows():
    draw = random.Random(7)
    word = lambda: f"k{draw.randint(0, 12)}"
    items = [(k, " ".join(word() for _ in range(draw.choice([1, 2, 5, 12, 13, 14, 20, 30])))) for k in range(12)] + [(None, "odd one out"), (20, None), (21, "--- !"), (3, "A again, k1"), (30, "k1 k2 k1 k2 k1 k2 k1 k2 k1 k2 k1 k2 k1 k2 k1 k2")]
    docs = list(TRICKY[:6])
    for k in range(60):
        words = [word() for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.7:
            own = (draw.choice(items)[1] or "").split()
            words[10:10] = own[draw.randint(0, 3) :]
        docs.append((100 + k, draw.choice([" ", "-", "\n"]).join(words).upper() if k % 3 else " ".join(words)))
    return docs, items


@pytest.mark.parametrize("bound", [1 << 24, 120])
def test_contamination(spark, documents, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", bound)  # 120: several automata, a pass each
    docs, items = contamination_rows()
    named = [("" if i is None else str(i), (t or "").encode()) for i, t in items]
    expected = [(i, *decontaminate.brute_force((t or "").encode(), named)) for i, t in docs]
    frame, bench = documents(docs), spark.createDataFrame(items, ITEM)
    assert sorted(map(repr, map(tuple, decontaminate.verdicts(decontaminate.contamination(frame, bench)).collect()))) == sorted(map(repr, expected))
    kept = decontaminate.drop_contaminated(frame, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(e[0]) for e in expected if not e[5])
    assert kept.columns == frame.columns


def test_removed_spans(spark, documents):
    item = " ".join(f"q{k}" for k in range(20))
    rest = " ".join(f"z{k}" for k in range(400))
    frame = documents([(1, f"{rest}. {item.upper()}, end"), (2, item), (3, None), (4, rest)])
    bench = spark.createDataFrame([(1, item)], ITEM)
    found = {r.doc_id: r.text for r in decontaminate.remove_spans(frame, bench).collect()}
    assert found == {1: f"{rest}. , end", 3: None, 4: rest}
    assert {r.doc_id for r in decontaminate.remove_spans(frame, bench, max_coverage=2).collect()} == {1, 2, 3, 4}


def test_contamination_of_empty_tables(spark, documents, clashing):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.verdicts(decontaminate.contamination(documents([]), none)).count() == 0
    assert decontaminate.verdicts(decontaminate.contamination(clashing, none)).where("n_hit = 0").count() == 4


TOXIC = ["idiot", "trash", "moron", "clown", "lowei", "vequ"]


def labelled(seed, n):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(draw.choice(["an", "er", "th", "on", "re", "in", "ed"]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(4, 80))]
        bad = k % 5 == 0
        for _ in range(draw.randint(1, 4) if bad else 0):
            stem = draw.choice(TOXIC)
            words[draw.randrange(len(words))] = stem + (draw.choice(["an", "er", "on"]) if stem in TOXIC[4:] else "")
        for at in range(6, len(words), 7):
            words[at] += draw.choice([".", "!", "?\n"])
        rows.append((k, " ".join(words)))
        labels.append(int(bad))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, documents):
    rows, labels = labelled(1, 900)
    frame = documents(rows)
    marks = spark.createDataFrame([(i, 0, y) for (i, _), y in zip(rows, labels, strict=True)] + [(None, 0, 1), (5, 0, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    found = {r.doc_id: r for r in toxicity.score(frame, model, locate=True).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    right = [(found[k].tox_score >= toxicity.THRESHOLD) == bool(labels[k]) for k in held]
    assert len(held) > 150 and np.mean(right) > 0.97
    for k in held:
        for x in found[k].tox_sentences:
            assert any(t in rows[k][1][x.start : x.end] for t in TOXIC)
    kept = toxicity.drop_toxic(frame, marks)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.tox_score < toxicity.THRESHOLD} and kept.columns == frame.columns


def test_toxicity_of_tricky_and_empty_tables(spark, documents, tricky, clashing):
    rows, labels = labelled(2, 300)
    model = toxicity.fit([t for _, t in rows], labels)
    out = {r.doc_id: r.tox_score for r in toxicity.score(tricky, model).collect()}
    assert out[1] == out[2] == out[3] == 0 and all(0 <= p <= 1 for p in out.values())
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(tricky, no_labels).count() == len(TRICKY)
    assert toxicity.score(documents([]), model).count() == 0
    out = toxicity.score(clashing, model, locate=True)
    assert {r.doc_id for r in out.where("tox_score >= 0.3").collect()} == {4} and sorted(out.columns) == sorted(clashing.columns)
    marks = spark.createDataFrame([(k, 0, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(clashing, marks).columns == clashing.columns
    assert len(toxicity.training_rows(documents([(5, "x")] * 40 + [(1, "y" * 100)]), marks, 3)) <= 3
    assert toxicity.training_rows(documents([(1, "y" * 100), (3, "z")]), marks, 9, 50) in ([], [("z", 1)])
    assert toxicity.fit([], []).bias < -20 and toxicity.fit(["a"], [1]).bias < -20


def test_noisy_or_by_hand():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    p = 1 / (1 + np.exp(1.0))
    assert toxicity.Scorer(model).scores(["a b. c! d", "", "...", "x"]) == pytest.approx([1 - (1 - p) ** 3, 0, 0, p])


def test_forward_backward_against_enumeration(monkeypatch):
    draw = np.random.default_rng(1)
    for _ in range(12):
        monkeypatch.setattr(crf, "SEGMENT", int(draw.integers(1, 9)))
        monkeypatch.setattr(crf, "NORMAL", int(draw.integers(1, 4)))
        lengths = draw.integers(1, 8, 4)
        scores, move, begin = draw.normal(size=(lengths.sum(), 3)) * 3, draw.normal(size=(3, 3)), draw.normal(size=3)
        found, pairs = crf.Chains(scores, lengths, move, begin).marginals(pairs=True)
        at, counts = 0, np.zeros((3, 3))
        for n in lengths.tolist():
            s, total, one, two = scores[at : at + n], 0.0, np.zeros((n, 3)), np.zeros((3, 3))
            for y in product(range(3), repeat=n):
                w = np.exp(begin[y[0]] + sum(s[k, y[k]] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
                total += w
                for k in range(n):
                    one[k, y[k]] += w
                for k in range(n - 1):
                    two[y[k], y[k + 1]] += w
            assert np.allclose(found[at : at + n], one / total)
            counts += two / total
            at += n
        if crf.SEGMENT >= 7:  # pairs are for sequences of one segment
            assert np.allclose(pairs, counts)


SYLLABLES = {"en": ["th", "er", "on", "ing", "whi"], "de": ["sch", "ung", "keit", "ü", "ver"], "fr": ["eau", "ou", "é", "ch", "tion"]}


def sentences(language, n, draw):
    return " ".join("".join(draw.choice(SYLLABLES[language]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def test_language_on_held_out_and_mixed_texts(spark, documents):
    draw = random.Random(3)
    rows = [(k, lang, sentences(lang, draw.randint(5, 60), draw)) for k, lang in enumerate(draw.choice(list(SYLLABLES)) for _ in range(400))]
    frame = documents([(k, t) for k, _, t in rows]).drop("lang").join(spark.createDataFrame([(k, g) for k, g, _ in rows], "doc_id long, lang string"), "doc_id")
    model = language_id.train(frame, 150)
    found = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    held = [(k, g) for k, g, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([found[k].lang_pred == g for k, g in held]) > 0.98 and all(0 <= r.lang_score <= 1 for r in found.values())
    mixed = f"{sentences('en', 30, draw)} {sentences('de', 30, draw)}"
    words = language_id.identify(documents([(1, mixed)]), model, words=True).first().word_langs
    right = [w.lang == ("en" if k < 30 else "de") for k, w in enumerate(words)]
    assert len(words) == 60 and np.mean(right) > 0.9


def test_language_of_tricky_and_empty_tables(spark, documents, tricky, clashing):
    model = language_id.fit([sentences(g, 300, random.Random(1)) for g in SYLLABLES], list(SYLLABLES))
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify(tricky, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[6][0] in SYLLABLES and out[8][0] in SYLLABLES
    none = language_id.train(documents([]))
    assert {r.lang_pred for r in language_id.identify(tricky, none, words=True).collect()} == {"und"}
    assert language_id.identify(documents([]), model).count() == 0 and language_id.identify(clashing, model, words=True).count() == 4
    assert language_id.train(clashing).languages == ["en"]
    assert language_id.fit(["1 2"], ["en"]).languages == []


def secret_texts():
    draw = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rand = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    out = [t or "" for _, t in TRICKY]
    out += ["token=api_key: abcdefgh", "TOKEN = 'short' secret: \"longenough\"", "api-key=xxxxxxxxx apikey=123456789 paſſword=12345678", "AKIA AKIAABCDEFGHIJKL AKIAAKIAAKIAAKIAZ", "é" * 5 + "deadbeef" * 4 + "0é token=" + "a" * 8]
    for n in (20, 32, 40, 64):
        out.append(f"see {rand(b64, n)}== and {rand('0123456789ABCDEF', n)}, {rand('abcdefghijklmnopqrstuvwxyz0123456789', n)}.")
        out.append(f"aaaaaaaaaaaaaaaaaaaa1 {'ab1' * n} license_version_3_of_the_gnu_project " + rand(b64, n))
    out.append(" ".join(f"token={rand('abcdef0123456789', 12)}" for _ in range(700)))
    return out


def test_secrets(documents):
    rows = list(enumerate(secret_texts()))
    found = {r.doc_id: r for r in secrets.report(secrets.scan(documents(rows).repartition(3))).collect()}
    added = 0
    for k, text in rows:
        base, spans = plain_secrets.brute_report(text)
        kinds = [x.split(":")[0] for x in base.split(",")] if base else []
        r = found[k]
        assert (r.spans, r.base_sha256) == (spans, hashlib.sha256(base.encode()).hexdigest()), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(x) for x in secrets.KINDS[:3])
        added += spans.count("random")
    assert added >= 10  # random tokens are found; periodic ones and names aren't
    assert "random" not in plain_secrets.brute_report("aaaaaaaaaaaaaaaaaaaa1 " + "ab1" * 30)[1]


WORDS = """customer order item total shipping address user account session handler factory manager service config parser index table column value update
delete create process request response client server database connection pool thread worker message queue stream buffer reader writer file path folder
image document page section header footer button widget layout style theme color margin border align first last next previous version package""".split()


def test_recall_of_random_tokens_and_precision_on_names():
    """By length and encoding at least 0.95 of random tokens are reported, and few names of several words and a number."""
    draw = random.Random(9)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for alphabet in (digits + low[:6], low.upper() + "234567", digits + low, digits + low + low.upper(), digits + low + low.upper() + "+/"):
        for n in (20, 24, 32, 40, 64):
            tokens = ["".join(draw.choice(alphabet) for _ in range(n)) for _ in range(500)]
            tokens = [t for t in tokens if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]
            kept = np.mean([plain_secrets.p_value(t) * n / secrets.LEAST_TOKEN > secrets.DISCOVERY for t in tokens])
            assert kept > 0.94, (alphabet, n, kept)
    names = [draw.choice(["_", "-", ""]).join([*draw.sample(WORDS, draw.randint(3, 5)), str(draw.randint(1, 2030))]) for _ in range(1500)]
    reported = [plain_secrets.p_value(t) * len(t) / secrets.LEAST_TOKEN > secrets.DISCOVERY for t in names if len(t) >= 20]
    assert np.mean(reported) < 0.2 and np.mean([r for r, t in zip(reported, [t for t in names if len(t) >= 20], strict=True) if len(t) >= 30]) < 0.06


def test_the_query_finds_a_planted_token_that_no_pattern_fits(documents, tmp_path):
    token = "q7ZxP0vKe3Rw9Lm2Ty8Ub5Nd1Hs6Fj4Ga"
    draw = random.Random(2)
    texts = [f"deploy with {token} please", "see customer_order_total_2024 there", None, f"{'word ' * 30000}{token}", "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))]
    frame = documents(list(enumerate(texts)))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.spans for r in secrets.op4_secrets(frame.sparkSession, str(tmp_path)).collect()}
    assert found == {0: f"random:12:{12 + len(token)}", 1: "", 2: "", 3: f"random:150000:{150000 + len(token)}", 4: "random:0:200000"}


def test_secrets_of_tricky_and_empty_tables(tricky, clashing):
    out = secrets.report(secrets.scan(tricky)).collect()
    assert len(out) == len(TRICKY) and all(r.spans == "" for r in out if r.doc_id in (1, 2, 3))
    assert secrets.report(secrets.scan(tricky.limit(0))).count() == 0 and secrets.report(secrets.scan(clashing)).count() == 4


def test_running_sums_over_many_groups(spark):
    sizes = [random.Random(k).randint(0, 9) for k in range(1000)]
    frame = spark.createDataFrame([(sizes,), ([],), ([5],)], "x array<bigint>")
    found = [r.y for r in frame.select(secrets._running(F.col("x")).alias("y")).collect()]
    assert found == [np.cumsum(sizes).tolist(), [], [5]]
