"""The pipeline's near-dedup against brute force: five-word shingles, Jaccard similarity 0.8."""

import random
import time

import corpus_pipeline
from skein.llm import common, similar, simhash
from skein.llm import shingles as hashed


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_kept(rows):
    """Number of groups, and the sets of row numbers."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k), []).append(row)
    return list(groups.values())


def near_copies(seed):
    draw = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for _ in range(30):
        words = [f"v{draw.randint(0, 5000)}" for _ in range(draw.randint(30, 200))] + passage * draw.randint(0, 1)
        for _ in range(draw.randint(1, 5)):
            rows.append((len(rows), " ".join(words)))
            for _ in range(draw.randint(1, 3)):
                words[draw.randrange(len(words))] = f"c{draw.randint(0, 10**6)}"
    return rows + [(1000, ""), (1001, None), (1002, " \n"), (1003, "A b"), (1004, "a  B"), (1005, "b a")]


def test_stage_keeps_one_of_each_group_at_similarity_0_8(spark, documents, monkeypatch):
    rows = near_copies(1)
    expected = sorted(min(i for i, _ in group) for group in brute_kept(rows))
    assert len(expected) < len(rows) - 30
    frame = documents(rows).repartition(5)
    out = corpus_pipeline.near_filter(spark, frame, "")
    assert sorted(r.doc_id for r in out.collect()) == expected and out.columns == frame.columns
    monkeypatch.setattr(similar, "SAMPLE", 1)
    monkeypatch.setattr(similar, "COMMON", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert sorted(r.doc_id for r in simhash.drop_near(frame).collect()) == expected


def test_stage_with_null_and_repeated_identifiers_and_empty_tables(documents):
    rows = [(None if i % 3 == 0 else i % 10, t) for i, t in near_copies(2)] * 2
    out = [(r.doc_id, r.text) for r in simhash.drop_near(documents(rows).repartition(3)).collect()]
    groups = brute_kept(rows)
    for group in groups:
        best = min(group, key=lambda r: (r[0] is None, r[0] or 0))[0]
        (kept,) = [i for i, t in out if (i, t) in group]
        assert kept == best
    assert len(out) == len(groups) and simhash.drop_near(documents([])).count() == 0


def test_similarity_just_at_and_below_the_bound():
    w = [f"w{k}" for k in range(49)]  # 45 shingles; another last word changes one, four last words four
    sets = [set(similar.hash_set(list(hashed.hashes(" ".join(x).encode(), 5))).tolist()) for x in (w, w[:-5] + list("abcde"), w[:-6] + list("abcdef"))]
    assert [5 * len(sets[0] & s) >= 4 * len(sets[0] | s) for s in sets] == [True, 5 * 40 >= 4 * 50, False]


def test_copies_unlike_each_other_are_gathered_by_the_least_edited(spark, documents, monkeypatch):
    """Copies with three edits each are similar to the text that they come from and not to each other; its row isn't the first."""
    words = [f"w{k}" for k in range(154)]
    rows = []
    for k in range(60):
        mine = list(words)
        for at in (2 + 5 * (k % 10), 52 + 5 * (3 * k % 10), 102 + 5 * ((7 * k + k // 10) % 10)):
            mine[at] = f"x{k}"
        rows.append((k, " ".join(mine)))
    rows += [(60, " ".join(words)), (61, "another text")]
    assert len(brute_kept(rows)) == 2 and len(brute_kept(rows[:60])) == 60
    monkeypatch.setattr(similar, "SAMPLE", 1)
    pairs, whole = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df, name="table": (out := whole(df, name), pairs.append(out.count()) if name in ("pairs", "possible") else None)[0])
    assert sorted(r.doc_id for r in simhash.drop_near(documents(rows).repartition(3)).collect()) == [0, 61]
    assert sum(pairs) < 4 * len(rows)


def test_parities_leave_all_similar_pairs_and_few_others(spark):
    """Sets of 1 to 400 hashes, which share none to all, and of very different sizes."""
    draw, sets, pairs = random.Random(3), [], []
    for k in range(400):
        n = draw.choice([1, 2, 5, 31, 32, 33, 40, 64, 65, 128, 129, 150, 257, 400])
        one = [draw.getrandbits(64) for _ in range(n)]
        left = one[: round(n * draw.choice([0.0, 0.3, 0.6, 0.8, 0.9, 0.97, 1.0]))]
        two = left + [draw.getrandbits(64) for _ in range(draw.choice([0, 1, round(0.1 * n), n - len(left), 3 * n]))] or one[:1]
        sets += [similar.hash_set([similar.np.array(s, similar.np.uint64)]) for s in (one, two)]
        pairs.append((2 * k + 1, 2 * k))
    keys = spark.createDataFrame([(k, len(s), similar.parity(s).tolist()) for k, s in enumerate(sets)], "row long, n int, parity array<long>")
    left = {(r.a, r.b) for r in similar._likely(spark.createDataFrame(pairs, "a long, b long"), keys).collect()}
    true = {(a, b) for a, b in pairs if 5 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * len(set(sets[a].tolist()) | set(sets[b].tolist()))}
    assert 50 < len(true) < 250 and true <= left and len(left) < len(true) + 25


def test_whole_sets_are_fetched_of_likely_pairs_only(documents, monkeypatch):
    """Texts that begin and end alike share early hashes and are too different: no whole set of them is looked at."""
    draw = random.Random(4)
    rows = []
    for k in range(12):
        words = [f"w{j}" for j in range(100)]
        for at in range(10, 95, 6):
            words[at] = f"x{draw.getrandbits(40)}"
        rows.append((k, " ".join(words)))
    rows += [(100, " ".join(f"y{j}" for j in range(100))), (101, " ".join(f"y{j}" for j in range(98)))]
    assert len(brute_kept(rows)) == 13
    monkeypatch.setattr(similar, "COMMON", 1000)
    fetched, whole = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df, name="table": (out := whole(df, name), fetched.append(out.count()) if name == "sets" else None)[0])
    assert sorted(r.doc_id for r in simhash.drop_near(documents(rows).repartition(3)).collect()) == [*range(12), 100]
    assert sum(fetched) == 2


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder.getAllFiles())) if f.getName().startswith("shuffle_")}
    before = files()
    out = common.cut(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):  # deleted beside the driver's work
        if not (files() - before):
            break
        time.sleep(0.1)
    assert not (files() - before) and out.count() == 1000
