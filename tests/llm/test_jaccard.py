import random
from itertools import combinations

import brute
import corpus_pipeline
from prepflow.llm import jaccard


def _shingles(text):
    w = brute.lowered(text).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _pairs(rows):
    """Index pairs of a Jaccard similarity of 4/5 or more, or without words."""
    sets = [_shingles(t) for _, t in rows]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return [(i, j) for i, j in combinations(range(len(rows)), 2) if near(sets[i], sets[j])]


def _stay(rows):
    """One row per class: the smallest id, null last, then the smallest text hash."""
    root = list(range(len(rows)))
    for i, j in _pairs(rows):
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    best = {}
    for r, (i, t) in zip(root, rows):
        row = (i is None, i or 0, brute.sha((t or "").encode())), (i, t or "")
        best[r] = min(best.get(r, row), row, key=lambda x: x[0])
    return sorted((row for _, row in best.values()), key=str)


def _varied(seed):
    """Texts and their copies with a few words changed, so similarities lie on both sides of 4/5."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    line = [word() for _ in range(8)]
    rows = []
    for _ in range(30):
        base = line + [word() for _ in range(rng.choice([4, 30, 120, 300]))]
        rows.append(base)
        for _ in range(rng.randint(1, 4)):
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def _stage(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    found = corpus_pipeline.one_of_each_class(spark, docs, "")
    assert found.columns == docs.columns
    return sorted(((r["doc_id"], r["text"] or "") for r in found.collect()), key=str)


def test_stage_finds_every_pair(spark, monkeypatch):
    for name, value in (("HOT", 3), ("LOCAL", 2), ("COUNTED", 3_000), ("SEEN", 7), ("VOTES", 50)):
        monkeypatch.setattr(jaccard, name, value)
    rows = _varied(1) + [(1_000, None), (1_001, ""), (1_002, "A b"), (1_003, "a B"), (1_004, "a b c")]
    assert len(_pairs(rows)) > 40
    assert _stage(spark, rows) == _stay(rows)


def test_recall_on_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = {r["doc_id"]: r["class_id"] for r in jaccard.near_copies(docs).collect()}
    near = _pairs(rows)
    found = sum(of[rows[i][0]] == of[rows[j][0]] for i, j in near)
    print(f"pairs of 4/5 or more in one class: {found} of {len(near)}")
    assert near and found == len(near)


def test_one_row_of_repeated_and_null_ids(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, text), (3, text), (3, other), (7, text), (None, text), (None, other), (None, "x y"), (None, "x y"), (None, None), (None, "")]
    assert _stage(spark, rows) == sorted([(3, text), (3, other), (None, "x y"), (None, "")], key=str)


def test_columns_of_any_name(spark):
    names = "copies stays as first row row_id row_key row_hash name_id class_id text_key unnamed key n".split()
    rows = [(i, t, *[k + i for k in range(len(names))]) for i, t in [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (3, "x")]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    found = jaccard.one_of_each_class(docs)
    assert found.columns == docs.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted({rows[0], rows[2]})


def test_fingerprints_against_definition(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "VOTES", 7)
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 9, 30, 0]
    hashes, offsets = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for s, e in zip(offsets[:-1], offsets[1:]):
        own = [int(h) for h in hashes[s:e]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    assert jaccard.fingerprints(hashes, offsets).view(np.uint64).tolist() == want


def test_bound_of_shared_hashes():
    """The leading bits never hide a shared hash."""
    import numpy as np

    rng = np.random.default_rng(9)
    for n in (0, 1, 50, 3_000):
        a, b = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate([a[: n // 2], b]))
        lead = lambda x: (x >> np.uint64(48)).astype(np.uint16)
        assert len(np.intersect1d(a, b)) <= jaccard.shared_at_most(lead(a), lead(b)) <= min(len(a), len(b))


def test_group_of_near_copies_is_not_paired_out(spark, monkeypatch):
    """Of a large group of copies some pairs are near and most are not: half of them need no check, and no class is split."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, rows = [word() for _ in range(300)], []
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(300), rng.randint(3, 6)):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    asked, check = [], jaccard._checked

    def counted(docs, pairs, words, short):
        asked.append(pairs.count() if short else 0)
        return check(docs, pairs, words, short)

    monkeypatch.setattr(jaccard, "_checked", counted)
    assert 200 < len(_pairs(rows)) < 4_000
    assert _stage(spark, rows) == _stay(rows)
    print("pairs checked:", asked)
    assert sum(asked) < 50 * len(rows)
