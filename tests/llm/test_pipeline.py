import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
import oracle
from prepflow.llm import line_dedup, mixing, quality
from test_jaccard import _stay
from test_passages import _without
from prepflow.llm.queries import ORACLE, QUERIES
from prepflow.llm.vocabularies import PATTERN, tokenizer_file


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, key):
    assert oracle.compare(QUERIES[key](spark, sf_dir), duck, ORACLE[key]) is None


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.items() <= entry.queries().items()


def _rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_against_brute_force(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    good = stages["quality classifier"](spark, docs, sf_dir)
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    before = [r for r in _rows(docs) if r[0] in kept]
    assert sorted(_rows(good)) == sorted(before) and 0 < len(before) < docs.count()

    lines = stages["line dedup"](spark, good, sf_dir)
    want = _without([r[:2] for r in before], line_dedup.GRAM + line_dedup.WINDOW - 1)
    after = _rows(lines)
    assert {i: t for i, t, _ in after} == {i: v[1] for i, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = stages["SimHash near-dedup"](spark, lines, sf_dir)
    assert sorted(((i, t or "") for i, t, _ in _rows(single)), key=str) == _stay([r[:2] for r in after])

    mixed = stages["mixing sources"](spark, single, sf_dir)
    assert Counter(r[0] for r in _rows(mixed)) == Counter(r["doc_id"] for r in mixing.mix(single).select("doc_id").collect())
    assert {r[0] for r in _rows(mixed)} == {r[0] for r in _rows(single)}
    for df in (good, lines, single, mixed):
        assert df.columns == docs.columns

    out = stages["byte-level BPE"](spark, mixed, sf_dir).collect()
    from prepflow.llm.tokenization import read_ranks

    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, _ in _rows(mixed):
        ids = encoding.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), brute.sha(t.encode())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want


def test_run_is_the_stages_in_order(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert found.where(F.length("ids") != F.col("n_tokens") * 4).count() == 0 and found.count() > 100


def test_stages_take_odd_tables(spark, sf_dir):
    """Nulls, repeated rows and an empty table, with the columns of documents."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, "a b c d. e f g.", "en", "s", 15), (1, "a b c d. e f g.", "en", "s", 15), (None, None, None, None, None), (2, "", None, "t", None), (3, None, "fr", None, 0)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs, counts = table, []
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            counts.append(docs.count())
        # nothing to learn rejects no row; one line of few words is no passage; then the copies are one row,
        # and so are the three texts without words; a source without tokens is not repeated
        assert counts == ([0] * 5 if table.isEmpty() else [5, 5, 2, 2, 2])
        assert {r["doc_id"] for r in docs.collect()} == (set() if table.isEmpty() else {1, 2})
