import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from prepflow.llm import token_files, tokenization
from prepflow.llm.vocabularies import PATTERN, tokenizer_file

tiktoken = pytest.importorskip("tiktoken")
RANKS = tokenizer_file("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizer_file("word_bpe_49k.json")
TEXTS = EDGES + [
    (20, "it's  WE'LL   they'd\n\n\n  x \t y z　 1234567 éé 文字 👍🏽"),
    (21, "<|endoftext|> <|startoftext|>"),
    (22, "a\x1cb \x85 c d   "),
    (23, "=" * 400 + " " * 90 + "aaa" * 300),
]


@pytest.fixture(scope="module")
def codec():
    return tokenization.ByteLevel(tokenization.definition(tokenization.read_ranks(RANKS), PATTERN))


@pytest.fixture(scope="module")
def reference():
    ranks = tokenization.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    public = pytest.importorskip("public_tokenizers")
    assert PATTERN == public.PATTERN


def test_byte_characters_are_a_bijection():
    spelled = tokenization.byte_characters()
    assert len(set(spelled)) == 256 and spelled[0x41] == "A" and not any(c.isspace() for c in spelled)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'aé1.-")), max_size=60))
def test_like_tiktoken(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_runs_like_tiktoken(codec, reference):
    rng = random.Random(3)
    for _ in range(800):
        unit = rng.choice(["a", "ab", "-", "0", "\n", " ", "é", "文", "the "])
        text = "".join(rng.choice([unit, unit, unit, " ", "x"]) for _ in range(rng.randint(1, 50)))
        assert codec.encode(text).tolist() == reference.encode_ordinary(text)


def test_starts_tile_split_characters(codec):
    text = "née 文字 👍🏽"
    ids = codec.encode(text)
    starts = codec.starts(ids).tolist() + [len(text.encode())]
    whole = text.encode()
    pieces = [whole[a:b] for a, b in zip(starts, starts[1:])]
    assert pieces == [codec.bytes[i] for i in ids]
    assert any(p.decode(errors="replace").endswith("�") for p in pieces)  # a character lies in two tokens


def test_long_text_is_cut_where_no_match_crosses(codec, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["word", "  ", " ", "\n", "1", "'s", "é"]) for _ in range(4_000))
    want = codec.encode(text).tolist()
    monkeypatch.setattr(tokenization, "PART_CHARS", 50)
    monkeypatch.setattr(tokenization, "REMEMBERED", 20)
    assert codec.encode(text).tolist() == want


def test_documents(clash, reference):
    rows = TEXTS + [(4, "again"), (4, "again")]
    found = tokenization.encode_documents(clash(rows), RANKS, PATTERN).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"]) for r in found)
    want = []
    for i, t in rows:
        ids, data = reference.encode_ordinary(t or ""), (t or "").encode()
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((str(i), len(ids), digest, hashlib.sha256(data).hexdigest(), t or ""))
    assert got == sorted(want)
    few = tokenization.encode_documents(clash(rows[:2]), RANKS, PATTERN, give=()).first()
    assert few["ids"] is None and few["decoded"] is None
    assert tokenization.encode_documents(clash([]), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("plane", token_files.PLANES)
@pytest.mark.parametrize("n", [1, 7, 8, 1_000])
def test_planes_round_trip(plane, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = token_files.to_planes(ids, plane)
    assert len(planes) == {"byte": 4, "bit": 32}[plane]
    assert (token_files.from_planes(planes, n, plane) == ids).all()


@pytest.mark.parametrize("plane,chunk_ids", [("byte", 1 << 16), ("bit", 7), ("byte", 1)])
def test_files_round_trip(spark, clash, tmp_path, plane, chunk_ids):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows = [r for r in TEXTS if r[0] not in ((8, 9, 10) if chunk_ids == 1 else ())] + [(30, "tie"), (30, "tie")]
    path = str(tmp_path / "t")
    token_files.write_tokens(clash(rows), WORDS, path, plane=plane, chunk_ids=chunk_ids)
    found = token_files.read_tokens(spark, path).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in found) == want
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert [r["start"] for r in index] == list(np.cumsum([0] + [r["n_ids"] for r in index])[:-1])
    assert all(r["n_ids"] <= chunk_ids for r in index)


def test_files_of_no_rows(spark, clash, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(clash([]), WORDS, path)
    assert token_files.read_tokens(spark, path).count() == 0
    with pytest.raises(ValueError, match="plane"):
        token_files.write_tokens(clash([]), WORDS, path, plane="nibble")
