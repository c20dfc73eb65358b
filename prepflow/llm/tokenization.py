"""Byte-level BPE over Arrow batches with the tokenizers library, and its inverse.

The rank file names byte strings. Byte-level BPE spells every byte as one printable character,
so that the vocabulary is text; ``byte_characters`` is that mapping, ``definition`` spells the
file with it and lists, for each token, every way to make it of two others, by rank: merging by that list is merging by rank.
Decoding looks up each id's characters, takes them back to bytes and joins these; only then is
anything read as UTF-8, because a character may be split over several tokens.

Words repeat, so each batch sends the library only the parts it has not seen before. Parts are cut
where no match of the pattern can cross, hence encode alike alone and in their text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prepflow.llm.arrow import slices, texts

REMEMBERED = 600_000
PART_CHARS = 1 << 20
ENCODED = (
    "doc_id bigint, n_tokens bigint, ids binary, starts binary, decoded string, "
    "ids_sha256 string, decoded_sha256 string"
)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file, read once on the driver; its size is the vocabulary's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def definition(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizer as the tokenizers library reads it."""
    spelling = byte_characters()
    spell = {token: "".join(spelling[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((rank, ranks[left], ranks[right], f"{spell[left]} {spell[right]}"))
    merges.sort()
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    spelled = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, spelled]},
            "decoder": spelled,
            "model": {
                "type": "BPE",
                "ignore_merges": True,  # a match that is a token is not merged
                "vocab": {spell[token]: rank for token, rank in ranks.items()},
                "merges": [m[-1] for m in merges],
            },
        }
    )


class PartEncoder:
    """Ids of whole texts from the ids of their parts, as little-endian unsigned 32-bit integers.

    ``keys`` cuts a text into parts. Parts seen before are remembered, ``REMEMBERED`` at most.
    """

    def __init__(self, tokenizer, keys: Callable):
        self.tokenizer, self.keys, self.known = tokenizer, keys, {}

    def encode(self, texts: list) -> list[bytes]:
        out = []
        for text in texts:
            ids = []
            for parts in self.keys(text):
                if len(self.known) > REMEMBERED:
                    self.known = {}
                known = self.known
                new = list({*parts}.difference(known))
                if new:
                    plain = [p if isinstance(p, str) else p.decode("utf-8", "replace") for p in new]
                    found = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
                    known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, found))
                ids.append(b"".join([known[p] for p in parts]))
            out.append(b"".join(ids))
        return out


def load(definition_text: str):
    """The tokenizer, on the one core of its task; strings of special tokens are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition_text)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    return tokenizer


# A single space between two characters that are not white space starts a match of any pattern
# that takes a leading space and white space as this kind does.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
RUN = re.compile(r"\s\s")


def spaced_parts(text: str) -> Iterator[list[str]]:
    """Lists of parts of a text, each but the first with its leading space; a long text gives several."""
    at = 0
    while at < len(text):
        found = BOUNDARY.search(text, at + PART_CHARS)
        end = found.start() if found else len(text)
        here = text[at:end]
        cut = BOUNDARY.split(here) if at or RUN.search(here) else here.split(" ")
        yield [cut[0], *[" " + part for part in cut[1:]]]
        at = end


class ByteLevel:
    """Encoder and decoder, made from the definition inside a task."""

    def __init__(self, text: str):
        self.tokenizer = load(text)
        self.parts = PartEncoder(self.tokenizer, spaced_parts)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, rank in vocab.items():
            self.bytes[rank] = bytes(back[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.parts.encode([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token starts in the text: tokens tile it, split characters included."""
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes


def _encode(definition_text, give: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in slices(batches):
            codec = codec or ByteLevel(definition_text.value)
            decimal = codec.decimal
            n, raw_ids, starts, texts_back, ids_sha, decoded_sha = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                decoded = codec.decode(ids)
                n.append(len(ids))
                raw_ids.append(ids.tobytes() if "ids" in give else None)
                starts.append(codec.starts(ids).astype("<u4").tobytes() if "starts" in give else None)
                texts_back.append(decoded if "decoded" in give else None)
                ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(raw_ids, pa.binary()),
                    pa.array(starts, pa.binary()),
                    pa.array(texts_back, pa.binary()).view(pa.string()),
                    pa.array(ids_sha, pa.string()),
                    pa.array(decoded_sha, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "starts", "decoded", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(
    df: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    give: tuple[str, ...] = ("ids", "starts", "decoded"),
) -> DataFrame:
    """Encode every text and decode its ids again.

    ``ranks`` is the path of a rank file on the driver, ``pattern`` cuts a text into the matches
    that are encoded separately. Returns doc_id, n_tokens, ids and starts (little-endian unsigned
    32-bit integers: the ids, and the byte where each token starts), decoded, ids_sha256 (of the
    decimal ids joined by commas) and decoded_sha256. Of ids, starts and decoded those not named in
    ``give`` are null.

    A null text counts as empty and has no ids. Rows that repeat each get a row, null ids stay
    null, other columns are ignored, and an empty table gives an empty result.
    """
    text = definition(read_ranks(ranks), pattern)
    shared = df.sparkSession.sparkContext.broadcast(text)  # as large as the vocabulary, not the data
    return texts(df, id_col, text_col).mapInArrow(_encode(shared, tuple(give)), ENCODED)
