"""Token ids in shuffled planes.

The file format: ids in document order, cut into chunks of ``CHUNK_IDS``. A chunk's ids are
transposed, so that all first bytes (or bits) stand together, then all second ones, and so on,
and each plane is compressed by zstandard. High planes are nearly constant and take no space.
A chunk row holds its planes, their sizes, and which documents have how many ids in it;
the chunk index says where each chunk starts in the whole sequence. Both are Parquet tables, so any
store that Spark writes to will do, and each write task makes one shard of chunks.

Documents are dealt out by ranges of id, hence shards follow one another in id order. Only the
sizes of shards, one row per write task, pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepflow.llm.arrow import raw, slices, texts
from prepflow.llm.tokenization import PART_CHARS, REMEMBERED, load

CHUNK_IDS = 1 << 16
END_ID = 2
PLANES = ("byte", "bit")
WHITE = re.compile(rb"[ \t-\r]")
CHUNKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int64()),
        ("at", pa.int64()),  # ids of the shard before this chunk
        ("n_ids", pa.int64()),
        ("first_doc", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("came_on", pa.bool_()),  # the first document began in an earlier chunk
        ("goes_on", pa.bool_()),  # the last one ends in a later chunk
        ("plane", pa.string()),
        ("sizes", pa.list_(pa.int32())),
        ("planes", pa.binary()),
    ]
)
CHUNKS_DDL = (
    "shard int, chunk bigint, at bigint, n_ids bigint, first_doc bigint, doc_ids array<bigint>, "
    "counts array<bigint>, came_on boolean, goes_on boolean, plane string, sizes array<int>, planes binary"
)
INDEX_DDL = (
    "shard int, chunk bigint, start bigint, n_ids bigint, first_doc bigint, n_docs bigint, bytes bigint"
)
PARTS = "shard int, doc bigint, doc_id bigint, at bigint, n_tokens bigint, whole boolean, ids binary"


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a chunk, most significant first."""
    big = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(big[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(big, axis=1)
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        big = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        big = np.packbits(bits, axis=1)
    return np.ascontiguousarray(big).view(">u4").ravel().astype("<u4")


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and ends every match with an end-of-word token.

    Words between ASCII white space encode alike alone and in their text, and so do the matches in
    a word, wherever a cut lies between ASCII or Latin-1 letters, digits and other ASCII
    characters. So each word is looked up, new words are cut into such pieces, and only pieces
    that are new go to the library, many in one string, told apart again by the end-of-word tokens. Words
    with any other character go to it whole. What is known is kept for the worker's next tasks.
    """

    def __init__(self, definition: str):
        import tokenizers

        # on the library's module: functions sent by value have no module of their own that would last
        kept = vars(tokenizers).setdefault("_prepflow_words", {})
        if kept.get("definition") != definition:
            tokenizer = load(definition)
            ends = np.zeros(max(tokenizer.get_vocab().values(), default=-1) + 1, bool)
            ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            kept.clear()
            kept.update(definition=definition, tokenizer=tokenizer, ends=ends, words={}, pieces={})
        self.tokenizer, self.ends = kept["tokenizer"], kept["ends"]
        self.words, self.pieces = kept["words"], kept["pieces"]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, with ``MARK`` after each, and the positions of the marks."""
        out = []
        for words in ascii_words(BREAK.join([*texts, b""]).lower()):
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self.words[BREAK.strip()] = np.uint32(MARK).tobytes()
            self._learn({*words}.difference(self.words))
            out.append(b"".join(map(self.words.__getitem__, words)))
        ids = np.frombuffer(b"".join(out), "<u4")
        return ids, np.flatnonzero(ids == MARK)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        whole = [w for w in words if not w.isascii() and ODD.search(w)]
        cut = {w: PIECE.findall(w) for w in words.difference(whole)}
        new = list(set(chain.from_iterable(cut.values())).difference(self.pieces))
        groups = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
        for group, ids in zip(groups, self._ids([b" ".join(g) for g in groups])):
            at = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(at) != len(group) or at[-1] != len(ids) * 4:
                self.pieces.update(zip(group, (x.tobytes() for x in self._ids(group))))
                continue
            data, at = ids.tobytes(), [0, *at.tolist()]
            self.pieces.update(zip(group, [data[s:e] for s, e in zip(at, at[1:])]))
        known = self.pieces.__getitem__
        self.words.update(
            (w, known(parts[0]) if len(parts) == 1 else b"".join(map(known, parts))) for w, parts in cut.items()
        )
        self.words.update(zip(whole, (x.tobytes() for x in self._ids(whole))))

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        plain = [t.decode("utf-8", "replace") for t in texts]
        found = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]


MARK = 0xFFFFFFFF  # no id, and
BREAK = b" \xff "  # no UTF-8
JOINED = 100
ODD = re.compile(rb"[\xc2\xc4-\xfe]|\xc3[\x97\xb7]")
# The matches of the vocabulary's pattern within a word of lower-case ASCII and Latin-1 letters.
PIECE = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|(?:[a-z]|\xc3[\x80-\xbf])+|[0-9]|[^a-z0-9\x80-\xff]+")


def ascii_words(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words between ASCII white space, a bounded number of bytes at a time."""
    at = 0
    while at < len(text):
        end = at + PART_CHARS
        if end < len(text):
            found = WHITE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


class _Shard:
    """Cuts the ids of one write task into chunk rows."""

    def __init__(self, shard: int, plane: str, size: int):
        self.shard, self.plane, self.size = shard, plane, size
        self.ids, self.docs, self.n = [], [], 0
        self.doc = self.chunk = self.at = 0
        self.came_on = False
        self.squeeze = zstandard.ZstdCompressor(level=3)

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take documents, whose ids end at ``ends``; give the chunks they fill."""
        at = doc = 0
        while at < len(ids):
            to = min(len(ids), at + self.size - self.n)
            last = int(np.searchsorted(ends, to))  # the document that holds the last of these ids
            edges = np.concatenate([[at], ends[doc:last], [to]])
            self.docs += zip(doc_ids[doc : last + 1], np.diff(edges).tolist())
            self.ids.append(ids[at:to])
            self.n += to - at
            goes_on = ends[last] > to
            doc = last + (not goes_on)
            if self.n == self.size:
                yield self.flush(self.doc + last + 1, bool(goes_on))
            at = to
        self.doc += len(doc_ids)

    def flush(self, begun: int, goes_on: bool = False) -> pa.RecordBatch:
        planes = [self.squeeze.compress(p) for p in to_planes(np.concatenate(self.ids), self.plane)]
        row = {
            "shard": self.shard,
            "chunk": self.chunk,
            "at": self.at,
            "n_ids": self.n,
            "first_doc": begun - len(self.docs),
            "doc_ids": [d for d, _ in self.docs],
            "counts": [n for _, n in self.docs],
            "came_on": self.came_on,
            "goes_on": goes_on,
            "plane": self.plane,
            "sizes": [len(p) for p in planes],
            "planes": b"".join(planes),
        }
        self.at += self.n
        self.chunk += 1
        self.ids, self.docs, self.n, self.came_on = [], [], 0, goes_on
        return pa.RecordBatch.from_pylist([row], schema=CHUNKS)


def _chunks(definition, end_id: int, plane: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = None, None
        for batch in slices(batches):
            encoder = encoder or WordEncoder(definition.value)
            shard = shard or _Shard(TaskContext.get().partitionId(), plane, size)
            data, offsets = raw(batch.column(1))
            data, cuts = data.tobytes(), offsets.tolist()
            ids, marks = encoder.encode([data[s:e] for s, e in zip(cuts, cuts[1:])])
            ids = np.where(ids == MARK, np.uint32(end_id), ids)
            yield from shard.add(batch.column(0).to_pylist(), ids, marks + 1)
        if shard and shard.n:
            yield shard.flush(shard.doc)

    return run


def write_tokens(
    df: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    plane: str = "byte",
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Encode every text and write chunks and chunk index below ``path``, in ascending id order.

    ``tokenizer`` is the path of a tokenizers definition on the driver. A null text counts as
    empty and has only the end id. Null ids come last; rows that share an id follow one another
    in the order of their text's hash. Other columns are ignored; an empty table gives empty
    files that read back as no rows.
    """
    if plane not in PLANES:
        raise ValueError(f"plane must be one of {PLANES}")
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # as large as the vocabulary, not the data
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    docs = texts(df, id_col, text_col).repartitionByRange(*order)
    docs = docs.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    rows = docs.mapInArrow(_chunks(shared, end_id, plane, chunk_ids), CHUNKS_DDL)
    rows.write.parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS_DDL).parquet(f"{path}/chunks")
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    start, starts = 0, []
    for row in sizes:  # one row per write task
        starts.append((row["shard"], start))
        start += row["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start bigint"))
    chunks.join(starts, "shard").select(
        "shard",
        "chunk",
        (F.col("shard_start") + F.col("at")).alias("start"),
        "n_ids",
        "first_doc",
        F.size("counts").cast("bigint").alias("n_docs"),
        F.length("planes").cast("bigint").alias("bytes"),
    ).write.parquet(f"{path}/index")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each document in each chunk; ``whole`` if the chunk has all of them."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            planes, at = [], 0
            for size in row["sizes"]:
                planes.append(expand.decompress(row["planes"][at : at + size]))
                at += size
            ids = from_planes(planes, row["n_ids"], row["plane"])
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            n = len(counts)
            whole = np.ones(n, bool)
            whole[0] = not row["came_on"]
            whole[-1] &= not row["goes_on"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row["shard"], np.int32)),
                    pa.array(row["first_doc"] + np.arange(n)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - counts),
                    pa.array(counts),
                    pa.array(whole),
                    pa.array([ids[e - c : e].tobytes() for c, e in zip(counts, ends)], pa.binary()),
                ],
                names=["shard", "doc", "doc_id", "at", "n_tokens", "whole", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids (little-endian unsigned 32-bit) of every document.

    A chunk is read by itself. Only documents that lie in several chunks are put together, and
    such a group is the parts of one document.
    """
    chunks = spark.read.schema(CHUNKS_DDL).parquet(f"{path}/chunks")
    index = spark.read.schema(INDEX_DDL).parquet(f"{path}/index")
    # one row per write task: the index of first chunks
    starts = F.broadcast(index.where("chunk = 0").select("shard", F.col("start").alias("shard_start")))
    rows = chunks.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("at"))
    parts = rows.select(
        "shard", "start", "n_ids", "first_doc", "doc_ids", "counts", "came_on", "goes_on", "plane", "sizes", "planes"
    ).mapInArrow(_parts, PARTS)
    whole = parts.where("whole").select("doc_id", F.col("at").alias("start"), "n_tokens", "ids")
    split = (
        parts.where("not whole")
        .groupBy("shard", "doc")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.min("at").alias("start"),
            F.sum("n_tokens").alias("n_tokens"),
            F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"),
        )
        .select(
            "doc_id",
            "start",
            "n_tokens",
            F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        )
    )
    return whole.unionByName(split)
