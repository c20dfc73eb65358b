"""Quality scores learned from preferences: a Bradley-Terry model.

Every document has a score, a linear function of features of its text. That a good document is
preferred over a bad one has the probability sigmoid(score difference), so the model is fitted by
logistic loss on feature differences of pairs, here by Newton steps with a ridge. The threshold is a quantile
of the scores of the labelled documents. Scores are shown as numbers from 0 to 1 with the threshold at ``CUT``.

Every labelled document takes part in the fit. They are dealt to blocks of at most ``BLOCK`` of either label, and
pairs are drawn within a block: as many as it has documents of its commoner label, or its share of ``PAIRS``
if that is more. A Newton step adds up one gradient and Hessian per block, in the order of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.arrow import slices, texts
from prepflow.llm.exchange import units
from prepflow.llm.hashing import Hasher
from prepflow.llm.jaccard import bit_table, in_table
from prepflow.llm.line_dedup import NEWLINE
from prepflow.llm.substring_dedup import SPACE
from prepflow.operators.ordering import index_rows, running_weights
from prepflow.session import checkpoint

BLOCK = 10_000  # documents of a label in a block
ADDED = 64  # groups of blocks whose sums reach the driver
PAIRS = 100_000
STEPS = 12
CUT = 0.7
STEEP = 4.0  # of the shown score, per standard deviation of the labelled scores
RIDGE = 1e-3

FEATURES = [
    "words", "characters", "lower", "upper", "digits", "space", "wide", "stops", "marks", "rare_marks",
    "control", "word_length", "long_words", "short_words", "capital_words", "marked_words", "bare_marks",
    "distinct_words", "commonest_word", "pairs_distinct", "lines", "distinct_lines", "commonest_line",
    "words_per_stop",
]


def _classes() -> dict[str, np.ndarray]:
    at = np.arange(256)
    stops = np.isin(at, list(b".,;:'\"()-?"))
    space = SPACE
    lower = (at >= 0x61) & (at <= 0x7A)
    upper = (at >= 0x41) & (at <= 0x5A)
    digits = (at >= 0x30) & (at <= 0x39)
    wide = at >= 0x80
    control = (at < 0x20) & ~space
    marks = ~(stops | space | lower | upper | digits | wide | control)
    return {
        "lower": lower, "upper": upper, "digits": digits, "space": space, "wide": wide, "stops": stops,
        "marks": marks, "rare_marks": marks & ~np.isin(at, list(b"!%&/")), "control": control,
    }


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the runs between ``offsets``, empty runs included."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _variety(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each run has, and how often its commonest one occurs."""
    n = len(offsets) - 1
    run = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((hashes, run))
    run, hashes = run[order], hashes[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(run)))
    most = np.zeros(n)
    np.maximum.at(most, run[begin], times)
    return np.bincount(run[begin], minlength=n).astype(float), most


class Featurizer:
    """Features of all texts of a batch; those of an empty text are zero."""

    def __init__(self):
        self.hasher, self.classes = Hasher(), _classes()

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        data, starts, ends, words = units(part, SPACE)
        _, line_starts, line_ends, lines = units(part, NEWLINE, SPACE)
        sizes = np.array([len(t) for t in part["text"].cast(pa.binary()).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        n_bytes, n_words, n_lines = (np.maximum(np.diff(x), 1).astype(float) for x in (offsets, words, lines))
        count = {name: _sums(flags[data], offsets) / n_bytes for name, flags in self.classes.items()}
        length = (ends - starts).astype(float)
        mark, upper = self.classes["marks"], self.classes["upper"]
        last = data[ends - 1]
        hashes = self.hasher.runs(data, starts, ends)
        different, commonest = _variety(hashes, words)
        two = np.append(self.hasher.windows(hashes, 2), np.zeros(min(1, len(hashes)), np.uint64))
        two_different, _ = _variety(two, words)
        line_different, line_commonest = _variety(self.hasher.runs(data, line_starts, line_ends), lines)
        columns = {
            "words": np.log1p(np.diff(words)),
            "characters": np.log1p(np.diff(offsets)),
            **count,
            "word_length": _sums(length, words) / n_words,
            "long_words": _sums(length > 15, words) / n_words,
            "short_words": _sums(length <= 3, words) / n_words,
            "capital_words": _sums(upper[data[starts]], words) / n_words,
            "marked_words": _sums(mark[last], words) / n_words,
            "bare_marks": _sums((length == 1) & mark[last], words) / n_words,
            "distinct_words": different / n_words,
            "commonest_word": commonest / n_words,
            "pairs_distinct": two_different / n_words,
            "lines": np.log1p(np.diff(lines)) - np.log1p(np.diff(words)),
            "distinct_lines": line_different / n_lines,
            "commonest_line": line_commonest / n_lines,
            "words_per_stop": np.log1p(np.diff(words)) - np.log1p(_sums(data == 0x2E, offsets)),
        }
        base = np.stack([columns[f] for f in FEATURES], axis=1)
        base[np.diff(offsets) == 0] = 0
        return base


@dataclass
class Ranking:
    """A fitted Bradley-Terry model: standardisation, weights, and the threshold of the raw score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def inputs(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z], axis=1)

    def raw(self, features: np.ndarray) -> np.ndarray:
        return self.inputs(features) @ self.weights

    def shown(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1, ``CUT`` exactly at the threshold, ascending with the raw score."""
        far = np.clip(STEEP * (self.raw(features) - self.threshold) / self.spread, -40, 40)
        return CUT / (CUT + (1 - CUT) * np.exp(-far))


@dataclass
class Block:
    """Feature rows of good and of bad documents; one that is in several blocks is ``own`` in one of them."""

    number: int
    better: np.ndarray
    worse: np.ndarray
    own_better: np.ndarray
    own_worse: np.ndarray

    @property
    def own(self) -> np.ndarray:
        return np.concatenate([self.better[self.own_better], self.worse[self.own_worse]])

    def differences(self, model: Ranking, pairs: int, seed: int) -> np.ndarray:
        """Of ``pairs`` pairs, or of as many as it takes to use every document."""
        rng = np.random.default_rng(seed + self.number)
        each = max(len(self.better), len(self.worse), pairs)

        def drawn(rows: np.ndarray) -> np.ndarray:
            # every document takes part before any takes part twice more often than another of its kind
            order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-each // len(rows)))])[:each]
            return model.inputs(rows)[order]

        return drawn(self.better) - drawn(self.worse)


Sums = Callable[[Callable[[Block], np.ndarray]], np.ndarray]  # of a function's values over all blocks


def _weigh(model: Ranking, total: Sums, pairs: int, seed: int) -> None:
    """Newton steps to the weights of the penalised likelihood."""
    k = len(model.weights)
    for _ in range(STEPS):

        def slope(block: Block, w: np.ndarray = model.weights) -> np.ndarray:
            difference = block.differences(model, pairs, seed)
            p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))  # probability of the wrong order
            bend = (difference * (p * (1 - p))[:, None]).T @ difference
            return np.concatenate([[len(p)], difference.T @ p, bend.ravel()])

        n, sums = (found := total(slope))[0], found[1:]
        gradient = sums[:k] / n - RIDGE * model.weights
        step = np.linalg.solve(sums[k:].reshape(k, k) / n + RIDGE * np.eye(k), gradient)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break


def _learn(total: Sums, both: bool, pairs: int, seed: int) -> Ranking:
    """Standardisation, weights and spread; ``both`` says whether there are documents of both kinds."""
    n, *sums = total(lambda block: np.append(len(block.own), block.own.sum(axis=0)))
    k = len(sums)
    mean = np.array(sums) / max(n, 1)
    scale = np.sqrt(total(lambda block: ((block.own - mean) ** 2).sum(axis=0)) / n) if n else np.ones(k)
    model = Ranking(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * k), 0.0, 1.0)
    if both:
        _weigh(model, total, pairs, seed)
        middle = total(lambda block: np.array([model.raw(block.own).sum()]))[0] / n
        far = total(lambda block: np.array([((model.raw(block.own) - middle) ** 2).sum()]))[0]
        model.spread = float(np.sqrt(far / n)) or 1.0
    return model


def fit(features: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Fit on labelled feature rows, as one block. Without documents of both kinds no document is rejected."""
    better, worse = features[good], features[~good]
    block = Block(0, better, worse, np.ones(len(better), bool), np.ones(len(worse), bool))
    model = _learn(lambda job: job(block), bool(len(better) and len(worse)), pairs, seed)
    if not len(better) or not len(worse):
        return model
    # the quantile that parts the labels with the fewest errors, an error on a good document counting the same
    scores = model.raw(features)
    ranked, at = np.unique(scores, return_inverse=True)
    change = np.bincount(at, np.where(good, 1.0, -1.0))
    cut = int(np.append(0.0, np.cumsum(change)).argmin())
    edge = np.concatenate([[ranked[0] - 1], ranked, [ranked[-1] + 1]])
    model.threshold = float((edge[cut] + edge[cut + 1]) / 2)
    return model


def _threshold(model: Ranking, rows: DataFrame) -> float:
    """What ``fit`` finds, from running counts of the labels over the scores of all ``rows`` (good, x)."""
    k = len(model.mean)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(batch["x"].flatten().to_numpy().reshape(-1, k))
            yield pa.RecordBatch.from_arrays([batch["good"], pa.array(raw)], names=["good", "raw"])

    # equal documents may differ in the last bits of their scores, a document does not between two readings
    steps = checkpoint(rows.select("good", "x").mapInArrow(scored, "good int, raw double")).groupBy("raw")
    steps = steps.agg(F.sum("good").alias("up"), F.sum(1 - F.col("good")).alias("down"))
    placed = running_weights(steps, [F.col("raw")], {"up": "ups", "down": "downs"})
    least = placed.agg(F.min(F.struct((F.col("ups") - F.col("downs")).alias("change"), "raw"))).first()[0]
    low, high = placed.agg(F.min("raw"), F.max("raw")).first()
    if least["change"] >= 0:
        return float(((low - 1) + low) / 2)
    after = placed.where(F.col("raw") > F.lit(least["raw"])).agg(F.min("raw")).first()[0]
    return float((least["raw"] + (high + 1 if after is None else after)) / 2)


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by the crc32 of their decimal text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(known):
    """Features of the documents whose id may be labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, featurizer = known.value, Featurizer()
        for batch in batches:
            given = pa.array(in_table(batch["id_hash"].to_numpy(), bits))
            for part in slices([batch.filter(given)]):
                rows = featurizer(part)
                values = pa.array(np.ascontiguousarray(rows).ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), values)
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists], names=["doc_id", "x"])

    return run


def _matrix(column, k: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _blocked(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """A row per block: its documents of both labels by ascending id. The rarer label repeats where blocks lack it."""
    blocks = -(-max(sizes.values()) // BLOCK)
    dealt = F.when(F.col("n") >= blocks, F.array(F.col("place") % blocks)).otherwise(
        F.sequence(F.col("place"), F.lit(blocks - 1).cast("bigint"), F.greatest("n", F.lit(1)))
    )
    placed = index_rows(rows, ["doc_id"], ["good"], idx="place", count="n")
    placed = placed.select("*", F.explode(dealt).alias("block"))
    k = len(FEATURES)

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        own = (table["place"].to_numpy() % blocks) == table["block"].to_numpy()
        good = table["good"].to_numpy() == 1
        x = _matrix(table["x"], k)
        blobs = [x[good].tobytes(), x[~good].tobytes(), own[good].tobytes(), own[~good].tobytes()]
        return pa.table({"block": table["block"][:1], **{c: pa.array([v], pa.binary()) for c, v in zip(PARTS, blobs)}})

    return placed.groupBy("block").applyInArrow(gather, "block bigint, " + ", ".join(f"{c} binary" for c in PARTS))


PARTS = ("better", "worse", "own_better", "own_worse")


def _block_sums(blocks: DataFrame) -> Sums:
    """Adds up over the blocks: always in the same order, so that a second fit gives the same model."""
    k = len(FEATURES)

    def total(job: Callable[[Block], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = [np.frombuffer(r[c]).reshape(-1, k) for c in PARTS[:2]]
                    own = [np.frombuffer(r[c], bool) for c in PARTS[2:]]
                    found = [[r["block"]], [job(Block(r["block"], *rows, *own)).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1], pa.binary())], names=["block", "v"])

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")
            sums = sum(np.frombuffer(v) for v in table["v"].to_pylist())
            return pa.table({"block": table["block"][:1], "v": pa.array([sums.tobytes()], pa.binary())})

        parts = blocks.mapInArrow(run, "block bigint, v binary")
        parts = parts.groupBy((F.col("block") % ADDED).alias("part")).applyInArrow(add, "block bigint, v binary")
        return sum(np.frombuffer(r["v"]) for r in sorted(parts.collect(), key=lambda r: r["block"]))

    return total


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Ranking:
    """Learn from the labels 0 and 1 of all ids that are not held out.

    Ids whose labels contradict each other, other labels and null ids are left out; of documents that
    share an id one is taken. Texts stay where they are, labelled documents move as feature rows, and the driver gets
    sums over blocks.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").alias("label"))
        .where(F.col("label_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg(F.min("label").alias("good"), F.max("label").alias("other"))
        .where("good = other")
        .select(F.col("label_id").cast("bigint").alias("label_id"), F.col("good").cast("int").alias("good"))
    )
    ids = bit_table(known.select(F.xxhash64("label_id").alias("id_hash")), "id_hash")
    rows = (
        texts(docs, id_col, text_col, F.xxhash64(F.col(f"`{id_col}`").cast("bigint")).alias("id_hash"))
        .mapInArrow(_features(ids), "doc_id bigint, x array<double>")
        .join(known, F.col("doc_id") == F.col("label_id"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("x", "good")).alias("row"))
        .select("doc_id", "row.x", "row.good")
    )
    rows = checkpoint(rows)
    sizes = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if not sizes:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    blocks = checkpoint(_blocked(rows, sizes))
    model = _learn(_block_sums(blocks), len(sizes) == 2, -(-PAIRS // -(-max(sizes.values()) // BLOCK)), 7)
    if len(sizes) == 2:
        model.threshold = _threshold(model, rows)
    return model


def score(model: Ranking, text: Column) -> Column:
    """The shown score of a text column, batch by batch; a null text counts as empty."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        featurizer = Featurizer()
        out = [
            model.shown(featurizer(part))
            for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])])
        ]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least ``CUT``) of every row.

    Empty and null texts are scored too. Repeated rows each get a row, null ids stay null, other
    columns are ignored, and an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    scored = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), score(model, F.col(f"`{text_col}`")).alias("score")
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
