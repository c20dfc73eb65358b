"""Row order at scale: dense positions, bounded frames, carries and prefix sums.

A window without PARTITION BY pulls the whole table into one task. Here rows lie in buckets,
consecutive ranges of the complete sort key, so a single hot value of the first key column is
split by the next one. The bounds of the buckets are literals (``Ranges``), found once on a sample:
every later job puts a row into the same bucket, so nothing has to be written down to keep jobs
in step, and any bounds give the same result. Between buckets one small row per bucket travels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.functions.columns import col, data_type, local_frame, sized
from prepflow.session import checkpoint

PART, POS = "__part", "__pos"
LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row position in its lower 33 bits
MIN_CHUNK = 1 << 13
HALO_SHARE = 8  # a chunk is at least this many times its frame's reach
MAX_CHUNKS = 20_000
BUCKET = "__bucket"
BUCKET_ROWS = 1 << 13  # fewer rows than this are not worth a bucket
BUCKETS = 4  # for each shuffle partition, so that hashing buckets to tasks evens out
SAMPLED = 24  # rows for each bucket
FAN = 2  # ways in which a step of the search for a row's bucket parts the bounds


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition and sort, then stamp each row with its partition and in-partition position.

    The checkpoint freezes the sampled range bounds: a later job that recomputed them could
    draw other bounds and disagree with the offsets.
    """
    stamped = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias(PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_BITS)).alias(POS),
        )
    )
    return checkpoint(stamped)


def _offsets(stamped: DataFrame, weights: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Exclusive running totals per partition: one row per non-empty shuffle partition."""
    names = list(weights)
    sizes = stamped.groupBy(PART).agg(*[F.sum(w).alias(k) for k, w in weights.items()]).collect()
    totals, rows = dict.fromkeys(names, 0), []
    for size in sorted(sizes, key=lambda r: r[PART]):
        rows.append((size[PART], *[totals[k] for k in names]))
        for k in names:
            totals[k] += int(size[k] or 0)
    schema = f"{PART} int, " + ", ".join(f"`{k}` bigint" for k in names)
    return local_frame(stamped.sparkSession, rows, schema), totals


@dataclass
class Ranges:
    """Which range of an order a row lies in: bounds as text, so that they can be stored with a plan.

    Bounds that fit the table badly make buckets uneven, nothing else.
    """

    columns: tuple[str, ...]
    cuts: list[list[str | None]] = field(default_factory=list)

    def bucket(self, df: DataFrame) -> Column:
        """The number of bounds at or below the row's key: a search by halves, the key read once a row.

        Never null, or joins on it would have a filter of their own search every row again.
        """
        if not self.cuts:
            return F.lit(0).alias(BUCKET)
        kinds = [data_type(df, c) for c in self.columns]
        key = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(self.columns)])
        bounds = F.array(*[
            F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(cut, kinds))]) for cut in self.cuts
        ])
        levels = 1
        while FAN**levels <= len(self.cuts):
            levels += 1
        strides = F.array(*[F.lit(FAN**i) for i in reversed(range(levels)) for _ in range(FAN - 1)])

        def search(k: Column) -> Column:
            # a bound beyond the last is null, and so not below the key
            return F.aggregate(
                strides, F.lit(0), lambda at, stride: F.when(F.get(bounds, at + stride - 1) <= k, at + stride).otherwise(at)
            )

        found = F.get(F.transform(F.array(key), search), F.lit(0))
        return F.coalesce(found, F.lit(0)).alias(BUCKET)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict | None) -> "Ranges | None":
        return cls(tuple(d["columns"]), d["cuts"]) if d else None


def cut_ranges(df: DataFrame, order_by: Sequence[str], n: int | None = None, buckets: int | None = None) -> Ranges:
    """Bounds of about even ranges, from a sample of the key columns; ``n`` is the row count where it is known.

    The sample is read in one scan of the key columns and bounded by ``SAMPLED`` rows a bucket.
    """
    keys = df.select(*[col(c) for c in order_by])
    if n is None:
        n = keys.count()
    if buckets is None:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(BUCKETS * width, n // BUCKET_ROWS + 1)
    if buckets <= 1 or n == 0:
        return Ranges(tuple(order_by))
    some = keys.where(F.rand(7) < F.lit(SAMPLED * buckets / n)) if n > SAMPLED * buckets else keys
    rows = some.select(F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)]).alias("k"))
    texts = F.transform(
        F.array_sort(F.collect_list("k")), lambda k: F.array(*[k[f"k{i}"].cast("string") for i in range(len(order_by))])
    )
    found = rows.agg(texts.alias("ks")).first()["ks"]
    step = len(found) / buckets
    cuts = [list(found[int(i * step)]) for i in range(1, buckets)] if found else []
    return Ranges(tuple(order_by), [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]])


def _present(bucketed: DataFrame, by: Sequence[Column], names: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row per series and bucket that has rows."""
    return bucketed.groupBy(*[k.alias(a) for k, a in zip(by, names)], F.col(BUCKET).alias("__b")).agg(*aggregates)


def _with_edges(bucketed: DataFrame, edges: DataFrame, by: Sequence[Column], names: Sequence[str], how: str) -> DataFrame:
    """Rows beside what their bucket got from others: without series that is one row a bucket, so broadcast."""
    same = [F.col(BUCKET) == F.col("__b")] + [k.eqNullSafe(F.col(a)) for k, a in zip(by, names)]
    return bucketed.join(edges if names else F.broadcast(edges), same, how)


def index_rows(
    df: DataFrame,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    idx: str = "idx",
    count: str | None = None,
    n: int | None = None,
    ranges: Ranges | None = None,
) -> DataFrame:
    """Add a dense zero-based position in ``order_by`` order, within each key if given.

    ``order_by`` must be a total order; ``count`` adds the number of rows of the series. Rows are
    shuffled once, by bucket, and numbered there; each bucket starts where the earlier ones end.
    The plan is lazy: only the bounds are found here, unless given. ``df`` is read twice by it, so it must
    give the same rows each time.
    """
    ranges = ranges or cut_ranges(df, [*keys, *order_by], n)
    by = [col(k) for k in keys]
    names = [f"__k{i}" for i in range(len(keys))]
    bucketed = df.withColumn(BUCKET, ranges.bucket(df))
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    earlier = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = _present(bucketed, by, names, [F.count(F.lit(1)).alias("__n")])
    sizes = sizes.select(
        *names,
        "__b",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
        F.sum("__n").over(whole).alias("__total"),
    )
    order = Window.partitionBy(*by, BUCKET).orderBy(*[col(c) for c in order_by])
    placed = _with_edges(bucketed.withColumn(POS, F.row_number().over(order)), sizes, by, names, "inner")
    out = [col(c) for c in df.columns] + [(F.col("__start") + F.col(POS) - 1).cast("bigint").alias(idx)]
    return placed.select(*out, *([F.col("__total").cast("bigint").alias(count)] if count else []))


def chunk_size(n: int, reach: int = 0) -> int:
    """Rows per chunk: enough to amortise the halo, and never more than MAX_CHUNKS chunks."""
    return max(MIN_CHUNK, HALO_SHARE * reach, -(-n // MAX_CHUNKS))


def with_halo(
    indexed: DataFrame,
    before: int,
    after: int,
    size: int,
    idx: str = "idx",
) -> DataFrame:
    """Assign rows to chunks of ``size`` positions and copy edge rows to the neighbour that needs them.

    Adds ``chunk`` and ``is_halo``. A window partitioned by chunk then sees every row within
    ``before`` / ``after`` positions of its own rows. Only edge rows are duplicated.
    """
    if size < max(before, after, 1):
        raise ValueError("chunk size must be at least the frame reach")
    i = F.col(idx)
    own = F.floor(i / F.lit(size)).cast("bigint")
    offset = i - own * F.lit(size)
    stay = F.struct(own.alias("chunk"), F.lit(False).alias("is_halo"))
    late, early = offset >= size - before, (offset < after) & (own > 0)
    to_next = F.struct((own + 1).alias("chunk"), F.lit(True).alias("is_halo"))
    to_previous = F.struct((own - 1).alias("chunk"), F.lit(True).alias("is_halo"))
    copies = (
        F.when(late & early, F.array(stay, to_next, to_previous))
        .when(late, F.array(stay, to_next))
        .when(early, F.array(stay, to_previous))
        .otherwise(F.array(stay))
    )
    return indexed.select("*", F.inline(copies))


def framed(
    indexed: DataFrame,
    columns: dict[str, "Frame"],
    n: int | None,
    keys: Sequence[str] = (),
    idx: str = "idx",
    size: int | None = None,
) -> DataFrame:
    """Evaluate bounded row-frame expressions over an indexed series, chunk by chunk."""
    before = max(f.before for f in columns.values())
    after = max(f.after for f in columns.values())
    size = size or chunk_size(n or 0, max(before, after))
    halo = with_halo(indexed, before, after, size, idx)
    part = [col(k) for k in keys] + [F.col("chunk")]
    order = Window.partitionBy(*part).orderBy(idx)
    out = halo.select(
        "*",
        *[
            f.expression(order if f.unframed else order.rowsBetween(-f.before, f.after)).alias(name)
            for name, f in columns.items()
        ],
    )
    return out.where(~F.col("is_halo")).drop("chunk", "is_halo")


class Frame:
    """A window expression and how far it reaches before and after the current row."""

    def __init__(self, before: int, after: int, expression, unframed: bool = False):
        self.before, self.after, self.expression, self.unframed = before, after, expression, unframed


def lagged(column: Column, k: int) -> Frame:
    return Frame(k, 0, lambda w: F.lag(column, k).over(w), unframed=True)


def running_weights(
    df: DataFrame,
    order: Sequence[Column],
    weights: dict[str, str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Running totals of integer weight columns over an ordered table of distinct values.

    ``weights`` maps a weight column to the name of its inclusive running total. With
    ``keys`` totals restart for every key. Rows should be pre-aggregated: one per value.
    """
    lead = [col(k) for k in keys]
    stamped = _range_sorted(df, [*lead, *order])
    local = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    base, _ = _offsets(stamped, {f"__b_{w}": F.col(w) for w in weights})
    out = stamped.join(F.broadcast(base), PART).select(
        *[col(c) for c in df.columns],
        *[
            (F.sum(F.col(w)).over(local) + F.col(f"__b_{w}")).cast("bigint").alias(t)
            for w, t in weights.items()
        ],
    )
    if keys:
        starts = out.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
            *[F.min(F.col(t) - F.col(w)).alias(f"__s_{w}") for w, t in weights.items()]
        )
        same = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        out = out.join(sized(starts), same).select(
            *[col(c) for c in df.columns],
            *[(F.col(t) - F.col(f"__s_{w}")).alias(t) for w, t in weights.items()],
        )
    return out


def carry_fill(
    df: DataFrame,
    columns: dict[str, bool],
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    n: int | None = None,
    ranges: Ranges | None = None,
) -> DataFrame:
    """Fill NULLs with the last present value (True) or the next one (False) in ``order_by`` order.

    One shuffle by bucket serves every column; between buckets one value per column and bucket
    travels. The order is that of the columns as they come in, within each key if given. The next value
    is the last one of the rows read backwards, by their number: a frame that ends with the bucket would be read
    anew for every row.
    """
    ranges = ranges or cut_ranges(df, [*keys, *order_by], n)
    by = [col(k) for k in keys]
    names = [f"__k{i}" for i in range(len(keys))]
    bucketed = df.withColumn(BUCKET, ranges.bucket(df))
    place = F.struct(*[col(c) for c in order_by])
    rows = Window.partitionBy(*by, BUCKET)
    onward = rows.orderBy(*[col(c) for c in order_by])
    upto = {True: onward, False: rows.orderBy(F.col(POS).desc())}
    edges, carried, filled, close = [], [], {}, {True: [], False: []}
    buckets = Window.partitionBy(*(names or [F.lit(0)]))
    for i, (name, forward) in enumerate(columns.items()):
        value, held = col(name), F.when(col(name).isNotNull(), place)
        edges.append((F.max_by if forward else F.min_by)(value, held).alias(f"__e{i}"))
        others = buckets.orderBy(F.col("__b").asc() if forward else F.col("__b").desc())
        far = F.last(f"__e{i}", ignorenulls=True).over(others.rowsBetween(Window.unboundedPreceding, -1))
        near = F.last(value, ignorenulls=True).over(upto[forward].rowsBetween(Window.unboundedPreceding, 0))
        close[forward].append(near.alias(f"__f{i}"))
        carried.append(far.alias(f"__c{i}"))
        filled[name] = F.coalesce(F.col(f"__f{i}"), F.col(f"__c{i}"))
    there = _present(bucketed, by, names, edges).select(*names, "__b", *carried)
    number = [F.row_number().over(onward).alias(POS)] if close[False] else []
    near = bucketed.select("*", *close[True], *number).select("*", *close[False])
    out = _with_edges(near, there, by, names, "left")
    return out.select(*[filled[c].alias(c) if c in filled else col(c) for c in df.columns])
