"""Vector codes by ball k-means: short codes of vectors' parts from codebooks that are learnt round by round, exactly.

A codebook entry with the parts assigned to it is a ball, with a radius. Another entry can only take a part
from it if the two entries lie no farther apart than twice the radius: those are its neighbours, and a ball without neighbours,
or one whose entry and neighbours all stayed where they were, is not looked at. In other balls a part nearer to its entry than half
the way to the nearest neighbour is in the stable core and stays. The half ways to the neighbours, in
rising order, cut the rest into rings, and a part in ring m is held against the first m neighbours only. All
comparisons are of whole numbers, so the result is that of plain assignment, ties to the lower index.

A round sends tasks the codebooks and gets back what parts that changed their entry add to its count and sum and take from
those of the entry before: parts that stay cost nothing there, and what reaches the driver has the size of the codebooks.
Vectors lie packed in rows of some thousands in a table that is bucketed once; each round's codes, a byte for each part, are a table of the
same buckets, so that every round joins the two without a shuffle, and neither is held in memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, scratch_path, unused
from .vectors import matrix, usable

#: Vectors in a packed row, and packed rows in a bucket; there are MANY buckets at most, and few vectors have as many buckets as packs, up to SOME.
PACK = 4_096
BUCKET = 32
SOME = 16
MANY = 10_000
#: Labels whose sums of errors may be broadcast: some MB.
FEW_LABELS = 50_000


@dataclass
class Round:
    """What tasks need in a round: the codebooks (parts, entries, dim), whether each ball is looked at, and its neighbours from near to far with their squared distances."""

    entries: np.ndarray
    looked_at: np.ndarray
    near: list[list[np.ndarray]]
    apart: list[list[np.ndarray]]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of equally many whole vectors."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def plain(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each vector, ties to the lower index."""
    best, code = squared(x, entries[0]), np.zeros(len(x), np.uint8)
    for e in range(1, len(entries)):
        d = squared(x, entries[e])
        nearer = d < best
        best[nearer], code[nearer] = d[nearer], e
    return code


def reassigned(x: np.ndarray, code: np.ndarray, now: Round, part: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry of each vector, largest squared distance of those held against it to each entry, -1 for none, and how many distances were computed)."""
    entries, out, radius, work = now.entries[part], code.copy(), np.full(len(now.entries[part]), -1, np.int64), 0
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(entries) + 1))
    for e in np.flatnonzero(now.looked_at[part]):
        mine = order[ends[e] : ends[e + 1]]
        if not len(mine):
            continue
        own = squared(x[mine], entries[e])
        work += len(mine)
        # How many neighbours lie no farther from the entry than twice the vector does: its ring; none in the stable core.
        ring = np.searchsorted(now.apart[part][e], 4 * own, side="right")
        best, chosen = own.copy(), np.full(len(mine), e, np.int64)
        for m, other in enumerate(now.near[part][e]):
            asks = np.flatnonzero(ring > m)
            if not len(asks):
                break
            d = squared(x[mine[asks]], entries[other])
            work += len(asks)
            wins = (d < best[asks]) | ((d == best[asks]) & (other < chosen[asks]))
            best[asks[wins]], chosen[asks[wins]] = d[wins], other
        out[mine] = chosen
        np.maximum.at(radius, chosen, best)
    return out, radius, work


def neighbours(entries: np.ndarray, radius: np.ndarray, moved: np.ndarray) -> Round:
    """The round that begins with these entries: ``radius`` is no smaller than that of each ball around its present entry, ``moved`` tells which entries changed since parts were last assigned."""
    parts, k, _ = entries.shape
    looked_at, near, apart = np.zeros((parts, k), bool), [], []
    for p in range(parts):
        d = np.array([squared(entries[p], entries[p, e]) for e in range(k)])
        near.append([])
        apart.append([])
        for e in range(k):
            others = np.flatnonzero((d[e] <= 4 * radius[p, e] ** 2 * (1 + 1e-9) + 1e-3) & (np.arange(k) != e))
            others = others[np.lexsort((others, d[e, others]))]
            near[p].append(others)
            apart[p].append(d[e, others])
            looked_at[p, e] = len(others) > 0 and bool(moved[p, e] or moved[p, others].any())
    return Round(entries, looked_at, near, apart)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """df (with ``pack``) as a bucketed table in the shared folder: (table, its path). Its name is gone from the catalog at once; the files stay."""
    spark = df.sparkSession
    name, path = f"millrace_{uuid.uuid4().hex}", scratch_path(spark, "packs")
    df.write.format("parquet").bucketBy(buckets, "pack").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table, path


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 4096.0,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes binary, error long for every vector; the codebooks as (part, entry, component)).

    Each component x becomes floor(scale * x), and a vector is cut into ``parts`` equal parts, at the end filled up with zeros if
    need be. A part's codebook begins as that part of the rows of the ``entries`` smallest ids (null ids last, ties to the smaller vector; fewer rows
    give fewer entries). Each round assigns every part to its nearest entry and moves entries to the floor of their
    mean; those without parts stay. ``codes`` has a byte for each part from a last assignment, and ``error`` is the sum of the squared distances.
    Null and empty vectors, those with null or non-finite components and those of another length than most rows have
    (ties: the longer) take no part. A repeated row counts each time; an empty table gives no rows. At most 256 entries.
    """
    spark = df.sparkSession
    floored = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x))
    rows = usable(df, vector, zero=True).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), floored.alias("v"))
    found = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not found:
        return spark.createDataFrame([], "vec_id long, label long, codes binary, error long"), np.zeros((parts, 0, 0), np.int64)
    dim, n = found[0]
    width = -(-dim // parts)
    rows = rows.where(F.size("v") == dim)
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(min(entries, 256)).collect()]
    shaped = lambda x: np.pad(x, ((0, 0), (0, parts * width - dim))).reshape(len(x), parts, width)
    book = np.ascontiguousarray(shaped(np.array(first, np.int64)).transpose(1, 0, 2))
    k = book.shape[1]
    buckets = min(max(blocks(n, PACK * BUCKET), min(blocks(n, PACK), SOME)), MANY)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                cut = whole.slice(at, PACK)
                values = [pa.array([cut.column(i).to_pylist()], pa.list_(pa.int64())) for i in (0, 1)]
                x = shaped(matrix(cut.column(2)).astype(np.int64))
                small = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.abs(x).max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([number]), *values, pa.array([small]), pa.array([x.astype(small).tobytes()], pa.binary())], ["pack", "ids", "labels", "kind", "x"])
                number += 1

    made = rows.mapInArrow(packed, "pack long, ids array<long>, labels array<long>, kind string, x binary")
    packs, _ = _bucketed(made.repartition(buckets, "pack"), buckets)
    codes = place = None
    count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
    radius, moved = np.full((parts, k), np.inf), np.ones((parts, k), bool)
    schema = "pack long, codes binary, count binary, total binary, radius binary"

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                x, before = opened(batch, i)
                after = np.empty(x.shape[:2], np.uint8)
                add, sums, far = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), np.full((parts, k), -1, np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p])
                    if before is None:
                        after[:, p] = plain(own, now.entries[p])
                        np.maximum.at(far[p], after[:, p], squared(own, now.entries[p][after[:, p]]))
                        gone = np.empty(0, np.int64)
                        came = np.arange(len(own))
                    else:
                        after[:, p], far[p], _ = reassigned(own, before[:, p], now, p)
                        gone = came = np.flatnonzero(after[:, p] != before[:, p])
                        np.subtract.at(add[p], before[gone, p], 1)
                        np.subtract.at(sums[p], before[gone, p], own[gone])
                    np.add.at(add[p], after[came, p], 1)
                    np.add.at(sums[p], after[came, p], own[came])
                yield pa.RecordBatch.from_arrays([batch.column("pack").slice(i, 1), *(pa.array([y.tobytes()], pa.binary()) for y in (after, add, sums, far))], ["pack", "codes", "count", "total", "radius"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The changes of many packs as one row for each task."""
        add, sums, far = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), np.full((parts, k), -1, np.int64)
        for batch in batches:
            for a, s, f in zip(*batch.columns):
                add += np.frombuffer(a.as_buffer(), np.int64).reshape(add.shape)
                sums += np.frombuffer(s.as_buffer(), np.int64).reshape(sums.shape)
                far = np.maximum(far, np.frombuffer(f.as_buffer(), np.int64).reshape(far.shape))
        yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (add, sums, far)], ["count", "total", "radius"])

    def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray | None]:
        x = np.frombuffer(batch.column("x")[i].as_buffer(), batch.column("kind")[i].as_py()).astype(np.int64).reshape(-1, parts, width)
        return x, np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8).reshape(-1, parts) if "codes" in batch.schema.names else None

    for _ in range(rounds):
        now = neighbours(book, radius, moved)
        shared = spark.sparkContext.broadcast(now)
        state = packs.select("pack", "kind", "x") if codes is None else packs.select("pack", "kind", "x").join(codes.select("pack", "codes"), "pack")
        old = place
        codes, place = _bucketed(state.mapInArrow(assigned, schema), buckets)
        if old:
            _delete(spark, old)
        changes = codes.select("count", "total", "radius").mapInArrow(folded, "count binary, total binary, radius binary")
        if buckets > 64:  # one more step, so that the driver gets few rows however many buckets there are
            changes = changes.repartition(64).mapInArrow(folded, "count binary, total binary, radius binary")
        far = np.full((parts, k), -1, np.int64)
        for row in changes.collect():
            count += np.frombuffer(row["count"], np.int64).reshape(count.shape)
            total += np.frombuffer(row["total"], np.int64).reshape(total.shape)
            far = np.maximum(far, np.frombuffer(row["radius"], np.int64).reshape(far.shape))
        book, radius, moved = moved_on(now, count, total, radius, far)
        shared.unpersist()
    now = neighbours(book, radius, moved)
    shared = spark.sparkContext.broadcast(now)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                x, before = opened(batch, i)
                after, error = np.empty(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p])
                    after[:, p] = plain(own, now.entries[p]) if before is None else reassigned(own, before[:, p], now, p)[0]
                    error += squared(own, now.entries[p][after[:, p]])
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(x), [None, pa.py_buffer(after.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, code, pa.array(error)], ["vec_id", "label", "codes", "error"])

    state = packs.select("pack", "ids", "labels", "kind", "x")
    state = state if codes is None else state.join(codes.select("pack", "codes"), "pack")
    out = state.drop("pack").mapInArrow(final, "vec_id long, label long, codes binary, error long")
    return out, book


def moved_on(now: Round, count: np.ndarray, total: np.ndarray, radius: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new entries, radii around them at most, which entries moved) once parts with these counts and sums are assigned.

    ``far`` has the squared distances of the parts that were held against entries. All parts of a ball that was looked at were; in
    others, those that were there before lie within the old ``radius``.
    """
    book = np.where((count > 0)[..., None], np.floor_divide(total, np.maximum(count, 1)[..., None]), now.entries)
    shift = np.sqrt(((book - now.entries) ** 2).sum(axis=2).astype(np.float64))
    held = np.sqrt(np.maximum(far, 0).astype(np.float64))
    known = now.looked_at | np.isinf(radius)  # at first every part is held against every entry
    return book, np.where(known, held, np.maximum(radius, held)) + shift, shift > 0


def hex_codes(codes: str = "codes"):
    """Codes as text, two lower-case hex digits for each part."""
    return F.lower(F.hex(codes))


def digest(book: np.ndarray) -> str:
    """SHA-256, in hex, of all components in the order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(df: DataFrame, label: str = "label", error: str = "error", name: str = "label_error") -> DataFrame:
    """df with the sum of ``error`` over the rows of equal ``label``, nulls together; sums are broadcast if there are at most FEW_LABELS."""
    key = unused(df, "_label")
    sums = df.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(name))
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return df.join(F.broadcast(sums) if few else sums, F.col(label).eqNullSafe(F.col(key))).drop(key)
