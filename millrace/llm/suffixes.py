"""Removal of repeated passages with suffix arrays, over all texts together.

A passage is a run of ``length`` bytes that starts at two or more places. To bring equal runs
together without sorting every suffix of the corpus, each run is assigned to an anchor: of the
``gram``-byte hashes inside it the smallest, the first of equals. Equal runs have equal anchors at equal
offsets, so they meet under the anchor's hash, and only anchors that occur twice matter.
What the runs of one anchor cover is its segment; equal segments are collapsed and counted. The different
segments of an anchor go into a suffix array: suffixes smaller than their successors are sorted directly,
the rest is induced by bucket scans, and adjacent common prefixes show the repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_texts, wide, written

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Positions that fit beside a hash while the smallest is sought.
_SPAN = 1 << 20
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_ODD, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes."""
    power, inverse = (x[: len(data)] for x in _power_tables(len(data)))
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power))
        out = (total[gram:] - total[:-gram]) * inverse[: len(data) - gram + 1]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` adjacent values."""
    n = len(values)
    padded = np.append(values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, anchor, first run, last run) for the stretches of runs with one anchor, in order."""
    out = []
    step = _SPAN - length
    for base in range(0, max(0, len(data) - length + 1), step):
        part = data[base : base + step + length - 1]
        hashes = gram_hashes(part, gram)
        low = np.uint64(_SPAN - 1)
        least = sliding_least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        out.append((hashes[place[first]].view(np.int64), place[first] + base, first + base, last + base))
    return out


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    # A suffix is small if it is less than its successor: at the next change of letter, that letter is larger.
    rise = np.append(np.sign(np.diff(t.astype(np.int16))), -1)
    change = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(change[::-1])[::-1]] > 0
    direct = np.flatnonzero(small)
    two = t[direct].astype(np.int32) * 256 + t[np.minimum(direct + 1, n - 1)]
    order = np.argsort(two, kind="stable")
    cuts = np.flatnonzero(np.diff(two[order])) + 1
    for part in np.split(order, cuts):  # those of the same two letters at a time: only their keys are held
        if len(part) > 1:
            direct[part] = sorted(direct[part].tolist(), key=lambda i: data[i : i + depth])
    direct = direct[order]
    edges = np.searchsorted(t[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets[t[-1]].append(np.array([n - 1]))  # the empty suffix comes first and induces the last one
    out = []
    for c in range(256):
        frontier = np.concatenate(buckets[c]) if buckets[c] else np.empty(0, np.int64)
        large = [frontier]
        while len(frontier):  # what a run of one letter induces within its own bucket
            before = frontier[frontier > 0] - 1
            frontier = before[t[before] == c]
            large.append(frontier)
        bucket = np.concatenate([*large, direct[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        letters = t[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        starts = np.flatnonzero(np.append(True, letters[1:] != letters[:-1])) if len(letters) else []
        for a, b in zip(starts, [*starts[1:], len(letters)]):
            buckets[letters[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to ``most``, each suffix of ``order`` shares with the one before it; 0 for the first."""
    n = len(data)
    t = np.frombuffer(data + b"\0" * (most + 8), np.uint8)
    word = np.zeros(n + most, np.uint64)
    for k in range(8):
        word |= t[k : k + n + most].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, most, 8):
        differ = word[order[live - 1] + at] ^ word[order[live] + at]
        same = differ == 0
        stop = differ[~same]
        out[live[~same]] = at + (np.log2((stop & (~stop + np.uint64(1))).astype(np.float64)) // 8).astype(np.int64)
        live = live[same]
        if not len(live):
            break
    out[live] = most
    return np.minimum(np.minimum(out, most), np.minimum(n - order, n - np.append(n, order[:-1])))


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, the offsets of runs of ``length`` bytes that start anywhere else in the segments."""
    data = b"\0".join(segments)
    starts = np.cumsum([0, *(len(s) + 1 for s in segments)])
    order = suffix_array(data, length)
    owner = np.searchsorted(starts, order, side="right") - 1
    sizes = np.array([len(s) for s in segments])
    order = order[order - starts[owner] + length <= sizes[owner]]  # a run stays inside its segment
    shared = common_prefixes(data, order, length) >= length
    twice = np.sort(order[shared | np.append(shared[1:], False)]) if len(order) else order
    cuts = np.searchsorted(twice, starts)
    return [twice[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], starts)]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted numbers as first and last of adjacent ones."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def _filter(keys: DataFrame, bits: int) -> DataFrame:
    """Rows (bucket, bitmap): one bit for the hash ``key`` of each row; at most 2**bits bits in all."""
    slot = F.pmod("key", F.lit(1 << bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def _maybe(df: DataFrame, key, keys: DataFrame, bits: int):
    """A condition on df that holds wherever ``key`` is among keys, and rarely elsewhere: 2**bits bits are broadcast, whatever the rows."""
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in _filter(keys, bits).toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        table[at : at + 4096] |= np.frombuffer(bytes(row["bitmap"]), np.uint8)[: len(table) - at]
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            slot = batch.to_numpy(zero_copy_only=False) % (1 << bits)
            yield pa.array((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool))

    return run(key)


def repeated_spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    length: int = 400,
    gram: int = 32,
    batch_bytes: int = 400_000,
    hot_segments: int = 2_000,
    filter_bits: int = 24,
    keep: tuple[Column, ...] = (),
) -> DataFrame:
    """id_col, ``keep``, ``data`` (the text's UTF-8 bytes) and ``spans`` (sorted, disjoint struct<start, end>) of every row.

    ``spans`` covers each byte of a run of ``length`` bytes that also starts anywhere else, in this row
    or another; overlaps count. A null text is empty and has no spans, as have texts shorter than
    ``length``. Each row is a document of its own, even if its id or the whole row is repeated, so a repeated row's long text is one span.
    An anchor with more than ``hot_segments`` different segments is cut up by the
    offset of its runs and the bytes that all runs of such an offset share; where more than ``hot_segments`` pieces
    share those bytes, too, their runs are counted one by one by their digests. Bits of a filter of fixed size
    decide which texts are shuffled; where it fills up, more are.
    """
    df = whole_texts(df)
    if not 1 < gram <= length:
        raise ValueError("gram must be 2 to length bytes")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    own = [F.col("_id").alias(id_col), *(F.col("_keep")[name].alias(name) for name in df.select(*keep).columns)]
    rows = rows.withColumn("th", F.xxhash64("_text")).withColumn("key", F.xxhash64(F.lit(3), "_id", "th"))
    long = rows.where(F.octet_length("_text") >= length)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            keys, parts, digests = batch.column(0).to_numpy(), [], []
            owners = []
            for key, value in zip(keys, batch.column(1)):
                raw = value.as_py().encode("utf-8", "replace")
                for fp, place, first, last in anchors(np.frombuffer(raw, np.uint8), length, gram):
                    parts.append((fp, place, first, last))
                    owners.append(np.full(len(fp), key))
                    digests += [xxhash.xxh3_128_digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
            if parts:
                fp, place, first, last = (np.concatenate(x) for x in zip(*parts))
                seg = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, seg[:, 0], seg[:, 1], np.concatenate(owners), first, (last - first).astype(np.int32), (place - first).astype(np.int32))], ["fp", "s0", "s1", "key", "first", "more", "anchor"])

    occ = written(long.select("key", "_text").mapInArrow(occurrences, "fp long, s0 long, s1 long, key long, first long, more int, anchor int"), "occurrences")
    twice = written(occ.groupBy("fp").count().where("count > 1").select("fp"), "twice")  # a plain table, so that the join can split a hot anchor
    occ = written(occ.join(twice, "fp", "left_semi"), "repeated")
    segments = written(occ.groupBy("fp", "s0", "s1").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "more", "anchor")).alias("at")), "segments")
    kinds = written(segments.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed = segments.join(kinds, "fp").select("fp", "s0", "s1", "kinds", "at.*")
    wanted = written(mixed.groupBy("key").agg(F.collect_list(F.struct("fp", "s0", "s1", "kinds", "first", "more", "anchor")).alias("cuts")), "wanted")
    step = max(1, (length - gram) // 10)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            out: list[tuple] = []
            for value, cuts in zip(batch.column(0), batch.column(1)):
                raw = value.as_py().encode("utf-8", "replace")
                for x in cuts.as_py():
                    first, last, place = x["first"], x["first"] + x["more"], x["first"] + x["anchor"]
                    if x["kinds"] <= hot_segments:
                        out.append((x["fp"], x["fp"], x["s0"], x["s1"], 0, False, raw[first : last + length]))
                        continue
                    for r in range(length // step + 1):  # runs that start r * step or up to a step more before the anchor
                        a, b = max(first, place - (r + 1) * step + 1), min(last, place - r * step)
                        if a <= b:
                            core = raw[place - r * step : place - (r + 1) * step + 1 + length]
                            name = xxhash.xxh3_64_intdigest(core, (x["fp"] ^ r) & 0xFFFFFFFFFFFFFFFF)
                            out.append((name - (1 << 64) if name >> 63 else name, x["fp"], x["s0"], x["s1"], a - first, True, raw[a : b + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["g", "fp", "s0", "s1", "skip", "hot", "part"])

    kept = long.where(_maybe(long, F.col("key"), wanted.select("key"), filter_bits)).select("key", "_text")
    pieces = kept.join(wanted, "key").select("_text", "cuts").mapInArrow(cut, "g long, fp long, s0 long, s1 long, skip int, hot boolean, part binary")
    pieces = written(pieces, "pieces")
    large = written(pieces.where("hot").groupBy("g").count().where(F.col("count") > hot_segments).select("g"), "large")

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            parts = batch.column(4).to_pylist()
            runs = np.array([len(x) - length + 1 for x in parts])
            places = [i for n in runs.tolist() for i in range(n)]
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x[i : i + length]) for x, n in zip(parts, runs.tolist()) for i in range(n)]), np.int64).reshape(-1, 2)
            owner = [np.repeat(batch.column(i).to_numpy(), runs) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digests[:, 0], digests[:, 1], *owner[:3], owner[3].astype(np.int64) + np.array(places, np.int64))], ["r0", "r1", "fp", "s0", "s1", "a"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found(part: list[tuple]) -> pa.RecordBatch:
            # A repeated row's segment comes once for each copy; parts of different segments may be equal, and are then repeats.
            owners: dict[tuple, set] = {}
            for x in part:
                owners.setdefault((x[0], x[5]), set()).add((x[2], x[3]))
            texts = list({text for _, text in owners})
            where = {s: i for i, s in enumerate(texts)}
            starts = repeated_starts(texts, length)
            runs = lambda x: [(0, len(x[5]) - length)] if len(owners[x[0], x[5]]) > 1 else _runs(starts[where[x[5]]])
            lists = [[(a + x[4], b + x[4]) for a, b in runs(x)] for x in part]
            some = [(x[1], x[2], x[3], [{"a": a, "b": b} for a, b in y]) for x, y in zip(part, lists) if y]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], k) for i, k in enumerate(kinds)], ["fp", "s0", "s1", "runs"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= batch_bytes and x[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[5])
        if held:
            yield found(held)

    some = not large.isEmpty()
    grouped = (pieces.join(large, "g", "left_anti") if some else pieces).select("g", "fp", "s0", "s1", "skip", "part").repartition(wide(spark), "g").sortWithinPartitions("g")
    matched = grouped.mapInArrow(sort, "fp long, s0 long, s1 long, runs array<struct<a: bigint, b: bigint>>")
    if some:
        single = pieces.join(large, "g", "left_semi").select("fp", "s0", "s1", "skip", "part").mapInArrow(singly, "r0 long, r1 long, fp long, s0 long, s1 long, a long")
        single, place = written(single, "single"), F.struct("s0", "s1", "a")
        again = written(single.groupBy("r0", "r1").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("r0", "r1"), "again")
        hits = single.join(again, ["r0", "r1"], "left_semi").select("fp", "s0", "s1", F.array(F.struct("a", F.col("a").alias("b"))).alias("runs"))
        matched = matched.unionByName(hits)
    whole = segments.where("n > 1").select("fp", "s0", "s1", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("at.more").cast("long").alias("b"))).alias("runs"))
    result = written(whole.unionByName(matched).groupBy("fp", "s0", "s1").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    # Runs in the order of their start; each run that begins past the end of all before it opens a span.
    hits = occ.join(result, ["fp", "s0", "s1"]).select("key", F.explode(F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("start"), (F.col("first") + r["b"] + length).alias("end")))).alias("r"))
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set("r")).alias("r"))
    joined = F.aggregate(
        "r",
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    spans = written(spans.select("key", joined.alias("spans")), "spans")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    marked = rows.withColumn("_may", _maybe(rows, F.col("key"), spans.select("key"), filter_bits))
    data = F.col("_text").cast("binary").alias("data")
    plain = marked.where("not _may").select(*own, data, none.alias("spans"))
    hit = marked.where("_may").select("_id", "_keep", "_text", "key").join(spans, "key", "left").select(*own, data, F.coalesce("spans", none).alias("spans"))
    return plain.unionByName(hit)


def _pieces(data: str, spans: str):
    """The stretches of ``data`` between spans, as an array of binary."""
    return F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.col(f"{spans}.end")),
        F.concat(F.col(f"{spans}.start"), F.array(F.octet_length(data).cast("long"))),
        lambda a, b: F.substring(F.col(data), (a + 1).cast("int"), (b - a).cast("int")),
    )


def kept_bytes(data: str = "data", spans: str = "spans"):
    """The bytes of column ``data`` outside column ``spans``, joined: binary."""
    return F.when(F.size(spans) == 0, F.col(data)).otherwise(F.aggregate(_pieces(data, spans), F.lit(b""), lambda acc, x: F.concat(acc, x)))


def kept_text(data: str = "data", spans: str = "spans"):
    """``kept_bytes`` as text, without the bytes of letters that a span cuts in two."""
    whole = F.transform(_pieces(data, spans), lambda x: F.btrim(F.make_valid_utf8(x.cast("string")), F.lit("\ufffd")))
    return F.when(F.size(spans) == 0, F.col(data).cast("string")).otherwise(F.array_join(whole, ""))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``repeated_spans`` (whose settings it takes) with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes joined, with parts of cut letters) and ``kept_text`` (without those)."""
    found = repeated_spans(df, id_col, text, **settings)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    kept = [c for c in found.columns if c not in ("data", "spans")]
    return found.select(*kept, "spans", F.octet_length("data").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept_bytes().alias("kept"), kept_text().alias("kept_text"))
