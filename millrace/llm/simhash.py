"""Near-duplicates by SimHash fingerprints and a binary-trie self-join.

A fingerprint has one bit for each bit of the shingles' hashes: set in more than half of them.
Equal fingerprints are one node. To link nodes within ``distance`` bits, the 64 bits are cut into
``parts``; two such fingerprints agree in at least parts - distance whole parts, so every choice
of that many parts makes a key under which they meet. Under a key, a binary trie of the
fingerprints is joined with itself: node pairs descend together, differing bits add up, and a
pair is dropped once they exceed the budget. All keys of a batch descend at once. Links come back
as a spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts, wide
from .components import components


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included, as rows of 8 bytes, highest first."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(found)
    if len(found) <= words:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist() if words > 1 else starts.tolist(), ends[words - 1 :].tolist())])
    return np.frombuffer(digests, np.uint8).reshape(-1, 8)


def simhash(text: str | None, words: int, seed: int) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words."""
    hashes = shingle_hashes(text, words, seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        counts += np.add.reduce(np.unpackbits(hashes[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """df with the long column ``name``, the whole text's fingerprint; null, empty and blank texts get zero.

    A-Z are lower-cased; words are runs other than blank and tab to carriage return. A text of
    fewer words is one shingle.
    """
    df = whole_texts(df)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(x.as_py(), words, seed) for x in batch], pa.int64())

    return df.withColumn(name, run(F.col(text).cast("string")))


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; root holds each member's smallest member, in place."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def trie_join(keys: np.ndarray, values: np.ndarray, budget: int, chunk: int = 1 << 18, accept=None) -> np.ndarray:
    """For values (unsigned, sorted under each key; keys contiguous): the smallest place linked to each, itself included.

    Two values of a key are linked if they differ in at most ``budget`` bits and ``accept(places, places)``, if given,
    says so, directly or through others. Equal values under a key, too, are compared by ``accept``.
    """
    n = len(values)
    root = np.arange(n)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.empty(0, np.int64)
    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    zero = np.zeros(big.sum(), np.int64)
    stack = [(0, np.stack([starts[big], ends[big], starts[big], ends[big], zero]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > chunk:  # depth first, the fewest errors first: memory stays bounded
            pairs = pairs[:, np.argsort(-pairs[4], kind="stable")]
            stack += [(depth, pairs[:, at : at + chunk]) for at in range(0, pairs.shape[1], chunk)]
            continue
        if len(stack) > 1 or pairs.shape[1] > n:  # what is linked already needs no further pairs
            change = np.append(0, np.cumsum(root[1:] != root[:-1])) if n else root
            joined = (root[pairs[0]] == root[pairs[2]]) & (change[pairs[1] - 1] == change[pairs[0]]) & (change[pairs[3] - 1] == change[pairs[2]])
            pairs = pairs[:, ~joined]
        if not pairs.shape[1]:
            continue
        if depth == 64:
            if accept is None:
                hooked(root, pairs[0], pairs[2])
            else:
                _accepted(root, pairs, accept)
            continue
        if depth in ones:
            count = ones[depth]
        else:
            count = np.append(0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64))
            if n <= 1 << 17:
                ones[depth] = count
        a, b, c, d, e = pairs
        left, right = b - (count[b] - count[a]), d - (count[d] - count[c])
        own = a == c
        made = []
        for p, q, r, s, more, keep in ((a, left, c, right, 0, True), (left, b, right, d, 0, True), (a, left, right, d, 1, True), (left, b, c, right, 1, ~own)):
            fine = (p < q) & (r < s) & (e + more <= budget) & keep & ~((p == r) & (q - p == 1))
            made.append(np.stack([x[fine] for x in (p, q, r, s, e + more)]))
        stack.append((depth + 1, np.concatenate(made, axis=1)))
    return root


def _accepted(root: np.ndarray, pairs: np.ndarray, accept) -> None:
    """Join what ``accept`` allows of leaf pairs; a leaf may hold several places of one value."""
    a, b, c, d, _ = pairs
    single = (b - a == 1) & (d - c == 1)
    left, right = a[single], c[single]
    for at in range(0, len(left), 4_096):  # what a slice links, later ones need not compare
        x, y = left[at : at + 4_096], right[at : at + 4_096]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        fine = accept(x, y)
        hooked(root, x[fine], y[fine])
    for i in np.flatnonzero(~single):
        left, right = np.arange(a[i], b[i]), np.arange(c[i], d[i])
        for x in left:  # one row of places at a time
            other = right[right > x] if a[i] == c[i] else right
            other = other[root[other] != root[x]]
            other = other[accept(np.full(len(other), x), other)] if len(other) else other
            hooked(root, np.full(len(other), x), other)


def _forest(distance: int, rows: int):
    """A function from batches of (key columns..., fp, node), whole keys in a row, to the links of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key, value, node = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((value, key))
            key, value, node = key[order], value[order], node[order]
            same = np.append(False, key[1:] == key[:-1])
            many = same | np.append(same[1:], False)
            key, value, node = key[many], value[many], node[many]
            root = trie_join(key, value, distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

        size = 0
        for batch in batches:
            names = batch.schema.names
            key = batch.column("key").to_numpy(zero_copy_only=False)
            held.append((key, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("node").to_numpy(zero_copy_only=False)))
            assert set(names) == {"key", "fp", "node"}
            size += len(key)
            if size >= rows and len(key):
                whole = [tuple(np.concatenate(x) for x in zip(*held))]
                cut = np.flatnonzero(whole[0][0] != whole[0][0][-1])
                at = cut[-1] + 1 if len(cut) else 0
                if at:  # the last key may go on in the next batch
                    yield links([tuple(x[:at] for x in whole[0])])
                held, size = [tuple(x[at:] for x in whole[0])], len(whole[0][0]) - at
        if size:
            yield links(held)

    return run


def _bits(low: int, high: int):
    """The bits low..high-1 of fp, counted from the lowest."""
    return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    """Bit numbers in ``parts`` runs of nearly equal size."""
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def in_blocks(placed: DataFrame, most: int) -> DataFrame:
    """placed (key, node, ...) with each key of more than ``most`` rows cut into blocks of about that many, and a key for every two of its blocks.

    Any two rows of a key still meet, and no key holds more than about 2 * ``most`` rows.
    """
    from .common import written

    counts = written(placed.groupBy("key").count().where(F.col("count") > most), "hot")
    if counts.isEmpty():
        return placed
    many = placed.join(counts, "key").withColumn("_n", F.ceil(F.col("count") / most)).withColumn("_i", F.pmod(F.xxhash64("node", F.lit(17)), F.col("_n")))
    many = many.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("key", F.xxhash64("key", F.least("_i", "_j"), F.greatest("_i", "_j")))
    return placed.join(counts, "key", "left_anti").unionByName(many.select(placed.columns))


def fingerprint_links(nodes: DataFrame, distance: int = 4, parts: int = 6, batch_rows: int = 100_000, hot_rows: int = 50_000) -> DataFrame:
    """Links (a, b) that join all nodes (fp long, node long; fp distinct) whose fp differ in at most ``distance`` bits, directly or in steps.

    Keys with more than ``hot_rows`` nodes are cut again: what is left of their bits goes into
    distance + 1 parts, of which two linked fingerprints share at least one. What is still larger is joined block by block.
    """
    spark = nodes.sparkSession
    whole = [(int(x[0]), int(x[-1]) + 1) for x in _cuts(list(range(64)), parts)]
    choices = list(combinations(range(parts), parts - distance))
    tagged = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), *[_bits(*whole[p]) for p in choice]).alias("key")) for i, choice in enumerate(choices)])
    keyed = nodes.select("fp", "node", F.inline(tagged))
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_rows).select("key")
    run, schema = _forest(distance, batch_rows), "a long, b long"
    placed = lambda df: df.select("key", "fp", "node").repartition(wide(spark), "key").sortWithinPartitions("key").mapInArrow(run, schema)
    if hot.isEmpty():
        return placed(keyed)
    again = []
    for i, choice in enumerate(choices):
        rest = [b for p in range(parts) if p not in choice for b in range(*whole[p])]
        for j, bits in enumerate(_cuts(rest, distance + 1)):
            runs = [b for b in bits]
            again.append((i, F.xxhash64("key", F.lit(j), *[_bits(b, b + 1) for b in runs])))
    finer = F.expr("array()").cast("array<bigint>")
    for i in range(len(choices)):
        finer = F.when(F.col("choice") == i, F.array(*[x for k, x in again if k == i])).otherwise(finer)
    cold = keyed.join(hot, "key", "left_anti")
    split = keyed.join(hot, "key", "left_semi").select("fp", "node", F.explode(finer).alias("key"))
    return placed(cold).unionByName(placed(in_blocks(split, hot_rows)))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = 4,
    distance: int = 4,
    seed: int = 42,
    parts: int = 6,
    batch_rows: int = 100_000,
    hot_rows: int = 50_000,
) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links, itself included) of every row.

    Texts as in ``fingerprints``: null, empty and blank ones share fingerprint zero, which links like
    any other. A repeated id gives a row each time; a null id keeps its fingerprint and gets its
    group's component (null if no row of it has an id). An empty table gives no rows.
    """
    from .common import written

    marked = written(fingerprints(df.select(F.col(id_col).cast("long").alias("doc_id"), text), text, words, seed).select("doc_id", "fp"), "fp")
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    # An id on several texts stands for several nodes: links between them hold for the id, so it joins them.
    found = components(fingerprint_links(nodes, distance, parts, batch_rows, hot_rows))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


BINS, EMPTY = 256, 65_535


def sketch(hashes: np.ndarray, seeds: int, bins: int = BINS) -> tuple[list[int], bytes]:
    """(``seeds`` smallest values under as many functions, smallest 16-bit value in each bin) of a text's shingle hashes."""
    h = hashes.copy().view(">u8").ravel().astype(np.uint64)
    least = np.full(bins, EMPTY, np.uint16)
    if not len(h):
        return [0] * seeds, least.tobytes()
    np.minimum.at(least, (h & np.uint64(bins - 1)).astype(np.int64), np.minimum(h >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16))
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)[:seeds]
    return [int(((h ^ (h >> np.uint64(29))) * k).min().view(np.int64)) for k in odd], least.tobytes()


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many numbers two sorted arrays of distinct ones share, and how many there are in all."""
    if not len(a) or not len(b):
        return 0, len(a) + len(b)
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return shared, len(a) + len(b) - shared


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The different numbers among a text's shingle hashes, sorted."""
    return np.unique(hashes.copy().view(">u8").ravel().astype(np.uint64))


def _finer(hot: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """(key, node) for the rows (key, node, count) of keys with more than ``most`` nodes: smaller keys, where they make less work, under which every similar pair still meets.

    With the shingles of each set in order from the key's rarest to its most frequent, two sets that overlap by
    ``similarity`` share one of the first n - ceil(similarity * n) + 1 of each. So each of those that another
    node has, too, makes a key. Texts that only share a frequent passage no longer meet; where the nodes are so alike that this makes more rows, the key stays.
    """
    from .common import written

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                size = np.array([len(x) for x in found])
                spread = [np.repeat(part.column(i).to_numpy(), size) for i in (0, 1)] + [np.repeat(size, size), np.concatenate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spread], ["key", "node", "size", "shingle"])

    each = hot.select("key", "node").join(sets, "node").select("key", "node", "shingles").mapInArrow(shingles, "key long, node long, size long, shingle long")
    each = written(each, "shingles")
    shared = written(each.groupBy("key", "shingle").agg(F.count("*").alias("f")).where("f > 1"), "shared")  # a plain table, so that the join can split a hot shingle
    own = each.join(shared, ["key", "shingle"]).groupBy("key", "node", "size").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("w"))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1 - (F.col("size") - F.size("w"))  # the set's own shingles come before
    keys = own.where(first > 0).select("key", "node", F.explode(F.slice("w", F.lit(1), first.cast("int"))).alias("x")).select("key", "node", F.xxhash64("key", F.col("x.shingle")).alias("sub"))
    keys = written(keys, "prefixes")
    work = lambda n: n * F.ceil(n / most)
    finer = keys.groupBy("key", "sub").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum(work(F.col("n"))).alias("finer"))
    coarse = hot.select("key", "count").distinct().join(finer, "key", "left").where(F.col("finer") >= work(F.col("count"))).select("key")
    coarse = written(coarse, "coarse")
    return hot.select("key", "node").join(coarse, "key", "left_semi").unionByName(keys.join(coarse, "key", "left_anti").select(F.col("sub").alias("key"), "node"))


def similar_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    distance: int = 22,
    slack: float = 0.12,
    seeds: int = 4,
    seed: int = 42,
    batch_rows: int = 20_000,
    batch_bytes: int = 16 << 20,
    hot_rows: int = 1_000,
) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), component_id (the smallest id reachable) and ``first`` of every row, for texts whose word shingles overlap by ``similarity`` (Jaccard) or more.

    ``first`` marks the row of smallest doc_id (null last), then text_hash, of each group; an exact repetition
    of that row is marked too.

    Fingerprints at that overlap differ in about 10 of 64 bits, too many for keys of whole parts. So texts
    meet under the smallest of their shingle hashes, ``seeds`` functions of them, which a pair shares with a chance of its
    overlap each (99.8 % for one of four at 0.8), and the trie self-join of the fingerprints runs under each with a budget of
    ``distance`` bits. Pairs within it whose sketches' bins, an estimate of the overlap with a standard error of about
    0.025, come to ``similarity`` - ``slack`` or more are compared shingle by shingle, and linked if the overlap of
    their whole sets is ``similarity`` or more. A key with more than ``hot_rows`` rows, such as a passage that very
    many texts share, is cut without losing a pair (see ``_finer`` and ``in_blocks``).
    Texts with equal sets of shingles are one node. Null, empty and blank texts are equal. A repeated id links no
    texts by itself. Rows without an id are linked like others; a group of only such rows has a null component_id. An empty table gives no rows.
    """
    df = whole_texts(df)
    from .common import written

    spark = df.sparkSession

    @F.arrow_udf("struct<fp: bigint, least: array<bigint>, bins: binary, node: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for x in batch:
                hashes = shingle_hashes(x.as_py(), words, seed)
                counts = np.zeros(64, np.int64)
                for at in range(0, len(hashes), 255):
                    counts += np.add.reduce(np.unpackbits(hashes[at : at + 255], axis=1), axis=0, dtype=np.uint8)
                out[0].append(int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True))
                least, bins = sketch(hashes, seeds)
                out[1].append(least)
                out[2].append(bins)
                out[3].append(int(np.uint64(xxhash.xxh64_intdigest(_distinct(hashes).tobytes(), seed)).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], ["fp", "least", "bins", "node"])

    whole = F.col(text).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), run(whole).alias("m")).select("doc_id", "text_hash", "m.*")
    marked = written(rows, "sketches")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    nodes = written(marked.groupBy("node").agg(least_row, F.min("fp").alias("fp"), F.first("least").alias("least"), F.first("bins").alias("bins")), "nodes")
    keyed = nodes.select("node", F.posexplode("least").alias("k", "v")).select("node", F.xxhash64("k", "v").alias("key"))
    counts = written(keyed.groupBy("key").count().where("count > 1"), "keys")
    met = written(keyed.join(counts, "key"), "met")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_distinct(shingle_hashes(x.as_py(), words, seed)).tobytes() for x in part.column(1)], pa.binary())], ["node", "shingles"])

    # Whole sets only of the nodes that meet others, from the text of one row each.
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", F.col("row.doc_id").alias("_doc"), F.col("row.text_hash").alias("_hash"))
    given = df.select(F.col(id_col).cast("long").alias("_own"), F.xxhash64(whole).alias("_own_hash"), whole.alias("_whole"))
    found = given.join(wanted, F.col("_own").eqNullSafe(F.col("_doc")) & (F.col("_own_hash") == F.col("_hash"))).groupBy("node").agg(F.min("_whole").alias("_whole"))
    sets = written(found.select("node", "_whole").mapInArrow(distinct, "node long, shingles binary"), "sets")
    hot, placed = met.where(F.col("count") > hot_rows), met.where(F.col("count") <= hot_rows).select("key", "node")
    if not hot.isEmpty():
        placed = placed.unionByName(in_blocks(written(_finer(hot, sets, similarity, hot_rows), "finer"), hot_rows))
    placed = placed.join(nodes.select("node", "fp", "bins").join(sets, "node"), "node").select("key", "fp", "node", "bins", "shingles")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            key, value, node = (table[c].to_numpy() for c in ("key", "fp", "node"))
            bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint16).reshape(-1, BINS)
            value = value.view(np.uint64)
            order = np.lexsort((value, key))
            key, value, node, bins = key[order], value[order], node[order], bins[order]
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].take(pa.array(order))]
            sizes = np.array([len(x) for x in shingles])

            def accept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                fine = np.zeros(len(a), bool)
                for at in range(0, len(a), 20_000):
                    x, y = bins[a[at : at + 20_000]], bins[b[at : at + 20_000]]
                    full = (x != EMPTY) | (y != EMPTY)
                    fine[at : at + 20_000] = ((x == y) & full).sum(axis=1) >= (similarity - slack) * full.sum(axis=1)
                fine &= np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
                for i in np.flatnonzero(fine).tolist():
                    shared, all_ = overlap(shingles[a[i]], shingles[b[i]])
                    fine[i] = shared / all_ >= similarity
                return fine

            root = trie_join(key, value, distance, accept=accept)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= batch_rows or sum(x.nbytes for x in held) >= batch_bytes:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table["key"].to_numpy()
                cut = np.flatnonzero(key != key[-1])
                at = int(cut[-1]) + 1 if len(cut) else 0
                if at:
                    yield solve(table.slice(0, at))
                held, size = table.slice(at).combine_chunks().to_batches(), table.num_rows - at
        if size:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    found = components(placed.repartition(wide(spark), "key").sortWithinPartitions("key").mapInArrow(links, "a long, b long"))
    named = written(nodes.select("node", "row").join(found, "node", "left").select("node", "row", F.coalesce("component", "node").alias("component")), "groups")
    least = named.groupBy("component").agg(F.min("row").alias("least"))
    placed = named.select("node", "component").join(least, "component").select("node", "least")
    own = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return marked.select("doc_id", "text_hash", "node").join(placed, "node").select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), own.alias("first"))
