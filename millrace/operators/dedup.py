"""Exact and near duplicates, and the rule that the first of them wins.

Near duplicates are texts whose normal forms' word sets have a Jaccard similarity of at least
``threshold``; the search finds all of them. Words are compared by 64-bit hashes. Rows with one word set form a
class, and only classes are compared: copies never make pairs.

With words in an order that is the same for all sets, two such sets share a word among the first n - ceil(threshold * n) + 1 of each. So
a set is listed under those words only, its prefix, and as the rarest words come first, lists are short. A pair is looked at
further if the sizes allow it and the words that are left after the shared one suffice. The first-wins rule needs less than all pairs: only
rows that were kept can make others go, so lists are gone through from their first rows on, a few more in every round, and what
is near to a kept row leaves all lists. ``m`` near copies of a text cost some ``m`` rows, not the square of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import dropped, swept, written
from .fold import small_batches

SLACK = 1e-9
#: Words whose order by frequency is known to every task: 4 MB. Others count as rarer.
ORDERED = 250_000
#: Edges that one task may settle by itself: some tens of MB.
SMALL = 200_000
#: With no more pairs than this in all lists, or no more for each row of the lists, they are gone through at once.
MOST_PAIRS = 2_000_000
PAIRS_A_ROW = 8
#: How many rows of each list the first round looks at, and how many times as many each further round.
FIRST, GROWTH = 16, 8


def exact_duplicates(df: DataFrame, scope: list[str], seq: str = "seq") -> DataFrame:
    """df with text_hash and is_duplicate: an earlier row of the scope has the same normal form."""
    hashed = df.withColumn("text_hash", T.text_hash(F.col("text")))
    first = hashed.groupBy(*scope, "text_hash").agg(F.min(seq).alias("_first"))
    return hashed.join(first, [*scope, "text_hash"]).withColumn("is_duplicate", F.col(seq) > F.col("_first")).drop("_first")


def frequent(words: DataFrame, most: int = ORDERED) -> np.ndarray:
    """The ``most`` most frequent of the numbers in column ``word``, rarest first; those that occur once are left out."""
    counted = words.groupBy("word").agg(F.count("*").alias("f")).where("f > 1")
    with swept(words.sparkSession):
        return ranked(counted.orderBy(F.desc("f"), "word").limit(most))


def ranked(order: DataFrame) -> np.ndarray:
    """The numbers of a table (word, f), rarest first."""
    table = order.select("word", "f").toArrow()
    word, f = (table[c].to_numpy() for c in ("word", "f"))
    return word[np.lexsort((word, f))]


def parities(words: np.ndarray, of: np.ndarray, sets: int, bits: int) -> np.ndarray:
    """For each of ``sets`` sets, of which ``words`` are ``of``, in how many of ``bits`` classes of numbers it has an odd number of them: 64 classes a long.

    Two sets' bits differ in no more places than there are words that only one of them has.
    """
    odd = np.bincount(of * bits + (words & (bits - 1)), minlength=sets * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)


def apart(a: list[str], b: list[str]) -> Column:
    """In how many places the columns ``a`` and ``b`` differ."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))


def within(differ: Column, threshold: float, na: Column, nb: Column) -> Column:
    """Whether sets of ``na`` and ``nb`` words may reach the threshold if at least ``differ`` words are in only one of them."""
    return differ * (1 + threshold) <= (na + nb) * (1 - threshold) + SLACK


def prefixes(sets: DataFrame, threshold: float, order: np.ndarray | None = None) -> DataFrame:
    """(cid, scope, n, at, p, q, word, then the other columns of ``sets``): the words of each set's prefix with their places in the order of words, and a sketch of the whole set in 128 bits.

    ``sets`` has cid, scope and words (distinct numbers). Words come in the given ``order``, or in that of their frequency among ``sets``; others
    are rarer and come first, by their numbers. Sets stay where they are: only the words' counts are shuffled.
    """
    if order is None:
        order = frequent(sets.select(F.explode("words").alias("word")))
    place = np.argsort(order, kind="stable")
    known = sets.sparkSession.sparkContext.broadcast((order[place], place + 1))
    more = [c for c in sets.columns if c not in ("cid", "scope", "words")]
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
    schema = ", ".join([f"cid {kinds['cid']}, scope {kinds['scope']}, n int, at int, p long, q long, word long"] + [f"`{c}` {kinds[c]}" for c in more])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = known.value
        for batch in batches:
            lists = batch.column("words")
            words = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(n)), n)
            bits = parities(words, of, len(n), 128)
            rank = np.zeros(len(words), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, words), len(names) - 1)
                rank = np.where(names[at] == words, places[at], 0)
            words = words[np.lexsort((words, rank, of))]
            at = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < np.repeat(n - np.ceil(n * threshold - SLACK) + 1, n)
            rows = pa.array(of[keep])
            taken = [batch.column(c).take(rows) for c in ("cid", "scope", *more)]
            made = [pa.array(x, t) for x, t in ((n[of[keep]], pa.int32()), (at[keep], pa.int32()), *[(bits[of[keep], i], pa.int64()) for i in (0, 1)], (words[keep], pa.int64()))]
            yield pa.RecordBatch.from_arrays([*taken[:2], *made, *taken[2:]], ["cid", "scope", "n", "at", "p", "q", "word", *more])

    return small_batches(sets).select("cid", "scope", "words", *more).mapInArrow(cut, schema)


def may_be_near(threshold: float, a: str = "a", b: str = "b") -> Column:
    """Whether lists' rows (columns n, at, p and q with ``a`` and ``b`` after them) under one word may be near: by their sizes, by what is left of both from that word on, and by their sketches.

    The first word that two sets share passes if they are near; later ones need not.
    """
    na, nb, left = F.col(f"n{a}"), F.col(f"n{b}"), F.least(F.col(f"n{a}") - F.col(f"at{a}"), F.col(f"n{b}") - F.col(f"at{b}"))
    sizes = (F.least(na, nb) >= F.greatest(na, nb) * threshold - SLACK) & (left * (1 + threshold) >= (na + nb) * threshold - SLACK)
    return sizes & within(apart([f"p{a}", f"q{a}"], [f"p{b}", f"q{b}"]), threshold, na, nb)


def sketches(sets: DataFrame) -> DataFrame:
    """(cid, n, s0 to s7) of sets (cid, words): of each of 512 classes of numbers, whether the set has an odd number of them."""
    schema = ", ".join([f"cid {sets.schema['cid'].dataType.simpleString()}, n int", *[f"s{i} long" for i in range(8)]])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            n = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().to_numpy(zero_copy_only=False)
            bits = parities(words, np.repeat(np.arange(len(n)), n), len(n), 512)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(n, pa.int32()), *[pa.array(bits[:, i]) for i in range(8)]], ["cid", "n", *[f"s{i}" for i in range(8)]])

    return small_batches(sets).select("cid", "words").mapInArrow(drawn, schema)


def may_reach(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) of which the sketches differ in no more places than two sets of such similarity can, with their number in ``apart``, written; sets are (cid, words).

    Most lists' pairs are unlike: these meet by 64 bytes of each set, not by its words.
    """
    named = lambda sets, side: sketches(sets).select(*[F.col(c).alias(c + side) for c in ("n", *[f"s{i}" for i in range(8)])], F.col("cid").alias(side))
    differ = apart(*[[f"s{i}{side}" for i in range(8)] for side in ("a", "b")])
    both = pairs.join(named(left, "a"), "a").join(named(right, "b"), "b")
    return written(both.where(within(differ, threshold, F.col("na"), F.col("nb"))).select(*pairs.columns, differ.alias("apart")).distinct(), "near")


def held(sets: DataFrame, near: DataFrame, side: str) -> DataFrame:
    """The rows of ``sets`` that written pairs have at ``side``; the others' words are not shuffled where the pairs are few."""
    ids = near.select(F.col(side).alias("cid")).distinct()
    return sets.join(F.broadcast(ids), "cid", "left_semi") if near.count() <= SMALL else sets


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b, ...) with their similarity, those that reach the threshold; sets are (cid, words)."""
    pairs = may_reach(pairs, left, right, threshold).drop("apart")
    named = pairs.join(held(left, pairs, "a").select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a").join(held(right, pairs, "b").select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return named.withColumn("similarity", shared / (F.size("wa") + F.size("wb") - shared)).where(F.col("similarity") >= threshold).drop("wa", "wb")


def _listed(index: DataFrame, name: str) -> DataFrame:
    """The lists' rows with ``name`` after their columns, but for scope and word."""
    own = ("n", "at", "p", "q")
    return index.select(F.col("cid").alias(name), *[F.col(c).alias(c + name) for c in own], "scope", "word", *[c for c in index.columns if c not in ("cid", "scope", "word", *own)])


def set_pairs(left: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all sets (cid, scope, words) in one scope that are at least ``threshold`` alike; a < b."""
    left = written(left, "sets")
    index = prefixes(left, threshold)
    found = _listed(index, "a").join(_listed(index, "b"), ["scope", "word"]).where((F.col("a") < F.col("b")) & may_be_near(threshold)).select("a", "b").distinct()
    return verified(found, left, left, threshold).select("a", "b", "similarity")


def near_duplicate_pairs(df: DataFrame, threshold: float = 0.85, scope: list[str] = [], seq: str = "seq", pairs: bool = True) -> DataFrame:
    """(a, b, similarity) for classes of equal word sets, each named by its first row; copies are in the membership, not here.

    With ``pairs`` false, each class but those that the first-wins rule keeps once: a is the first kept class that it is near to. These are
    no more rows than there are classes, however many near copies there are. ``seq`` names rows and is not null; of a repeated one it is not told which row is meant.
    """
    classes = _classes(df, scope, seq).where("size(words) > 0")
    if pairs:
        return set_pairs(classes, threshold)
    classes = written(classes.select("cid", "scope", "words", _order(F.col("cid"), F.lit(0)).alias("e")), "classes")
    kept, _, index = leaders(classes, threshold)
    led = _near_kept(index.where(F.col("e").isNotNull()).join(kept.select("cid"), "cid", "left_anti"), index.join(kept.select("cid"), "cid", "left_semi"), classes, threshold)
    return led.groupBy(F.col("a").alias("b")).agg(F.min(F.struct("eb", "b", "similarity")).alias("x")).select(F.col("x.b").alias("a"), "b", F.col("x.similarity").alias("similarity"))


def _classes(df: DataFrame, scope: list[str], seq: str) -> DataFrame:
    rows = df.select(F.col(seq).alias("cid"), _scope(scope).alias("scope"), T.hashed_set(F.col("text")).alias("words"))
    return rows.groupBy("scope", *_set_key(), F.size("words").alias("n")).agg(F.min("cid").alias("cid"), F.first("words").alias("words")).select("cid", "scope", "words")


def _scope(scope: list[str]) -> Column:
    """The scope's columns as one text; a null in them is a value of its own."""
    return F.coalesce(F.struct(*scope, F.lit(0)).cast("string"), F.lit(""))


def _set_key() -> list[Column]:
    """Two hashes of a set of words: one of 64 bits would meet itself among some 10**9 sets."""
    return [F.xxhash64("words").alias("set"), F.xxhash64(F.lit(1), "words").alias("set2")]


def _order(seq: Column, row: Column) -> Column:
    """Rows' place in the walk: by seq, nulls last, then by the row's own number."""
    return F.struct(seq.isNull().alias("last"), seq.cast("long").alias("seq"), row.cast("long").alias("row"))


def word_set_members(df: DataFrame, scope: list[str] = [], seq: str = "seq") -> DataFrame:
    """(seq, class): the first row with the same word set, for every row."""
    rows = df.select(F.col(seq).alias("seq"), _scope(scope).alias("scope"), F.md5(F.concat_ws(" ", T.word_set(F.col("text")))).alias("set"))
    rows = written(rows, "members")
    return rows.join(rows.groupBy("scope", "set").agg(F.min("seq").alias("class")), ["scope", "set"]).select("seq", "class")


def _walked(edges: DataFrame) -> DataFrame:
    """(cid, lost) of the nodes a that are lost or, else, not sure, from all edges (a, b, ea, sure_a, sure_b) in the order of ea, in one task; for few edges only."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        a, b, last, seq, row, sure_a, sure_b = (table[c].to_numpy() for c in ("a", "b", "last", "seq", "row", "sure_a", "sure_b"))
        order = np.lexsort((row, seq, last))
        lost: set[int] = set()
        open_: set[int] = set()
        ends = [*(np.flatnonzero(np.diff(a[order])) + 1).tolist(), len(order)]
        for begin, end in zip([0, *ends], ends):
            mine = order[begin:end]
            own, unsure = int(a[mine[0]]), not sure_a[mine[0]]
            for i in mine:
                other = int(b[i])
                if other in open_ or (not sure_b[i] and other not in lost):
                    unsure = True
                elif other not in lost:
                    lost.add(own)
                    break
            if own not in lost and unsure:
                open_.add(own)
        yield pa.RecordBatch.from_arrays([pa.array([*lost, *open_], pa.int64()), pa.array([True] * len(lost) + [False] * len(open_))], ["cid", "lost"])

    return edges.select("a", "b", "ea.last", F.coalesce("ea.seq", F.lit(0)).alias("seq"), "ea.row", "sure_a", "sure_b").coalesce(1).mapInArrow(walk, "cid long, lost boolean")


def leaders(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, lost, index) of a written table of classes (cid, scope, words, e): what the first-wins rule keeps of the classes with a place ``e`` in the walk.

    ``kept`` has cid and e, ``lost`` has cid and ``near``, the place of a kept class that it is near to, and ``index`` the prefixes of all classes with
    their e. A class without words is near to none and kept.

    In each round a class is held against those that come first in its lists, kept ones and undecided ones, up to a limit that grows from round
    to round. Where no earlier one lies beyond the limit, it is sure: it is kept if all that it is near to are lost. Any class that is near to a kept one is lost.
    """
    sets = classes.where("size(words) > 0")
    index = written(prefixes(sets.select("cid", "scope", "words", "e"), threshold), "index")
    bare = classes.where("size(words) = 0 and e is not null").select("cid", "e")
    undecided, kept, lost = sets.where("e is not null").select("cid", "e"), None, None
    asks = lists = index.where("e is not null")
    limit: int | None = FIRST
    while True:
        if kept is not None:
            asks, lists = (index.join(x.select("cid"), "cid", "left_semi") for x in (undecided, undecided.unionByName(kept)))
        asked = asks.groupBy("scope", "word").agg(F.count("*").alias("f"), F.count("*").alias("all"))
        if kept is not None:
            asked = asked.drop("all").join(lists.groupBy("scope", "word").agg(F.count("*").alias("all")), ["scope", "word"])
        with swept(classes.sparkSession):
            pairs, rows, longest = asked.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum(F.col("f") * (F.col("all") - F.col("f") / 2)), F.sum("f"), F.max("all"))]).first()
        if longest <= limit or pairs <= max(MOST_PAIRS, PAIRS_A_ROW * rows):
            limit = None
        heads = _listed(lists, "b").withColumnRenamed("e", "eb")
        if limit is not None:
            place = Window.partitionBy("scope", "word").orderBy("eb")
            heads = heads.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).drop("place")
            heads = written(heads, "heads")
        near = _listed(asks, "a").withColumnRenamed("e", "ea")
        pairs = near.join(heads, ["scope", "word"]).where((F.col("eb") < F.col("ea")) & may_be_near(threshold)).groupBy("a", "b").agg(F.first("ea").alias("ea"), F.first("eb").alias("eb"))
        edges = verified(pairs, sets, sets, threshold).drop("similarity")
        unsure = None
        if limit is not None:
            # Lists that go on beyond the limit: rows after their last head have not met all earlier ones.
            long_ = heads.groupBy("scope", "word").agg(F.count("*").alias("heads"), F.max("eb").alias("end")).where(F.col("heads") == limit)
            unsure = written(near.join(long_, ["scope", "word"]).where(F.col("ea") > F.col("end")).select(F.col("a").alias("cid")).distinct(), "unsure")
        edges = met = written(edges, "edges")
        gone = None
        if kept is not None:  # near to one that an earlier round kept
            gone = written(edges.join(kept.select(F.col("cid").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("cid")).agg(F.min("eb").alias("near")), "gone")
            edges = edges.join(kept.select(F.col("cid").alias("b")), "b", "left_anti")
            for side in ("a", "b"):
                edges = edges.join(gone.select(F.col("cid").alias(side)), side, "left_anti")
        for side in ("a", "b"):
            if unsure is None:
                edges = edges.withColumn(f"sure_{side}", F.lit(True))
            else:
                edges = edges.join(unsure.select(F.col("cid").alias(side), F.lit(True).alias("_u")), side, "left").withColumn(f"sure_{side}", F.col("_u").isNull()).drop("_u")
        if kept is not None or unsure is not None:
            edges = written(edges, "edges")
            dropped(met)
        fresh, open_ = _settled(edges)
        found = fresh if gone is None else gone.unionByName(fresh)
        rest = undecided.join(found.select("cid"), "cid", "left_anti")
        if unsure is None:
            kept = rest if kept is None else kept.unionByName(rest)
            lost = found if lost is None else lost.unionByName(found)
            return kept.unionByName(bare), lost, index
        left = unsure.unionByName(open_).distinct()
        rest = written(rest.join(left.withColumn("open", F.lit(True)), "cid", "left").select("cid", "e", F.coalesce("open", F.lit(False)).alias("open")), "rest")
        new = rest.where("not open").select("cid", "e")
        kept = new if kept is None else kept.unionByName(new)
        lost = found if lost is None else lost.unionByName(found)
        dropped(heads, unsure, edges)
        undecided, limit = rest.where("open").select("cid", "e"), limit * GROWTH
        if undecided.isEmpty():
            return kept.unionByName(bare), lost, index


def _settled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cid, near) of the nodes that are lost, cid of those that stay open) from written edges (a, b, ea, eb, sure_a, sure_b) to earlier nodes."""
    first = edges
    lost = edges.select(F.col("a").alias("cid")).limit(0)
    open_ = lost
    while (left := edges.count()) > SMALL:
        blocked = edges.select(F.col("a").alias("b")).distinct()
        sure = written(edges.where("sure_b").select("b").distinct().join(blocked, "b", "left_anti"), "sure")
        now = written(edges.join(sure, "b", "left_semi").select("a").distinct(), "lost")
        if now.isEmpty():
            break
        lost = lost.unionByName(now.withColumnRenamed("a", "cid"))
        for side in ("a", "b"):
            edges = edges.join(now.withColumnRenamed("a", side), side, "left_anti")
        edges = written(edges, "edges")
    if left > SMALL:
        open_ = edges.select(F.col("a").alias("cid")).distinct()
    elif left:
        walked = written(_walked(edges), "walked")
        lost, open_ = lost.unionByName(walked.where("lost").select("cid")), walked.where("not lost").select("cid")
    # Which kept node each lost one is near to: one that is sure, not lost and not open.
    near = first.where("sure_b")
    for gone in (lost, open_):
        near = near.join(gone.select(F.col("cid").alias("b")), "b", "left_anti")
    near = near.groupBy(F.col("a").alias("cid")).agg(F.min("eb").alias("near"))
    return written(lost.join(near, "cid").select("cid", "near"), "lost"), open_


def _near_kept(asks: DataFrame, kept: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, eb, similarity) of rows of lists that are near to a kept class."""
    pairs = _listed(asks.drop("e"), "a").join(_listed(kept, "b").withColumnRenamed("e", "eb"), ["scope", "word"]).where((F.col("a") != F.col("b")) & may_be_near(threshold))
    return verified(pairs.groupBy("a", "b").agg(F.first("eb").alias("eb")), sets, sets, threshold)


def first_wins(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (seq, scope, text or its hash and words, eligible, and ``row``, a number of each row's own, seq if missing) with ``reason``: (row, seq, reason), why each is a duplicate of an earlier kept row, else null.

    Rows are walked in the order of seq, nulls last, those of one seq by ``row``: a row is kept if it is eligible and neither equal nor near to a row
    kept before it in its scope.
    """
    if "row" not in rows.columns:
        rows = rows.withColumn("row", F.col("seq"))
    if "hash" not in rows.columns:
        rows = rows.withColumns({"hash": T.text_hash(F.col("text")), "words": T.hashed_set(F.col("text"))})
    rows = rows.withColumn("words", F.coalesce("words", F.array().cast("array<bigint>")))
    whole = written(rows.select("row", _order(F.col("seq"), F.col("row")).alias("o"), "scope", "eligible", "hash", "words", *_set_key()), "rows")
    classes = whole.groupBy("scope", "set", "set2").agg(F.first("words").alias("words"), F.min_by("row", "o").alias("cid"), F.min("o").alias("o"), F.min(F.when(F.col("eligible"), F.struct("o", "hash"))).alias("first"))
    classes = written(classes.select("cid", "scope", "set", "set2", "words", "o", F.col("first.o").alias("e"), F.col("first.hash").alias("e_hash")), "classes")
    slim = written(whole.select("row", "o", "scope", "set", "set2", "hash"), "rows")
    dropped(whole)
    kept, lost, index = leaders(classes, threshold)
    # Classes with rows before their first eligible one, or without one, are held against all that was kept.
    early = written(classes.where("size(words) > 0 and (e is null or o < e)").select("cid").join(kept.select("cid"), "cid", "left_anti"), "early")
    near = lost
    if not early.isEmpty():
        more = _near_kept(index.join(early, "cid", "left_semi"), index.join(kept.select("cid"), "cid", "left_semi"), classes, threshold)
        near = near.unionByName(more.select(F.col("a").alias("cid"), F.col("eb").alias("near")))
    near = near.groupBy("cid").agg(F.min("near").alias("near"))
    own = classes.join(kept.select("cid", F.col("e").alias("ke")), "cid", "left").select("cid", "scope", "set", "set2", "ke", F.when(F.col("ke").isNotNull(), F.col("e_hash")).alias("kh"))
    marked = own.join(near, "cid", "left").drop("cid")
    out = slim.select("row", "o", "scope", "set", "set2", "hash").join(marked, ["scope", "set", "set2"])
    reason = F.when((F.col("ke") < F.col("o")) & F.col("kh").eqNullSafe(F.col("hash")), "exact_duplicate").when((F.col("ke") < F.col("o")) | (F.col("near") < F.col("o")), "semantic_similarity")
    return out.select("row", F.col("o.seq").alias("seq"), reason.alias("reason"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with a number of each row's own in ``name``, in the order of its partitions."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def first_wins_dedup(df: DataFrame, threshold: float = 0.85, scope: list[str] = [], seq: str = "seq") -> DataFrame:
    """df with ``reason`` (null: kept); every row may be kept. Rows of null seq come last, those of one seq in any order; a null text is like an empty one, and equal only to a null or empty one."""
    df = numbered(df, "_row")
    rows = df.select(F.col("_row").alias("row"), F.col(seq).alias("seq"), _scope(scope).alias("scope"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("eligible"))
    return df.join(first_wins(rows, threshold).select(F.col("row").alias("_row"), "reason"), "_row").drop("_row")


def dedup_stats(df: DataFrame) -> DataFrame:
    """How many different hashes and normal forms there are; normal forms are told apart by 192 bits of hashes, so no text is shuffled."""
    forms = df.select(T.text_hash(F.col("text")).alias("h"), F.xxhash64(T.normalize_text(F.col("text"))).alias("x"))
    return forms.agg(F.countDistinct("h").alias("total_seen"), F.countDistinct("h", "x").alias("unique_normalized"))


def dedup_state(df: DataFrame, by: list[str] = [], bits: int = 14) -> DataFrame:
    """The same counts as a state that later batches add to: sketches of 2**bits registers, of a relative error of some 1.04 / 2**(bits / 2) (0.8 %), and how many rows there were.

    A null text is in neither sketch.
    """
    seen = F.hll_sketch_agg(T.text_hash(F.col("text")), bits).alias("seen")
    return df.groupBy(*by).agg(seen, F.hll_sketch_agg(T.normalize_text(F.col("text")), bits).alias("normalized"), F.count("*").alias("rows"))


def merge_states(states: DataFrame, by: list[str] = []) -> DataFrame:
    """One state of many, by ``by``: what ``dedup_state`` of all their rows would be, to the last register."""
    return states.groupBy(*by).agg(F.hll_union_agg("seen").alias("seen"), F.hll_union_agg("normalized").alias("normalized"), F.sum("rows").alias("rows"))


def state_totals(states: DataFrame) -> DataFrame:
    """The states' estimates: total_seen and unique_normalized, beside their other columns."""
    return states.withColumns({"total_seen": F.hll_sketch_estimate("seen"), "unique_normalized": F.hll_sketch_estimate("normalized")}).drop("seen", "normalized")
