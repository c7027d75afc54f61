"""Analytics of a request log (event_id, key, ts, tokens, ok, rate_limited, latency, attempt)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .fold import fold

MICROS = 1_000_000
NEAR_LIMIT = 90.0
MOST_ATTEMPTS = 6
#: Seconds of the units in limit headers.
UNITS = {"s": 1, "m": 60, "h": 3600}


def trailing_usage(log: DataFrame, seconds: int = 60, key: str = "key") -> DataFrame:
    """log with requests_in_window and tokens_in_window: what the key used in the ``seconds`` up to each request.

    A key's rows are cut into stretches of ``seconds``, each row being also copied to the next stretch, so a hot
    key is many windows and not one. A window is what its own stretch holds up to the request, and what the stretch before holds from a time on: two sums
    that only grow, one in the order of time and one against it. No window is summed anew, however many rows it has, and nothing is taken off a sum.
    """
    width = seconds * MICROS
    timed = log.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    copies = F.when(F.col("_us").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    cut = timed.withColumn("_at", F.explode(copies)).withColumn("_bucket", F.floor(F.col("_us") / width) + F.col("_at")).withColumn("_us", F.col("_us") + F.col("_at") * width)
    stretch = Window.partitionBy(key, "_bucket")
    # A row and its copy, ``width`` later, are one stretch's: what is copied to a time after the request is still in its window.
    own, before = stretch.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0), stretch.orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, -1)
    tokens = [F.sum(F.when(F.col("_at") == at, F.col("tokens"))).over(frame) for at, frame in ((0, own), (1, before))]
    both = F.coalesce(tokens[0] + tokens[1], *tokens)
    used = cut.withColumns({"requests_in_window": F.count_if(F.col("_at") == 0).over(own) + F.count_if(F.col("_at") == 1).over(before), "tokens_in_window": both})
    return used.where("_at = 0").drop("_us", "_at", "_bucket")


def usage_report(log: DataFrame, now: Column, request_limit: int, token_limit: int, seconds: int = 60) -> DataFrame:
    """For each key with requests in the last ``seconds``: use, share of the limits in percent and what remains."""
    recent = log.where((F.col("ts") > now - F.make_interval(secs=F.lit(seconds))) & (F.col("ts") <= now))
    used = recent.groupBy("key").agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"))
    return used.select(
        "*",
        (F.col("requests") / request_limit * 100).alias("request_pct"),
        (F.col("tokens") / token_limit * 100).alias("token_pct"),
        F.greatest(F.lit(0), request_limit - F.col("requests")).alias("requests_remaining"),
        F.greatest(F.lit(0.0), token_limit - F.col("tokens")).alias("tokens_remaining"),
    )


def parse_reset_duration(text: Column) -> Column:
    """Seconds of text such as 6m0s: every number and the one letter after it; other letters count nothing."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)([a-zA-Z])"), F.lit(1))
    letters = F.regexp_extract_all(text, F.lit(r"(\d+)([a-zA-Z])"), F.lit(2))
    worth = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    parts = F.zip_with(numbers, letters, lambda n, u: n.try_cast("long") * F.coalesce(F.try_element_at(worth, F.lower(u)), F.lit(0)))
    return F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def parse_limit_headers(df: DataFrame, headers: str = "headers", now: str = "seen_at") -> DataFrame:
    """df with structs request_info and token_info (null without a positive limit, or if any number is not whole)."""
    get = lambda k: F.try_element_at(F.col(headers), F.lit(f"x-ratelimit-{k}"))
    out = df
    whole = F.lit(True)
    for kind in ("requests", "tokens"):
        for part in ("limit", "remaining"):
            raw = get(f"{part}-{kind}")
            whole = whole & (raw.isNull() | raw.try_cast("long").isNotNull())
    for kind, name in (("requests", "request_info"), ("tokens", "token_info")):
        limit, left = (F.coalesce(get(f"{p}-{kind}").try_cast("long"), F.lit(0).cast("long")) for p in ("limit", "remaining"))
        wait = parse_reset_duration(F.coalesce(get(f"reset-{kind}"), F.lit("")))
        info = F.struct(limit.alias("limit"), left.alias("remaining"), wait.alias("reset_seconds"), (F.col(now).cast("timestamp") + F.make_dt_interval(secs=wait)).alias("reset_time"), ((limit - left) / limit * 100).alias("usage_pct"))
        out = out.withColumn(name, F.when(whole & (limit > 0), info))
    return out


def proactive_check(request_left: Column, token_left: Column, tokens_needed: Column) -> Column:
    """Why a request would be refused, or null."""
    return F.when(request_left <= 0, "request limit exhausted").when(token_left < tokens_needed, "not enough tokens remaining")


def near_limit(usage_pct: Column, threshold: float = NEAR_LIMIT) -> Column:
    return usage_pct >= threshold


def usage_metrics(attempts: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """Totals, success share in percent and peak use of a window, for each ``by``."""
    used = trailing_usage(attempts, seconds)
    return used.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("successful"),
        F.count_if("rate_limited").alias("rate_limited"),
        F.count_if(F.col("rate_limited") & (F.col("attempt") < MOST_ATTEMPTS)).alias("retried"),
        F.coalesce(F.try_divide(F.count_if("ok") * 100.0, F.count("*")), F.lit(0.0)).alias("success_pct"),
        F.max("requests_in_window").alias("peak_requests"),
        F.max("tokens_in_window").alias("peak_tokens"),
    )


def _moving(x: np.ndarray, keep: float, before: float, size: int = 128) -> np.ndarray:
    """y[i] = (1 - keep) * x[i] + keep * y[i - 1], from y[-1] = before."""
    if not len(x):
        return np.empty(0)
    powers = keep ** np.arange(size + 1)
    within = np.tril(powers[np.abs(np.subtract.outer(np.arange(size), np.arange(size)))]) * (1 - keep)
    rows = np.append(x, np.zeros(-len(x) % size)).reshape(-1, size) @ within.T
    for i in range(len(rows)):
        rows[i] += powers[1:] * before
        before = rows[i, -1]
    return rows.ravel()[: len(x)]


def ema_response_time(log: DataFrame, alpha: float = 0.1) -> DataFrame:
    """log with ``ema``: the first latency other than 0 (0 before it), then a moving mean. Latencies are not null or negative; 0 < alpha < 0.5, or a mean could be 0 again.

    The log is cut by ranges of (key, ts, event_id), so that a hot key has many stretches. A stretch is walked twice in its task:
    as if it were the key's first, and, since a mean is linear in the one before it, as factor and offset of that one. Then only
    the stretches' ends are chained, a row for each, and what a stretch begins with is joined back.
    """
    if not 0 < alpha < 0.5:
        raise ValueError("alpha must lie between 0 and 0.5")
    keep = 1 - alpha
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields] + ["_part int, _n long, _a double, _linear double, _fresh double, _seen boolean"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, linear, fresh, seen = None, 0, 0.0, 0.0, False
        for batch in batches:
            keys, x = batch.column("key"), batch.column("latency").to_numpy(zero_copy_only=False).astype(np.float64)
            codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            out, place, begun = np.zeros((3, len(x))), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            ends = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(x)] if len(x) else []
            for a, b in zip([0, *ends], ends):
                if n == 0 or keys[a].as_py() != current:
                    current, n, linear, fresh, seen = keys[a].as_py(), 0, 0.0, 0.0, False
                own = x[a:b]
                m = 0 if seen else int(np.argmax(own != 0)) if own.any() else b - a
                out[0, a:b], out[1, a:b] = keep ** (n + 1.0 + np.arange(b - a)), _moving(own, keep, linear)
                if m < b - a:
                    out[2, a + m : b] = _moving(own, keep, fresh) if seen else np.append(own[m], _moving(own[m + 1 :], keep, own[m]))
                    begun[a + m : b] = seen = True
                place[a:b] = n + np.arange(b - a)
                n, linear, fresh = n + b - a, float(out[1, b - 1]), float(out[2, b - 1])
            made = [pa.array(np.full(len(x), TaskContext.get().partitionId()), pa.int32()), *map(pa.array, (place, *out, begun))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_part", "_n", "_a", "_linear", "_fresh", "_seen"])

    def step(state: float | None, row: tuple) -> tuple:
        a, along, first, begun = row
        return (a * state + along if state is not None else first if begun else None), (state,)

    rows = written(log.repartitionByRange("key", "ts", "event_id").sortWithinPartitions("key", "ts", "event_id").mapInArrow(walk, schema), "walked")
    ends = rows.groupBy("key", "_part").agg(F.max_by(F.struct("_a", "_linear", "_fresh", "_seen"), "_n").alias("x")).select("key", "_part", "x.*")
    several = ends.groupBy("key").count().where("count > 1").select(F.col("key").alias("_key"))
    ends = ends.join(several, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    chained = fold(ends, ["key"], ["_part"], lambda: None, step, ["_a", "_linear", "_fresh", "_seen"], "_before double").select(F.col("key").alias("_key"), F.col("_part").alias("_at"), "_before")
    joined = rows.join(chained, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    mean = F.when(F.col("_before").isNull() | F.isnan("_before"), F.col("_fresh")).otherwise(F.col("_a") * F.col("_before") + F.col("_linear"))
    return joined.withColumn("ema", mean).select(*log.columns, "ema")
