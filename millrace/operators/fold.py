"""One ordered fold for rules that SQL windows cannot express: state is carried from row to row of a key."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def small_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """df, in a session whose Arrow batches hold ``size`` bytes at most: 10,000 rows with arrays are too many for a task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not given or not 0 < int(given[1]) <= size:
        conf.set(name, f"{size}b")
    return df


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], inputs: list[str], outputs: str) -> DataFrame:
    """df with the columns ``outputs`` (DDL): ``step(state, values of inputs)`` returns (state, values), row by row in ``order`` within each key.

    Keys are spread over tasks and rows stream through: a task holds one batch and one state, whatever the size of a key.
    """
    names = [x.strip().split()[0] for x in outputs.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start()
        for batch in batches:
            own = list(zip(*[batch[k] for k in keys])) if keys else [()] * len(batch)
            made = []
            for key, values in zip(own, zip(*[batch[c] for c in inputs])):
                if key != current:
                    current, state = key, start()
                state, out = step(state, values)
                made.append(out)
            yield batch.assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
