"""Drawings that arrive in parts: keyed state holds a drawing's paths until all that it declares are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gathered(paths: DataFrame, declared: str = "n_paths", key: str = "drawing_id", item: str = "path_id") -> DataFrame:
    """The rows of ``paths``, a stream, of every drawing once it is whole: when as many different ``item`` as it declares have come.

    A drawing's rows come out together, in the batch that completes it, and its state is dropped but for the mark that it
    is done, so that rows which come again later don't bring it back. A row that repeats an ``item`` replaces the
    earlier one; the number declared is the largest that a row gives, and rows without one wait. State is kept by drawing
    and grows with the rows of drawings that aren't whole.
    """
    names = [c for c in paths.columns if c != key]
    kind = paths.schema[key].dataType.simpleString()
    packed = paths.select(F.col(key), F.col(item).cast("string").alias("item"), F.coalesce(F.col(declared), F.lit(0)).cast("long").alias("n"), F.to_json(F.struct(*names)).alias("record"))

    def gather(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, records, most, done = state.get if state.exists else ([], [], 0, False)
        held = dict(zip(items, records, strict=True))
        for part in parts:
            if not done and len(part):
                held.update(zip(part["item"].tolist(), part["record"].tolist(), strict=True))
                most = max(most, int(part["n"].max()))
        whole = not done and 0 < most <= len(held)
        if done or whole:
            state.update(([], [], most, True))
        else:
            state.update((list(held), list(held.values()), most, False))
        if whole:
            yield pd.DataFrame({key: [k[0]] * len(held), "record": list(held.values())})

    rows = packed.groupBy(key).applyInPandasWithState(gather, f"{key} {kind}, record string", "items array<string>, records array<string>, most long, done boolean", "append", GroupStateTimeout.NoTimeout)
    schema = ", ".join(f"`{c}` {paths.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(key, F.from_json("record", schema).alias("r")).select(key, "r.*").select(*paths.columns)
