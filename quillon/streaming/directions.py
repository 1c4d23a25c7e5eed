"""Direction state over an unbounded stream: the same rules as the replay, kept by Spark between batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.directions import SCHEMA, Direction, Directions


def direction_stream(events: DataFrame, host: str, order: list[str]) -> DataFrame:
    """The directions of each host after each batch in which it has events (output mode ``update``).

    ``events`` as in ``operators.directions.replay``. Batches apply in their order, the
    events within one by ``order``. A host's state is at most a hundred directions.
    """
    columns = [host, *[c.split()[0] for c in SCHEMA.split(", ")]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, made = (json.loads(state.get[0]) if state.exists else []), (state.get[1] if state.exists else 0)
        directions = Directions(Direction(**d) for d in kept)
        directions.made = made
        rows = pd.concat(list(batches)).sort_values(order)
        for e in rows.itertuples():
            directions.apply(e.kind, list(e.keywords) if e.keywords is not None else [], 0.0 if pd.isna(e.score) else e.score, 0.0 if pd.isna(e.novelty) else e.novelty, e.source, e.label or "")
        state.update((json.dumps([asdict(d) for d in directions.all]), directions.made))
        yield pd.DataFrame([(key[0], *r) for r in directions.rows()], columns=columns)

    return events.groupBy(host).applyInPandasWithState(run, f"`{host}` string, {SCHEMA}", "directions string, made int", "update", GroupStateTimeout.NoTimeout)
