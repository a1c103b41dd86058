"""The limit on series keys as a stateful operator on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.tags import canonical_tags, scope

OUT = "series string, ts long, seq long, value double, tags map<string,string>, scope string, admitted boolean"
STATE = "keys array<string>"


def admit_stream(points: DataFrame, limit: int, scope_key: str | None = None) -> DataFrame:
    """The stream with ``scope`` and ``admitted``: whether the key of a point was among the first ``limit`` of its scope.

    Within a micro-batch points are taken by ``seq``. The state of a scope is the set of its admitted keys, as they are and not as
    hashes, at most ``limit`` of them. An exact limit needs one state per scope, so a hot scope is one task per batch;
    of it only the distinct keys are ranked, and rows are passed on as they came. Where that is too much, ``write_stream`` into an
    engine with a limit ranks the keys of each micro-batch over all tasks.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        parts, first = [], {}
        for part in batches:
            parts.append(part)
            least = part[~part["key"].isin(known)].groupby("key", sort=False)["seq"].min()
            for k, seq in least.items():
                if k not in first or seq < first[k]:
                    first[k] = seq
        known.update(sorted(first, key=lambda k: (first[k], k))[: max(0, limit - len(known))])
        state.update((sorted(known),))
        for part in parts:
            out = part.assign(admitted=np.fromiter((k in known for k in part["key"]), bool, len(part)))
            yield out[["series", "ts", "seq", "value", "tags", "scope", "admitted"]]

    keyed = points.withColumns({"scope": scope("tags", scope_key), "key": F.to_json(F.struct("series", canonical_tags("tags").alias("tags")))})
    return keyed.groupBy("scope").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
