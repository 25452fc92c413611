"""Groups that pass through a task one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, gather: int = 4096) -> DataFrame:
    """``run`` on the rows of every group, as ``applyInPandas`` does, for groups that are many and bounded: rows are
    sorted by ``keys`` and read in batches, so a group costs no batch of its own. Results are gathered into frames
    of ``gather`` rows or more."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out, held = None, [], 0
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            new = np.zeros(len(b), dtype=bool)
            for k in keys:
                v = b[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if (r := run(b.iloc[lo:hi])) is not None and len(r):
                    out.append(r)
                    held += len(r)
            if held >= gather:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
            rest = b.iloc[starts[-1] :]
        if rest is not None and (r := run(rest)) is not None and len(r):
            out.append(r)
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)
