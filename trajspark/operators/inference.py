"""Batched inference: a policy from observation rows to action chunks, loaded once per Python worker."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Policy = Callable[[pd.DataFrame], list[np.ndarray]]

_LOADED: dict = {}


def infer(df: DataFrame, keys: list[str], load: Callable[[], Policy], batch: int = 256) -> DataFrame:
    """(keys, chunk): the policy's chunk (array of vectors) for every row.

    `load` makes the policy; it is called once in each worker, by the identity of its code. Rows are
    handed over in batches of at most `batch`; as many chunks must come back as rows went in.
    """
    kinds = dict(df.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = (load.__module__, load.__qualname__, load.__code__.co_code)
        if name not in _LOADED:
            _LOADED[name] = load()
        policy = _LOADED[name]
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                chunks = policy(some)
                if len(chunks) != len(some):
                    raise ValueError(f"{len(some)} rows went in, {len(chunks)} chunks came back")
                yield some[keys].assign(chunk=[np.asarray(c, np.float32).tolist() for c in chunks])

    return df.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk array<array<float>>")
