"""The contract of pluggable models: rows in, rows out, one model per Python worker, errors per row.

The engine ships no neural weights. A model is a factory that a task calls once, lazily (a partition without rows loads
nothing); it gets a batch of inputs and returns one output per input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[Sequence], Sequence]
_REGISTRY: dict[str, Callable[[], Model]] = {}


def register(name: str, factory: Callable[[], Model]) -> None:
    """Makes a model available by name; an existing name is an error, so no registration is replaced by accident."""
    if name in _REGISTRY:
        raise ValueError(f"a model named {name} is registered")
    _REGISTRY[name] = factory


def factory_of(name: str) -> Callable[[], Model]:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"no model named {name}; registered: {sorted(_REGISTRY)}") from None


def apply_model(rows: DataFrame, ident: str, source: str, factory: Callable[[], Model], kind: str, out: str = "output", batch: int = 64) -> DataFrame:
    """``(ident, out, error)``. A batch that fails is tried item by item, so one bad input costs itself only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or factory()
            ids, inputs, results = frame[ident].tolist(), frame[source].tolist(), []
            for i in range(0, len(inputs), batch):
                part = inputs[i : i + batch]
                try:
                    done = [(x, None) for x in model(part)]
                    if len(done) != len(part):
                        raise ValueError(f"{len(part)} inputs, {len(done)} outputs")
                except Exception:
                    done = []
                    for item in part:
                        try:
                            (value,) = model([item])
                            done.append((value, None))
                        except Exception as e:
                            done.append((None, f"{type(e).__name__}: {e}"))
                results += done
            yield pd.DataFrame({ident: ids, out: [v for v, _ in results], "error": [e for _, e in results]})

    key = rows.schema[ident].dataType.simpleString()
    return rows.select(ident, source).mapInPandas(run, f"{ident} {key}, {out} {kind}, error string")
