"""Row-by-row operators on streaming tables.

Filtering features, substituting rules and scoring need no state, so the batch functions
take a streaming DataFrame unchanged; ``apply_to_stream`` only refuses the others early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.registry import OPERATORS, ROW_BY_ROW, operator


def apply_to_stream(name: str, stream: DataFrame, *args, **kwargs) -> DataFrame:
    function = operator(name)
    if function not in [OPERATORS[n] for n in ROW_BY_ROW]:
        raise ValueError(f"{name} needs the whole table and cannot run on a stream")
    return function(stream, *args, **kwargs)
