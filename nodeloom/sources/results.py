"""Results as lines of JSON: schema, batches, summary."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame


def ndjson(rows: DataFrame, stats: dict[str, int] | None = None, batch: int = 1000) -> Iterator[str]:
    """Lines for a client: the schema, then batches as partitions arrive, then a summary; one partition is held at a time."""
    yield json.dumps({"event": "schema", "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in rows.schema.fields]})
    held: list[str] = []
    count = 0
    for r in rows.toJSON().toLocalIterator():
        held.append(r)
        count += 1
        if len(held) == batch:
            yield f'{{"event": "batch", "rows": [{", ".join(held)}]}}'
            held = []
    if held:
        yield f'{{"event": "batch", "rows": [{", ".join(held)}]}}'
    yield json.dumps({"event": "summary", "rows": count, "stats": stats or {}})


def write_ndjson(rows: DataFrame, path: str) -> None:
    """The rows as lines of JSON files, written by the executors."""
    rows.write.json(path)
