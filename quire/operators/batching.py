"""Greedy request batches and their numbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

BUDGET, OVERHEAD = 1800, 24


def batches(units: DataFrame, budget: int = BUDGET, overhead: int = OVERHEAD) -> DataFrame:
    """units(doc_id, para_index, source) plus batch and cost: a unit opens a batch when it would exceed the budget; one too large stands alone.

    Costs stream by in order, a document is never gathered: prefix sums of the costs tell by binary search where a batch ends, and the search
    goes on from there. What is carried from one Arrow batch to the next is the document, its last batch and what that holds."""
    cost = (X.utf16_length(F.col("source")) + overhead).alias("cost")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, batch, used = None, 0, 0
        for part in parts:
            keys = part.column("doc_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(part.column("cost").to_numpy())])
            out = np.zeros(part.num_rows, np.int32)
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            for begin, end in zip(begins, [*begins[1:], len(keys)], strict=True):
                if (own := part.column("doc_id")[int(begin)].as_py()) != doc or begin:
                    doc, batch, used = own, 0, 0
                at = begin
                while at < end:
                    to = max(int(np.searchsorted(total, total[at] + budget - used, "right")) - 1, at if used else at + 1)
                    to = min(to, end)
                    out[at:to] = batch
                    used += int(total[to] - total[at])
                    if to < end:
                        batch, used = batch + 1, 0
                    at = to
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("para_index"), pa.array(out), part.column("cost")], ["doc_id", "para_index", "batch", "cost"])

    kinds = dict(units.dtypes)
    rows = units.select("doc_id", "para_index", cost).repartition("doc_id").sortWithinPartitions("doc_id", "para_index")
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, para_index {kinds['para_index']}, batch int, cost int")


def renumber(outstanding: DataFrame) -> DataFrame:
    """Position of each unit in its next request, from 0: columns doc_id, batch, para_index."""
    return outstanding.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("para_index")) - 1)
