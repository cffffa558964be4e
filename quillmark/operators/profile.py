"""Where the kernel's time goes."""

from __future__ import annotations

from time import perf_counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.blocks import BlockParser
from ..kernel.html import HtmlRenderer
from ..kernel.tree import TreeBuilder
from ..options import Options

_PHASES = ("blocks", "tree", "html")


def phase_profile(docs: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """One row: ``documents, characters`` and the seconds that all workers spend on ``blocks`` (block structure alone),
    ``tree`` (blocks, inlines and the node rows) and ``html`` (blocks, inlines and HTML).

    Null texts aren't counted. Every document is measured where it lies; only sums leave a task.
    """
    flags = options.flags

    def measure(batches):
        chosen = Options.from_flags(flags)
        phases = (lambda t: BlockParser(t, chosen), TreeBuilder(chosen).build, HtmlRenderer(chosen).render)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            seconds = []
            for phase in phases:
                began = perf_counter()
                for t in texts:
                    phase(t)
                seconds.append(perf_counter() - began)
            yield pa.RecordBatch.from_pydict({"n": [len(texts)], "c": [sum(map(len, texts))]} | {p: [s] for p, s in zip(_PHASES, seconds)})

    measured = docs.select(F.col(text)).mapInArrow(measure, "n long, c long, " + ", ".join(f"{p} double" for p in _PHASES))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return measured.agg(total("n").alias("documents"), total("c").alias("characters"), *(total(p).alias(p) for p in _PHASES))
