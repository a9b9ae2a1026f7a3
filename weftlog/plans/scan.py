"""Running results over the elements of an array, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan(xs: Column, start: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """start and what step(result so far, element) gives after each element of xs: an array of size(xs) + 1 results.

    Arrays grow by copying, so results are gathered in blocks: an array of n elements costs n * block
    copies and a copy of n / block references for each block.
    """
    last = lambda done: F.element_at(done, -1)

    def one_block(done: Column, at: Column) -> Column:
        here = F.aggregate(F.slice(xs, at + 1, F.lit(block)), F.array(last(last(done))), lambda out, x: F.array_append(out, step(last(out), x)))
        return F.array_append(done, F.slice(here, 2, block))

    blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(blocks, F.array(F.array(start)), one_block))
