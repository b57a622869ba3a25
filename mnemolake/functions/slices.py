"""What a Python task holds at once: slices of Arrow batches, and lookups of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are answered at once, as Python values and Arrow builders take many times a row's bytes; entries that a lookup may have before it begins anew.
SLICE, KNOWN = 256, 1 << 16


def slices(batches: Iterator) -> Iterator:
    """Arrays or record batches in pieces of SLICE rows; what a batch took goes back before the next is read."""
    for batch in batches:
        for first in range(0, len(batch), SLICE):
            yield batch.slice(first, SLICE)
        del batch
        pa.default_memory_pool().release_unused()
