"""What a service does, as lines of JSON on its standard error."""

from __future__ import annotations

import datetime as dt
import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger(__name__)


def line(event: str, **fields) -> None:
    log.info(json.dumps({"at": dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds"), "event": event} | fields, default=str))


@contextmanager
def timed(event: str, **fields) -> Iterator[dict]:
    """One line when the block ends, with its milliseconds, what the block added to the yielded dict and, if it raised, the error."""
    began = time.perf_counter()
    try:
        yield fields
    except BaseException as error:
        fields["error"] = type(error).__name__
        raise
    finally:
        line(event, ms=round(1000 * (time.perf_counter() - began), 2), **fields)


def to_stderr() -> None:
    """Lines are shown only after this; called again, it changes nothing."""
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
