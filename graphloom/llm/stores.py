"""What a Python worker keeps from task to task: the stores of one operator at a time."""
from __future__ import annotations

import gc
from functools import lru_cache, wraps

_CACHES: list = []
_THRESHOLD = gc.get_threshold()


def kept(build):
    """``build`` with its last two results kept in the worker; other operators' are dropped before one is made."""
    @wraps(build)
    def made(*args):
        release(but=cache)
        return build(*args)

    cache = lru_cache(2)(made)
    _CACHES.append(cache)
    return cache


def release(but=None) -> None:
    """Drops what operators (but one) have kept in this worker, and lets the collector run as usual again.

    Workers are used by the next stages too: what an earlier stage kept would stand beside all that these need.
    """
    held = [c for c in _CACHES if c is not but and c.cache_info().currsize]
    for c in held:
        c.cache_clear()
    if held:
        gc.set_threshold(*_THRESHOLD)
        gc.unfreeze()
        gc.collect()
