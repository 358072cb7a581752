"""A bounded memo of what words map to: two generations, so frequent words stay and memory is bounded."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """memo[key] is make(key). Holds at most `size` recent keys and as many of the generation before."""

    def __init__(self, make: Callable, size: int = 400_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
