"""A bounded memory of computed values."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """When the young generation is full it replaces the old one. Callers look up `young` themselves
    and call find() for what is not there. Keys longer than 64 are never kept."""

    def __init__(self, make: Callable, entries: int):
        self._make, self._entries = make, entries
        self.young: dict = {}
        self._old: dict = {}

    def find(self, key):
        found = self._old.get(key)
        if found is None:
            found = self._make(key)
        if len(key) <= 64:
            if len(self.young) >= self._entries:
                self._old = dict(self.young)
                self.young.clear()
            self.young[key] = found
        return found
