"""State of one key, read when it is needed and written once per micro-batch."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd


class Entries:
    """A typed map of the state store; what a batch adds, changes or removes is written by ``flush``."""

    def __init__(self, state) -> None:
        self.state, self.known, self.dirty = state, {}, set()

    def get(self, *key):
        if key not in self.known:
            self.known[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.known[key]

    def put(self, key: tuple, value: tuple | None, new: bool = False) -> None:
        """None removes.  A ``new`` key that goes again within the batch never reaches the store."""
        self.known[key] = value
        self.dirty.add((key, new) if (key, True) not in self.dirty else (key, True))

    def flush(self) -> None:
        for key, new in self.dirty:
            value = self.known[key]
            if value is not None:
                self.state.updateValue(key, value)
            elif not new and self.state.containsKey(key):
                self.state.removeKey(key)


#: Entries of a page, and pages held in memory at a time.
PAGE, HELD = 64, 16_384


class Numbered:
    """Entries 0, 1, 2, … in pages (page -> JSON); a page is read when needed, and written when it changed or too many are held."""

    def __init__(self, state, size: int) -> None:
        self.state, self.size, self.stored, self.pages, self.dirty = state, size, -(-size // PAGE), {}, set()

    def _page(self, number: int) -> list:
        if (page := self.pages.get(number)) is None:
            if len(self.pages) >= HELD:
                self.flush()
                self.pages.clear()
            known = self.state.getValue((number,)) if number < self.stored else None
            page = self.pages[number] = json.loads(known[0]) if known else []
        return page

    def get(self, i: int):
        return self._page(i // PAGE)[i % PAGE]

    def change(self, i: int) -> list:
        """The entry, to be changed before any other is asked for."""
        entry = self._page(i // PAGE)[i % PAGE]
        self.dirty.add(i // PAGE)
        return entry

    def put(self, i: int, entry) -> None:
        page = self._page(i // PAGE)
        page.extend([None] * (i % PAGE + 1 - len(page)))
        page[i % PAGE] = entry
        self.dirty.add(i // PAGE)
        self.size = max(self.size, i + 1)

    def add(self, entry) -> int:
        self.put(self.size, entry)
        return self.size - 1

    def flush(self) -> None:
        for number in self.dirty:
            self.state.updateValue((number,), (json.dumps(self.pages[number]),))
            self.stored = max(self.stored, number + 1)
        self.dirty.clear()


class Named:
    """Entries by name (None is one too) in pages by the name's hash; the pages double in number as the names do."""

    def __init__(self, state, size: int) -> None:
        self.state, self.size, self.known, self.read, self.dirty = state, size, {}, set(), set()
        self.count = self._fitting(size)

    @staticmethod
    def _fitting(size: int) -> int:
        return 1 << max(0, size // (PAGE // 2)).bit_length() if size else 0

    def _of(self, name: str | None, count: int) -> int:
        return zlib.crc32((name or "").encode()) % count

    def _read(self, number: int) -> None:
        if number not in self.read:
            self.read.add(number)
            if (stored := self.state.getValue((number,))) is not None:
                for name, entry in json.loads(stored[0]):
                    self.known.setdefault(name, entry)

    def get(self, name: str | None):
        if name not in self.known and self.count:
            self._read(self._of(name, self.count))
        return self.known.get(name)

    def put(self, name: str | None, entry) -> None:
        self.get(name)  # its page is then known whole
        self.size += name not in self.known
        self.known[name] = entry
        self.dirty.add(name)

    def flush(self) -> None:
        """Writes the pages of changed names; all, when there are more pages now."""
        count = self._fitting(self.size)
        if count != self.count:
            for number in range(self.count):
                self._read(number)
            changed = None
        else:
            changed = {self._of(name, count) for name in self.dirty}
        page_of = lambda name: self._of(name, count)
        names = self.known if changed is None else (name for name in self.known if page_of(name) in changed)
        for number, held in groupby(sorted(names, key=page_of), page_of):
            self.state.updateValue((number,), (json.dumps([(name, self.known[name]) for name in held]),))
        self.count = count
        self.dirty.clear()


def ordered_rows(batches: Iterator[pd.DataFrame], order: list[str]):
    """Rows of one key and micro-batch in order."""
    return pd.concat(list(batches)).sort_values(order).itertuples(index=False)


def frame(rows: list[tuple], schema: str, fix: Callable[[pd.DataFrame], pd.DataFrame] = lambda x: x) -> pd.DataFrame:
    return fix(pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]))
