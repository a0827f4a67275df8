"""Names of one axis: positions by name and names by position, built once and not carried by data."""

from __future__ import annotations


class Names:
    def __init__(self, names) -> None:
        self._names = tuple(names)
        self._index = {n: i for i, n in enumerate(self._names)}
        if len(self._index) != len(self._names):
            raise ValueError("names must be unique")

    def __len__(self) -> int:
        return len(self._names)

    def __iter__(self):
        return iter(self._names)

    def __contains__(self, name) -> bool:
        return name in self._index

    def index(self, name) -> int:
        return self._index[name]

    def try_index(self, name) -> int | None:
        return self._index.get(name)

    def indices(self, names) -> list[int]:
        return [self._index[n] for n in names]

    def name(self, i: int) -> str:
        return self._names[i]

    def select(self, names) -> Names:
        return Names(n for n in names if self.index(n) >= 0)

    def concat(self, other: Names) -> Names:
        return Names([*self, *other])
