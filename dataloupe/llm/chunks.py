"""Texts cut at single spaces, and a bounded table of what each distinct piece stands for."""

from __future__ import annotations

from collections.abc import Callable

MOST_CHUNKS = 600_000
MOST_CHARS = 24_000_000


class ChunkTable:
    """Values of the chunks of a text, each distinct chunk computed once.

    ``cuts`` splits a text at those spaces that no token can span; the space itself belongs
    to the chunk that follows it. ``compute(chunks, first)`` gives the values of a list of
    chunks; ``first`` tells that they begin a text, so that no space stands before them.
    ``plain(chunk)`` is whether a piece between two spaces is a chunk by itself: texts made
    of such pieces are cut by ``str.split``, the others by ``cuts``.

    The table only saves work. When, after some texts, it holds ``most`` entries or ``MOST_CHARS``
    characters it is emptied, so its memory does not follow the vocabulary.
    """

    def __init__(
        self,
        compute: Callable[[list[str], bool], list],
        cuts: Callable[[str], list[str]],
        plain: Callable[[str], bool],
        most: int = MOST_CHUNKS,
    ):
        self.compute, self.cuts, self.plain = compute, cuts, plain
        self.most = most
        self.inner: dict[str, object] = {}
        self.odd: dict[str, object] = {}
        self.first: dict[str, object] = {}
        self.chars = 0

    def values(self, text: str) -> list:
        """One value per chunk, in order; none for an empty text."""
        return self.all_values([text])[0]

    def all_values(self, texts: list[str]) -> list[list]:
        """The values of several texts; their new chunks are computed together."""
        split = [t.split(" ") if t else [] for t in texts]
        inner, plain = self.inner, self.plain
        new: set[str] = set()
        tables = [inner] * len(texts)
        for i, pieces in enumerate(split):
            if not pieces:
                continue
            missing = [p for p in pieces[1:] if p not in inner]
            if all(map(plain, missing)) and plain(pieces[0]):
                new.update(missing)
            else:
                split[i], tables[i] = self.cuts(texts[i]), self.odd
        odd = (p for pieces, t in zip(split, tables) if t is self.odd for p in pieces[1:])
        self._learn(inner, new, False)
        self._learn(self.odd, {p for p in odd if p not in self.odd}, False)
        heads = {pieces[0] for pieces in split if pieces}
        self._learn(self.first, {p for p in heads if p not in self.first}, True)
        out = [
            [self.first[pieces[0]], *map(table.__getitem__, pieces[1:])] if pieces else []
            for pieces, table in zip(split, tables)
        ]
        self._forget()
        return out

    def _learn(self, table: dict, new: set[str], first: bool) -> None:
        if new:
            chunks = list(new)
            table.update(zip(chunks, self.compute(chunks, first), strict=True))
            self.chars += sum(map(len, chunks))

    def _forget(self) -> None:
        held = len(self.inner) + len(self.odd) + len(self.first)
        if held > self.most or self.chars > MOST_CHARS:
            self.clear()

    def clear(self) -> None:
        self.inner.clear(), self.odd.clear(), self.first.clear()
        self.chars = 0
