"""A text as a list of pieces, with an index of where the originals of patches occur.

A patch applies if its original occurs exactly once. Instead of searching and rewriting the whole
text for each, an automaton over the originals of a batch of patches notes in which piece each of
them starts; an edit changes one piece (or the few that it touches) and only the starts that can
reach into it are found anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa

PIECE = 4096  # characters of a piece at first


class PieceText:
    """The text, its pieces and, after `index`, the starts of each pattern by piece."""

    def __init__(self, text: str, size: int = PIECE):
        self.pieces = [text[at : at + size] for at in range(0, len(text), size)] or [""]
        self.applied = 0

    def text(self) -> str:
        return "".join(self.pieces)

    def index(self, patterns: Sequence[str]) -> None:
        """Find the starts of some different, non-empty patterns."""
        self._patterns = patterns
        self._longest = max(map(len, patterns))
        self._automaton = ahocorasick.Automaton()
        for number, pattern in enumerate(patterns):
            self._automaton.add_word(pattern, number)
        self._automaton.make_automaton()
        self._total = [0] * len(patterns)
        self._where: list[set[int]] = [set() for _ in patterns]
        self._starts: list[dict[int, list[int]]] = [{} for _ in self.pieces]
        for at in range(len(self.pieces)):
            self._scan(at)

    def _scan(self, at: int) -> None:
        """Note the patterns that start in a piece; they may end in later ones."""
        for number, starts in self._starts[at].items():
            self._total[number] -= len(starts)
            self._where[number].discard(at)
        piece, more, after = self.pieces[at], self._longest - 1, at + 1
        ahead = []
        while more > 0 and after < len(self.pieces):
            ahead.append(self.pieces[after][:more])
            more -= len(ahead[-1])
            after += 1
        found: dict[int, list[int]] = {}
        for end, number in self._automaton.iter(piece + "".join(ahead)):
            start = end + 1 - len(self._patterns[number])
            if start < len(piece):
                found.setdefault(number, []).append(start)
        for number, starts in found.items():
            self._total[number] += len(starts)
            self._where[number].add(at)
        self._starts[at] = found

    def only_place(self, number: int) -> tuple[int, int] | None:
        """Piece and offset of a pattern that occurs once; occurrences that overlap the first count with it."""
        total, length = self._total[number], len(self._patterns[number])
        if total == 0 or total > length:
            return None
        first = min(self._where[number])
        place = first, min(self._starts[first][number])
        if total > 1:
            last = max(self._where[number])
            between = sum(len(self.pieces[at]) for at in range(first, last))
            if between + max(self._starts[last][number]) - place[1] >= length:
                return None
        return place

    def replace(self, place: tuple[int, int], length: int, new: str) -> None:
        """Put `new` in the place of some characters."""
        at, offset = place
        piece = self.pieces[at]
        rest = length - (len(piece) - offset)
        self.pieces[at] = piece[:offset] + new + piece[offset + length :]
        last = at
        while rest > 0:
            last += 1
            cut = min(rest, len(self.pieces[last]))
            self.pieces[last] = self.pieces[last][cut:]
            rest -= cut
        # Patterns that start before the edit can reach into it.
        first, reach = at, self._longest - 1 - offset
        while reach > 0 and first > 0:
            first -= 1
            reach -= len(self.pieces[first])
        for changed in range(first, last + 1):
            self._scan(changed)

    def apply(self, patches: Sequence[tuple[str | None, str | None]]) -> None:
        """Apply `(original, fixed)` in order, each only where its original occurs exactly once by then."""
        numbers: dict[str, int] = {}
        for original, fixed in patches:
            if original and fixed is not None:
                numbers.setdefault(original, len(numbers))
        if not numbers:
            return
        self.index(list(numbers))
        for original, fixed in patches:
            if original and fixed is not None and (place := self.only_place(numbers[original])):
                self.replace(place, len(original), fixed)
                self.applied += 1


def patch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patched texts, from rows `(repo, path, text, original, fixed)` in order: a file's text, then its patches.

    Holds one file and one batch of patches, however many patches a file has.
    """
    names = ["repo", "path", "new_content", "n_applied"]
    key, texts = None, []

    def out() -> pa.RecordBatch:
        rows = [(*key, t.text(), t.applied) for t in texts]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names)

    for batch in batches:
        waiting: list[tuple] = []
        for repo, path, text, original, fixed in zip(*(c.to_pylist() for c in batch.columns)):
            if (repo, path) != key:
                for done in texts:
                    done.apply(waiting)
                if texts:
                    yield out()
                key, texts, waiting = (repo, path), [], []
            if text is not None:
                texts.append(PieceText(text))
            else:
                waiting.append((original, fixed))
        for done in texts:
            done.apply(waiting)
    if texts:
        yield out()
