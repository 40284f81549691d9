"""SentencePiece encoding and decoding with sampled segmentations.

The lattice of a text holds all ways to spell it by pieces of the vocabulary; no piece
crosses a blank, so it is the lattice of one part between blanks after another.
Perturbed A-star search over it draws segmentations without replacement (Gumbel
top-k): a node is the set of all segmentations that go on from the choices so far, its
priority the largest perturbed log-probability among them. The best child of a node
keeps the node's priority, so a whole path is expanded at once; its other children wait
in the queue.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, filterfalse, groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfcast.llm import common
from shelfcast.llm.tokens import BLANK

SAMPLES = 2
SEED = 17
# Choices of a row; others form one further choice, which leads to a row of their own.
LISTED = 6
WIDE = 8
# Rows and parts that are remembered before all of them go; bytes of text taken at once.
ROWS, PARTS, SLICE = 5 << 17, 250_000, 1 << 18
FIRST_RANK = 10
_PARTS = re.compile(r" *[^ ]+| +$")


class Grown:
    """A numpy array that takes appended rows."""

    def __init__(self, dtype: type, *shape: int):
        # memory that no row has touched yet costs nothing
        self.data, self.n = np.zeros((ROWS + ROWS // 4, *shape), dtype), 0

    def extend(self, rows) -> None:
        if (need := self.n + len(rows)) > len(self.data):
            more = np.zeros((max(need, len(self.data) * 3 // 2) - len(self.data), *self.data.shape[1:]), self.data.dtype)
            self.data = np.concatenate((self.data, more))
        self.data[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Cut:
    """Code points of texts one after another: the end of the text of each, the places at which texts start, hashes of stretches."""

    def __init__(self, texts: list[str]):
        self.points, lengths = _points("".join(texts)), np.array([len(t) for t in texts])
        n, ends = len(self.points), np.cumsum(lengths)
        self.end, self.starts = np.repeat(ends, lengths), ends - lengths
        self._total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.points * _powers(n, common.MULTIPLIER), dtype=np.uint64)))
        self._inverse = _powers(n, pow(int(common.MULTIPLIER), -1, 1 << 64))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the stretches from a to b."""
        return (self._total[b] - self._total[a]) * self._inverse[a]

    def ends(self) -> np.ndarray:
        """Hashes, none of them 0, of what is left of its text from each place on."""
        found = self.hashes(np.arange(len(self.points)), self.end)
        found[found == 0] = 1
        return found


class Spellings:
    """The lattices of parts between blanks, as choices one after another.

    A piece weighs the inverse of its rank in the vocabulary. The pieces that go on from
    a place of a part are the choices of its row, each with the chance that a spelling
    of the rest starts with it. What goes on from a place depends on the rest of its
    stretch alone, so equal ends of stretches have the same rows. An entry is a stretch
    that pieces spell, or the id of a piece outside the lattice (a byte), which has one
    choice.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.piece, self.weight, base = {}, {}, None
        for i in range(self.library.get_piece_size()):
            if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i):
                continue
            base = i if base is None else base
            self.piece[self.library.id_to_piece(i)] = i
            self.weight[i] = -float(np.log(i - base + FIRST_RANK))
        self.longest = max(map(len, self.piece), default=0)
        self._weights = np.full(self.library.get_piece_size(), -np.inf)
        self._weights[list(self.weight)] = list(self.weight.values())
        # by length: hashes of the pieces in rising order, their ids and code points
        self._pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._seen = np.zeros(1 << 20, bool)
        by_length: dict[int, list[str]] = {}
        for x in self.piece:
            by_length.setdefault(len(x), []).append(x)
        for n, found in sorted(by_length.items()):
            points = _points("".join(found)).reshape(-1, n)
            value = (points * _powers(n, common.MULTIPLIER)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(value)
            if (value[order][1:] == value[order][:-1]).any():
                raise ValueError("two pieces of one hash")
            self._pieces[n] = value[order], np.array([self.piece[x] for x in found])[order], points[order]
            self._seen[_slot(value)] = True
        self.gone, self.of = 0, []
        self.clear()

    def clear(self) -> None:
        """Drops all entries; later ones go on with their numbers."""
        self.gone += len(self.of)
        self.of: list[str | int] = []  # keys of the entries from number ``gone`` on
        self.start = Grown(np.int64)  # by entry
        # by row: chance of the listed choices up to each, above 1 from the last on; of all choices log chance, piece (or -1), next row (or -1)
        self.up_to, self.log_q = Grown(float, WIDE), Grown(float, LISTED + 1)
        self.ids, self.next = Grown(np.int32, LISTED + 1), Grown(np.int32, LISTED + 1)
        # by the first row of a place: log weight from it to the end, its code point, the row of the place after it (or -1)
        self.onward, self.point, self.after = Grown(float), Grown(np.uint32), Grown(np.int32)
        self._table(1 << 20)

    def _table(self, size: int) -> None:
        """An empty table of ends of stretches: a hash (or 0), and the first row of the place it begins at."""
        self._key, self._row = np.zeros(size, np.uint64), np.zeros(size, np.int32)

    def lattice(self, text: str) -> tuple[str, list[list[tuple[int, int]]], list[float]]:
        """Text, edges (end, id) by start, and log weight from each place to the end, of one stretch."""
        if not text:
            return text, [], [0.0]
        cut = Cut([text])
        a, b, ids = self._edges(cut, np.arange(len(cut.points)))
        onward = self._onward(cut, a, b, ids, np.arange(len(cut.points)), np.full(len(cut.points) + 1, -np.inf))
        edges: list[list[tuple[int, int]]] = [[] for _ in text]
        for i, j, e in sorted(zip(a.tolist(), b.tolist(), ids.tolist(), strict=True)):
            edges[i].append((j, e))
        return text, edges, [*onward[:-1].tolist(), 0.0]

    def _edges(self, cut: Cut, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces (start, end, id) that begin at the places ``at``, which rise.

        Substrings of each length are looked up by their hashes, all places at once.
        """
        points, end, found = cut.points, cut.end, []
        for size, (hashes, ids, spelled) in self._pieces.items():
            at = at[end[at] - at >= size]
            value = cut.hashes(at, at + size)
            maybe = self._seen[_slot(value)]
            a, value = at[maybe], value[maybe]
            which = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = np.flatnonzero(hashes[which] == value)
            a, which = a[hit], which[hit]
            same = (points[a[:, None] + np.arange(size)] == spelled[which]).all(axis=1)
            a, which = a[same], which[same]
            found.append((a, a + size, ids[which]))
        a, b, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(a, kind="stable")  # a few rising runs
        return a[order], b[order], ids[order]

    def _onward(self, cut: Cut, a: np.ndarray, b: np.ndarray, ids: np.ndarray, fresh: np.ndarray, onward: np.ndarray) -> np.ndarray:
        """The log weight from each place of ``fresh`` to the end of its text, set in ``onward``; (a, b, ids) are their edges."""
        count = np.bincount(a, minlength=len(onward))
        first = np.cumsum(count) - count
        weight, last = self._weights[ids], b == cut.end[a]
        # by the distance to the end: what goes on from a place is known before the place comes
        far = cut.end[fresh] - fresh
        order = np.argsort(far, kind="stable")
        for place in np.split(fresh[order], np.flatnonzero(np.diff(far[order])) + 1):
            sizes = count[place]
            if not sizes.all():
                place, sizes = place[sizes > 0], sizes[sizes > 0]
            starts = np.cumsum(sizes) - sizes
            i = np.repeat(first[place] - starts, sizes) + np.arange(int(sizes.sum()))
            onward[place] = _log_sums(weight[i] + np.where(last[i], 0.0, onward[b[i]]), starts, sizes)
        return onward

    def add(self, texts: list[str], pieces: list[int]) -> int:
        """Entries of distinct stretches and of pieces outside the lattice; the number of the first, the others follow."""
        number, n = self.gone + len(self.of), len(pieces)
        if texts:
            self.start.extend(self._add_texts(texts))
        if n:
            base = self.up_to.n
            log_q, ids = np.full((n, LISTED + 1), -np.inf), np.full((n, LISTED + 1), -1)
            log_q[:, 0], ids[:, 0] = 0.0, pieces
            following = np.full((n, LISTED + 1), -1)
            following[:, LISTED] = np.arange(base + 1, base + n + 1)
            self._extend(np.full((n, WIDE), 2.0), log_q, ids, following, np.zeros(n), np.zeros(n), np.full(n, -1))
            self.start.extend(np.arange(base, base + n))
        self.of += texts
        self.of += pieces
        return number

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Where each hash is in the table, which takes those that it has not."""
        if (self.up_to.n + len(key)) * 4 > len(self._key) * 3:
            self._table(1 << int((self.up_to.n + len(key)) * 2).bit_length())  # what was in it is not shared any more
        mask = len(self._key) - 1
        slots = (key * common.MULTIPLIER >> np.uint64(65 - len(self._key).bit_length())).astype(np.int64)
        left, at = np.arange(len(key)), slots
        while len(left):
            held = self._key[at]
            free = held == 0
            self._key[at[free]] = key[left[free]]
            passed = self._key[at] != key[left]
            left = left[passed]
            slots[left] = at = (at[passed] + 1) & mask
        return slots

    def _shared(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By place: its row if its end is known, else -1; the first place that has the same end; its
        slot; and whether the table may have it.

        Equal hashes count if the code points and the places after them agree, so by
        induction from the end the whole ends do. A text in which any do not, or that
        is like a place of such a text, has rows of its own.
        """
        n = len(cut.points)
        slots, like = self._slots(cut.ends()), np.arange(n)
        row = self._row[slots].astype(np.int64) - 1
        fresh, old = np.flatnonzero(row < 0), row >= 0
        self._row[slots[fresh[::-1]]] = fresh[::-1]  # of several writes the last holds
        like[fresh] = self._row[slots[fresh]]
        self._row[slots[fresh]] = 0
        # the place after each, as its row or (below -1) as the first place like it; -1 at the end of a text
        after = np.append(np.where(old, row, -2 - like)[1:], -1)
        after[cut.end - 1] = -1
        same = cut.points == np.where(old, self.point.data[row], cut.points[like])
        same &= after == np.where(old, self.after.data[row], after[like])
        own = np.zeros(n, bool)
        if not same.all():
            own = np.isin(cut.end, cut.end[~same])
            own = np.isin(cut.end, cut.end[own[like] & ~old | own])
            row[own], like[own] = -1, np.flatnonzero(own)
        return row, like, slots, ~own

    def _add_texts(self, texts: list[str]) -> np.ndarray:
        """The first row of each text; places whose ends have no rows yet get them."""
        cut = Cut(texts)
        known, like, slots, kept = self._shared(cut)
        base, n = self.up_to.n, len(cut.points)
        fresh = np.flatnonzero((known < 0) & (like == np.arange(n)))
        a, b, ids = self._edges(cut, fresh)
        last = b == cut.end[a]
        b = like[np.minimum(b, n - 1)]
        onward = np.append(np.where(known >= 0, self.onward.data[known], -np.inf), -np.inf)
        self._onward(cut, a, np.where(last, cut.end[a], b), ids, fresh, onward)
        ahead = np.where(last, 0.0, onward[b])
        live = ahead > -np.inf
        a, b, ids, last = a[live], b[live], ids[live], last[live]
        x = self._weights[ids] + ahead[live] - onward[a]
        count = np.bincount(a, minlength=n)
        before = np.cumsum(count) - count
        order = np.arange(len(a))
        for size in range(2, int(count.max(initial=0)) + 1):
            i = before[count == size][:, None] + np.arange(size)
            order[i] = np.take_along_axis(i, np.argsort(-x[i], axis=1, kind="stable"), axis=1)
        b, ids, last, x = b[order], ids[order], last[order], x[order]
        rows = np.zeros(n, np.int64)
        rows[fresh] = np.maximum(1, -(-count[fresh] // LISTED))
        first = np.cumsum(rows) - rows  # first row of a place, from the base
        number, slot = np.divmod(np.arange(len(a)) - before[a], LISTED)
        row, height = first[a] + number, int(rows.sum())
        whole = np.zeros(height)
        rest = np.full(height, -np.inf)
        # a place of many choices: the mass of each of its rows, with that of the rows that go on from it
        if (many := count[a] > LISTED).any():
            top = np.full(height, -np.inf)
            np.maximum.at(top, row[many], x[many])
            mass = np.zeros(height)
            np.add.at(mass, row[many], np.exp(x[many] - top[row[many]]))
            held = np.flatnonzero(mass)
            whole[held] = top[held] + np.log(mass[held])
            for k in range(int(number.max()) - 1, -1, -1):
                i = np.unique(row[many & (number == k) & (count[a] > (k + 1) * LISTED)])
                rest[i] = whole[i + 1]
                whole[i] = np.logaddexp(whole[i], whole[i + 1])
        x = x - whole[row]
        # the row of every place
        at = np.where(known >= 0, known, base + first[like])
        log_q, found = np.full((height, LISTED + 1), -np.inf), np.full((height, LISTED + 1), -1, np.int32)
        following, up_to = np.full((height, LISTED + 1), -1, np.int32), np.zeros((height, WIDE))
        cell = row * (LISTED + 1) + slot
        log_q.ravel()[cell], found.ravel()[cell] = x, ids
        following.ravel()[cell] = np.where(last, -1, at[b])
        following[:, LISTED] = np.arange(base + 1, base + height + 1)
        log_q[:, LISTED] = rest - whole
        chance = np.exp(x)
        # the last choice of a place takes what rounding leaves
        chance[np.arange(len(a)) == (before + count - 1)[a]] = 2.0
        up_to.ravel()[row * WIDE + slot] = chance
        np.cumsum(up_to[:, :LISTED], axis=1, out=up_to[:, :LISTED])
        up_to[:, LISTED:] = 2.0
        of_row = np.repeat(np.arange(n), rows)
        after = np.append(at[1:], -1)
        after[cut.end - 1] = -1
        self._extend(up_to, log_q, found, following, onward[of_row], cut.points[of_row], after[of_row])
        put = fresh[kept[fresh]]
        self._row[slots[put]] = at[put] + 1
        return at[cut.starts]

    def _extend(self, up_to: np.ndarray, log_q: np.ndarray, ids: np.ndarray, following: np.ndarray, *of_place: np.ndarray) -> None:
        for grown, found in zip(
            (self.up_to, self.log_q, self.ids, self.next, self.onward, self.point, self.after),
            (up_to, log_q, ids, following, *of_place),
            strict=True,
        ):
            grown.extend(found)

    def starts(self, entries: np.ndarray) -> np.ndarray:
        """The first row of each entry."""
        return self.start.data[entries - self.gone]

    def draw(self, row: int, without: dict, rng: np.random.Generator) -> int:
        """A choice that is not in ``without``, in proportion to its chance."""
        q = np.exp(self.log_q.data[row])
        q[list(without)] = 0.0
        up_to = np.cumsum(q)
        taken = int(np.searchsorted(up_to, rng.random() * up_to[-1], side="right"))
        return min(taken, int(np.flatnonzero(q)[-1]))

    def walk(self, rows: list[np.ndarray], rngs: list[np.random.Generator]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each search: choices from its rows to the end of their parts, one part after another, and the
        number of the part of each.

        A choice is numbered by its row and its place in it. All searches take their
        steps together, each with numbers of its own.
        """
        ends = np.cumsum([0, *map(len, rows)])
        rows, up_to, following = np.concatenate(rows), self.up_to.data, self.next.data.ravel()
        who, steps = np.arange(len(rows)), []
        size = np.zeros(len(rows), np.int64)
        while len(who):
            left, drawn = np.searchsorted(who, ends).tolist(), np.empty(len(who))
            for rng, a, b in zip(rngs, left, left[1:], strict=False):
                rng.random(out=drawn[a:b])
            passed = up_to.take(rows, axis=0) <= drawn[:, None]
            taken = np.bitwise_count(passed.view(np.uint64).ravel())  # eight truth values to a word
            steps.append((who, cells := rows * (LISTED + 1) + taken))
            size[who] += 1
            rows = following.take(cells)
            on = np.flatnonzero(rows >= 0)
            who, rows = who.take(on), rows.take(on).astype(np.int64)
        to = np.cumsum(size)
        at, out = to - size, np.zeros(int(size.sum()), np.int64)
        for t, (w, cells) in enumerate(steps):
            out[at.take(w) + t] = cells
        part, cut = np.repeat(np.arange(len(size)), size), np.append(0, to)[ends].tolist()
        return [(out[a:b], part[a:b] - first) for a, b, first in zip(cut, cut[1:], ends.tolist(), strict=False)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _slot(value: np.ndarray) -> np.ndarray:
    return (value * common.MULTIPLIER) >> np.uint64(44)


def _log_sums(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log of the sum of the exponentials of each group of neighbours."""
    if len(x) == len(starts):
        return x
    most = np.maximum.reduceat(x, starts)
    base = np.where(most == -np.inf, 0.0, most)
    with np.errstate(divide="ignore"):
        return base + np.log(np.add.reduceat(np.exp(x - np.repeat(base, sizes)), starts))


class Encoder(dict):
    """The entry of each part between blanks, or below 0 one less than the negative of its place in ``several``.

    The library merges each part once.
    """

    def __init__(self, spellings: Spellings):
        super().__init__()
        self.spellings, self.library = spellings, spellings.library
        self.several: list[list[int]] = []
        self.known = {x for x in spellings.piece if len(x) == 1}
        self.name = {i: x for x, i in spellings.piece.items()}.__getitem__
        self.blank = self.library.encode("a ")[len(self.library.encode("a")) :]

    def all_entries(self, texts: list[str]) -> list[np.ndarray]:
        """Entries of each text; blanks are plain ones. What is new to all texts is spelled at once."""
        if self.spellings.up_to.n > ROWS or len(self) > PARTS:
            self.forget()
        lists = [_split(text) for text in texts]
        parts = list(chain.from_iterable(lists))
        fresh = list(filterfalse(self.__contains__, set(parts)))
        self._add(fresh)
        found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        ends = np.cumsum([0, *map(len, lists)])
        if len(many := np.flatnonzero(found < 0)):
            lists = [self.several[-1 - i] for i in found[many].tolist()]
            size = np.ones(len(found), np.int64)
            size[many] = [len(x) for x in lists]
            to = np.cumsum(size)
            long, found = found < 0, np.repeat(found, size)
            found[np.repeat(long, size)] = list(chain.from_iterable(lists))
            ends = np.append(0, to)[ends]
        return [found[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def forget(self) -> None:
        self.spellings.clear()
        self.several.clear()
        self.clear()

    def entries(self, text: str) -> np.ndarray:
        return self.all_entries([text])[0]

    def _add(self, parts: list[str]) -> None:
        """A part of characters that are all pieces is one stretch, whatever the library merges in it, if the
        library leaves the characters of the parts as they are."""
        text = " ".join(parts)
        plain = self.library.normalize(text) == BLANK + text.replace(" ", BLANK)
        known, whole, others = self.known.issuperset, [], {}
        for part in parts:
            if plain and part and known(part):
                whole.append(part)
            else:
                others[part] = self._stretches(part)
        keys = dict.fromkeys(chain.from_iterable(others.values()))
        texts, pieces = [k for k in keys if isinstance(k, str)], [k for k in keys if not isinstance(k, str)]
        number = self.spellings.add([BLANK + part for part in whole] + texts, pieces)
        self.update(zip(whole, range(number, number + len(whole)), strict=True))
        of = {k: i for i, k in enumerate(texts + pieces, number + len(whole))}
        for part, found in others.items():
            self.several.append([of[k] for k in found])
            self[part] = -len(self.several)

    def _stretches(self, part: str) -> list[str | int]:
        """What the library makes of a part: stretches of pieces in the lattice, and pieces outside it."""
        out: list[str | int] = []
        ids = self.library.encode(part) if part else self.blank
        for plain, run in groupby(ids, self.spellings.weight.__contains__):
            out += ["".join(map(self.name, run))] if plain else run
        return out


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> Encoder:
    """One for all tasks of a process: its vocabulary takes most of a second to read."""
    return Encoder(Spellings(model))


def _split(text: str) -> list[str]:
    if not text:
        return []
    parts = text.split(" ")
    return [p[1:] for p in _PARTS.findall(" " + text)] if "" in parts else parts


@dataclass
class Segmentation:
    """One path: its choices, the entry that each belongs to, and their log chances."""

    cells: np.ndarray
    part: np.ndarray
    log_p: np.ndarray
    score: float

    def ids(self, s: Spellings) -> np.ndarray:
        found = s.ids.data.ravel().take(self.cells)
        return found[found >= 0]


@dataclass(order=True)
class Node:
    """Segmentations like ``before`` up to ``place`` but for the choices ``without`` there.

    late: log of the waiting time to the first of them; the perturbed score is its negative.
    """

    late: float
    number: int
    before: Segmentation | None = field(compare=False)
    place: int = field(compare=False)
    without: dict = field(compare=False)


Found = list[tuple[np.ndarray, float, float, float]]


def sample(entries: np.ndarray, s: Spellings, k: int, rng: np.random.Generator) -> Found:
    """What ``search`` finds for one text."""
    return sample_all([entries], s, k, [rng])[0]


def sample_all(entries: list[np.ndarray], s: Spellings, k: int, rngs: list[np.random.Generator]) -> list[Found]:
    """What ``search`` finds for each text, all of them walking at once."""
    searches = [search(x, s, k, rng) for x, rng in zip(entries, rngs, strict=True)]
    out: list[Found] = [[] for _ in searches]
    live = [(i, next(x)) for i, x in enumerate(searches)]
    while live:
        walked, asked = s.walk([rows for _, rows in live], [rngs[i] for i, _ in live]), []
        for (i, _), path in zip(live, walked, strict=True):
            try:
                asked.append((i, searches[i].send(path)))
            except StopIteration as end:
                out[i] = end.value
        live = asked
    return out


def search(entries: np.ndarray, s: Spellings, k: int, rng: np.random.Generator) -> Generator[np.ndarray, tuple[np.ndarray, np.ndarray], Found]:
    """Up to k distinct segmentations: ids, log-probability, perturbed score, log inclusion score.

    A Gumbel score is the negative log of an exponential waiting time. In a node the
    first to come is drawn by its chance; those beside it come after a further
    exponential time over their mass, whatever was drawn. So each choice needs one
    draw for itself and one for when those beside it come. The
    inclusion score is the log of the chance to be drawn, given the least time that
    is left out; it is 0 if nothing is left out. Yields rows to walk from.
    """
    starts, width = s.starts(entries), LISTED + 1
    queue, number, done = [Node(float(np.log(rng.standard_exponential())), 0, None, -1, {})], 1, []

    def wait(late: float, mass: float, path: Segmentation, place: int, without: dict) -> None:
        """mass: log of the chance of the node; late: log of the time that has passed."""
        nonlocal number
        late = float(np.logaddexp(late, np.log(rng.standard_exponential()) - mass))
        heapq.heappush(queue, Node(late, number, path, place, without))
        number += 1

    while queue and len(done) < k:
        node = heapq.heappop(queue)
        start, rows, first = node.place + 1, starts, 0
        if node.before is not None:
            at, before = node.place, node.before
            row = int(before.cells[at]) // width
            cell = row * width + s.draw(row, node.without, rng)
            onward, first = int(s.next.data.ravel()[cell]), int(before.part[at])
            rows = starts[first + 1 :]
            if onward >= 0:
                rows = np.concatenate(([onward], rows))
            else:
                first += 1
        cells, part = yield rows
        part = part + first
        if node.before is not None:
            cells = np.concatenate((before.cells[:at], [cell], cells))
            part = np.concatenate((before.part[: at + 1], part))
        path = Segmentation(cells, part, s.log_q.data.ravel().take(cells), -node.late)
        if node.before is not None:
            without = node.without | {cell % width: float(np.exp(path.log_p[at]))}
            if (left := 1 - sum(without.values())) > 1e-12:
                wait(node.late, float(path.log_p[:at].sum()) + np.log(left), path, at, without)
        done.append(path)
        if start == len(cells):
            continue
        left = -np.expm1(path.log_p[start:])
        beside = np.flatnonzero(left > 1e-12)
        lead = (np.cumsum(path.log_p) - path.log_p)[start:][beside]
        late = np.log(rng.standard_exponential(len(beside)) / left[beside]) - lead
        # no more than what is still to be drawn, and one, can leave the queue
        wanted = k - len(done) + 1
        for t in (np.argpartition(late, wanted)[:wanted] if len(late) > wanted else np.arange(len(late))).tolist():
            p = start + int(beside[t])
            taken = int(path.cells[p]) % width
            after = float(np.logaddexp(node.late, late[t]))
            heapq.heappush(queue, Node(after, number, path, p, {taken: float(np.exp(path.log_p[p]))}))
            number += 1
    kappa = -queue[0].late if queue else -np.inf
    out = []
    for path in done:
        log_p = float(path.log_p.sum())
        chance = -np.expm1(-np.exp(min(log_p - kappa, 700.0))) if np.isfinite(kappa) else 1.0
        # a tiny chance is its own first order
        inclusion = float(np.log(chance)) if chance > 0 else log_p - kappa
        out.append((path.ids(s), log_p, path.score, inclusion))
    return out


def sampled_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(doc_id, sample, ids, log_p, score, inclusion, decoded): up to k rows for every row of docs.

    model: path of a sentencepiece model, read on the driver. ids spell the whole
    text; decoded tells whether the library turns them back into it (with its own
    blank in place of U+2581). Samples of a document are distinct, in falling
    perturbed score; fewer than k if it has no more segmentations. The draw depends
    on doc_id, the seed and the text alone, so repeated rows give equal samples. A
    null doc_id counts as -1. Null and empty texts have one segmentation, without ids.
    """
    data = Path(model).read_bytes()
    common.small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data)
        encoder.forget()
        spellings = encoder.spellings
        for ids, texts in common.rows(batches, "doc_id", "text", bound=SLICE):
            out, texts = [], [(text or "").replace(BLANK, " ") for text in texts]
            rngs = [np.random.Generator(np.random.Philox(key=[seed, (-1 if d is None else d) & (1 << 64) - 1])) for d in ids]
            drawn = sample_all(encoder.all_entries(texts), spellings, k, rngs) if ids else []
            for d, text, paths in zip(ids, texts, drawn, strict=True):
                for i, (found, *numbers) in enumerate(paths):
                    decoded = spellings.library.decode(found.tolist()) == text
                    out.append((d, i, found, *numbers, decoded))
            d, i, found, log_p, score, inclusion, decoded = zip(*out, strict=True) if out else [[]] * 7
            lengths = np.concatenate((np.zeros(1, np.int32), np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = pa.array(common.concat(found, np.int32).astype(np.int32))
            yield pa.record_batch(
                [
                    pa.array(d, pa.int64()), pa.array(i, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(lengths), flat),
                    pa.array(log_p, pa.float64()), pa.array(score, pa.float64()), pa.array(inclusion, pa.float64()),
                    pa.array(decoded, pa.bool_()),
                ],
                names=["doc_id", "sample", "ids", "log_p", "score", "inclusion", "decoded"],
            )

    schema = "doc_id long, sample int, ids array<int>, log_p double, score double, inclusion double, decoded boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
