"""Suffix order with common prefixes by induced sorting in external memory.

The sorter scans suffixes in order and puts the suffix one byte before each into
the queue of its first byte: what comes out of the queues is sorted.  Queues keep
tuples (position, common prefix with the tuple before) and move them to disk when
they outgrow the memory given.  Only the text (one byte a suffix, a memory map when
it is large) is read at random.  The order of the suffixes that start the scan comes
from the same sorter, applied to the string of their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Common prefixes are counted up to this many bytes, more than any caller asks for.
MOST_PREFIX = 64
#: Tuples of one step, and tuples that all queues of a pass keep in memory.
CHUNK, IN_MEMORY = 1 << 18, 1 << 23
#: Suffixes that a step over names takes, about; a more frequent name has a step of its own.
_NAME_STEP = 1 << 12

Chunk = tuple[np.ndarray, np.ndarray]


class Queues:
    """First-in, first-out queues of (position, prefix), one per byte; popped from one end of the alphabet to the other."""

    def __init__(self, in_memory: int = IN_MEMORY) -> None:
        self.held: list[list] = [[] for _ in range(256)]
        self.limit, self.size, self.file = in_memory, 0, None

    def push(self, key: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.held[key].append((position, prefix))
        self.size += len(position)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Move everything that is held in memory to the disk, queue by queue."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.held:
            loose = [k for k, entry in enumerate(queue) if not isinstance(entry[0], int)]
            if loose:
                # what is in memory was pushed after what is on disk
                position, prefix = (np.concatenate([queue[k][i] for k in loose]) for i in (0, 1))
                del queue[loose[0] :]
                for at in range(0, len(position), CHUNK):
                    place = self.file.tell()
                    part = position[at : at + CHUNK]
                    self.file.write(part.tobytes())
                    self.file.write(prefix[at : at + CHUNK].tobytes())
                    queue.append((place, len(part)))
        self.size = 0

    def _read(self, place: int, size: int) -> Chunk:
        self.file.seek(place)
        return np.frombuffer(self.file.read(8 * size), np.int64), np.frombuffer(self.file.read(size), np.uint8)

    def pop_last(self, key: int) -> Chunk | None:
        """The tuples that were pushed last, None when the queue is empty."""
        if not self.held[key]:
            return None
        first, second = self.held[key].pop()
        if isinstance(first, int):
            return self._read(first, second)
        self.size -= len(first)
        return first, second

    def pop(self, key: int) -> Chunk | None:
        """The oldest tuples of a queue, None when it is empty."""
        queue = self.held[key]
        if not queue:
            return None
        if isinstance(queue[0][0], int):
            return self._read(*queue.pop(0))
        # small pushes together, up to a step's worth
        taken, size = 0, 0
        while taken < len(queue) and size < CHUNK:
            size += len(queue[taken][0])
            taken += 1
        parts = queue[:taken]
        del queue[:taken]
        self.size -= size
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of ``values[low..high]`` (both included) for each pair, by tables of doubling reach."""
    out = np.empty(len(low), np.uint8)
    reach = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table, k = values, 0
    while True:
        at = np.flatnonzero(reach == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        k += 1
        if not (reach >= k).any():
            return out
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])


def _induce(text: np.ndarray, flip: bool, seeds: Callable[[int], Iterator[Chunk]], prefixes: bool, queues: Queues) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """One pass: yields (byte, positions, prefixes, whether seeds) in scan order.

    ``flip`` scans from the last suffix to the first.  ``seeds(byte)`` gives the
    suffixes that are sorted already; they come after the induced ones of a byte.
    A prefix is the one shared with the tuple before, 0 at the first of a byte.
    """
    for step in range(256):
        byte = 255 - step if flip else step
        # smallest prefix seen since a byte last took a suffix; sources of different bytes share nothing
        since = np.zeros(256, np.uint8)
        last, met = None, False
        source: Iterator[Chunk] | None = None
        while True:
            chunk = queues.pop(byte) if source is None else next(source, None)
            if chunk is None:
                if source is not None:
                    break
                source = seeds(byte)
                continue
            position, prefix = chunk
            if not len(position):
                continue
            if prefixes and (last is None or (source is not None and not met)):
                # the first of a byte shares nothing; where induced ones and seeds meet, the text tells
                prefix = prefix.copy()
                prefix[0] = 0 if last is None else _common(text, position[:1], last)[0]
            last, met = position[-1:], source is not None
            yield byte, position, prefix, source is not None
            before = text[np.maximum(position - 1, 0)]
            goes = (before < byte) if flip else (before > byte)
            if source is None:
                goes |= before == byte
            goes &= position > 0
            index = np.flatnonzero(goes)
            if prefixes and not len(index):
                since = np.minimum(since, prefix.min())
                continue
            target = before[index]
            order = np.argsort(target, kind="stable")
            index, target = index[order], target[order]
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.empty(0, np.int64)
            if prefixes:
                low = np.empty_like(index)
                low[1:] = index[:-1] + 1
                low[first] = 0
                shared = _range_minimum(prefix, low, index)
                shared[first] = np.minimum(shared[first], since[target[first]])
                shared = np.minimum(shared, MOST_PREFIX - 1) + np.uint8(1)
                ends = np.concatenate([first[1:], [len(index)]]) - 1
                since = np.minimum(since, prefix.min())
                rest = np.full(len(ends), 255, np.uint8)
                more = index[ends] + 1 < len(prefix)
                rest[more] = _range_minimum(prefix, index[ends][more] + 1, np.full(int(more.sum()), len(prefix) - 1))
                since[target[first]] = rest
            else:
                shared = np.zeros(len(index), np.uint8)
            children = position[index] - 1
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(index)]):
                queues.push(int(target[a]), children[a:b], shared[a:b])


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one counts as such."""
    out = np.ones(len(text), bool)
    if len(text) > 1:
        # equal neighbours take the type of the end of their run
        place = np.where(text[:-1] != text[1:], np.arange(len(text) - 1), len(text) - 2)
        ends = np.minimum.accumulate(place[::-1])[::-1]
        out[:-1] = (text[:-1] < text[1:])[ends]
    return out


def _leftmost(small: np.ndarray) -> np.ndarray:
    """Positions of suffixes that are smaller than the next while the one before them is not."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _names(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names, in text order, of the pieces from each start to the next (included); ``ordered`` has the starts sorted by piece."""
    ends = np.concatenate([starts[1:], [starts[-1]]])
    number = np.empty(len(text), np.int32)
    number[starts] = np.arange(len(starts))
    number = number[ordered]
    length = (ends - starts + 1)[number]
    a, b = ordered[:-1], ordered[1:]
    same = length[:-1] == length[1:]
    left, offset = np.flatnonzero(same), 0
    while len(left):
        equal = text[a[left] + offset] == text[b[left] + offset]
        same[left[~equal]] = False
        offset += 1
        left = left[equal]
        left = left[length[left] > offset]
    names = np.empty(len(starts), np.int64)
    names[number] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _induce_names(text: np.ndarray, seeds: np.ndarray, flip: bool, kinds: int) -> np.ndarray:
    """One pass over a string of names in memory: the induced positions in scan order.

    A step takes a range of names at once.  What is induced within the range joins
    it, placed by the place of the suffix that induced it, until nothing new comes;
    a run of one name joins as a whole.  Within a name the order is: by how far a
    suffix lies inside its run, then by the place of the run's end.
    """
    own = ((kinds - 1 - text) if flip else text).astype(np.int32)
    counts = np.bincount(own, minlength=kinds)
    step_of = (np.cumsum(counts) - counts) // _NAME_STEP
    step_of = np.unique(step_of, return_inverse=True)[1]
    steps = int(step_of[-1]) + 1
    first_name = np.searchsorted(step_of, np.arange(steps + 1))
    run_start = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), np.arange(len(own)), 0))
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(steps)]
    seed_names = own[seeds]
    seed_at = np.searchsorted(step_of[seed_names], np.arange(steps + 1))
    out = []

    def named_before(position: np.ndarray) -> np.ndarray:
        before = own[np.maximum(position - 1, 0)]
        before[position == 0] = -1
        return before

    for step in range(steps):
        low, high = int(first_name[step]), int(first_name[step + 1])
        fixed = slice(int(seed_at[step]), int(seed_at[step + 1]))
        pushed = waiting[step]
        waiting[step] = []
        position = np.concatenate([*[p for p, _ in pushed], seeds[fixed]])
        name = np.concatenate([*[n for _, n in pushed], seed_names[fixed]])
        pending = len(position) - (fixed.stop - fixed.start)
        seed = np.arange(len(position)) >= pending
        key = np.concatenate([np.arange(pending), np.arange(len(position) - pending)])
        wave = np.zeros(len(position), np.int64)
        late = np.zeros(len(position), bool)
        parent = np.full(len(position), -1)
        before = named_before(position)
        fresh = np.arange(len(position))
        while True:
            # by name, seeds last, place in the run, induced here last, then by key: one number, as all are small
            number = (name.astype(np.int64) - low) * 2 + seed
            for values, size in ((wave, int(wave.max(initial=0)) + 1), (late, 2), (key, int(key.max(initial=0)) + 1)):
                number = number * size + values
            order = np.argsort(number)
            ahead, here = before[fresh], name[fresh]
            larger = fresh[(ahead > here) & (ahead < high)]
            ends = fresh[(ahead == here) & ~seed[fresh] & (wave[fresh] == 0)]
            if not len(larger) and not len(ends):
                break
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            length = position[ends] - run_start[position[ends]]
            inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + 1
            roots = np.repeat(ends, length)
            grown = np.concatenate([position[larger] - 1, position[roots] - inside])
            position = np.concatenate([position, grown])
            name = np.concatenate([name, before[larger], name[roots]])
            before = np.concatenate([before, named_before(grown)])
            parent = np.concatenate([parent, larger, roots])
            wave = np.concatenate([wave, np.zeros(len(larger), np.int64), inside])
            late = np.concatenate([late, np.ones(len(larger), bool), np.zeros(len(roots), bool)])
            seed = np.concatenate([seed, np.zeros(len(grown), bool)])
            key = np.concatenate([key, np.zeros(len(grown), np.int64)])
            born = np.flatnonzero(parent >= 0)
            key[born] = rank[parent[born]]
            fresh = np.arange(len(position) - len(grown), len(position))
        position, name, before = position[order], name[order], before[order]
        out.append(position[~seed[order]])
        place = np.flatnonzero(before >= high)
        target = step_of[before[place]]
        sort = np.argsort(target, kind="stable")
        place, target = place[sort], target[sort]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else []
        for a, b in zip(first, [*first[1:], len(place)]):
            waiting[target[a]].append((position[place[a:b]] - 1, before[place[a:b]]))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def order_names(text: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names 0, 1, ...; the last name is the only 0.  Recursive."""
    kinds = int(text.max()) + 1
    if kinds == len(text):
        out = np.empty(len(text), np.int64)
        out[text] = np.arange(len(text))
        return out
    small = _types(text)
    starts = _leftmost(small)
    end = np.array([len(text) - 1])

    def both(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = _induce_names(text, seeds, False, kinds)
        falling = _induce_names(text, large[::-1], True, kinds)
        return large, np.concatenate([end, falling[::-1]])

    rough = both(starts[np.argsort(text[starts], kind="stable")])[1]
    marked = np.zeros(len(text), bool)
    marked[starts] = True
    ordered = rough[marked[rough]]
    large, smaller = both(starts[order_names(_names(text, starts, ordered))])
    merged = np.concatenate([large, smaller])
    return merged[np.argsort(text[merged] * 2 + np.repeat([0, 1], [len(large), len(smaller)]), kind="stable")]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that suffixes ``a`` and ``b`` share, up to ``MOST_PREFIX``."""
    out = np.full(len(a), MOST_PREFIX, np.uint8)
    # eight bytes at a time; the only 0 ends the text, so no two suffixes agree beyond it
    left, offset, size = np.arange(len(a)), 0, len(text)
    whole = np.lib.stride_tricks.as_strided(text, (max(0, size - 7), 8), (1, 1)) if size >= 8 else None

    def word(place: np.ndarray) -> np.ndarray:
        if whole is None or place.max(initial=0) > size - 8:
            tail = np.minimum(place[:, None] + np.arange(8)[None, :], size - 1)
            return np.ascontiguousarray(text[tail]).view(np.uint64).ravel()
        return whole[place].view(np.uint64).ravel()

    while len(left) and offset < MOST_PREFIX:
        differs = word(a[left] + offset) ^ word(b[left] + offset)
        done = differs != 0
        bits = differs[done]
        lowest = np.frexp((bits & (~bits + np.uint64(1))).astype(np.float64))[1] - 1
        out[left[done]] = np.minimum(offset + (lowest >> 3), MOST_PREFIX)
        left = left[~done]
        offset += 8
    return out


def _by_byte(text: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> Callable[[int], Iterator[Chunk]]:
    """Seeds of each byte, in the order given."""
    bounds = np.searchsorted(text[position], np.arange(257))

    def seeds(byte: int) -> Iterator[Chunk]:
        for at in range(bounds[byte], bounds[byte + 1], CHUNK):
            part = slice(at, min(at + CHUNK, bounds[byte + 1]))
            yield position[part], prefix[part]

    return seeds


def sorted_suffixes(text: np.ndarray, in_memory: int = IN_MEMORY) -> Iterator[Chunk]:
    """Suffixes from the largest to the smallest, in chunks, each with the prefix that it shares with the one before.

    ``text`` is an array of bytes whose last one is 0 and the only 0; it may be a
    memory map.  Prefixes count up to ``MOST_PREFIX``.  The last suffix is left out.
    """
    small = _types(text)
    starts = _leftmost(small)
    if not len(starts) or starts[-1] != len(text) - 1:
        starts = np.append(starts, len(text) - 1)

    def two_passes(position: np.ndarray, prefix: np.ndarray, prefixes: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        # the larger-than-next suffixes go through a second set of queues, byte by byte, to be read backwards
        kept = Queues(in_memory)
        for byte, place, shared, seeded in _induce(text, False, _by_byte(text, position, prefix), prefixes, Queues(in_memory)):
            if not seeded:
                kept.push(byte, place, shared)

        def backwards(byte: int) -> Iterator[Chunk]:
            following = None
            while (chunk := kept.pop_last(byte)) is not None:
                place, shared = chunk
                # read backwards, a prefix belongs to the pair of a suffix and the one after it
                turned = np.empty_like(shared)
                turned[0] = 0 if following is None else following
                turned[1:] = shared[:0:-1]
                following = shared[0]
                yield place[::-1], turned

        yield from _induce(text, True, backwards, prefixes, Queues(in_memory))

    first = np.argsort(text[starts], kind="stable")
    marked = np.zeros(len(text), bool)
    marked[starts] = True
    rough = [place[marked[place]] for _, place, _, seeded in two_passes(starts[first], np.zeros(len(starts), np.uint8), False) if not seeded]
    ordered = np.concatenate([np.concatenate([*rough, starts[:0]])[::-1]])
    ordered = np.concatenate([[len(text) - 1], ordered[ordered != len(text) - 1]])
    ordered = starts[order_names(_names(text, starts, ordered))]
    shared = np.zeros(len(ordered), np.uint8)
    shared[1:] = _common(text, ordered[:-1], ordered[1:])
    for _, place, prefix, _ in two_passes(ordered, shared, True):
        yield place, prefix
