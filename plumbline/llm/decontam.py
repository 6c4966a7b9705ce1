"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Texts become lower-case words without ASCII punctuation. The CGK walk reads a
word sequence from a start: at step j it outputs the word under it, then moves on
by a random bit of (j, word). Two sequences at small edit distance fall into step
again after each edit, so their outputs differ in few places (small Hamming
distance). A hash samples COORDS places of the first STEPS outputs; REPEATS hashes
use independent walks. Every position of an item is hashed, and every position of
every document is looked up, so a leak is found unless each of its stretches of
about STEPS / 2 words is edited. Every place a lookup can only fail is left at once:
the sampled outputs so far must start some item's key.

Edits spread over all words are found by a second search over characters (class
Seeds): a seed is two stretches of ``half`` characters with at most one edit between
them. The number of seeds asked of an item follows from the tolerance and TARGET, for
edits at random places. An item too short for seeds is cut into one piece more than it
may have edits; one of them is whole in any leak, so its pieces lose nothing.

Repetitive texts: a key that an item holds many times is kept once, with the range of
its places, so what is expanded grows with the text and not with the product of
repeats; hits are counted in cells before they are sorted; long texts are searched
in stretches that overlap by the longest item.

A hit lines the item up with a document window of the item's size; the window,
widened by the permitted edits, is then checked with the exact edit distance of
characters (best place of the whole item inside it).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .session import cut, ready

STEPS, COORDS, REPEATS = 16, 9, 4
#: A walk of STEPS outputs may leave an item of fewer words; such items are hashed as whole windows of exactly their size
#: (twice as many steps as words). All items are sought by seeds too, whatever their size.
SHORT = 12
#: Benchmark text that one pass over the documents may carry to every task; larger benchmarks take several passes.
BLOCK_BYTES = 1 << 19
#: Share of items to find that have as many edits as are permitted, at random places.
TARGET = 0.95
#: Items of up to so many characters are sought by whole pieces.
PIECES = 11
#: Characters in each half of a seed, for items of up to so many characters.
HALVES = ((3, 39), (4, 1 << 40))
#: A key that an item holds more often than this, and more often than once in so many characters, stands for a range of places.
OFTEN, DENSE = 8, 100
#: Characters that are searched at once, and hits that are expanded at once (a stretch is halved until it has fewer, as long as it is longer than its overlaps).
STRETCH, HITS = 1 << 18, 1 << 21
#: Bytes of text that are searched at once (or one longer text): what a task holds besides follows from it.
SLICE = 1 << 18
#: Document windows that are compared with items at once, and numbers that characters are told apart by.
WINDOWS, SYMBOLS = 4096, 64
_DROP = np.zeros(256, bool)
_DROP[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _coordinates(repeat: int, steps: int, coords: int) -> list[int]:
    rng = np.random.default_rng([23, repeat, steps])
    return sorted(rng.choice(steps, min(coords, steps), replace=False).tolist())


def normal_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without punctuation in lower case, word starts and ends in them, and words per row."""
    keep = ~_DROP[raw]
    kept = np.concatenate(([0], np.cumsum(keep)))
    low = K.LOWER[raw[keep]]
    return low, *K.words(low, kept[offsets])


def padded(hashes: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with ``pad`` zeros after each row, and the place of every word in them."""
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * pad, counts)
    out = np.zeros(len(hashes) + pad * len(counts) + 1, np.uint64)
    out[place] = hashes
    return out, place


def walk(words: np.ndarray, starts: np.ndarray, repeat: int, coords: list[int], admit: list[np.ndarray] | None, size: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys of sampled CGK outputs from each start: (starts, last positions, keys, keys after each coordinate).

    With ``admit``, starts whose key so far is in none of its tables are left. With
    ``size``, words from start + size on count as padding (0).
    """
    pos, key, step, trail = starts.copy(), np.zeros(len(starts), np.uint64), 0, []
    begin = starts
    for level, c in enumerate(coords):
        while step < c:
            here = words[pos]
            move = (here >> K.U64((step + STEPS * repeat) % 64)) & K.U64(1)
            if size is not None:
                move = np.where(pos < begin + size, move, K.U64(0))
            pos = pos + move.astype(np.int64)
            step += 1
        here = words[pos]
        if size is not None:
            here = np.where(pos < begin + size, here, K.U64(0))
        key = (key ^ here) * K.U64(0x9E3779B97F4A7C15)
        key ^= key >> K.U64(32)
        if admit is not None:
            ok = np.flatnonzero(admit[level][(key & K.U64(len(admit[level]) - 1)).astype(np.int64)])
            begin, pos, key = begin[ok], pos[ok], key[ok]
        trail.append(key)
    return begin, pos, key, trail


class Index:
    """The keys of all positions of all items of a block."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        raw, offs = K.buffer_of(pa.array([t for _, t in items], pa.string()))
        low, starts, ends, counts = normal_words(raw, offs)
        hashes = K.span_hash(low, starts, ends)
        text, at = low.tobytes(), np.concatenate(([0], np.cumsum(counts)))
        self.at = at
        self.words = [[text[starts[w] : ends[w]].decode("utf-8", "replace") for w in range(at[i], at[i + 1])] for i in range(len(items))]
        self.patterns = [" ".join(w) for w in self.words]
        self.seeds: dict[float, Seeds] = {}
        seq, place = padded(hashes, counts, 3 * STEPS)
        row = np.repeat(np.arange(len(items)), counts)
        self.tables = []
        sizes = sorted({int(n) for n in counts if 0 < n < SHORT})
        for size in [None, *sizes]:
            steps = STEPS if size is None else 2 * size
            own = counts[row] >= SHORT if size is None else (counts[row] == size) & (np.arange(len(row)) == at[row])
            if not own.any():
                continue
            for repeat in range(REPEATS):
                coords = _coordinates(repeat, steps, COORDS)
                begin, last, key, trail = walk(seq, place[own], repeat, coords, None, size)
                inside = np.ones(len(begin), bool) if size is not None else last < place[at[row[own]]] + counts[row[own]]
                admit = []
                room = 1 << max(10, min(24, (32 * int(inside.sum())).bit_length()))
                for level in trail:
                    bits = np.zeros(room, bool)
                    bits[(level[inside] & K.U64(room - 1)).astype(np.int64)] = True
                    admit.append(bits)
                self.tables.append((size, repeat, coords, admit, *_ranges(key[inside], row[own][inside], begin[inside] - place[at[row[own][inside]]])))

    def candidates(self, seq: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(start in seq, item, first and last offset in the item) of every key that meets an item's, in bounded parts."""
        for size, repeat, coords, admit, keys, rows, first, last in self.tables:
            begin, _, key, _ = walk(seq, place, repeat, coords, admit, size)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            met = np.flatnonzero(hi > lo)
            for part in _bounded(met, (hi - lo)[met]):
                at, own = _expanded(lo[part], (hi - lo)[part])
                yield begin[part][own], rows[at], first[at], last[at]


def _ranges(key: np.ndarray, row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, one row for each key and item: (key, item, first offset, last offset)."""
    order = np.lexsort((offset, row, key))
    key, row, offset = key[order], row[order], offset[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return key[at], row[at], offset[at], offset[np.append(at[1:], len(key)) - 1] if len(at) else offset


def _bounded(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in parts whose sizes add up to about HITS at most (or one row)."""
    total, i = np.concatenate(([0], np.cumsum(sizes))), 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
        yield rows[i:j]
        i = j


def _expanded(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo, lo + 1 ... of n each, and which row each is from."""
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - (np.cumsum(n) - n - lo)[own], own


def characters(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with one space after each, and the place of every word's first."""
    change = np.zeros(len(low) + 1, np.int8)
    change[starts] = 1
    change[ends] -= 1
    solid = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    points = np.frombuffer(low[kept].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum(kept & (low & 0xC0 != 0x80))))
    return points, before[starts]


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` (up to 4) characters."""
    n = max(0, len(points) - size + 1)
    short = (points & 0xFFFF).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out |= short[i : i + n] << K.U64(16 * i)
    out *= K.U64(0x9E3779B97F4A7C15)
    return out ^ out >> K.U64(32)


def _pairs(runs: np.ndarray, gap: int) -> np.ndarray:
    n = max(0, len(runs) - gap)
    return (runs[:n] ^ runs[gap:] * K.U64(0xD6E8FEB86659FD93)) * K.U64(0x9E3779B97F4A7C15)


def seeds_asked(length: int, half: int, tolerance: float) -> int:
    """Seeds that an item of ``length`` characters keeps with chance TARGET at the most edits (a third of the mean at most)."""
    mean = (1 - tolerance) ** (2 * half) * (1 + tolerance) * length
    return max(1, int(min(mean - NormalDist().inv_cdf(TARGET) * sqrt(max(mean, 0) * half), mean / 3)))


class Seeds:
    """Places of items in documents by seeds of characters, whatever the words.

    A seed is a run of ``half`` characters and another that starts ``half`` or
    ``half`` + 1 later, on both sides: equal, substituted, inserted and deleted
    characters between the halves all meet. Hits of an item whose diagonals differ by
    the permitted edits at most are counted together. A window is then left if the
    edits of the item's pieces, each at its best place nearby, add up to more than is
    permitted: no text has fewer edits to the whole item, so this loses nothing.
    """

    def __init__(self, patterns: list[str], tolerance: float) -> None:
        self.length = np.array([len(p) for p in patterns], np.int64)
        self.most = (self.length * tolerance).astype(np.int64)
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in patterns]
        self.pieces = -(-self.length // 64)
        self.base = np.cumsum(self.pieces) - self.pieces
        self.equal = np.zeros((int(self.pieces.sum()), SYMBOLS), np.uint64)
        for x, n, base in zip(points, self.pieces.tolist(), self.base.tolist(), strict=True):
            piece = np.arange(len(x)) * n // max(1, len(x))
            place = np.arange(len(x)) - np.searchsorted(piece, piece)
            np.bitwise_or.at(self.equal, (base + piece, x % SYMBOLS), K.U64(1) << place.astype(np.uint64))
        self.classes = []
        shortest = PIECES
        for half, longest in HALVES:
            own = np.flatnonzero((self.length > shortest) & (self.length <= longest)).tolist()
            asked = np.array([seeds_asked(int(n), half, tolerance) for n in self.length], np.int64)
            rows = []
            for i in own:
                runs = grams(points[i], half)
                rows += [(i, pairs, np.arange(len(pairs))) for pairs in (_pairs(runs, gap) for gap in (half, half + 1))]
            self._add([(half, half), (half, half + 1)], rows, asked, 2 * half + 1)
            shortest = longest
        once = np.ones(len(patterns), np.int64)
        for size in (1, 2, 3, 4):  # pieces: of the longer ones, their beginnings
            rows = []
            for i in np.flatnonzero((self.length > 0) & (self.length <= PIECES)).tolist():
                cuts = np.arange(self.most[i] + 2) * self.length[i] // (self.most[i] + 1)
                at = np.array([a for a, b in pairwise(cuts.tolist()) if min(4, b - a) == size], np.int64)
                rows.append((i, grams(points[i], size)[at], at))
            self._add([(size, 0)], rows, once, size)

    def _add(self, kinds: list[tuple[int, int]], rows: list[tuple[int, np.ndarray, np.ndarray]], asked: np.ndarray, span: int) -> None:
        """A table of keys: (item, keys, offsets) of its items. Keys that an item repeats often go into a second one."""
        if not sum(len(k) for _, k, _ in rows):
            return
        key = np.concatenate([k for _, k, _ in rows])
        offset = np.concatenate([o for _, _, o in rows]).astype(np.int64)
        item = np.repeat(np.array([i for i, _, _ in rows], np.int64), [len(k) for _, k, _ in rows])
        order = np.lexsort((item, key))
        key, item, offset = key[order], item[order], offset[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        group = np.cumsum(new) - 1
        times = np.bincount(group)[group]
        often = times > np.maximum(OFTEN, self.length[item] // DENSE)
        shift = 64 - min(26, max(16, int(len(key) * 16).bit_length()))
        bits = np.zeros(1 << 64 - shift, bool)
        bits[(key >> K.U64(shift)).astype(np.int64)] = True
        tables = []
        for mine in (~often, often):
            k, i, o = key[mine], item[mine], offset[mine]
            if mine is often:  # one row for each cell of offsets
                cell = o // self._cell(i)
                k, i, cell = (np.array(x) for x in zip(*sorted(set(zip(k.tolist(), i.tolist(), cell.tolist(), strict=True))), strict=True)) if len(k) else (k, i, cell)
                k, o = k.astype(np.uint64), cell
            own, runs = np.unique(k, return_counts=True)
            tables.append((own, np.cumsum(runs) - runs, runs, i, o))
        self.classes.append((kinds, shift, bits, tables, asked, span))

    def _cell(self, item: np.ndarray) -> np.ndarray:
        """Width of the cells of offsets of items that repeat themselves."""
        return np.maximum(8, self.most[item] + 1)

    def windows(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, place of a hit, lowest and highest first place of the item by the hits) of all windows that may hold an item; ``rows`` are the places where texts start.

        The hits of a window lie within the item's length and edits, so stretches that overlap by that lose none.
        """
        found = [(np.zeros(0, np.int64),) * 4]
        for kind in self.classes:
            lap = int((self.length + 2 * self.most).max(initial=0)) + kind[5]
            todo = [(a, min(a + STRETCH + lap, len(points))) for a in range(0, len(points), STRETCH)]
            while todo:
                a, b = todo.pop()
                part = self._stretch(kind, points, a, b, rows, b - a > 4 * lap)
                if part is None:
                    middle = (a + b) // 2
                    todo += [(a, middle + lap), (middle, b)]
                else:
                    found += part
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _stretch(self, kind: tuple, points: np.ndarray, a: int, b: int, rows: np.ndarray, may_halve: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None:
        """Windows of the hits in points[a:b]; None where they are too many at once."""
        kinds, shift, bits, (usual, often), asked, _ = kind
        met, many = [], []
        mine = grams(points[a:b], kinds[0][0])
        for _, gap in kinds:
            key = _pairs(mine, gap) if gap else mine
            place = np.flatnonzero(bits[(key >> K.U64(shift)).astype(np.int64)])
            key, place = key[place], place + a
            for (keys, begins, sizes, _, _), out in ((usual, met), (often, many)):
                if len(keys):
                    slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    same = np.flatnonzero(keys[slot] == key)
                    out.append((slot[same], place[same], begins[slot[same]], sizes[slot[same]]))
        if may_halve and sum(int(n.sum()) for *_, n in met) > HITS:
            return None
        out = []
        if met:
            slot, place, lo, n = (np.concatenate(x) for x in zip(*met, strict=True))
            at, own = _expanded(lo, n)
            item, place = usual[3][at], place[own]
            first = place - usual[4][at]
            ok = self._crowded(item, first, asked)
            out.append(self._grouped(item[ok], first[ok], place[ok], asked, points, rows))
        for slot, place, _, _ in many:
            out += self._repeated(often, slot, place, points, rows)
        return out

    def _crowded(self, item: np.ndarray, first: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Hits whose cell of diagonals holds, with the next or the last cell, as many as their item is asked for; cells may share a counter."""
        if not len(item):
            return item
        width = self.most[item] + 1
        room = 1 << max(10, min(20, int(len(item)).bit_length()))
        cell = (first + (1 << 30)) // width + item * 0x9E3779B1 & room - 1
        count = np.bincount(cell, minlength=room).astype(np.int32)
        most = count.copy()  # with the fuller of the two cells beside it
        most[:-1], most[-1] = np.maximum(count[1:], np.concatenate((count[-1:], count[:-2]))), max(count[0], count[-2])
        return np.flatnonzero((count + most)[cell] >= asked[item])

    def _repeated(self, table: tuple, slot: np.ndarray, place: np.ndarray, points: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of items that repeat themselves: every cell of 16 places against every cell of offsets, without a count."""
        _, begins, sizes, items, cells = table
        row = np.searchsorted(rows, place, "right")
        order = np.lexsort((place, slot))
        slot, place, row = slot[order], place[order], row[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (place[1:] >> 4 != place[:-1] >> 4) | (row[1:] != row[:-1])
        slot, place, row = slot[new], place[new], row[new]
        out = []
        for part in _bounded(np.arange(len(slot)), sizes[slot]):
            at, own = _expanded(begins[slot[part]], sizes[slot[part]])
            item, here = items[at], place[part][own]
            wide = self._cell(item)
            low, high = (here & ~15) - (cells[at] + 1) * wide + 1, (here | 15) - cells[at] * wide
            near = low // np.maximum(64, wide)
            order = np.lexsort((near, row[part][own], item))
            same = np.ones(len(order) + 1, bool)
            i, r, b = item[order], row[part][own][order], near[order]
            same[1:-1] = (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (b[1:] != b[:-1])
            start = np.flatnonzero(same)[:-1]
            if len(start):
                out.append(self._alike(points, i[start], here[order][start], np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start)))
        return out

    def _grouped(self, item: np.ndarray, first: np.ndarray, place: np.ndarray, asked: np.ndarray, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of enough hits, of those that may hold their item."""
        order = np.lexsort((place, first, item))
        item, first, place = item[order], first[order], place[order]
        room = int(first.max(initial=0) - first.min(initial=0)) + int(self.most.max(initial=0)) + 2
        line = item * room + (first - first.min(initial=0))
        end = np.searchsorted(line, line + self.most[item], "right")
        enough = end - np.arange(len(line)) >= asked[item]
        # every diagonal within reach of a group that is large enough
        ahead = np.maximum.accumulate(np.where(enough, line + self.most[item], -1)) if len(line) else line
        ok = np.flatnonzero(line <= ahead)
        item, place, first = item[ok], place[ok], first[ok]
        bucket = first // (self.most[item] + 1)
        new = np.ones(len(item), bool)
        row = np.searchsorted(rows, place, "right")
        new[1:] = (item[1:] != item[:-1]) | (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        return self._alike(points, item[at], place[at], first[at], first[np.append(at[1:], len(item))[: len(at)] - 1])

    def _alike(self, points: np.ndarray, item: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        reach = int((self.length + 3 * self.most).max(initial=0)) + 64
        symbols = np.pad((points % SYMBOLS).astype(np.int64), reach)  # more text never adds edits
        edits = np.zeros(len(item), np.int64)
        span = -(-self.length[item] // np.maximum(1, self.pieces[item])) + 2 * self.most[item] + high - low
        order = np.argsort(span, kind="stable")  # windows that are searched together are about as wide
        for i in range(0, len(order), WINDOWS):
            part, n = order[i : i + WINDOWS], 0
            while True:
                part = part[(self.pieces[item[part]] > n) & (edits[part] <= self.most[item[part]])]
                if not len(part):
                    break
                k = item[part]
                begin, end = -(-n * self.length[k] // self.pieces[k]), -(-(n + 1) * self.length[k] // self.pieces[k])
                lo = low[part] + begin - self.most[k] + reach
                wide = int((high[part] + end + self.most[k] + reach - lo).max())
                edits[part] += self._least_edits(symbols, self.base[k] + n, end - begin, lo, wide)
                n += 1
        ok = np.flatnonzero(edits <= self.most[item])
        return item[ok], place[ok], low[ok], high[ok]

    def _least_edits(self, symbols: np.ndarray, piece: np.ndarray, size: np.ndarray, lo: np.ndarray, wide: int) -> np.ndarray:
        """Smallest edit distance of each piece to any part of its window, as ``best_place`` (symbols that share a number count as equal)."""
        table, row, top = self.equal.reshape(-1), piece * SYMBOLS, (size - 1).astype(np.uint64)
        up, down, one = np.full(len(piece), ~K.U64(0)), np.zeros(len(piece), np.uint64), K.U64(1)
        score = size.copy()
        best = size.copy()
        for j in range(wide):
            eq = table[row + symbols[j:][lo]]
            diagonal = eq & up
            diagonal += up
            diagonal ^= up
            diagonal |= eq
            eq |= down
            plus = diagonal | up
            np.invert(plus, out=plus)
            plus |= down
            diagonal &= up
            score += (plus >> top & one).view(np.int64)
            score -= (diagonal >> top & one).view(np.int64)
            np.minimum(best, score, out=best)
            plus <<= one
            diagonal <<= one
            np.bitwise_or(eq, plus, out=up)
            np.invert(up, out=up)
            up |= diagonal
            down = plus & eq
        return best


def best_place(pattern: str, text: str) -> int:
    """Smallest edit distance of the whole pattern to any part of the text (bit-parallel)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        if score < best:
            best = score
            if not best:
                break
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
    return best


def _regions(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(document, item, its stretches of words without overlaps) of windows that may overlap."""
    some = np.flatnonzero(hi > lo)
    order = some[np.lexsort((lo[some], item[some], doc[some]))]
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    if not len(doc):
        return
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    pair = np.cumsum(new) - 1
    room = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + pair * room)  # a later pair lies beyond all earlier ones
    start = new.copy()
    start[1:] |= lo[1:] + pair[1:] * room > reach[:-1]
    at = np.flatnonzero(start)
    ends = np.maximum.reduceat(hi, at)
    pair_of = pair[at]
    first = np.flatnonzero(np.diff(pair_of, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        yield int(doc[at[a]]), int(item[at[a]]), list(zip(lo[at[a:b]].tolist(), ends[a:b].tolist(), strict=True))


def find_items(texts: pa.Array, index: Index, tolerance: float) -> dict[str, list]:
    """Row number, item, fewest edits, similarity and first word of every item found in a batch of texts."""
    out: dict[str, list] = {"row": [], "item_id": [], "edits": [], "similarity": [], "first_word": []}
    raw, offs = K.buffer_of(texts)
    seeds = index.seeds.get(tolerance)
    if seeds is None:
        seeds = index.seeds[tolerance] = Seeds(index.patterns, tolerance)
    for i, j in K.slices(offs, SLICE):
        low, starts, ends, counts = normal_words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        seq, place = padded(K.span_hash(low, starts, ends), counts, 3 * STEPS)
        at = np.concatenate(([0], np.cumsum(counts)))
        lined = [(np.zeros(0, np.int64),) * 4]
        sizes = np.diff(index.at)
        for begin, item, first, last in index.candidates(seq, place):
            word = np.searchsorted(place, begin)
            slack = np.ceil(tolerance * sizes[item]).astype(np.int64)
            lined.append((np.searchsorted(at, word, "right") - 1, item, word - last - slack, word - first + sizes[item] + slack))
        points, heads = characters(low, starts, ends)
        item, hit, low_first, high_first = seeds.windows(points, heads[at[:-1][counts > 0]])
        doc = np.searchsorted(at, np.searchsorted(heads, hit, "right") - 1, "right") - 1
        lined.append((doc, item, np.searchsorted(heads, low_first - seeds.most[item], "right") - 1, np.searchsorted(heads, high_first + seeds.length[item] + seeds.most[item], "left")))
        doc, item, lo, hi = (np.concatenate(x) for x in zip(*lined, strict=True))
        for d, k, regions in _regions(doc, item, np.maximum(at[doc], lo), np.minimum(at[doc + 1], hi)):
            pattern = index.patterns[k]
            most = int(tolerance * len(pattern))
            best, where = len(pattern) + 1, 0
            for lo, hi in regions:
                text = low[starts[lo] : ends[hi - 1]].tobytes().decode("utf-8", "replace")
                edits = best_place(pattern, " ".join(text.split()))
                if edits < best:
                    best, where = edits, lo
                if best == 0:
                    break
            if best <= most:
                for name, value in zip(out, (i + d, index.ids[k], best, 1 - best / max(1, len(pattern)), int(where - at[d])), strict=True):
                    out[name].append(value)
    return out


def _leaks(batches: Iterator[pa.RecordBatch], index: Index, tolerance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = find_items(batch.column(1), index, tolerance)
        doc_id = batch.column(0).take(pa.array(found["row"], pa.int64()))
        kinds = {"item_id": pa.int64(), "edits": pa.int32(), "similarity": pa.float64(), "first_word": pa.int64()}
        yield pa.RecordBatch.from_pydict({"doc_id": doc_id} | {c: pa.array(found[c], t) for c, t in kinds.items()})


def _clean(batches: Iterator[pa.RecordBatch], index: Index, tolerance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.ones(batch.num_rows, bool)
        ok[find_items(batch.column(batch.num_columns - 1), index, tolerance)["row"]] = False
        yield batch.filter(pa.array(ok)).select(range(batch.num_columns - 1))


def _indexes(items: DataFrame) -> Iterator[Broadcast]:
    """Broadcast indexes of the benchmark, one after the other, in blocks of about BLOCK_BYTES of text by its measured size."""
    context = items.sparkSession.sparkContext
    pool = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND length(text) > 0")
    passes = max(1, ceil((pool.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    for k in range(passes):
        block = sorted((r[0], r[1]) for r in pool.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect())
        yield context.broadcast(Index(block))


def without_leaks(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", tolerance: float = 0.2) -> DataFrame:
    """The columns ``keep`` of the documents that hold no benchmark item, judged as by ``leaks``; nothing is shuffled.

    ``keep`` names the text column too. Each block of the benchmark takes a pass, written as a table, so that one index is held at a time and none once this returns.
    """
    ready(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    for index in _indexes(items):
        # written, so that the index can leave the workers' memory before anything else runs
        rows = cut(rows.mapInArrow(lambda it, index=index: _clean(it, index.value, tolerance), fields)).withColumn("__text", F.col(text))
        index.destroy()
    return rows.drop("__text")


def leaks(docs: DataFrame, items: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Benchmark items found in documents: (doc_id, item_id, edits, similarity, first_word).

    An item is found where its words lie in a document within ``tolerance`` times
    its length in character edits (lower case, no ASCII punctuation, one space
    between words). One row for each pair of ids, with the fewest edits; rows that
    repeat a doc_id or item_id are one document or item. Null and empty texts, and
    texts of punctuation only, are never found and hold nothing. The benchmark goes
    to every task, in as many passes as its measured size needs (BLOCK_BYTES each), one
    after the other. Other columns of either table are ignored.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    found = None
    for index in _indexes(items):
        part = texts.mapInArrow(lambda it, index=index: _leaks(it, index.value, tolerance), "doc_id long, item_id long, edits int, similarity double, first_word long")
        part = cut(part)
        index.destroy()  # one index is held at a time
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "similarity")).alias("b")).select("doc_id", "item_id", "b.edits", "b.similarity", "b.first_word")
