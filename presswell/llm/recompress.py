"""Locally consistent naming of token runs and pairs, in numpy over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A symbol that covers this many characters is complete: it takes no further part in the rounds.
FULL = 16
ROUNDS = 14
#: Of so many neighbouring symbols, the one with the smallest name is an anchor.
WINDOW = 3
#: Characters on either side of an anchor that its key covers.
HALF = 50
#: A symbol longer than this is a run, or a stretch in which nothing marks a place: it repeats itself within PHASES characters.
LONG = 3 * FULL
PHASES = 4 * FULL
#: Texts are handled in slices of about so many characters, to bound the memory of a task.
SLICE = 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows: those of its characters, each in its place."""
    up, _ = powers(len(codes) + 1)
    s = np.empty(len(codes) + 1, np.uint64)
    s[0] = 0
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=s[1:])
    return s


def stretch_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), equal for equal stretches wherever they stand."""
    _, down = powers(len(s))
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


def token_starts(codes: np.ndarray) -> np.ndarray:
    """Where tokens begin: after white space, at signs of scripts without it, and, in long unbroken tokens, where a hash of the four signs before says so."""
    blank = (codes <= 32) | (codes == 0xA0)
    begin = np.empty(len(codes), bool)
    begin[0] = True
    begin[1:] = (blank[:-1] & ~blank[1:]) | (codes[1:] >= 0x2E80) | (codes[1:] == 0) | (codes[:-1] == 0)
    starts = np.flatnonzero(begin)
    size = np.diff(np.append(starts, len(codes)))
    if len(size) and size.max() > 2 * FULL:
        inside = np.repeat(size > 2 * FULL, size)
        c = codes.astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        h[4:] = mix(c[:-4] * np.uint64(0x10001) ^ (c[1:-3] << np.uint64(16)) ^ (c[2:-2] << np.uint64(32)) ^ (c[3:-1] << np.uint64(48)))
        begin |= inside & (h % np.uint64(8) == np.uint64(1))
        starts = np.flatnonzero(begin)
    return starts


def symbols(codes: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and name of the symbols after all rounds.

    A name is a hash of what the symbol covers, so every task gives equal stretches equal names without asking another.
    Each round first names runs of one symbol, then the pairs whose left sign falls on one side of a coin and whose right
    sign falls on the other; both decisions rest on the two symbols alone, so inside equal stretches they are equal too.
    """
    start = token_starts(codes)
    end = np.append(start[1:], len(codes))
    name, size = stretch_hash(s, start, end), (end - start).astype(np.int64)
    full = (size >= FULL) | (codes[start] == 0)
    for r in range(ROUNDS):
        same = (name[1:] == name[:-1]) & ~full[1:] & ~full[:-1]
        if same.any():
            head = np.append(True, ~same)
            at = np.flatnonzero(head)
            n = np.diff(np.append(at, len(name)))
            total = np.add.reduceat(size, at)
            # a run that fills a symbol is named without its length, which may differ where a stretch is cut
            count = np.where(total >= FULL, 0, n).astype(np.uint64)
            name = np.where(n > 1, mix(name[at] + count * _M1 + np.uint64(7)), name[at])
            start, size, full = start[at], total, full[at] | (total >= FULL)
        coin = (mix(name + np.uint64((r + 1) * int(_BASE) % 2**64)) >> np.uint64(63)).astype(bool)
        pair = ~coin[:-1] & coin[1:] & ~full[:-1] & ~full[1:]
        if not pair.any():
            continue
        left = np.flatnonzero(pair)
        name[left] = mix(name[left] * _M2 + name[left + 1])
        size[left] += size[left + 1]
        full[left] = size[left] >= FULL
        keep = np.ones(len(name), bool)
        keep[left + 1] = False
        start, size, name, full = start[keep], size[keep], name[keep], full[keep]
    return start, size, name


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, place and key of each anchor whose surroundings of HALF characters lie within its text.

    The key is the hash of the 2 * HALF characters around the place. Any stretch of 4 * HALF characters that two texts
    share holds an anchor of both in its middle half, where the symbols no longer feel what stands outside.
    """
    if any("\0" in t for t in texts):  # the separator, as an unused sign
        texts = [t.replace("\0", "\uffff") for t in texts]
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    s = prefix(codes)
    start, size, name = symbols(codes, s)
    chosen = np.ones(len(name), bool)
    if len(name) >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(name, WINDOW)
        chosen[:] = False
        chosen[windows.argmin(axis=1) + np.arange(len(windows))] = True
    # both ends of a run are anchors, and so are enough places inside for every phase of what it repeats
    long = (size > LONG) & (codes[start] != 0)
    chosen |= long
    chosen[1:] |= long[:-1]
    inner = (start[long, None] + HALF + np.arange(PHASES)[None, :])[np.arange(PHASES)[None, :] < (size[long, None] - HALF)]
    place = np.unique(np.concatenate((start[chosen], inner)))
    text = np.searchsorted(first, place, side="right") - 1
    inside = (place - first[text] >= HALF) & (place + HALF <= first[text] + lengths[text])
    place, text = place[inside], text[inside]
    return text, place - first[text], stretch_hash(s, place - HALF, place + HALF).view(np.int64)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters each; a longer text is a range of its own."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > SLICE:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
