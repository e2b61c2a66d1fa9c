"""Word shingles as 64-bit hashes, and b-bit MinHash signatures of their sets, for use in tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that are hashed in one go; longer texts are hashed piece by piece.
STEP_BYTES = 1 << 20
SEED = 20240229


def _mix(x):
    """Finalizer of 64-bit hashes: every input bit reaches every output bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables():
    import numpy as np

    draw = np.random.default_rng(SEED)
    values = draw.integers(0, 2**64, 256, dtype="uint64")
    values[65:91] = values[97:123]  # A-Z as a-z
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    odd = draw.integers(0, 2**63, 64, dtype="uint64") * np.uint64(2) + np.uint64(1)
    return values, blank, odd


def word_hashes(data, values, blank):
    """Hash and first byte of every word of some bytes."""
    import numpy as np

    found, starts = [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + STEP_BYTES)
        while end < len(data) and not blank[data[end]]:
            end += 1
        part = np.frombuffer(data, dtype="uint8", count=end - at, offset=at)
        place = np.flatnonzero(~blank[part])
        if len(place):
            first = np.flatnonzero(np.diff(place, prepend=-2) > 1)
            sizes = np.diff(np.append(first, len(place)))
            power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, dtype="uint64"), dtype="uint64")
            offset = np.arange(len(place)) - np.repeat(first, sizes)
            found.append(_mix(np.add.reduceat(values[part[place]] * power[offset], first)))
            starts.append(place[first] + at)
        at = end
    if not found:
        return np.array([], dtype="uint64"), np.array([], dtype="int64")
    return np.concatenate(found), np.concatenate(starts)


def shingle_sets(texts, words):
    """For each text its distinct shingles of so many words, as sorted hashes.

    With fewer words, the whole sequence is the one shingle; without any, or null, the set is empty.
    """
    import numpy as np

    values, blank, odd = _tables()
    held, size = [], 0

    def flush():
        ends = np.cumsum([len(d) + 1 for d in held])
        hashes, starts = word_hashes(b" ".join(held), values, blank)
        last = np.searchsorted(starts, ends)
        full = np.zeros(max(0, len(hashes) - words + 1), dtype="uint64")
        for k in range(words):
            full += hashes[k : k + len(full)] * odd[k]
        full = _mix(full)
        begin = 0
        for end in last:
            n = end - begin
            if n >= words:
                yield np.unique(full[begin : end - words + 1])
            elif n:
                own = (hashes[begin:end] * odd[:n]).sum(dtype="uint64", keepdims=True)
                yield _mix(own + odd[32 + n : 33 + n])
            else:
                yield np.array([], dtype="uint64")
            begin = end

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > STEP_BYTES:
            yield from flush()
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from flush()


def signatures(sets, places):
    """MinHash of each set that is not empty: a matrix of 16-bit values, zeros for empty sets."""
    import numpy as np

    draw = np.random.default_rng(SEED + 1)
    factors = draw.integers(0, 2**63, places, dtype="uint64") * np.uint64(2) + np.uint64(1)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), places), dtype="uint16")
    rows = np.flatnonzero(sizes)
    if len(rows):
        flat = np.concatenate([sets[r] for r in rows])
        starts = np.cumsum(sizes[rows]) - sizes[rows]
        for k in range(places):
            least = np.minimum.reduceat(flat * factors[k], starts)
            out[rows, k] = (_mix(least) >> np.uint64(48)).astype("uint16")
    return out
