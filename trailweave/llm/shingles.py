"""Word shingles of texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The largest bitmap of a text is 2 ** MOST_LOG bits.
MOST_LOG = 17
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
MIX = np.uint64(0xC4CEB9FE1A85EC53)


#: Texts are hashed in parts of so many bytes, or one text.
PART_BYTES = 2_000_000


def text_id(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def hashed(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased and cut at ASCII white space, and how many of them each text has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():
        ends = np.r_[0, np.cumsum(real)][np.cumsum(sizes)]
        sizes, flat = np.diff(ends, prepend=0), flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[coded.indices.to_numpy()], sizes


def shingle_ids(texts: pa.StringArray, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its ``width``-word shingles; of fewer words, one for the
    whole; of none, none."""
    h, sizes = hashed(texts)
    out = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):  # each word's place counts
        part = h[k : len(out) + k] * FACTORS[k]
        out += part ^ part >> np.uint64(31)
    out = mixed(out).view(np.int64)
    found, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            found.append(np.unique(out[at : at + n - width + 1]))
        else:
            found.append(np.array([text_id(h[at : at + n].tobytes())] if n else [], np.int64))
        at += n
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(29)


def parts(texts: pa.Array):
    """The texts in turn, nulls as empty ones, in parts of PART_BYTES at most or of one text."""
    texts = texts.fill_null("")
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > PART_BYTES:
            yield at, texts.slice(at, i - at)
            at, size = i, 0
        size += n
    yield at, texts.slice(at)


def text_ids(texts: pa.StringArray) -> list[int]:
    return [text_id(x) for x in pc.ascii_lower(texts).cast(pa.binary()).to_pylist()]


def bitmap(ids: np.ndarray) -> np.ndarray:
    """Which low bits of the hashes occur, in 8 to 16 times as many places (a power of two) as there are shingles,
    as longs."""
    log = min(max((8 * len(ids) - 1).bit_length(), 6), MOST_LOG)
    out = np.zeros(1 << log, bool)
    out[ids & (1 << log) - 1] = True
    return np.packbits(out, bitorder="little").view("<i8")


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
