"""Exact byte-level BPE in linear time, by backtracking over longest matches.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton of the vocabulary finds every token at every
place of a piece in one pass. From the left, the longest token that fits the one before it is taken; where
none fits, the last one is taken back and that boundary is dead. Two tokens fit each other if merging the
bytes of both by rank gives just these two; the answers are remembered. A sequence whose neighbours all fit
is the one that merging gives, and the prefix up to any boundary has only one such sequence, hence a
boundary dies once at most and the work is linear.

A piece that is a token as a whole is that token, reachable by merges or not, as in the public encoders of
this format.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trailweave.llm.common import resident

#: Entries that a worker remembers for words and for pairs of tokens; then it forgets them all.
MOST_WORDS = 1_000_000
MOST_PAIRS = 1_000_000
LONGEST_KEPT = 64

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"(?:\A|\s) | (?:\s|\Z)")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}


NEVER = 1 << 62


def merged(data: bytes, ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Plain BPE by repeated merging of the leftmost pair of least rank: the ids, and the ids that the
    first and the last part went through on the way. For short inputs."""
    parts = [data[i : i + 1] for i in range(len(data))]
    first, last = [ranks[parts[0]]], [ranks[parts[-1]]]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if at == 0:
            first.append(best)
        if at == len(parts) - 1:
            last.append(best)
    return [ranks[p] for p in parts], first, last


class _Words(dict):
    """Ids of words, as bytes, by the word; filled on demand."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.whole = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.pieces = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.finder = ahocorasick.Automaton()
        for t, r in self.whole.items():
            self.finder.add_word(t, r)
        self.finder.make_automaton()
        self.reached: dict[int, tuple[list[int], list[int]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.spaced, self.bare = _Words(self._ids, " "), _Words(self._ids, "")

    def _history(self, token: int) -> tuple[list[int], list[int]] | None:
        """The first and the last parts that merging the token's bytes goes through, if it ends in the token."""
        if token not in self.reached:
            ids, first, last = merged(self.tokens[token], self.ranks)
            self.reached[token] = (first, last) if ids == [token] else None
        return self.reached[token]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives just the two.

        Ranks never fall while parts merge, so the last part of ``a`` and the first part of ``b`` change at
        known ranks; the two fit if at no time the merge across would come before the next change of either.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        left, right, tokens = self._history(a)[1], self._history(b)[0], self.tokens
        i, j, m, n = 1, 1, len(left), len(right)
        known = True
        while known:
            across = self.ranks.get(tokens[left[i - 1]] + tokens[right[j - 1]], NEVER)
            next_left, next_right = left[i] if i < m else NEVER, right[j] if j < n else NEVER
            if across < next_left and across <= next_right:
                known = False
            elif next_left == next_right == NEVER:
                break
            elif next_left <= next_right:
                i += 1
            else:
                j += 1
        self.pairs[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """``piece``: bytes as Latin-1."""
        if (one := self.whole.get(piece)) is not None:
            return [one]
        n, length = len(piece), self.length
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.finder.iter(piece):
            at[end - length[token] + 1].append(token)  # ends grow, so the longest comes last
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos = 0
        while pos < n:
            here = at[pos]
            while here:
                token = here[-1]
                if alive[pos + length[token]] and self._history(token) and (not out or self._fit(out[-1], token)):
                    out.append(token)
                    pos += length[token]
                    break
                here.pop()
            else:
                if not out:
                    raise ValueError("a byte of the text is not in the vocabulary")
                alive[pos] = 0
                pos -= length[out.pop()]
                at[pos].pop()
        return out

    def _ids(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += self.encode_piece(piece.encode().decode("latin-1"))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No piece of the pattern spans a lone space from its left side, so the text is cut before each lone
        space and the parts are looked up.
        """
        first, *rest = _LONE_SPACE.split(text) if _OTHER_SPACE.search(text) else text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def encoder(vocabulary: bytes, pattern: str) -> ByteBpe:
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    return resident(("byte bpe", key), lambda: ByteBpe(read_ranks(vocabulary), pattern))


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array of ints)
    if ``with_ids``.

    ``path``: a vocabulary of base64 tokens and ranks, which only the driver reads and then broadcasts
    (its size is fixed, about 1 MB). Null text counts as empty: no ids, and digests of no bytes. Null and
    repeated ids pass through; texts of any length take linear time; an empty table gives an empty result;
    other columns are ignored.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        bpe = encoder(shared.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, coded, back, each = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids) // 4)
                coded.append(sha(ids).hexdigest())
                back.append(sha(bpe.decode(ids)).hexdigest())
                if with_ids:
                    each.append(array("I", ids).tolist())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(each, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
