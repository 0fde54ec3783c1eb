import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import tiktoken
from tokenizers import Tokenizer

from trailweave.llm import bpe, packing

RANKS = bpe.read_ranks(open(public.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "ñ", "漢字", "한국", "🙂", "'s", "'ll", "1", "23", "!!!", "…", "\x1c", "\x85", "\u00a0", "the", "ing", "क्", "́", "א", "\r\n", "xxxxx", "http://", " the", "<|endoftext|>", "E", "Σ"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_bpe_is_the_library_and_round_trips():
    mine = bpe.ByteBpe(RANKS, public.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for t in texts(4000) + ["ab" * 20_000, "a" * 5000, ""]:
        ids = mine.encode(t)
        assert array("I", ids).tolist() == theirs.encode_ordinary(t), t
        assert mine.decode(ids) == t.encode()


def test_bpe_query_form(make, odd):
    df = bpe.byte_bpe(make(odd), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, with_ids=True)
    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = sorted((r.n_tokens, r.ids) for r in df.collect())
    assert got == sorted((len(x), x) for x in (theirs.encode_ordinary(t or "") for _, t in odd))
    assert bpe.byte_bpe(make([]), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0


def test_word_ids_are_the_library():
    path = public.path("word_bpe_49k.json")
    mine, theirs = packing.WordIds(open(path).read()), Tokenizer.from_file(path)
    sample = texts(3000, 8) + ["Word, word. WORD! don't we'll x" + "y" * 200 + "."]
    sample += ["GELDİ. İ! ज़क़, फ़. \u0958. \u095f!", "hello <|endoftext|> world", "<|STARTOFTEXT|> <|startoftext|>x", "é. e\u0301. ﬁ, ǰ! Ǆ; ΣΑΣ. ß?"]
    rng = random.Random(12)
    letters = ["İ", "Σ", "ज़", "फ़", "\u0958", "ß", "é", "e\u0301", "a", "Z", "ﬁ", "가", "ᄀ", "ᅡ", "ǰ", ".", "!", ",", "?", ";", ":", "'s", " ", "<|endoftext|>", "\u0307", "़"]
    sample += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    for t, ids, e in zip(sample, mine.batch(sample), theirs.encode_batch(sample, add_special_tokens=False)):
        assert array("I", ids).tolist() == e.ids, t


def check_packing(rows, tokens_of, window):
    windows, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id] += r.length
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert docs == tokens_of
    return sum(docs.values()) / len(windows) / window


def test_packing_keeps_every_id_once(make, odd):
    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = odd + [(100 + i, " ".join(rng.choice(["sun", "moon", "stars"]) for _ in range(rng.randrange(1, 3000)))) for i in range(200)]
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    rows += [(900, "GELDİ. ज़क़, <|endoftext|> फ़."), (901, "word " * 5000)]
    for i, t in rows[-2:]:
        want[i] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got = packing.pack(make(rows, 9), path, most_open=8).collect()
    of = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows if i is not None and i != 4}
    for r in got:  # each piece is the library's ids from its start
        if r.doc_id in of:
            piece = of[r.doc_id][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(of[r.doc_id])
    assert check_packing(got, want, packing.WINDOW) > 0.9
    assert all(r.start % packing.WINDOW == 0 and 0 < r.length <= packing.WINDOW for r in got)
    assert packing.pack(make([]), path).count() == 0


def test_packing_has_few_rows_as_strings_at_once():
    rows = [(i, None if i % 7 == 0 else f"text {i}") for i in range(2 * packing.ROWS_AT_ONCE + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    parts = list(packing.few_at_once(batch))
    assert [len(k) for k, _ in parts] == [packing.ROWS_AT_ONCE, packing.ROWS_AT_ONCE, 5]
    assert [x for k, t in parts for x in zip(k, t)] == [(i, t or "") for i, t in rows]


def test_best_fit_bounds_its_windows():
    fit, rng = packing.BestFit(100, 5), random.Random(4)
    for i in range(2000):
        list(fit.add(rng.randrange(1, 101), (i,)))
        assert fit.count <= 6 and fit.count == sum(map(len, fit.by_room))
