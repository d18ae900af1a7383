import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, multiset, rows
from tokenizers import Tokenizer

from logloom.llm import bpe, tokens
from logloom.llm import textbatch as tb
from logloom.llm.bpe import decode, encode, encode_decode
from logloom.llm.token_count import count_tokens
from logloom.llm.tokens import Pieces, PlainEncoder, TreeEncoder, parts

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def fuzz():
    r = random.Random(1)
    alphabet = [*"abAB019 .,'!<|>\n\t \r\u0085  éÉßü×÷́ 日本\U0001f600X-_\x1c\x00İſœ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "  "]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(4000)]


def unsplit():
    r = random.Random(2)
    return ["a" * 5000, "ab" * 4000 + " x", "'" * 3000, "".join(r.choice("abcdefgh") for _ in range(20000)), "".join(r.choice("etaoin12日本") for _ in range(9000)), "x" * 3000 + "<|endoftext|>" + "y" * 3000]


@pytest.mark.parametrize(("path", "encoder"), [(WORD, PlainEncoder(WORD, False)), (BYTE, TreeEncoder(BYTE)), (BYTE, TreeEncoder(BYTE, leaf=64, workers=4))])
def test_same_as_library(path, encoder):
    texts = fuzz() + unsplit()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    known = Pieces(encoder)
    data, offsets = tb.flat(pa.array(texts))
    slots, at = known.slots(data, offsets)
    ids = known.ids[tb.ragged(known.start[slots], known.length[slots])]
    counts = np.bincount(np.searchsorted(offsets, at, side="right") - 1, weights=known.length[slots], minlength=len(texts)).astype(int)
    edges = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


def east_asian():
    r = random.Random(8)
    alphabet = [*"日本語漢字倉侮かながぱアー々〆。、，！？・「」　é a1'゙゚́‍한글ไทย〇㐀龍", "。、", "，的", "<|endoftext|>"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]


@pytest.mark.parametrize(("path", "encoder"), [(WORD, PlainEncoder(WORD, False)), (BYTE, TreeEncoder(BYTE, leaf=64))])
def test_cuts_at_east_asian_stops(path, encoder):
    texts = east_asian()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    known = Pieces(encoder)
    data, offsets = tb.flat(pa.array(texts))
    assert len(tokens.chunk_starts(data, offsets)) > 1.5 * len(texts)
    slots, at = known.slots(data, offsets)
    ids = known.ids[tb.ragged(known.start[slots], known.length[slots])]
    counts = np.bincount(np.searchsorted(offsets, at, side="right") - 1, weights=known.length[slots], minlength=len(texts)).astype(int)
    edges = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


@pytest.mark.parametrize("ids", [True, False])
def test_cache_is_bounded_in_bytes(ids, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 1 << 20)
    r, known, tokenizer = random.Random(3), Pieces(PlainEncoder(WORD, False), ids=ids), Tokenizer.from_file(WORD)
    for _ in range(30):
        texts = ["".join(chr(r.randint(0x5000, 0x8FFF)) for _ in range(r.choice([20, 300, 900]))) for _ in range(60)] + ["的。" * 300]
        data, offsets = tb.flat(pa.array(texts))
        slots, at = known.slots(data, offsets)
        counts = np.bincount(np.searchsorted(offsets, at, side="right") - 1, weights=known.length[slots], minlength=len(texts)).astype(int)
        assert counts.tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert all(len(k) <= tokens.LONG for k in known.slot)
        # At most the limit and what one call adds.
        assert sum(map(len, known.slot)) + 120 * len(known.slot) <= (1 << 20) + 300_000 and known.ids.nbytes <= 4 << 20


def thue_morse(a, b, n=1024):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize(("path", "encoder"), [(WORD, PlainEncoder(WORD, False)), (BYTE, TreeEncoder(BYTE))])
@pytest.mark.parametrize("collide", [False, True])
def test_pieces_of_one_hash_are_told_apart(path, encoder, collide, monkeypatch):
    # Such words share any polynomial hash modulo 2**64; with collide, all of more than 8 bytes share theirs.
    plain = tb.word_hashes
    if collide:
        monkeypatch.setattr(tb, "word_hashes", lambda data, start, end, folded=False: np.where(end - start > 8, np.uint64(7), plain(data, start, end, folded)))
    tokenizer = Tokenizer.from_file(path)
    for x, y in (("a", "b"), ("e", "q")):
        words = [thue_morse(x, y), thue_morse(y, x)]
        for texts in (words, words[::-1], [" ".join(words)], [" ".join(words[::-1])], ["same sameness sameness " + words[0] + " sameness"]):
            known = Pieces(encoder)
            for one in ([texts], [[t] for t in texts]):
                for batch in one:
                    data, offsets = tb.flat(pa.array(batch))
                    slots, at = known.slots(data, offsets)
                    ids = known.ids[tb.ragged(known.start[slots], known.length[slots])]
                    assert ids.tolist() == [i for t in batch for i in tokenizer.encode(t, add_special_tokens=False).ids]


def test_parts_of_long_texts():
    text = ("x y\n" * 50 + "q" * 300) * 40
    data, offsets = tb.flat(pa.array([text]))
    known = Pieces(TreeEncoder(BYTE))
    pieces = list(parts(data, offsets, 1000))
    assert len(pieces) > 5 and b"".join(p[0].tobytes() for p in pieces) == text.encode()
    assert sum(int(known.length[known.slots(p, e)[0]].sum()) for p, e, _ in pieces) == len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)


def test_counts(spark):
    tokenizer = Tokenizer.from_file(WORD)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 100) for r in rows()), key=repr)
    got = count_tokens(documents(spark), WORD, limit=100, slice_bytes=200)
    assert multiset(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(documents(spark, []), WORD).count() == 0


def test_round_trip(spark):
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted(((r[0], ids := tokenizer.encode(r[1] or "", add_special_tokens=False).ids, tokenizer.decode(ids, skip_special_tokens=False)) for r in rows()), key=repr)
    assert multiset(encode_decode(documents(spark), BYTE, slice_bytes=200), "doc_id", "ids", "decoded") == want
    assert multiset(decode(encode(documents(spark), BYTE), BYTE), "doc_id", "ids", "decoded") == want
    broken = spark.createDataFrame([(1, [447, 222]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert multiset(decode(broken, BYTE), "doc_id", "decoded") == [(1, tokenizer.decode([447, 222], skip_special_tokens=False)), (2, ""), (3, "")]
    assert encode_decode(documents(spark, []), BYTE).count() == 0


def test_default_encoder_takes_leaves_together():
    # The encoder of the query: a long text's leaves, and the joins of a level, go to the library in batches.
    encoder = bpe._pieces(BYTE, 3).encoder  # as with spark.task.cpus=3
    batches, leaves = [], encoder.leaves
    encoder.workers, had = max(2, encoder.workers), encoder.workers
    encoder.leaves = lambda words: batches.append(len(words)) or leaves(words)
    word = "".join(random.Random(3).choice("abcdefgh") for _ in range(8 * encoder.leaf))
    try:
        assert encoder.tree(word) == [t.id for t in encoder.model.tokenize(word)]
    finally:
        del encoder.leaves
        encoder.workers = had
    assert batches[:2] == [8, 4] and had == 3
