import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skerry.llm import packing


def check_plan(counts, capacity):
    plan = packing.best_fit_plan(counts, capacity)
    used = Counter()
    for lengths, copies in plan.templates:
        assert copies > 0 and sum(lengths) <= capacity
        for length in lengths:
            used[length] += copies
    assert used == {i: int(n) for i, n in enumerate(counts) if i and n}
    return plan


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once_and_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 100, 2048]))
    counts = np.bincount(np.minimum(rng.geometric(6 / capacity, 4000), capacity), minlength=capacity + 1)
    plan = check_plan(counts, capacity)
    bound = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert bound <= plan.sequences <= bound + 2


def test_exact_complements_and_residuals():
    counts = np.zeros(11, int)
    counts[[7, 3, 6, 2, 1, 5]] = [2, 2, 3, 3, 6, 3]
    assert check_plan(counts, 10).sequences == -(-int((counts * np.arange(11)).sum()) // 10)
    assert check_plan(np.zeros(11, int), 10).sequences == 0
    only_large = np.zeros(11, int)
    only_large[6] = 5
    assert check_plan(only_large, 10).sequences == 5


def test_pieces():
    assert list(packing.pieces_of(5, 10)) == [(0, 5)]
    assert list(packing.pieces_of(10, 10)) == [(0, 10)]
    assert list(packing.pieces_of(23, 10)) == [(0, 3), (3, 10), (13, 10)]
    assert list(packing.pieces_of(20, 10)) == [(0, 10), (10, 10)]


def test_pack_round_trip(spark):
    texts = ["", None, "hello world", "naïve café <|endoftext|> 漢字 🙂", "the of and " * 1500, "x" * 5000, "same", "same"]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(2, "hello world", 9), (None, "no key", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    file = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, file, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    library = Tokenizer.from_file(file)
    library.encode_special_tokens = True
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for n, (start, length) in enumerate(packing.pieces_of(len(ids))):
            want[i, n, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert packing.pack(docs.limit(0), file).count() == 0


def test_added_tokens_as_the_library_has_them(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["plain", "a <|endoftext|> b", "<|endoftext|>", "<|endof text|>", "é <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(file)
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, file, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=True).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), t


def test_latin_texts_have_the_library_ids():
    """The fast way against the library on texts of every Latin character, white space, digits, contractions and controls."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(file, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=True), Tokenizer.from_file(file)
    rng = np.random.default_rng(12)
    alphabet = [chr(c) for c in range(0x250) if c not in range(0x80, 0xA0)] + [chr(0x85), "'s", "'ll", "'RE", "  ", "\n\n", "\r\n", " \t", "123", "the", " and", "<|", "|>"] * 6
    for size in (1, 3, 12, 60):
        for _ in range(700):
            text = "".join(rng.choice(alphabet, size))
            assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
