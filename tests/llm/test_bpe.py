import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from skerry.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "  \n\t  x", "Hello, world's best! I'll see we've 3 don't", "naïve Café über 漢字かな 🙂🙂 ß²³¼ ½x", "x" * 700, "ab" * 300 + " é" * 80, "\x1c a\x85b\xa0　c  ", "<|endoftext|> a_b __ 12345",
    "Ünïcödé " * 50, "the of and the of and", "ﬁ ǅ Ⅻ ٣ ́a", "\x00\x01 null", "a\r\n\r\n  b ", "'S 'T 'lll", "Thingtition oferwhtiea onerntat", "a\u2003\u2009b \u1680c\u2028\u205f",
]


def test_same_ids_as_tiktoken_and_exact_round_trip(spark):
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "y"), (None, "no key", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, FILE, rows=3).collect()
    assert len(got) == len(rows)
    want = {i: t or "" for i, t, _ in rows}
    for r in got:
        text = want[r.doc_id]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(text), text
        assert bytes(r.decoded).decode() == text
    assert bpe.encode(docs.limit(0), FILE).count() == 0


def test_fold_and_heap_agree(spark):
    ranks = bpe.read_ranks(FILE)
    words = ["a", "thingtition", " oferwhtiea", "zzzzzzzzzz", "été".encode().decode("latin-1"), "aaaaabaaab" * 6]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.word_ids(F.col("w"), ranks).alias("ids"))
    for r in df.collect():
        assert r.ids == bpe.merged_ids(r.w.encode("latin-1"), ranks)


def test_vector_bounds_equal_the_pattern():
    rng = np.random.default_rng(9)
    alphabet = list("ab é'sretvlmdZ09 \n\t  !?_") + ["'s", "'re", "'ll", " 'd", "  "]
    split = bpe.splitter()
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + ["×a", "a÷b²", "'", "'r", "a'"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    starts = bpe.token_starts(np.frombuffer(b"".join(raw), np.uint8), offsets, split).tolist()
    want = []
    for base, t in zip(offsets, texts):
        at = int(base)
        for w in split(t):
            want.append(at)
            at += len(w.encode())
    assert starts == want


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_long_words_go_through_the_fold(spark):
    """A Thue-Morse word and its complement (equal under any polynomial hash modulo 2^64), runs of one byte, and random words."""
    rng = np.random.default_rng(5)
    one = thue_morse(2048)
    texts = [one, one.translate(str.maketrans("ab", "ba")), f"{one}\n{one.translate(str.maketrans('ab', 'ba'))}", " " * 30_001 + "x", "=" * 20_000, "ab" * 3000, "aab" * 2000 + "aaaa"]
    texts += ["".join(rng.choice(list("etaoinshrdlué"), n)) for n in (64, 65, 97, 300, 2000)] + ["".join(rng.choice(list("ab"), 1500))]
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(docs, FILE).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_both_folds_agree_with_the_heap_on_odd_vocabularies(spark, monkeypatch):
    """Vocabularies in which joining a pair can make one of lower rank: the fold must still take the leftmost lowest pair."""
    rng = np.random.default_rng(6)
    for short in (64, 1):
        monkeypatch.setattr(bpe, "SHORT", short)
        for _ in range(4):
            pieces = {"".join(rng.choice(list("abc"), rng.integers(2, 6))).encode() for _ in range(25)} - {b"a", b"b", b"c"}
            order = rng.permutation(len(pieces) + 3)
            ranks = {p: int(r) for p, r in zip([b"a", b"b", b"c", *sorted(pieces)], order, strict=True)}
            words = ["".join(rng.choice(list("abc"), rng.integers(1, 60))) for _ in range(60)]
            df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.word_ids(F.col("w"), ranks).alias("ids"))
            for r in df.collect():
                assert r.ids == bpe.merged_ids(r.w.encode(), ranks), (ranks, r.w)
