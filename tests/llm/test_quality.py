import re
from collections import Counter

from skerry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


PROSE = "the cat and the dog went to a house in the woods of old and " + " ".join(f"word{i} of the" for i in range(40))
TEXTS = [None, "", " \t\n", "a", "a b", "a b c a b c", "x\n \nx\n\x0b\nx", "é ß\x0cç 🙂", "a " * 5000, "#*$%&|<> & \x85 \xa0", PROSE, PROSE + "\n" + PROSE, "A b c d A b c e A b c"]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, PROSE, 2)], "doc_id long, text string, quality int")
    rows = quality.with_metrics(docs).select("doc_id", "quality.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)} | {None: brute(PROSE)}


def test_filter_keeps_prose_and_columns(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(10, PROSE, 1)], "doc_id long, text string, quality int")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [10, 10]
    assert quality.quality_filter(docs.limit(0)).count() == 0
    why = quality.with_metrics(docs, into="q").select("doc_id", quality.failed_rules("q").alias("why")).collect()
    assert next(r.why for r in why if r.doc_id == 10) == []


def test_hash_halves_settle_false_matches(spark):
    from pyspark.sql import functions as F

    packed = spark.sql("SELECT array(1L, 2L, 67108865L, 134217729L, 134217730L) AS p").select(quality._repeated(F.col("p")).alias("r")).first()
    assert packed.r == [1, 2, 1, 2]


def test_places_beyond_26_bits(spark):
    from pyspark.sql import functions as F

    far, hash_ = (1 << 30) + 5, 7 << quality.PLACE_BITS
    packed = spark.createDataFrame([([hash_ | 3, hash_ | far, (8 << quality.PLACE_BITS) | 4],)], "p array<long>")
    assert packed.select(quality._repeated(F.col("p"), quality.PLACE_BITS).alias("r")).first().r == [3, far]


def test_repeated_rows_and_long_text(spark):
    long = " ".join(f"w{i % 40_000}x" for i in range(120_000))
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, None, "c")], "doc_id long, text string, __quality string")
    rows = quality.with_metrics(docs).select("doc_id", "__quality", "quality.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in rows) == sorted([(1, *brute(long)), (1, *brute(long)), (2, *brute(None))])
    assert quality.quality_filter(docs).columns == docs.columns
