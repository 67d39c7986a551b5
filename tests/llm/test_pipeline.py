import importlib.util
import pathlib

import public_tokenizers
import test_quality
import test_simhash
import test_suffixdedup
from tokenizers import Tokenizer

from skerry.llm import packing, quality

_spec = importlib.util.spec_from_file_location("corpus_pipeline", pathlib.Path(__file__).parents[2] / "corpus_pipeline.py")
corpus_pipeline = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(corpus_pipeline)


def prose(seed, n=90):
    stop = ["the", "of", "and", "to", "in", "is"]
    return " ".join(stop[(seed * 31 + i * 7) % 6] if (seed + i) % 3 == 0 else f"w{(seed * 7919 + i * i * 31) % 9973}é" for i in range(n))


def documents():
    passage = "a passage that several documents share word for word over more than fifty bytes"
    rows = [(i, prose(i) + (" " + passage if i % 3 == 0 else ""), "en", "s", 0) for i in range(30)]
    rows += [(40, rows[4][1], "en", "t", 0), (41, rows[5][1].replace("w", "W"), "en", "t", 0), (42, "short text", "en", "t", 0), (43, None, None, None, None), (44, "spam " * 200, "en", "t", 0)]
    return rows + [(45, prose(77).replace(" ", "### "), "en", "t", 0)]


def test_stages_equal_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], ""))
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in states[:-1]]
    assert all(s.columns == docs.columns for s in states[:-1])
    texts = {i: t for i, t, *_ in rows}
    good = [i for i, t in texts.items() if (m := test_quality.brute(t))[0] >= 50 and 2 * m[4] <= m[0] and m[2] <= 0.3 * m[0]]
    assert ids[1] == sorted(good)
    components = test_simhash.brute_components([(i, test_simhash.brute_print(texts[i])) for i in ids[1]])
    assert ids[2] == sorted(set(components.values())) and 40 not in ids[2] and 41 not in ids[2]
    kept = {r.doc_id: (r.text, r.n_chars, r.source) for r in states[3].collect()}
    want = test_suffixdedup.brute([(i, texts[i]) for i in ids[2]])
    assert {i: v[0] for i, v in kept.items()} == {i: k.decode("utf-8", "ignore") for i, *_, k in want}
    assert all(n == len(t) and s == "s" for t, n, s in kept.values()) and any(r > 0 for _, _, r, *_ in want)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = states[4].collect()
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, (t, *_) in kept.items()}
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in total} == total
    assert -(-sum(total.values()) // packing.CAPACITY) <= len({r.sequence_id for r in pieces}) <= 5, "seven documents of some 265 tokens fit into one"


def test_run_reads_documents(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 25
    assert quality.RULES


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_stages_carry_further_columns_and_odd_rows(spark):
    odd = [(None, prose(50), None, None, None), (None, None, "en", None, 5), (7, prose(7), "xx", "y", -1), (7, prose(7), "xx", "y", -1), (60, prose(61) + " x" * 30_000, "en", "s", 0)]
    docs = spark.createDataFrame(documents()[:12] + odd, SCHEMA).selectExpr("*", "timestamp_micros(coalesce(doc_id, 0) * 1000003 + 1) AS key", "map(1, lang, 2, source) AS chunk", "named_struct('k', doc_id) AS component", "X'00ff' AS kept", "doc_id AS length")
    want = {str(r) for r in docs.drop("text", "n_chars").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "chunk", "component", "kept", "length"]
        rows = docs.drop("text", "n_chars").collect()
        assert rows and {str(r) for r in rows} <= want
    assert docs.filter("doc_id = 7").count() == 3 and docs.filter("doc_id IS NULL").count() == 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.filter("doc_id = 7").count() >= 3 and pieces.filter("doc_id IS NULL").count() >= 1
