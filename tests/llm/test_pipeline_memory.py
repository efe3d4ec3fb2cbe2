"""What the pipeline's Python workers hold during and after a task."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from evokeline.llm import packing, tokens
from evokeline.llm.common import small_batches

PATH = public_tokenizers.path(packing.VOCABULARY)


def test_words_are_bounded_and_ids_stay():
    letters = "abcdefghij"
    texts = [" ".join(f"word{letters[k % 10]}{letters[j % 10]}{letters[k // 10]} Über{letters[j // 10]}" for j in range(40)) for k in range(60)]
    whole = tokens.packed_ids(texts, PATH)
    words, _ = tokens.encoder(PATH)
    assert words.held > 2000
    assert tokens.packed_ids(texts, PATH, 2000) == whole and words.held <= 2000
    assert [x for k in range(60) for x in tokens.packed_ids(texts[k : k + 1], PATH, 2000)] == whole
    tokens.forget_words()


def test_memory_goes_back_after_the_vocabulary(monkeypatch):
    tokens.packed_ids(["a few words"], PATH)
    left = []
    monkeypatch.setattr(tokens, "give_back", lambda: left.append(tokens.encoder.cache_info().currsize))
    tokens.forget_words()
    assert left == [0]


def test_pieces_do_not_depend_on_the_words_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = (packing.pieces(docs, with_ids=2, words=x) for x in (1000, None))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty() and few.count() == many.count() > 0
    assert corpus_pipeline.WORDS < tokens.WORDS


def test_batches_of_the_stages(spark):
    """Python gets about a megabyte at once; rows that are longer come alone."""
    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("some text "), 200).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], ["bytes", "rows"])

    with small_batches(spark):
        seen = docs.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in seen) == 4000 and max(r["bytes"] for r in seen) < 1.5 * (1 << 20)
