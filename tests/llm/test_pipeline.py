import os
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evokeline.llm import line_dedup, near_copies, packing, secret_scan, toxicity


def test_stages(spark):
    settings = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        rows = out.collect()
        kept.append(spark.createDataFrame(rows, docs.schema))
    clean, lines, single, hidden = ({r["doc_id"]: r["text"] for r in x.collect()} for x in kept[1:])
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(clean) == {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert set(lines) == set(clean)
    assert lines == {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(kept[1]).collect()}
    assert set(single) == {r["doc_id"] for r in near_copies.first_of_each(kept[2]).collect()} and len(single) < len(lines)
    trained = secret_scan.train(kept[3])
    assert set(hidden) == set(single) and all(hidden[k] == secret_scan.hidden(v, secret_scan.spans(v, trained), "[secret]") for k, v in single.items())
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect()
    assert {r["doc_id"] for r in last} == set(hidden)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = {k: tokenizer.encode(v or "", add_special_tokens=False).ids + [packing.CLOSING_ID] for k, v in hidden.items()}
    for r in last:
        own = np.frombuffer(r["ids"], "<u2")
        assert own.tolist() == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] and zlib.crc32(own.astype("<u4").tobytes()) == r["ids_crc32"]
    tables = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    whole = corpus_pipeline.run(spark, sf).collect()
    left = [x for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - tables if x.startswith(("toxicity", "line_dedup", "simhash", "secrets", "secret_scans"))]
    assert len(left) == 1 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == settings
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, last))
    assert packing.CAPACITY == 4096


def tables(spark, docs, folder):
    """A folder with ``docs`` as documents, labels of some of them and the other tables that stages read."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(8)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_odd_tables_go_through(spark, odd, none, tmp_path):
    """Null columns, empty and long texts, repeated rows and clashing names give pieces of all kept texts; an empty table gives none."""
    rows = corpus_pipeline.run(spark, tables(spark, odd, str(tmp_path / "odd"))).collect()
    texts = {r["doc_id"] for r in odd.collect()}
    assert rows and {r["doc_id"] for r in rows} <= texts
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path / "odd"))
        assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows}
    assert corpus_pipeline.run(spark, tables(spark, none, str(tmp_path / "none"))).collect() == []
