"""The registered queries against their SQL, and the pipeline against its parts."""

import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, contamination, near_duplicates
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tidemark.llm import language, quality  # noqa: E402
from tidemark.llm import queries as llm  # noqa: E402
from tidemark.llm.common import fold, table  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = llm.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted((repr(tuple(r)) for r in frame.select(columns).collect()))
    cursor = duck.execute(llm.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())


def test_token_queries_equal_the_library(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    library = Tokenizer.from_file(public_tokenizers.path(llm.WORD_TOKENIZER))
    ids = {r.doc_id: e.ids for r, e in zip(
        rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True)}
    counts = {r.doc_id: r for r in llm.queries()["op6_token_counts"](spark, SMALL).collect()}
    assert all((counts[r.doc_id].n_tokens, counts[r.doc_id].n_bytes) == (len(ids[r.doc_id]), len((r.text or "").encode()))
               for r in rows)
    assert all(r.over_limit == (r.n_tokens > llm.TOKEN_LIMIT) for r in counts.values())
    files, start = {r.doc_id: r for r in llm.queries()["op2_token_files"](spark, SMALL).collect()}, 0
    for r in rows:
        whole = np.array([*ids[r.doc_id], llm.END_ID], dtype="<u4")
        got = files[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_has_a_row_for_each_document(spark, name):
    rows = llm.queries()[name](spark, SMALL).collect()
    docs = {r.doc_id for r in table(spark, SMALL, "documents").select("doc_id").collect()}
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == docs


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "benchmark", "pieces"]
    labels = table(spark, SMALL, "labels").where(fold("doc_id", 5) != 0)
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()
            if r.score >= quality.KEEP}
    after = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert after.schema == docs.schema and {r.doc_id for r in after.collect()} == good
    model = language.train(after.where(fold("doc_id", 4) != 2))
    known = {r.doc_id for r in language.identify(after, model, ["doc_id"]).collect() if not r.rejected}
    after = corpus_pipeline.language_stage(spark, after, SMALL)
    rows = after.collect()
    assert after.schema == docs.schema and {r.doc_id for r in rows} == known
    expected = {c for _, _, c in near_duplicates([(r.doc_id, r.text) for r in rows])}
    after = corpus_pipeline.duplicate_stage(spark, after, SMALL)
    assert after.schema == docs.schema and {r.doc_id for r in after.collect()} == expected
    benchmark = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    after = corpus_pipeline.benchmark_stage(spark, after, SMALL)
    rows = after.collect()
    assert after.schema == docs.schema and {r.doc_id for r in rows} == expected
    assert not any(hit for _, hit, _ in contamination(benchmark, [r.text for r in rows]))
    done = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in done} == expected
    assert all(r.n_pieces == len(r.ids) for r in done)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null, empty, long, repeated and odd texts; clashing columns; labels of other rows."""
    docs = table(spark, SMALL, "documents").withColumns({"score": F.lit(0.5), "n_words": F.lit(1)})
    docs.unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    folder, frame = str(tmp_path), table(spark, str(tmp_path), "documents")
    names = frame.columns
    assert {"score", "n_words"} < set(names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, folder)
        assert frame.columns == names and frame.count() <= before.count()
    kept = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    assert all(i not in kept for i in (10_000, 10_001, 10_002))  # null, empty, blank
    done = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in done) == sorted((i is not None, i) for i in kept)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SMALL, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
