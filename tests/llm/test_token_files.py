"""Token files against the tokenizer on whole texts, what their files hold, and edge cases."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import token_files
from quillmark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = token_files.Encoder(Path(PATH).read_text(), True, 1)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def test_query_by_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    wanted, at = [], 0
    for doc_id, text in docs:
        ids = ids_of(text)
        wanted.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op11_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == wanted


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "\n", "\x1c", " ", "it's", "é", "É", "<|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ", "word,", "word's.", "3rd", "x'.", "İ", "Éa%&", "ça.'", "÷é", "ß", "ÿ!", "e\u0301", "\u0301", "abc[x]"])), max_size=12).map("".join))
def test_words_one_by_one_equal_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == ids_of(text)


LONG = " ".join(f"w{i}, and some more." for i in range(60_000))


@pytest.mark.parametrize("by_words", [False, True])
def test_edge_cases(spark, tmp_path, by_words):
    rows = [(None, "a b", "en"), (None, None, "en"), (3, "The END of it", None), (3, "The END of it", None), (3, "another", "de"), (1, "", "en"), (2, LONG, "en"), (-5, " \t\n", "en")]
    docs = spark.createDataFrame(rows, "id long, body string, ids string").withColumns({n: F.lit(n) for n in ("part", "first", "meta", "doc_id", "_hash")}).repartition(3)
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, PATH, by_words=by_words, doc_id="id", text="body", meta=("ids", "part"))
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, -5, 1, 2, 3, 3, 3]
    at = 0
    for r in found:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.meta["part"] == "part"
        at += len(r.ids)
    assert sorted(map(tuple, (r.ids for r in found))) == sorted(tuple(ids_of(t)) for _, t, _ in rows)
    everything = [i for r in found for i in r.ids]
    for begin, end in ((0, at), (1, 4), (7, 8), (at - 3, at + 10), (5, 5), (at, at + 5)):
        got = [i for r in sorted(token_files.read_span(spark, path, begin, end).collect()) for i in r.ids]
        assert got == everything[begin:end]


def test_a_table_without_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH)
    assert token_files.read_documents(spark, str(tmp_path / "t")).count() == 0
    assert token_files.read_span(spark, str(tmp_path / "t"), 0, 9).count() == 0


@pytest.mark.parametrize("encoding, used", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_files(spark, tmp_path, encoding, used):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, PATH, by_words=True, encoding=encoding, row_group_bytes=100_000, page_bytes=8192)
    files = [pq.ParquetFile(f) for f in sorted((tmp_path / "t" / "tokens").glob("*.parquet"))]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    columns = {g.column(k).path_in_schema: g.column(k) for g in groups for k in range(g.num_columns)}
    assert len(groups) > len(files)
    assert used in columns["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["first"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in (columns["doc_id"], columns["first"]))
    ids = [g.column(0).statistics for g in groups]  # in order over all groups and files: a filter on ids skips most
    assert all(a.max <= b.min for a, b in zip(ids, ids[1:]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan(token_files.read_documents(spark, path, tokens=False)) and "GreaterThan(doc_id,50)" in plan(token_files.read_documents(spark, path).where("doc_id > 50"))
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(list(r.ids) == ids_of(whole[r.doc_id]) for r in token_files.read_documents(spark, path).collect())


def test_checksums(spark):
    rows = spark.createDataFrame([([1, 2],), ([],), (None,), ([49407],)], "ids array<int>").coalesce(1)
    assert [r[0] for r in rows.select(token_files.ids_crc32(F.col("ids"))).collect()] == [zlib.crc32(np.array([1, 2], "<u4").tobytes()), 0, None, zlib.crc32(np.array([49407], "<u4").tobytes())]
