import json
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from fieldlake.llm import chat, queries, warc
from fieldlake.llm.line_dedup import dedup_lines
from fieldlake.llm.spans import match_spans, running_sums

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{cases.SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, cases.SF)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    got = sorted(str(tuple(r[n] for n in names)) for r in frame.collect())
    assert got == sorted(map(str, cursor.fetchall()))


# ---- lines ----------------------------------------------------------------

def test_lines_of_odd_documents(spark):
    docs = cases.odd_documents(spark)
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    want = cases.line_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(str, got)) == sorted(str((i, n, k, t)) for i, n, k, t in want)


def test_lines_of_no_documents(spark):
    assert dedup_lines(cases.no_documents(spark)).count() == 0


# ---- chat -----------------------------------------------------------------

TRICKY = [
    "", "␛", "␛␛<s>", "<␛s>", "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<<SYS>><</SYS>>", "<s</s>[INST][/INST", "a\nb\n",
    "<|im_end|>", "␛<|im_end|>␛",
]


def test_escapes_are_reversible_and_hide_control_strings(spark):
    rows = spark.createDataFrame([(t,) for t in TRICKY], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in rows.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def test_layouts_are_told_by_their_fields(spark, tmp_path):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "more", "output": "o"},
        {"prompt": "p", "completion": "c", "note": "n"}, {"question": "q", "answer": "a"}, {"prompt": "only"}, {"other": 1},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, records)))
    out = chat.with_turns(spark.read.json(str(tmp_path / "r.jsonl"))).select("layout", "turns_out").collect()
    got = sorted((r.layout, None if r.turns_out is None else [(t.role, t.text) for t in r.turns_out]) for r in out if r.layout != "unknown")
    assert got == [
        ("conversations", [("user", "q"), ("assistant", "a")]), ("instruction", [("user", "i"), ("assistant", "o")]),
        ("instruction_input", [("user", "i\nmore"), ("assistant", "o")]), ("messages", [("system", "s"), ("user", "")]),
        ("prompt_completion", [("user", "p"), ("assistant", "c")]), ("question_answer", [("user", "q"), ("assistant", "a")]),
    ]
    assert sum(r.layout == "unknown" and r.turns_out is None for r in out) == 2


def test_odd_turns_read_back(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, "assistant", "first\n<|im_end|>\n"), (1, 2, None, None), (None, 1, "assistant", "ü␛"),
            *((3, i, "assistant" if i % 2 else "us er\n", f"t{i}<s>") for i in range(300))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.format_digests(chat.formatted(chat.with_turns(chat.gathered(frame), ignore=("conv_id",)))).collect()}
    assert set(out) == {1, None, 3}
    turns = [("assistant", "first\n<|im_end|>\n"), ("user", "q"), ("user", "q"), ("", "")]
    assert out[1].turns_sha256 == cases.sha("".join(f"{r}\n{t}\n" for r, t in turns)) and out[1].n_turns == 4
    assert out[1].loss_sha256 == cases.sha("first\n<|im_end|>\n") and out[1].loss_chars == 17
    assert out[3].loss_sha256 == cases.sha("".join(f"t{i}<s>" for i in range(1, 300, 2))) and out[3].n_turns == 300
    assert chat.format_digests(chat.formatted(chat.with_turns(chat.gathered(frame.limit(0)), ignore=("conv_id",)))).count() == 0


def test_the_learned_text_is_cut_by_the_mask(spark):
    rows = spark.createDataFrame([(1, 0, "user", "question"), (1, 1, "assistant", "a long enough <s> answer")], "conv_id bigint, turn bigint, role string, text string")
    made = chat.formatted(chat.with_turns(chat.gathered(rows), ignore=("conv_id",)))

    def moved(by_start, by_end):
        shift = F.transform("loss_mask", lambda m: F.struct(m["turn"].alias("turn"), (m["start"] + by_start).alias("start"), (m["end"] + by_end).alias("end")))
        return chat.format_digests(made.withColumn("loss_mask", shift)).first()

    assert moved(0, 0).loss_sha256 == cases.sha("a long enough <s> answer")
    assert moved(2, 0).loss_sha256 == cases.sha("long enough <s> answer")
    assert moved(-3, -3).loss_sha256 != moved(0, 0).loss_sha256
    with pytest.raises(Exception, match="mask"):
        moved(7, 7)


def test_running_sums_and_spans(spark):
    values = list(range(1, 700))
    row = spark.createDataFrame([(values, [], "abXcdXX" * 400)], "v array<bigint>, e array<bigint>, t string").select(
        running_sums(F.col("v")).alias("v"), running_sums(F.col("e")).alias("e"), match_spans(F.col("t"), "X+").alias("m")).first()
    assert row.v == [sum(values[:i]) for i in range(len(values))] and row.e == []
    assert [(m.start, m.end) for m in row.m][:3] == [(2, 3), (5, 7), (9, 10)] and len(row.m) == 800


# ---- archives -------------------------------------------------------------

@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_round_trip_and_skipping(spark, tmp_path, compression):
    body = "é" * 300
    pages = spark.createDataFrame(
        [(2, "http://a/\r\nx", body), (1, "http://b", body), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "n", body), (1, "http://b", body)],
        "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(pages).coalesce(1), path, compression=compression, split_bytes="300")
    (tmp_path / "w" / "left-over.warc").write_bytes(b"no record")  # of a task that was lost
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == 7 and {r.target_uri for r in rows} == {"http://a/%0D%0Ax", "http://b", None, "u", "n"}
    by = sorted((str(r.record_id), r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)) for r in rows)
    whole = body.encode()
    assert by[0][1:] == ("response", None, 600, whole) and by[1] == by[0]
    assert by[2][1:] == ("revisit", "<urn:page:1>", 600, b"") and by[-1][0] == "None" and by[-1][1] == "revisit"
    reader = warc._Reader({"path": path})
    splits = reader.partitions()
    assert len(splits) > 1
    assert warc.read_warc(spark, path).filter("record_type = 'revisit' AND target_uri LIKE 'http://a%'").count() == 1
    reader.tests = [("record_type", "in", ("revisit",))]
    assert sum(b.num_rows for s in splits for b in reader.read(s)) == 2
    assert all(r.payload is None for r in warc.read_warc(spark, path, payload="false").collect())


def test_foreign_gzip_and_empty_archives(spark, tmp_path):
    import gzip

    row = dict.fromkeys(warc._ARROW.names) | {"record_type": "response", "record_id": "r", "payload": b"hello", "date": "d"}
    data = warc.record_bytes(row)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc.gz").write_bytes(gzip.compress(data) + gzip.compress(data))
    (tmp_path / "f" / "b.warc").write_bytes(data)
    assert [bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path / "f")).collect()] == [b"hello"] * 3
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_pages(pages).count() == 0


def test_archives_of_several_writers_are_read_whole(spark, tmp_path):
    import gzip

    row = dict.fromkeys(warc._ARROW.names) | {"record_type": "response", "record_id": "r", "payload": b"hello", "date": "d"}
    own = spark.createDataFrame([(i, "u", f"page {i}") for i in range(3)], "page_id bigint, url string, html string")
    warc.write_warc(warc.page_records(own).coalesce(1), str(tmp_path / "own"), compression="gzip")
    mine = b"".join(p.read_bytes() for p in sorted((tmp_path / "own").glob("*.warc.gz")))
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.warc.gz").write_bytes(mine + gzip.compress(warc.record_bytes(row)) * 5 + mine)
    read = warc.read_warc(spark, str(tmp_path / "mixed"))
    assert read.count() == 11 and read.filter("record_id = 'r'").count() == 5
    assert warc.read_warc(spark, str(tmp_path / "mixed"), payload="false").count() == 11
    (tmp_path / "own" / "late.warc.gz").write_bytes(gzip.compress(warc.record_bytes(row)))
    assert warc.read_warc(spark, str(tmp_path / "own")).count() == 3
    assert warc.read_warc(spark, str(tmp_path / "own"), unlisted="true").count() == 4
