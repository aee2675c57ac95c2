import json

import pytest

from spanmill.sources import jsonl
from spanmill.streaming import segment, shuffle


def test_marked_and_span_records(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({"text": "Oné.<|sentence|> Two.<|paragraph|> tail"}) + "\n\n")
    row = jsonl.read_marked(spark, str(path)).first()
    assert row.text == "Oné. Two. tail"
    assert [(s.start, s.end) for s in row.spans] == [(0, 5), (5, 10), (10, 15)] and list(row.markers) == [4, 9]
    other = tmp_path / "b.jsonl"
    good = {"text": "é One. Two.", "spans": [{"label": "Sentence", "start": 7, "end": 11}, {"label": "Sentence", "start": 0, "end": 6}, {"label": "odd", "start": 0, "end": 99}]}
    other.write_text("\n".join([json.dumps(good), json.dumps({"text": "ab", "spans": [{"label": "sentence", "start": 0, "end": 9}]}), "{nope", json.dumps({"text": "x<|sentence|>y"})]))
    records, rejected = jsonl.read_spans(spark, str(other))
    got = {r.text: [(s.label, s.start, s.end) for s in r.spans] for r in records.collect()}
    assert got == {"é One. Two.": [("sentence", 0, 7), ("sentence", 8, 12)], "xy": [("sentence", 0, 1), ("sentence", 1, 2)]}
    assert sorted(r.error for r in rejected.collect()) == ["malformed", "span out of range"]


def test_chunked_stream_equals_batch(spark, tmp_path):
    text = "One is here. Mr. Xi said so. Two is 3.5 there! Is three? E. coli grows. Four. \n\n  Five without end"
    chunks = [(1, k, text[k * 7 : k * 7 + 7], (k + 1) * 7 >= len(text)) for k in range(-(-len(text) // 7))]
    source = str(tmp_path / "in")
    schema = "doc_id long, chunk long, text string, final boolean"
    for part in (chunks[:3], chunks[8:] + chunks[5:6], chunks[3:5], chunks[6:8]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = segment.chunked_sentences(stream).writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.start, r.end, r.value) for r in spark.table("chunked").collect())
    batch = segment.segment_stream(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert got == sorted((r.start, r.end, r.value) for r in batch.collect())


def test_shuffle_buffer(spark, tmp_path):
    schema = "id long, text string, last boolean"
    source = str(tmp_path / "in")
    rows = [(k, None if k % 9 == 0 else f"t{k}", None) for k in range(120)]
    for part in (rows[:50], rows[50:55], rows[55:], [(-1, None, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(name, seed, buffer=7):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = shuffle.shuffled(stream, "id", buffer, seed, 3, "last")
        query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return [(r.shard, r.turn, r.id, r.text) for r in spark.table(name).orderBy("shard", "turn").collect()]

    one, again, other = run("one", 1), run("again", 1), run("other", 2)
    assert one == again != other
    assert sorted(r[2:] for r in one) == sorted(r[2:] for r in other) == [r[:2] for r in rows]
    for shard in range(3):
        ids = [r[2] for r in one if r[0] == shard]
        assert [r[1] for r in one if r[0] == shard] == list(range(len(ids))) and ids != sorted(ids)
    with pytest.raises(ValueError):
        shuffle.shuffled(spark.range(3), "id")
