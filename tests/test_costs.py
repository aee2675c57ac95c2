"""What a query may work out only once, and what may be a row: costs that grew faster than the input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmill.functions import text as T
from spanmill.operators import candidates as C
from spanmill.operators import models as M
from spanmill.operators import spans as R
from spanmill.plans import catalogue, segmenter
from spanmill.plans.pipeline import Pipeline
from spanmill.operators import features as X

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", ["silver_labels", "segment_bundle"])
def test_exploded_arrays_are_worked_out_once(spark, name):
    found = plan(catalogue.queries()[name](spark, SF))
    assert found.count("split(text#") == 1, found


def test_spans_of_a_query_are_worked_out_once(spark):
    assert plan(catalogue.queries()["render_strict"](spark, SF)).count("split(text#") == 1
    assert "Join" not in plan(catalogue.queries()["render_strict"](spark, SF))


def test_scores_ask_for_features_once(spark):
    values = F.array(F.rand(1), F.rand(2))
    out = spark.range(3).select(M.logistic(values, [1.0, 2.0], 0.5).alias("score")).where("score >= 0.5")
    assert str(plan(spark.range(3).select(M.logistic(F.array(F.sqrt("id"), F.lit(1.0)), [1.0, 2.0], 0.5).alias("s")))).count("SQRT") == 1
    assert out.columns == ["score"]


def test_pipeline_cuts_only_what_its_blocks_look_at():
    assert Pipeline().with_block("n", X.ascii_neighbours).around == ("left", "right")
    assert Pipeline().with_block("n", X.boundary_shape).around == X.EVERYTHING


def test_tokens_go_on_over_matches(spark):
    token = lambda s: tuple(s["token"])
    (row,) = docs(spark, "Say U.S.A.! e.g.1.x ").select(T.locate("text", "[.!?]", ("token",)).alias("s")).collect()
    assert [token(s) for s in row.s] == [(0, 1, 1, True), (1, 2, 2, True), (2, 3, 3, True), (3, 3, 3, True), (0, 1, 0, False), (1, 2, 0, False), (2, 2, 0, False)]


def test_sampled_positions_of_a_column_need_no_shuffle(spark):
    texts = docs(spark, "Ünö. Two!" * 9, "", None, "abc")
    ends = F.array(F.lit(6).cast("long"), F.lit(1).cast("long"), F.lit(999).cast("long"))
    rows = C.sampled_positions(texts, ends, 5)
    assert "Join" not in plan(rows) and "Window" not in plan(rows)
    edges = texts.select("doc_id", F.explode(ends).alias("position"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rows) == key(C.sampled_positions(texts, edges, 5))
    assert (0, 6) in key(rows) and (0, 1) not in key(rows) and len(key(rows)) == 5 + 1 + 1 + 4  # 1 is inside a letter


def test_positions_at_ends_of_spans(spark):
    places = spark.createDataFrame([(1, p) for p in range(0, 9)], "doc_id long, position long")
    spans = spark.createDataFrame([(1, 1, 4, False, False), (1, 5, 5, False, False), (1, 6, 8, True, True)], "doc_id long, start long, end long, left_open boolean, right_open boolean")
    got = {r.position: (r.inside, r.starts, r.ends) for r in R.position_targets(places, spans).collect()}
    assert got == {0: (0, 0, 0), 1: (1, 1, 0), 2: (1, 0, 0), 3: (1, 0, 0), 4: (0, 0, 1), 5: (0, 1, 1), 6: (1, 0, 0), 7: (1, 0, 0), 8: (0, 0, 0)}
    assert plan(R.position_targets(places, spans)).count("Join") == 2


def test_few_spans_are_python_objects_at_a_time(monkeypatch):
    monkeypatch.setattr(R, "SLICE", 4)
    lists = [[1] * 2, None, [1] * 9, [], [1], [2]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists)], ["doc_id", "spans"])
    parts = [p.column(0).to_pylist() for p in R._slices(batch, 1)]
    assert sum(parts, []) == list(range(6)) and parts == [[0, 1], [2], [3, 4], [5]]


def test_long_blocks_are_not_read_again_for_each_line(spark):
    import time

    seconds = []
    for lines in (10, 1_000, 10_000):
        table = docs(spark, "- first of a list\n" + "this line goes on and on\n" * lines + "\nKey: value\n")
        began = time.perf_counter()
        rows = C.blocks(table).select("block", "start", "end", "value").collect()
        seconds.append(time.perf_counter() - began)
        assert [(r.block, r.start, r.end) for r in rows] == [(0, 0, 18 + 25 * lines), (1, 18 + 25 * lines + 1, 18 + 25 * lines + 12)]
        assert rows[1].value == "Key: value\n" and len(rows[0].value) == 18 + 25 * lines
    assert seconds[2] < 20 * seconds[1] + 3, seconds


def test_sentence_edges_at_a_threshold(spark):
    rows = segmenter.sentences(docs(spark, "One here. Two there."), values=False).collect()
    assert [(r.start, r.end) for r in rows] == [(0, 9), (10, 20)]


def test_scans_copy_no_element_for_each_that_follows(spark):
    import itertools
    import time

    kind = "struct<a:bigint,b:string>"
    plus = lambda s, x: (s + x, F.struct((s + x).alias("a"), F.lit("b").alias("b")))
    seconds = []
    for n in (0, 1, 16, 17, 256, 4_097, 3_000, 30_000):
        items = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        began = time.perf_counter()
        found = spark.range(1).select(T.scan(items, F.lit(0).cast("bigint"), plus, kind).alias("s")).first().s
        seconds.append(time.perf_counter() - began)
        assert [x.a for x in found] == list(itertools.accumulate(range(1, n + 1)))
    assert seconds[-1] < 15 * seconds[-2] + 1, seconds
    assert spark.range(1).select(T.scan(F.lit(None).cast("array<int>"), F.lit(0).cast("bigint"), plus, kind).alias("s")).first().s is None
