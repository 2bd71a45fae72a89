"""What must not grow with a table: broadcasts, sorted cells, batches of a worker."""

import numpy as np

from framelake import queries
from framelake.operators import events, packed
from framelake.sources import bitstream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_display_is_drawn_without_joins_or_sorted_cells(spark):
    text = plan(queries.QUERIES["g23_trainer"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in text and "SortAggregate" not in text and "HashAggregate" in text


def test_resampled_pixels_are_never_broadcast(spark):
    df = queries.QUERIES["g09_resize_planes_cubic"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    joins = [line for line in final.splitlines() if "Join" in line and "sy#" in line]
    assert len(joins) == 3 and all("SortMergeJoin" in line for line in joins)  # one for each plane


def test_a_finger_at_just_the_limit_is_not_open(spark):
    at = {6: (4, 22), 8: (11, 22)}  # squares 500 and 605, 1.21 times as much
    hand = spark.createDataFrame([(0, j, *at.get(j, (0, 0))) for j in range(21)], "hand long, joint int, x int, y int")
    assert [r.pointing for r in events.hand_shape(hand).collect()] == [False]


def test_units_are_handed_on_in_bounded_batches(spark, monkeypatch):
    payload = b"\0\0\1ab" * 20_000
    df = spark.createDataFrame([(1, bytearray(payload)), (2, None), (3, bytearray(b"\0\0\1x"))], "id long, payload binary").coalesce(1)
    made = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: made.append((self, run)) or self)
    bitstream._explode(df, "id", "payload", bitstream._units)
    monkeypatch.undo()
    (rows, run), = made
    batches = list(run(rows.toArrow().to_batches()))
    assert max(b.num_rows for b in batches) <= bitstream.UNITS and sum(b.num_rows for b in batches) == 20_001
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_passes_over_frames_share_a_worker(spark):
    for name in ("g21_interleaved", "g21_back", "n07_background_blur"):
        assert plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1


def test_blur_of_small_frames_takes_each_place_once(monkeypatch):
    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += isinstance(at, tuple)
            return super().__getitem__(at)
    p = np.random.default_rng(1).integers(0, 256, (3, 8, 8, 1), np.uint8)
    small = packed.background_blur(0.5, 0.5)(p.view(Counted))
    assert Counted.reads == 0
    assert small.shape == p.shape


def test_line_items_take_more_parts_instead_of_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(queries, "PART_ROWS", 100)
    text = plan(queries.QUERIES["m04_gaze"](spark, "/root/testdata/sf0.001"))
    assert ", 60), REPARTITION_BY_NUM" in text and ", 4), ENSURE_REQUIREMENTS" not in text
