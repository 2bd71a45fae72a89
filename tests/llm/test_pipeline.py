"""Every stage of the pipeline against a brute-force version on its own input, and the whole run."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake.llm import bytepairs, packing, secrets
from framelake.llm.shared import cut, scratch, settled
from tests_llm_helpers import frame, model, words
from test_dedup import linked
from test_text import base_counts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    """(input, output) of every stage on the fixture."""
    model("byte_bpe_50k.json")
    docs, out = frame(spark, rows).select(*COLUMNS), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, "").write.parquet(at)
        after = spark.read.parquet(at)
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for _, after in stages[:-1]:
        assert after.columns == COLUMNS


def test_quality_keeps_what_passes(stages):
    before, after = map(rows_of, stages[0])
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not base_counts(r[1])[-1])


def test_one_document_of_each_group_stays(stages):
    before, after = map(rows_of, stages[1])
    group = linked(before, 5, 80)
    want = {r for r in before if r[0] is None or group[r[0]][1] == r[0]}
    assert len(after) == len(set(after)) and set(after) == want


def test_repeated_passages_go(stages):
    before, after = map(rows_of, stages[2])
    raw = {i: (t or "").encode() for i, t, _ in before}
    count: dict[bytes, int] = {}
    for x in raw.values():
        for p in range(len(x) - 399):
            count[x[p:p + 400]] = count.get(x[p:p + 400], 0) + 1
    want = {}
    for i, x in raw.items():
        gone = {q for p in range(len(x) - 399) if count[x[p:p + 400]] > 1 for q in range(p, p + 400)}
        want[i] = bytes(b for q, b in enumerate(x) if q not in gone).decode("utf-8", "ignore")
    assert {i: t for i, t, _ in after} == {i: t for i, t in want.items() if words(t)}


def test_passages_of_over_50_words_go_however_short_they_are(spark):
    own = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(4)]
    passage = " ".join(f"p{j}" for j in range(51))
    fifty = " ".join(f"q{j}" for j in range(50))
    assert len(passage) < 400
    texts = [f"{own[0]} {passage} end", f"{passage}\n{own[1]}", f"{own[2]} {fifty} x", f"{own[3]} {fifty} y"]
    after = dict((i, t) for i, t, _ in rows_of(corpus_pipeline.without_repeats(spark, frame(spark, [(i, t, "h") for i, t in enumerate(texts)]).select(*COLUMNS), "")))
    assert after == {0: f"{own[0]}  end", 1: f"\n{own[1]}", 2: texts[2], 3: texts[3]}


def test_secrets_are_masked_and_all_documents_stay(stages):
    before, after = map(rows_of, stages[3])
    want = {i: secrets.redact(t, secrets._spans([t])[0], "[secret]") for i, t, _ in before}
    assert {i: t for i, t, _ in after} == want
    assert all(r.n_chars == len(r.text) for r in stages[3][1].collect())


def test_packing_holds_every_token_once(stages):
    before, after = stages[4]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    for i in {r.doc_id for r in pieces}:
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:n]) for n in range(len(mine))] and sum(r.length for r in mine) == mine[0].doc_tokens


def test_whole_run_equals_its_stages(spark, rows, stages, tmp_path):
    frame(spark, rows).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(json.dumps(r.asDict()) for r in got.collect()) == sorted(json.dumps(r.asDict()) for r in stages[-1][1].collect())
    frame(spark, []).select(*COLUMNS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def written(spark):
    return {str(p.parent) for p in Path(scratch(spark).removeprefix("file://")).glob("cut-*/_SUCCESS")}


def test_settled_tables_leave_only_themselves(spark):
    before = written(spark)
    outer = settled(spark, lambda: cut(settled(spark, lambda: cut(spark.range(9)).where("id > 3"))).where("id > 6"))
    assert sorted(r.id for r in outer.collect()) == [7, 8] and len(written(spark) - before) == 1
    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: 1 // 0)
    kept = cut(spark.range(2))
    assert settled(spark, lambda: kept).count() == kept.count() == 2


def test_stages_delete_what_they_no_longer_read(spark, rows):
    docs = frame(spark, rows).select(*COLUMNS)
    for stage, most in ((corpus_pipeline.one_of_each_group, 1), (corpus_pipeline.without_repeats, 2)):
        before = written(spark)
        out = stage(spark, docs, "")
        assert len(written(spark) - before) <= most and out.count()


def test_packing_places_each_document_once_and_drops_its_encoder(spark, rows):
    packed = packing.pack(frame(spark, rows).select(*COLUMNS), model("byte_bpe_50k.json"))
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    bytepairs.encoder(model("byte_bpe_50k.json"))
    list(packing._pieces(2048)(iter([])))
    assert not bytepairs.encoder.cache_info().currsize
