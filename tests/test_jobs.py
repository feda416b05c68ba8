"""Context and prompts, gate and resumable scoring, run specifications, the streaming job."""

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit import schemas
from assaykit.operators import context as C
from assaykit.operators import scoring as S
from assaykit.operators import text
from assaykit.operators.images import batch_encoder, embed
from assaykit.operators.reports import expected_items, refusal_audit, refusal_records
from assaykit.operators.text import encode
from assaykit.plans.evaluation import retrieval_decision
from assaykit.plans.runs import RunSpec, experiment_grid, resolve_mode
from assaykit.session import SHUFFLES_END, cut_lineage, settings, shared_folder
from assaykit.plans.waves import WaveLog, score_in_waves
from assaykit.streaming import incremental
from assaykit.streaming.incremental import score_incrementally
from suite.sources import incremental_scoring

KB = [
    ("EDH", "lens shaped collection between skull and dura"),
    ("SDH", "crescent shaped collection along the convexity"),
    ("SAH", "blood in the sulci and cisterns"),
]


def kb(spark):
    return spark.createDataFrame(KB, "doc_id string, text string")


def test_text_context_is_nearest_first(spark):
    q = spark.createDataFrame([(1, "crescent along the convexity"), (2, "sulci and cisterns")], "query_id long, text string")
    got = {r.query_id: r.context for r in C.build_context(q, "text", C.text_top_k(q, kb(spark), 2)).collect()}
    assert got[1].startswith(V.TEXT_CONTEXT_HEADER + "\n- crescent") and got[1].count("\n- ") == 2
    assert got[2].split("\n")[1] == "- blood in the sulci and cisterns"
    whole = C.build_context(q, "text", C.text_top_k(q, kb(spark), 5))
    assert all(r.context.count("\n- ") == 3 for r in whole.collect())


def test_providers(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    assert C.build_context(q, "none").first().context == ""
    with pytest.raises(ValueError):
        C.build_context(q, "web")
    with pytest.raises(ValueError):
        C.build_context(q, "image")


def test_texts_without_terms_encode_to_zero(spark):
    df = spark.createDataFrame([(1, "..."), (2, None), (3, "a a b")], "i int, text string")
    got = {r.i: np.array(r.embedding) for r in encode(df).collect()}
    assert not got[1].any() and not got[2].any() and abs(np.linalg.norm(got[3]) - 1) < 1e-6


def test_few_shot_messages(spark):
    q = spark.createDataFrame([("q.png",), ("lonely.png",)], "query_id string")
    pool = spark.createDataFrame([("a.png", "A"), ("b.png", "B")], "pool_id string, label_text string")
    chosen = spark.createDataFrame([("q.png", "b.png", 1), ("q.png", "a.png", 2)], "query_id string, pool_id string, slot int")
    ctx = C.build_context(q, "image", chosen, pool)
    chat = {r.query_id: r.chat for r in ctx.withColumn("chat", C.few_shot_messages(F.col("query_id"), F.col("exemplars"), "ask", "sys")).collect()}
    assert [m.role for m in chat["q.png"]] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert [m.content[0].image for m in chat["q.png"] if m.role == "user"] == ["b.png", "a.png", "q.png"]
    assert [m.content[0].text for m in chat["q.png"] if m.role == "assistant"] == ["B", "A"]
    assert [m.role for m in chat["lonely.png"]] == ["system", "user"]
    bare = ctx.select(C.few_shot_messages(F.col("query_id"), F.col("exemplars"), "ask").alias("chat"), "query_id").filter("query_id = 'lonely.png'").first()
    assert [m.role for m in bare.chat] == ["user"]


def test_system_prompt(spark):
    got = spark.createDataFrame([("",), ("ctx",), (None,)], "c string").select(C.system_prompt("base", F.col("c")).alias("p")).collect()
    assert [r.p for r in got] == ["base", "base\n\nctx", "base"]


def test_two_stage_uses_each_images_own_findings(spark):
    f = spark.createDataFrame([("a", " lens between skull and dura "), ("b", "blood in cisterns")], "query_id string, stage1_findings string")
    got = {r.query_id: r.context for r in C.two_stage_context(f, kb(spark), 1).collect()}
    assert "lens shaped" in got["a"] and "blood in" in got["b"]


# -- scoring ------------------------------------------------------------------


def fake_model():
    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        assert not batch["image_file"].str.startswith("forbidden").any()
        return pd.DataFrame({"raw_text": ["HEMORRHAGE: yes\nSUBTYPES: SDH"] * len(batch), "n_tokens": 7})

    return answer


def manifest(spark, names):
    return spark.createDataFrame([(n, 1, i) for i, n in enumerate(names)], "image_file string, patient int, slice int")


def test_finished_rows_never_reach_the_model(spark):
    m = manifest(spark, ["a", "b", "forbidden1", "forbidden2"])
    done = manifest(spark, ["forbidden1", "forbidden2"])
    rows = S.resume_scoring(m, done, fake_model, "r").collect()
    assert {r.image_file for r in rows} == {"a", "b"}
    assert all((r.run, r.pred_any_hem, r.pred_SDH, r.pred_IPH, r.n_tokens, r.method) == ("r", 1, 1, 0, 7, "structured") for r in rows)
    assert S.resume_scoring(m.filter("image_file < 'c'"), None, fake_model, "r", partitions=3).count() == 2


def test_blocked_rows_skip_scoring(spark):
    answers = spark.createDataFrame([("a", "Yes"), ("forbidden", "NO."), ("c", "unclear"), ("d", None)], "image_file string, gate_answer string")
    passed, blocked = S.gate(answers)
    assert {r.image_file for r in S.score(passed, fake_model).collect()} == {"a", "c", "d"}
    assert [(r.image_file, r.raw_text) for r in blocked.collect()] == [("forbidden", V.GATE_REFUSAL_TEXT)]


def test_refusal_records_and_audit(spark):
    valid = spark.createDataFrame([("a", 1), ("b", 0)], "image_file string, any_hemorrhage int")
    cats = spark.createDataFrame([("x.png",)], "image_file string")
    answers = spark.createDataFrame([("a", "Objective Findings Impression"), ("b", "sorry"), ("cats/x.png", "This is a cat.")], "image_file string, raw_text string")
    rec = refusal_records(expected_items(valid, {"cats": cats}), answers)
    assert {(r.image_file, r.got, r.ok) for r in rec.collect()} == {("a", "answered", True), ("b", "refused", False), ("cats/x.png", "refused", True)}
    assert {(r.label, r.n, r.n_mismatch) for r in refusal_audit(rec).collect()} == {("answered", 1, 0), ("refused_other", 2, 1)}


def test_batch_encoder(spark):
    def make():
        return lambda x: x * 2.0

    df = spark.createDataFrame([("a", [3.0, 4.0])], "image_file string, pixels array<float>")
    got = embed(df, batch_encoder(make, 4, [2])).first().embedding
    assert np.allclose(got, [0.6, 0.8])


# -- plans --------------------------------------------------------------------


def test_modes_and_specs(spark):
    assert resolve_mode() == "none" and resolve_mode(two_stage=True) == "text-twostage" and resolve_mode(image=True) == "image"
    assert resolve_mode(image=False, default_image=True) == "none"
    with pytest.raises(ValueError):
        resolve_mode(two_stage=True, default_image=True)
    with pytest.raises(ValueError):
        RunSpec("x", context="web")
    with pytest.raises(ValueError):
        experiment_grid(spark.range(1), [RunSpec("x"), RunSpec("x")])
    assert experiment_grid(spark.range(3), [RunSpec("x"), RunSpec("y", k=5)]).count() == 6


def test_decision_retries_once_after_matching(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = spark.createDataFrame([(i, v[i].tolist(), [str(i % 2)]) for i in range(20)], "query_id long, embedding array<float>, labels array<string>")
    p = spark.createDataFrame([(i, v[20 + i].tolist(), [str(i % 2)], [i % 4] * 4) for i in range(20)], "pool_id long, embedding array<float>, labels array<string>, pixels array<int>")
    ref = spark.createDataFrame([([0, 1, 2, 3],)], "pixels array<int>")
    good = q.select(F.col("embedding").alias("e"), F.col("labels").alias("l"))

    def embed_matched(pool):
        # as if matching made every pool image look like the query with its label
        best = {r.l[0]: r.e for r in good.collect()}
        return pool.withColumn("embedding", F.when(F.col("labels")[0] == "0", F.array(*map(F.lit, best["0"]))).otherwise(F.array(*map(F.lit, best["1"]))).cast("array<float>"))

    hopeless = p.withColumn("labels", F.array(F.lit("none")))
    # nothing matches: real 0 >= null 0 passes at once
    assert retrieval_decision(q, hopeless, embed_matched, ref, 5, 50)["decision"] == "B"
    out = retrieval_decision(q, p, embed_matched, ref, 5, 200)
    assert out["decision"] in ("B", "C") and out["histogram_matched"] == (not out["passed"])


def test_checkpoint_folder_is_the_sessions(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder == shared_folder(spark)
    assert cut_lineage(spark.range(5)).count() == 5


def test_scoring_frees_its_frames_piece_by_piece(spark):
    def make():
        import weakref

        seen = []

        def answer(batch):
            column = batch["text"]
            length = column.str.len()  # the accessor makes the column hold itself
            seen.append(weakref.ref(column))
            alive = sum(r() is not None for r in seen)
            return pd.DataFrame({"raw_text": [f"{len(batch)} {alive}"] * len(batch), "n_tokens": length})

        return answer

    work = spark.range(4500).repartition(1).select(F.col("id").alias("image_file"), F.lit("some text").alias("text"))
    got = S.score(work, make).collect()
    assert sorted(r.image_file for r in got) == list(range(4500)) and {r.n_tokens for r in got} == {9}
    rows, alive = zip(*(map(int, r.raw_text.split()) for r in got))
    assert max(rows) <= S.PIECE and max(alive) <= 2


def test_terms_are_counted_in_steps(monkeypatch):
    monkeypatch.setattr(text, "STEP", 7)
    lists = [[], [1, 1, 3], [], [0] * 20, [2], [], [3, 2, 1, 0, 3], []]
    got = text.slot_counts(pa.array(lists, pa.list_(pa.int32())), 4)
    assert got.tolist() == [[float(x.count(k)) for k in range(4)] for x in lists]
    assert text.slot_counts(pa.array([[9], *lists], pa.list_(pa.int32())).slice(1), 4).tolist() == got.tolist()
    assert text.slot_counts(pa.array([[], []], pa.list_(pa.int32())), 4).tolist() == [[0.0] * 4] * 2


# -- streaming ----------------------------------------------------------------


def write_answers(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"run": r, "image_file": k, "raw_text": t, "gen_seconds": 1.0, "n_tokens": 3}) + "\n" for r, k, t in rows))


def test_stream_adds_each_key_once(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    yes = "HEMORRHAGE: yes\nSUBTYPES: IPH"
    write_answers(src, "1.json", [("r", "a", yes), ("r", "a", yes), ("r", "b", "HEMORRHAGE: no")])
    score_incrementally(spark, str(src), sink, state).awaitTermination()
    write_answers(src, "2.json", [("r", "b", yes), ("r", "c", yes), ("s", "a", yes)])
    score_incrementally(spark, str(src), sink, state, files_per_batch=1).awaitTermination()
    rows = {(r.run, r.image_file): r.pred_any_hem for r in spark.read.parquet(sink).collect()}
    assert rows == {("r", "a"): 1, ("r", "b"): 0, ("r", "c"): 1, ("s", "a"): 1}
    assert spark.read.parquet(sink).count() == 4


def test_last_answer_of_a_batch_counts_and_earlier_batches_are_settled(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    yes, no = "HEMORRHAGE: yes\nSUBTYPES: IPH", "HEMORRHAGE: no"
    write_answers(src, "1.json", [("r", f"i{i}", no) for i in range(50)] + [("r", f"i{i}", yes) for i in range(0, 50, 2)] + [("r", None, yes)])
    score_incrementally(spark, str(src), sink, state).awaitTermination()
    write_answers(src, "2.json", [("r", f"i{i}", yes) for i in range(60)])
    score_incrementally(spark, str(src), sink, state).awaitTermination()
    got = {r.image_file: r.pred_any_hem for r in spark.read.parquet(sink).collect()}
    assert got == {f"i{i}": int(i % 2 == 0 or i >= 50) for i in range(60)}


def test_settled_keys_are_looked_up_without_a_python_call_for_each(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write_answers(src, "1.json", [("r", f"i{i % 700}", f"HEMORRHAGE: {'yes' if i >= 700 else 'no'}") for i in range(1400)])
    job = score_incrementally(spark, str(src), sink, state)
    job.awaitTermination()
    assert [o["operatorName"] for o in job.recentProgress[0]["stateOperators"]] == ["dedupe"]
    got = spark.read.parquet(sink).collect()
    assert len(got) == 700 and all(r.pred_any_hem == 1 for r in got)


def test_the_last_answer_is_found_where_texts_wait_in_a_file(monkeypatch):
    monkeypatch.setattr(incremental, "HELD_BYTES", 100)
    # (run, image, text, time, file, block, line); batches don't come in ingest order
    rows = [("r", "a", "x", 2, "f", 0, 9), ("r", "b", "x", 1, "f", 0, 0), ("s", "a", "x", 1, "f", 0, 1), ("r", "a", "y", 1, "g", 0, 9),
            ("r", "b", "y", 1, "g", 0, 0), ("s", "a", None, 1, "f", 0, 2), ("r", "b", "z", 1, "f", 7, 5)]
    names = ["run", "image_file", "raw_text", "time", "file", "block", "line"]
    whole = pa.table(dict(zip(names, zip(*rows)))).set_column(3, "time", pa.array([r[3] for r in rows], pa.timestamp("us", "UTC")))
    for size in (1, 2, 7):
        out = list(incremental._last(names[:3])(iter(whole.to_batches(max_chunksize=size))))
        got = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
        assert got == [("r", "a", "x"), ("r", "b", "y"), ("s", "a", None)]
    assert list(incremental._last(names[:3])(iter([]))) == []


def test_batches_never_read_the_sink(spark, tmp_path):
    src, sink, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    write_answers(src, "1.json", [("r", f"i{i}", "HEMORRHAGE: no") for i in range(200)])
    score_incrementally(spark, str(src), str(sink), state).awaitTermination()
    for f in sink.rglob("*.parquet"):
        f.write_bytes(b"not readable")  # whoever reads what is stored fails
    for batch in range(2, 5):
        write_answers(src, f"{batch}.json", [("r", "i7", "HEMORRHAGE: yes"), ("r", f"new{batch}", "HEMORRHAGE: yes")])
        job = score_incrementally(spark, str(src), str(sink), state)
        job.awaitTermination()
        assert sum(p["numInputRows"] for p in job.recentProgress) == 2
    assert {f.name for f in sink.iterdir()} >= {"run=r", "_spark_metadata"}


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    write_answers(src, "1.json", [("r", "a", "HEMORRHAGE: no"), ("r", "b", "HEMORRHAGE: no")])
    score_incrementally(spark, str(src), sink, str(state)).awaitTermination()
    # a driver lost after the batch was written, before it was marked as done
    for f in [*(state / "commits").glob("[0-9]*"), *(state / "commits").glob(".[0-9]*")]:
        f.unlink()
    score_incrementally(spark, str(src), sink, str(state)).awaitTermination()
    assert sorted(r.image_file for r in spark.read.parquet(sink).collect()) == ["a", "b"]


def test_texts_are_packed_one_by_one_and_come_back_whole(monkeypatch):
    monkeypatch.setattr(incremental, "PIECE_BYTES", 10)
    texts = ["a" * 5000, None, "", "\u00e9\U0001f600\n\x00", "b", "c" * 9, None, ""]
    n = len(texts)
    whole = pa.table({"run": ["r"] * n, "image_file": [f"i{i}" for i in range(n)], "raw_text": texts, "gen_seconds": [1.5] * n, "n_tokens": pa.array(range(n), pa.int32())})
    for size in (1, 3, n):
        packed = list(incremental._packed(iter(whole.to_batches(max_chunksize=size))))
        rows = [r for b in packed for r in b.to_pylist()]
        assert "raw_text" not in rows[0] and [r["line"] for r in rows] == list(range(n))
        assert len(rows[0]["packed"]) < 100 and rows[1]["packed"] is None and rows[0]["n_bytes"] == 5000
        back = list(incremental._unpacked(iter(packed)))
        assert pa.Table.from_batches(back).select(whole.column_names).equals(whole)
        assert back[0].schema.names == schemas.ANSWERS.names
        # a piece ends with the text that fills it
        assert all(sum(len((t or "").encode()) for t in b.column("raw_text").to_pylist()[:-1]) < 10 for b in back)


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def test_a_batch_leaves_no_shuffle_files_and_a_packed_sink(spark, tmp_path):
    src, sink = tmp_path / "in", tmp_path / "out"
    write_answers(src, "1.json", [("r", f"i{i}", f"HEMORRHAGE: no\n{i}") for i in range(500)])
    before = shuffle_files(spark)
    score_incrementally(spark, str(src), str(sink), str(tmp_path / "state")).awaitTermination()
    assert not shuffle_files(spark) - before
    assert {r.raw_text for r in spark.read.parquet(str(sink)).collect()} == {f"HEMORRHAGE: no\n{i}" for i in range(500)}
    for f in sink.rglob("part-*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        assert {group.column(i).compression for i in range(group.num_columns)} == {"ZSTD"}


def test_settings_hold_for_a_while(spark):
    (key,) = SHUFFLES_END
    for start in (None, "false"):
        spark.conf.unset(key) if start is None else spark.conf.set(key, start)
        with pytest.raises(KeyError), settings(spark, SHUFFLES_END):
            assert spark.conf.get(key) == "true"
            raise KeyError
        assert spark.conf.get(key, None) == start
    spark.conf.unset(key)


def test_incremental_scoring_stores_less_than_its_texts_four_times_over(spark, tmp_path):
    draw = np.random.default_rng(0)
    words = ["".join(draw.choice(list("aeinorst"), 6)) for _ in range(5000)]
    texts = [" ".join(draw.choice(words, 500)) for _ in range(300)]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(Path(shared_folder(spark)).iterdir())
    out = incremental_scoring(spark, str(tmp_path))
    assert sorted((r.run, r.image_file) for r in out.collect()) == sorted((r, f"img_{i}.png") for r in ("007", "010", "text") for i in range(300))
    stored = [f for d in set(Path(shared_folder(spark)).iterdir()) - before for f in d.rglob("part-*")]
    # four copies of the texts in answer files, three in the sink; before, the answer files alone held more
    assert sum(f.stat().st_size for f in stored) < 4 * sum(map(len, texts))


# -- waves --------------------------------------------------------------------


def counting_model(folder, broken=()):
    def make():
        def answer(batch):
            for k in batch["image_file"]:
                if k in broken:
                    raise RuntimeError("gone")
                with open(f"{folder}/asked", "a") as f:
                    f.write(f"{k}\n")
            return pd.DataFrame({"raw_text": ["HEMORRHAGE: yes\nSUBTYPES: SDH"] * len(batch), "n_tokens": 7})

        return answer

    return make


def test_waves_keep_what_is_committed(spark, tmp_path):
    names = [f"img{i}" for i in range(40)]
    m, log = manifest(spark, names), str(tmp_path / "run")
    with pytest.raises(Exception, match="gone"):
        score_in_waves(m, counting_model(tmp_path, broken={"img11"}), "r", log, wave_rows=10)
    held = WaveLog(spark, log)
    kept = {r.image_file for r in held.records().collect()} if held.records() else set()
    assert len(held.entries()) < 4 and "img11" not in kept
    (tmp_path / "asked").write_text("")
    committed = []
    got = score_in_waves(m, counting_model(tmp_path), "r", log, wave_rows=7, on_commit=committed.append)
    assert sorted(r.image_file for r in got.collect()) == sorted(names)
    assert not kept & set((tmp_path / "asked").read_text().split())
    assert sum(e["rows"] for e in committed) == 40 - len(kept)
    # a longer manifest asks for the new images only; nothing left asks for none
    (tmp_path / "asked").write_text("")
    more = score_in_waves(manifest(spark, [*names, "new"]), counting_model(tmp_path), "r", log)
    assert more.count() == 41 and (tmp_path / "asked").read_text().split() == ["new"]
    assert score_in_waves(m.limit(0), counting_model(tmp_path), "r", str(tmp_path / "none")).count() == 0


def test_a_lost_attempt_is_not_read_and_records_are_not_overwritten(spark, tmp_path):
    log = WaveLog(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "attempt-lost"))
    assert log.records() is None and log.entries() == []
    spark.range(2).write.parquet(str(tmp_path / "attempt-a"))
    log.commit("attempt-a", 2, 0)
    assert log.records().count() == 2 and log.entries() == [{"number": 0, "attempt": "attempt-a", "rows": 2}]
    with pytest.raises(RuntimeError, match="another job"):
        log.commit("attempt-lost", 3, 0)
    assert log.records().count() == 2


# -- whole scoring runs -------------------------------------------------------


def test_gated_few_shot_run(spark):
    from assaykit.plans.scoring import gated_few_shot_run

    q = spark.createDataFrame([("a", "ct"), ("forbidden", "cat"), ("b", "ct")], "image_file string, kind string")
    pool = spark.createDataFrame([("p1", "HEMORRHAGE: yes\nSUBTYPES: SAH")], "pool_id string, label_text string")

    def gate_model():
        return lambda b: pd.DataFrame({"raw_text": np.where(b["kind"] == "ct", "YES", "NO"), "n_tokens": 1})

    def model():
        def answer(b):
            assert not b["image_file"].str.startswith("forbidden").any()
            copied = [next(m["content"][0]["text"] for m in chat if m["role"] == "assistant") for chat in b["chat"]]
            return pd.DataFrame({"raw_text": copied, "n_tokens": 2})

        return answer

    def choose(work):
        return work.select("image_file", F.lit(1).alias("slot"), F.lit("p1").alias("pool_id"))

    got = {r.image_file: r for r in gated_few_shot_run(q, choose, pool, gate_model, model, "r", "ask").collect()}
    assert got["a"].pred_SAH == 1 and got["b"].pred_any_hem == 1
    assert got["forbidden"].raw_text == V.GATE_REFUSAL_TEXT and got["forbidden"].n_tokens == 0


def test_exemplar_grid_runs_every_setting(spark):
    from assaykit.plans.retrieval import exemplar_grid

    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4)).tolist(), i % 2) for i in range(30)]
    unit = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), c) for i, v, c in rows]
    q = spark.createDataFrame(unit[:10], "query_id long, embedding array<float>, any_hemorrhage int")
    p = spark.createDataFrame(unit[10:], "pool_id long, embedding array<float>, any_hemorrhage int")
    specs = [
        RunSpec("plain", "image", k=4), RunSpec("random", "image", k=2, random=True), RunSpec("con", "image", contrastive=True),
        RunSpec("soft", "image", contrastive=True, random_neg=True), RunSpec("text", "text"),
    ]
    counts = {r.run: r["count"] for r in exemplar_grid(q, p, specs).groupBy("run").count().collect()}
    assert counts == {"plain": 40, "random": 20, "con": 30, "soft": 30}
