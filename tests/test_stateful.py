"""Streams with keyed state and byte offsets: restarts, replays, deadlines."""

import json
import random
import time

import pytest

from tracelake.operators import judgement
from tracelake.streaming import appended, capture, stateful


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_an_empty_first_batch(spark, tmp_path):
    """A sink whose first epochs hold nothing goes on with the next."""
    out, write = str(tmp_path / "s"), capture.upsert_into(str(tmp_path / "s"))
    rows = spark.createDataFrame([("r1", "h", "s", 10)], "receipt_id string, host string, session_id string, n_bytes long")
    for epoch, batch in enumerate([rows.limit(0), rows.limit(0), rows, rows.limit(0), rows.limit(0)]):
        write(batch, epoch)
    write(spark.createDataFrame([("r2", "h", "s", 30)], rows.schema), 5)
    assert [(r.receipt_id, r.notices) for r in capture.state(spark, out).collect()] == [("r2", 2)]


def run(df, tmp_path, name, seconds=None, **more):
    """Runs the stream into Parquet until all is done (or for some seconds)."""
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    q = q.trigger(**(more or {"availableNow": True})).start()
    q.awaitTermination(seconds) if seconds else q.awaitTermination()
    q.stop()


def test_appended_lines(spark, tmp_path):
    """Each whole line once, over restarts, with tails that wait and ranges that cut lines."""
    folder = tmp_path / "logs" / "a"
    folder.mkdir(parents=True)
    rng, want = random.Random(1), {}
    for turn in range(4):
        for name in ("x.jsonl", "y.jsonl", "other.txt"):
            with open(folder / name, "ab") as f:
                if turn == 2:
                    f.write(b" 1}\n")
                for _ in range(rng.randrange(0, 6)):
                    f.write(json.dumps({"n": rng.randrange(99), "é": "y" * rng.randrange(0, 90)}).encode() + rng.choice([b"\n", b"\n\n", b"\r\n"]))
                if turn == 1:
                    f.write(b'{"half":')
        run(appended.lines(spark, f"file://{tmp_path}/logs", ".jsonl", 37), tmp_path, "lines")
        rows = spark.read.parquet(str(tmp_path / "lines-out")).collect()
        for name in ("x.jsonl", "y.jsonl"):
            data = (folder / name).read_bytes()
            whole = data[: data.rfind(b"\n") + 1]
            got = sorted((r.start, r.stop, r.line) for r in rows if r.path.endswith(name))
            at, want = 0, []
            for line in whole.split(b"\n")[:-1]:
                want.append((at, at + len(line) + 1, line.decode()))
                at += len(line) + 1
            assert got == want
    state = {r.path[-7:]: r for r in appended.progress(spark.read.parquet(str(tmp_path / "lines-out"))).collect()}
    for name, r in state.items():
        data = (folder / name).read_bytes()
        assert (r.complete_size, r.n_records, r.malformed) == (len(data), sum(bool(x.strip()) for x in data.split(b"\n")), False)


def test_no_byte_is_read_twice(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs" / "z"
    log.write_bytes(b"one\ntwo\nthr")
    reader = appended.Reader({"path": f"file://{tmp_path}/logs"})
    first = reader.latestOffset()
    log.write_bytes(b"one\ntwo\nthree\n")
    second = reader.latestOffset()
    assert list(first.values()) == [8] and [(p.start, p.stop) for p in reader.partitions(first, second)] == [(8, 14)]
    assert reader.partitions(second, second) == [] and reader.partitions(second, first) == []


OPS = "run string, ord long, op string, code string, args array<string>"


def test_evolution_over_restarts(spark, tmp_path):
    """Stopped and started again, out of order and with repeats: the batch fold's codes, each operation once."""
    rng, runs = random.Random(4), {}
    for r in range(6):
        codes, ops = [], []
        for i in range(12):
            op = rng.choice(["append", "append", "split", "merge", "reuse"]) if codes else "append"
            code = f"c{r}_{i}" if op in ("append", "merge") else rng.choice(codes)
            args = [f"s{r}_{i}", f"t{r}_{i}"] if op == "split" else rng.sample(codes, min(2, len(codes))) if op == "merge" else []
            if r == 5 and i == 9:
                op, code, args = "reuse", "never", []
            ops.append((f"r{r}", i, op, code, args))
            codes = stateful.apply(codes, op, code, args) or codes
        runs[f"r{r}"] = ops
    flat = [o for ops in runs.values() for o in ops]
    rng.shuffle(flat)
    for i in range(3):
        part = flat[i * 24 : (i + 1) * 24] + flat[:5]
        spark.createDataFrame(part, OPS).coalesce(1).write.parquet(str(tmp_path / f"ops/b={i}"))
        stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "ops/*"))
        run(stateful.evolve(stream), tmp_path, "ops")
    audit = spark.read.parquet(str(tmp_path / "ops-out")).collect()
    assert sorted((a.run, a.ord) for a in audit) == sorted((r, i) for r in runs for i in range(12))
    last = {a.run: sorted(a.codes) if a.codes is not None else None for a in audit if a.ord == 11}
    fold = judgement.fold_taxonomy(spark.createDataFrame(flat, OPS)).collect()
    assert last == {r.run: r.codes for r in fold} and last["r5"] is None and last["r0"]
    assert all(a.applied == (a.codes is not None) for a in audit)


REQUESTS = "host string, session_id string, receipt_id string, n_bytes long, kind string"


def test_deadline(spark, tmp_path):
    """A session end whose log isn't there stays pending past the deadline and is committed when it is."""
    def put(i, rows):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))

    def go(seconds):
        df = stateful.captures(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in/*")), 500)
        run(df, tmp_path, "cap", seconds, processingTime="1 second")
        return [(r.session_id, r.receipt_id, r.status) for r in spark.read.schema(stateful.CAPTURED).parquet(str(tmp_path / "cap-out")).collect()]

    put(0, [("h", "s", "r1", 100, "ask"), ("h", "s", None, 40, "log"), ("h", "t", "r2", 10, "ask"), ("h", "t", None, 30, "log")])
    got, began = go(12), time.time()
    while ("s", "r1", "pending") not in got and time.time() - began < 60:
        got = go(8)
    assert sorted(got) == [("s", "r1", "pending"), ("t", "r2", "committed")]
    put(1, [("h", "s", None, 120, "log"), ("h", "t", "r2", 10, "ask"), ("h", "t", "r3", 5, "ask")])
    began = time.time()
    while len(got) < 5 and time.time() - began < 60:
        got = go(8)
    assert sorted(got) == [("s", "r1", "committed"), ("s", "r1", "pending"), ("t", "r2", "committed"), ("t", "r2", "no_op"), ("t", "r3", "no_op")]
