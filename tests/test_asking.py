import http.server
import json
import pickle
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexloom.operators import models
from lexloom.operators.asking import Answers, SharedRate, in_order
from lexloom.operators.models import HttpBackend, Response
from lexloom.plans import pipeline


@pytest.fixture
def service():
    """A stub that answers after 50 ms and keeps what it was asked, when, and how many at once."""

    class Service:
        def __init__(self):
            self.asked, self.times, self.open, self.most, self.lock, self.broken = [], [], 0, 0, threading.Lock(), False
            outer = self

            class Handler(http.server.BaseHTTPRequestHandler):
                def do_POST(self):
                    said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
                    with outer.lock:
                        outer.asked.append(said)
                        outer.times.append(time.time())
                        outer.open += 1
                        outer.most = max(outer.most, outer.open)
                    time.sleep(0.05)
                    with outer.lock:
                        outer.open -= 1
                    body = json.dumps({"choices": [{"message": {"content": "An answer to: " + said[-40:]}}]}).encode()
                    self.send_response(400 if outer.broken and "odd" in said else 200)
                    self.send_header("Content-Length", str(len(body)))
                    self.end_headers()
                    self.wfile.write(body)

                def log_message(self, *args):
                    pass

            class Server(http.server.ThreadingHTTPServer):
                request_queue_size = 64

            self.server = Server(("127.0.0.1", 0), Handler)
            self.backend = HttpBackend(f"http://127.0.0.1:{self.server.server_port}/", "m", pause=0.0)
            threading.Thread(target=self.server.serve_forever, daemon=True).start()

    made = Service()
    yield made
    made.server.shutdown()


def test_order_and_window():
    open_, most, lock, drawn = [0], [0], threading.Lock(), []

    def call(i):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.002 * (7 - i % 7))
        with lock:
            open_[0] -= 1
        return i

    def items():
        for i in range(60):
            drawn.append(i)
            yield i

    walk = in_order(call, items(), 5)
    assert next(walk) == 0 and len(drawn) <= 6  # not read ahead
    assert list(walk) == list(range(1, 60)) and 1 < most[0] <= 5
    assert list(in_order(call, [], 3)) == [] and list(in_order(call, [3, 1], 1)) == [3, 1]
    with pytest.raises(ZeroDivisionError):
        list(in_order(lambda x: 1 // x, [1, 0, 1], 2))
    with pytest.raises(ValueError):
        list(in_order(call, [1], 0))


def test_eight_workers_are_over_five_times_faster(spark, service):
    rows = spark.createDataFrame([(i, f"Text number {i} of the many texts that are to be summarised here.") for i in range(64)], "i int, t string").coalesce(1).cache()
    rows.count()
    took, got = {}, {}
    for workers in (1, 8):
        rows.limit(1).select(models.summaries(F.col("t"), service.backend)).collect()
        service.most, service.times = 0, []
        got[workers] = [(r["i"], r["s"]) for r in rows.select("i", models.summaries(F.col("t"), service.backend, workers=workers).alias("s")).collect()]
        took[workers] = max(service.times) - min(service.times)  # without what it takes to start the job
        assert service.most == workers
    assert got[1] == got[8] and [i for i, _ in got[8]] == list(range(64)) and all(s for _, s in got[8])
    assert took[1] > 5 * took[8]


def test_the_pipeline_asks_chunks_together(spark, service):
    text = " ".join(f"Part{i} " + "word " * 160 + "end." for i in range(8))
    docs = spark.createDataFrame([(1, text), (2, text + " And more of it here."), (3, "short")], "doc_id long, text string").coalesce(1)
    told = lambda w: sorted((r["doc_id"], r["seq"], r["type"], str(r["summary"])) for r in pipeline.run_pipeline(docs, backend=service.backend, workers=w).collect())
    one = told(1)
    assert service.most == 1
    assert told(8) == one and service.most == 8


def test_one_rate_for_all_partitions(spark, service):
    rate = 40.0
    rows = spark.createDataFrame([(i, f"Text number {i} of the texts that are to be summarised here.") for i in range(60)], "i int, t string")
    got = models.summarise_chunks(rows, service.backend, "t", partitions=4, workers=4, rate=rate).collect()
    assert len(got) == 60 and all(r["summary"] for r in got)
    times = sorted(service.times)
    assert len(times) == 60
    for i in range(len(times)):  # any second, with a part of a slot for the way to the server
        within = sum(times[i] <= t < times[i] + 1.0 for t in times)
        assert within <= rate + 3
    assert times[-1] - times[0] >= 59 / rate - 0.1
    with pytest.raises(ValueError):
        models.summarise_chunks(rows, service.backend, "t", rate=2.0)


def test_slots():
    class Clock:
        now = 1000.3

        def sleep(self, seconds):
            self.now += seconds

    used = []
    for share in range(3):
        clock = Clock()
        limited = SharedRate(models.ExtractiveBackend(), 2.0, 3, share, lambda c=clock: c.now, clock.sleep)
        mine = [limited.wait() for _ in range(5)]
        assert all(s % 3 == share for s in mine) and mine == sorted(set(mine)) and all(b - a == 3 for a, b in zip(mine, mine[1:], strict=False))
        used += mine
    assert len(set(used)) == 15
    assert pickle.loads(pickle.dumps(SharedRate(models.ExtractiveBackend(), 2.0, 3, 1))).wait() % 3 == 1
    with pytest.raises(ValueError):
        SharedRate(models.ExtractiveBackend(), 0, 3)
    with pytest.raises(ValueError):
        SharedRate(models.ExtractiveBackend(), 1, 3, 3).wait()


def test_answers_are_kept(spark, service, tmp_path):
    rows = [(i, f"{'odd' if i % 2 else 'even'} prompt {i % 20}", 10, 0.3, "own column") for i in range(40)] + [(99, None, 10, 0.3, "x")]
    requests = spark.createDataFrame(rows, "i int, prompt string, max_tokens int, temperature double, key string").repartition(3)
    kept = Answers(spark, f"file://{tmp_path}/answers", "m")
    service.broken = True
    got = {r["i"]: r["answer"] for r in kept.ask(requests.drop("key"), service.backend, blocks=3).collect()}
    assert len(got) == 41 and got[99] is None and all((got[i] is None) == bool(i % 2) for i in range(40)) and len(service.asked) == 20
    service.broken, service.asked = False, []
    again = kept.ask(requests.drop("key"), service.backend, blocks=5, partitions=2, workers=4)
    got = {r["i"]: r["answer"] for r in again.collect()}
    assert len(service.asked) == 10 and all("odd" in a for a in service.asked) and all(got[i] == f"An answer to: {rows[i][1]}" for i in range(40))
    service.asked = []
    assert again.collect() and again.count() == 41  # a stage that is run again reads the table
    assert kept.ask(requests.drop("key"), service.backend).count() == 41 and service.asked == []
    other = Answers(spark, f"file://{tmp_path}/answers", "another model").ask(requests.drop("key").filter("i = 0"), service.backend, blocks=1)
    assert other.first()["answer"] and len(service.asked) == 1


def test_a_job_that_dies_loses_one_block_at_most(spark, tmp_path):
    requests = spark.createDataFrame([(f"prompt {i}", 10, 0.3) for i in range(50)], "prompt string, max_tokens int, temperature double")
    log = str(tmp_path / "log")

    class Dying:
        def complete(self, request):
            if request.prompt == "prompt 31":
                raise RuntimeError("the machine is gone")
            with open(log, "a") as f:
                f.write(request.prompt + "\n")
            return Response(True, "told " + request.prompt)

    class Living(Dying):
        def complete(self, request):
            return super().complete(request) if request.prompt != "prompt 31" else Response(True, "told prompt 31")

    kept = Answers(spark, f"file://{tmp_path}/answers")
    with pytest.raises(Exception, match="the machine is gone"):
        kept.ask(requests, Dying(), blocks=10)
    before = {r["key"] for r in kept.table().collect()}
    open(log, "w").close()
    got = kept.ask(requests, Living(), blocks=10).collect()
    assert all(r["answer"] == "told " + r["prompt"] for r in got) and len(got) == 50
    asked = open(log).read().split("\n")[:-1]
    assert len(asked) == len(set(asked)) and len(asked) + 1 + len(before) == 50


def test_folds_over_rows_equal_folds_of_lists(spark):
    rows = [(c, i, f"Text {i} of group {c}. It has two sentences.") for c in range(5) for i in range(c * 3)]
    rows += [(7, 1, None), (7, None, "first"), (8, 1, None), (None, 2, "b"), (None, 1, "a"), (9, 1, "tie b"), (9, 1, "tie a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g int, o int, t string, n string").repartition(6)
    for how in (models.Merging, models.Refining):
        got = {r["g"]: (r["n"], r["summary"]) for r in models.folded_rows(df, "g", "o", "t", how).collect()}
        for g in {r[0] for r in rows}:
            texts = [t for _, _, t in sorted(((o is not None, o or 0, t or "") for k, o, t in rows if k == g and t is not None))]
            assert got[g] == (len(texts), models.whole(how, texts, models.ExtractiveBackend()))
    assert models.folded_rows(df.limit(0), "g", "o", "t").collect() == []


def test_a_long_group_is_carried_from_batch_to_batch(spark):
    class Counting:
        """Holds nothing but how many it saw and how many it saw out of order."""

        def __init__(self, backend):
            self.n, self.last, self.wrong = 0, -1, 0

        def add(self, text):
            self.wrong += int(text) <= self.last
            self.n, self.last = self.n + 1, int(text)

        def result(self):
            return f"{self.wrong} {self.last}"

    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.lpad(F.col("id").cast("string"), 9, "0").alias("t")).repartition(7)
    got = models.folded_rows(df, "g", "o", "t", Counting).collect()
    assert [(r["n"], r["summary"]) for r in got] == [(n, f"0 {n - 1}")]
