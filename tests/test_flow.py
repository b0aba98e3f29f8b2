import dataclasses
import json
import random
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from indexflow import cli, service
from indexflow import flow as flows
from indexflow.functions.builtin import EmbedText, ExtractByLlm, LlmSpec, ParseJson, SplitRecursively, stand_in
from indexflow.functions.udf import executor_class, function
from indexflow.operators.graph import DeclaredNode, NodeFromFields, Nodes, Relationships, TargetFieldMapping
from indexflow.plans.builder import DataSlice, FlowBuilder, FlowError, GeneratedField, transform_flow
from indexflow.plans.state import Conflict
from indexflow.plans.update import run_update
from indexflow.sources.base import TableSource
from indexflow.streaming.live import FlowLiveUpdater, FlowLiveUpdaterOptions
from indexflow.targets import Graph, Table, VectorCollection, VectorIndex
from indexflow.types import basic


@dataclasses.dataclass
class Word:
    word: str
    n: int


@pytest.fixture
def app(spark, tmp_path):
    flows.init(spark, flows.Settings(f"file://{tmp_path}/state", "ns", buckets=2))
    yield flows
    for name in flows.flow_names():
        flows.remove_flow(name)


@function()
def words(text: str) -> list[Word]:
    if text.startswith("bad"):
        raise ValueError("no good")
    return [Word(w, len(w)) for w in text.split()]


def word_flow(rows):
    def define(b, s):
        s["docs"] = b.add_source(TableSource(rows(), "id", "at"), name="docs")
        out = s.add_collector()
        with s["docs"].row() as d:
            d["words"] = d["text"].transform(words)
            with d["words"].row() as w:
                out.collect(word=w["word"], id=d["id"], n=w["n"])
        out.export("words", Table(), primary_key_fields=["id", "word"])

    return define


def contents(f):
    return sorted(tuple(r) for r in f.table("words").collect())


def test_updates_equal_a_full_run(spark, app):
    """After any changes the target is what a run from scratch would make, and rows in error keep what they had."""
    rng = random.Random(4)
    rows: dict[int, tuple[str, int]] = {}
    current = lambda: spark.createDataFrame([(i, t, at) for i, (t, at) in rows.items()], "id long, text string, at long")
    f = app.add_flow_def("words", word_flow(current))
    for step in range(3):
        for i in rng.sample(range(8), 4):
            if i in rows and rng.random() < 0.3:
                del rows[i]
            else:
                rows[i] = (" ".join(rng.sample("abcdefgh", 3)), step * 10 + i)
        stats = f.update().sources["docs"]
        assert contents(f) == sorted((i, w, 1) for i, (t, _) in rows.items() for w in t.split())
        assert stats.errors == 0
    again = f.update().sources["docs"]
    assert again.no_change == len(rows) and not again.changed
    key = next(iter(rows))
    before = contents(f)
    rows[key] = ("bad text", 999)
    stats = f.update()
    assert stats.sources["docs"].errors == 1 and "no good" in stats.errors[0][2] and contents(f) == before
    rows[key] = (rows[key][0].removeprefix("bad "), 1000)
    assert f.update().sources["docs"].updates == 1
    rows[key] = ("older text", 5)  # late data is skipped
    assert not f.update().sources["docs"].changed


def test_one_changed_row_rewrites_one_bucket(spark, app, tmp_path):
    app.init(spark, app.Settings(f"file://{tmp_path}/state", "ns", buckets=16))
    at = {i: 1 for i in range(40)}
    f = app.add_flow_def("buckets", word_flow(lambda: spark.createDataFrame([(i, f"w{i} v{n}", n) for i, n in at.items()], "id long, text string, at long")))
    f.update()
    before = f.state.load()
    at[7] = 2
    f.update()
    after = f.state.load()
    changed = {n: sum(after.parts[n].get(b) != p for b, p in before.parts[n].items()) for n in after.parts}
    # a word of the row goes, another comes: two target keys
    assert changed["tracking"] == 1 and changed["keys.words"] == 1 and 1 <= changed["target.words"] <= 2 and len(before.parts["tracking"]) > 8
    assert len(contents(f)) == 80 and (7, "v2", 2) in contents(f) and (7, "v1", 2) not in contents(f)
    # tables that only older versions than the last two name are deleted
    at[7] = 3
    f.update()
    kept = {p.split("/tables/")[1].split("/")[0] for v in f.state._versions() for p in f.state._read(v).paths()}
    folder = f.state._path(f"{f.state.root}/tables")
    assert len(f.state._versions()) == 2 and {x.getPath().getName() for x in f.state._fs.listStatus(folder)} == kept
    assert not before.parts["tracking"].items() <= f.state.load().parts["tracking"].items()


def test_the_newest_version_of_a_key_wins(spark, app):
    rows = [(1, "old", 1), (1, "new", 2), (2, "new", 5), (2, "old", 1), (3, "b", 4), (3, "a", 4), (4, "some", None), (4, "new", 0)]
    f = app.add_flow_def("newest", word_flow(lambda: spark.createDataFrame(rows, "id long, text string, at long")))
    f.update()
    assert len(contents(f)) == 4 and {(i, w) for i, w, _ in contents(f)} >= {(1, "new"), (2, "new"), (4, "new")}
    again = f.update().sources["docs"]
    assert again.no_change == 4 and len(contents(f)) == 4


def test_waiting_updates_take_on_further_sources(spark, app, monkeypatch):
    seen, gate = [], threading.Event()
    f = app.add_flow_def("waiting", word_flow(lambda: None))
    monkeypatch.setattr(flows, "run_update", lambda *a: (seen.append(a[4]), gate.wait(10)))
    first = f.update_async({"a"})
    while not seen:
        pass
    second = f.update_async({"b"})
    assert f.update_async({"c"}) is second and second is not first
    gate.set()
    second.result()
    third = [f.update_async({"a"}).result(), f.update_async().result()]
    assert seen[:2] == [{"a"}, {"b", "c"}] and seen[-1] is None and third


def test_same_content_at_a_newer_ordinal_is_no_change(spark, app):
    at = [1]
    f = app.add_flow_def("same", word_flow(lambda: spark.createDataFrame([(1, "a b", at[0])], "id long, text string, at long")))
    f.update()
    at[0] = 2
    assert f.update().sources["docs"].no_change == 1
    assert f.row_status("docs").first()["processed_ordinal"] == 2
    at[0] = 1
    assert f.update().sources["docs"].no_change == 1


def test_a_run_that_dies_before_publishing_changes_nothing(spark, app, monkeypatch):
    f = app.add_flow_def("crash", word_flow(lambda: spark.createDataFrame([(1, "a b", 1)], "id long, text string, at long")))
    state = f.state
    monkeypatch.setattr(state, "publish", lambda _: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run_update(spark, f.define, state)
    assert f.state.load().version == 0
    f.update()
    assert len(contents(f)) == 2
    assert f.state.sweep() > 0 and len(contents(f)) == 2
    stale = f.state.load()
    f.state.publish(f.state.load())
    with pytest.raises(Conflict):
        f.state.publish(stale)


def test_a_key_that_another_row_still_produces_stays(spark, app):
    rows = {1: ("x", 1), 2: ("x", 1)}

    def define(b, s):
        s["d"] = b.add_source(TableSource(spark.createDataFrame([(i, t, a) for i, (t, a) in rows.items()], "id long, text string not null, at long"), "id", "at"), name="d")
        c = s.add_collector()
        with s["d"].row() as d:
            c.collect(word=d["text"])
        c.export("words", Table(), primary_key_fields=["word"])

    f = app.add_flow_def("shared", define)
    f.update()
    del rows[1]
    assert f.update().sources["d"].deletions == 1
    assert [r["word"] for r in f.table("words").collect()] == ["x"]


CALLS = []


def test_cached_results_and_generated_ids_are_stable(spark, app):
    @function(cache=True, behavior_version=1)
    def loud(text: str) -> str:
        return text.upper()

    rows = [(1, "a a b", 1)]

    def define(b, s):
        s["d"] = b.add_source(TableSource(spark.createDataFrame(rows, "id long, text string, at long"), "id", "at"), name="d")
        c = s.add_collector()
        with s["d"].row() as d:
            d["words"] = d["text"].transform(words)
            with d["words"].row() as w:
                w["loud"] = w["word"].transform(loud)
                c.collect(key=GeneratedField.UUID, word=w["loud"])
        c.export("out", VectorCollection("c"), primary_key_fields=["key"])

    f = app.add_flow_def("memo", define)
    f.update()
    first = {r["id"] for r in f.table("out").collect()}
    rows[0] = (1, "a a b c", 2)
    f.update()
    after = {r["id"] for r in f.table("out").collect()}
    assert len(first) == 3 and len(after) == 4 and first < after
    memo = next(n for n in f.state.load().names() if n.startswith("memo."))
    assert f.state.table(f.state.load(), memo).count() == 3
    rows[0] = (1, "c", 3)
    f.update()
    assert f.state.table(f.state.load(), memo).count() == 1  # what no row uses is forgotten
    with pytest.raises(ValueError):
        function(cache=True)(lambda text: text)


def test_graph_flow(spark, app):
    rows = [(1, "Doc1", "paris"), (2, "Doc2", "rome")]

    def define(b, s):
        s["m"] = b.add_source(TableSource(spark.createDataFrame(rows, "id long, doc string not null, place string not null"), "id"), name="m")
        docs, mentions = s.add_collector(), s.add_collector()
        with s["m"].row() as m:
            docs.collect(name=m["doc"])
            mentions.collect(id=m["id"], doc=m["doc"], place=m["place"])
        docs.export("docs", Graph(Nodes("Document")), primary_key_fields=["name"])
        mentions.export("mentions", Graph(Relationships("MENTION", NodeFromFields("Document", (TargetFieldMapping("doc", "name"),)), NodeFromFields("Place", (TargetFieldMapping("place", "name"),)))), primary_key_fields=["id"])
        b.declare(DeclaredNode("Place", ("name",)))

    f = app.add_flow_def("graph", define)
    f.update()
    assert sorted((r["name"], r["self_contained"]) for r in f.graph_nodes("Place").collect()) == [("paris", False), ("rome", False)]
    assert sorted((r["id"], r["source_name"], r["target_name"]) for r in f.graph_relationships("MENTION").collect()) == [(1, "Doc1", "paris"), (2, "Doc2", "rome")]
    rows.pop()
    f.update()
    assert [r["name"] for r in f.graph_nodes("Place").collect()] == ["paris"] and [r["name"] for r in f.graph_nodes("Document").collect()] == ["Doc1"]


def test_definition_errors(spark):
    df = spark.createDataFrame([(1, "t", [1.0])], "id long, text string, v array<double>")
    b = FlowBuilder(spark)
    s = b.scope
    s["a"] = b.add_source(TableSource(df, "id"), name="a")
    s["b"] = b.add_source(TableSource(df, "id"), name="b")
    out = s.add_collector()
    with pytest.raises(FlowError):
        s["a"] = b.constant(1)
    with pytest.raises(FlowError):
        b.add_source(TableSource(df, "id"), name="a")
    with pytest.raises(FlowError):
        s["missing"]
    with s["a"].row() as a, s["b"].row() as other:
        with pytest.raises(FlowError):
            out.collect(x=a["id"], y=other["id"])
        with pytest.raises(FlowError):
            a["text"]["sub"]
        with pytest.raises(FlowError):
            a["id"].row()
        with pytest.raises(TypeError):
            a["id"].transform(ParseJson())
        with pytest.raises(TypeError):
            a["text"].transform(words, "more")
        with pytest.raises(TypeError):
            a["text"].transform(SplitRecursively(), size=3)
        with pytest.raises(FlowError):
            b.transform(words)
        with pytest.raises(FlowError):
            out.collect(x=GeneratedField.UUID, y=GeneratedField.UUID)
        out.collect(id=a["id"], v=a["v"])
        with pytest.raises(TypeError):
            out.collect(id=a["text"], v=a["v"])
    with pytest.raises(TypeError):
        out.export("e", Table(), primary_key_fields=["v"])
    with pytest.raises(FlowError):
        out.export("e", Table(), primary_key_fields=[])
    with pytest.raises(ValueError):
        out.export("e", Table(), primary_key_fields=["id"], vector_indexes=[VectorIndex("v")])
    out.export("e", Table(), primary_key_fields=["id"])
    with pytest.raises(FlowError):
        out.collect(id=1, v=[1.0])


def test_model_calls_are_batched_and_overlap(spark, tmp_path):
    import asyncio
    import time

    log = str(tmp_path / "log")

    def client(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    @function()
    async def slow(text: str) -> str:
        await asyncio.sleep(0.3)
        if text == "bad":
            raise ValueError("no")
        return text + "!"

    embed = EmbedText("openai", "m", output_dimension=1, client=client)
    embed = dataclasses.replace(embed, prepare=lambda: client)  # without pauses after failures
    rows = [(i, "bad" if i == 70 else "t" * (i % 5)) for i in range(150)] + [(150, None)]
    b = FlowBuilder(spark)
    b.scope["d"] = b.add_source(TableSource(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id"))
    with b.scope["d"].row() as d:
        d["e"] = d["text"].transform(embed)
        d["s"] = d["text"].transform(slow)
        c = b.scope.add_collector()
        c.collect(id=d["id"], e=d["e"], s=d["s"])
    began = time.monotonic()
    got = {r["id"]: r for r in c.rows.collect()}
    assert time.monotonic() - began < 30  # one after the other they take 45 s and more
    assert "refused" in got[70]["__err"] and got[150]["e"] is None and all(list(got[i]["e"]) == [i % 5.0] and got[i]["s"].endswith("!") for i in range(150) if i != 70)
    sizes = [int(x) for x in open(log)]
    assert max(sizes) > 8 and sum(sizes) <= 300
    with pytest.raises(ValueError):
        EmbedText("openai", "m", output_dimension=4)


def test_functions_of_all_forms(spark):
    @function()
    async def later(text: str, *more: str) -> str:
        return "/".join((text, *more))

    class Spec:
        def __init__(self, by: int):
            self.by = by

    @executor_class()
    class Adder:
        spec: Spec

        def prepare(self):
            self.ready = self.spec.by

        def __call__(self, text: str) -> int:
            return len(text) + self.ready

    b = FlowBuilder(spark)
    b.scope["d"] = b.add_source(TableSource(spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string"), "id"))
    with b.scope["d"].row() as d:
        d["x"] = d["text"].transform(later, "y", "z")
        d["n"] = d["text"].transform(Adder(by=5))
        d["e"] = d["text"].transform(EmbedText("openai", "m", output_dimension=4, client=stand_in(4)))
        d["l"] = d["text"].transform(ExtractByLlm(LlmSpec("openai", "m", client=lambda request: json.dumps({"word": request["text"], "n": 2})), Word))
        c = b.scope.add_collector()
        c.collect(id=d["id"], x=d["x"], n=d["n"], e=d["e"], w=d["l"]["word"])
    got = {r["id"]: r for r in c.rows.collect()}
    assert (got[1]["x"], got[1]["n"], got[1]["w"], len(got[1]["e"])) == ("ab/y/z", 7, "ab", 4)
    assert got[2]["x"] is None and got[2]["n"] is None and got[2]["e"] is None and "either" in got[2]["__err"]


def test_transform_flows_evaluate_values(spark):
    @transform_flow()
    def count(text: DataSlice[str]):
        return text.transform(words)

    assert count.eval(spark, "one three") == [Word("one", 3), Word("three", 5)]
    with pytest.raises(RuntimeError):
        count.eval(spark, "bad")


def test_null_tables_are_errors_and_empty_ones_vanish(spark):
    b = FlowBuilder(spark)
    rows = spark.createDataFrame([(1, [("x",)]), (2, []), (3, None)], "id long, items array<struct<v: string>>")
    b.scope["d"] = b.add_source(TableSource(rows, "id"))
    c = b.scope.add_collector()
    with b.scope["d"].row() as d, d["items"].row() as i:
        c.collect(id=d["id"], v=i["v"])
    got = {r["id"]: r["__err"] for r in c.rows.collect()}
    assert set(got) == {1, 3} and got[1] is None and "null" in got[3]


def test_names_auth_and_registry(app):
    assert app.target_default_name("F", "t.x") == "ns__F__t__x" and app.app_namespace(".") == "ns."
    ref = app.add_auth_entry("db", {"password": "s"})
    assert app.auth_entry(app.ref_auth_entry("db")) == {"password": "s"} and "s" not in repr(ref).replace("AuthRef", "").replace("key='db'", "")
    with pytest.raises(ValueError):
        app.add_auth_entry("db", 1)
    app._AUTH.clear()
    with pytest.raises(ValueError):
        app.add_flow_def("no-dash", lambda b, s: None)


def test_setup_dump_service_and_cli(spark, app, tmp_path, capsys):
    f = app.add_flow_def("serve", word_flow(lambda: spark.createDataFrame([(1, "a b", 1), (2, "bad", 1)], "id long, text string, at long")))
    assert f.setup()["words"].change.value == "create" and f.setup()["words"].change.value == "no change"
    assert f.evaluate_and_dump(app.EvaluateAndDumpOptions(f"file://{tmp_path}/dump")) == 2
    texts = {p.name: p.read_text() for p in (tmp_path / "dump").glob("*.yaml")}
    assert "word: a" in texts["docs@1.yaml"] and "no good" in texts["docs@2.yaml"]
    assert service.respond("POST", "/api/flows/serve/update")[1]["docs"]["insertions"] == 1
    server = service.serve(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/api/flows"
    get = lambda path: json.load(urllib.request.urlopen(base + path))
    assert get("") == ["serve"] and get("/serve/schema")["sources"]["docs"]["kind"] == "KTable"
    assert get("/serve/keys?field=docs") == [{"id": 1}, {"id": 2}]
    assert {r["word"] for r in get("/serve/data?field=docs&key=1")["words"]} == {"a", "b"}
    assert get("/serve/rowStatus?field=docs&key=1")["logic_current"] is True
    assert service.respond("GET", "/api/flows/none")[0] == 404 and service.respond("GET", "/api/flows/serve/data?field=docs&key=x")[0] == 400
    server.shutdown()
    module = tmp_path / "empty_app.py"
    module.write_text("")
    assert cli.main(["ls", str(module)]) == 0 and "ns.serve" in capsys.readouterr().out
    with FlowLiveUpdater(f, FlowLiveUpdaterOptions(live_mode=False)) as live:
        while live.next_status_updates(60).active_sources:
            pass
        live.wait()
        assert live.update_stats().sources["docs"].no_change == 1
    f.drop()
    assert f.state.load().version == 0


def test_live_updates_follow_the_source(spark, app):
    import datetime

    rows = [(1, "a", 1)]

    def define(b, s):
        s["d"] = b.add_source(TableSource(spark.createDataFrame(rows, "id long, text string, at long"), "id", "at"), name="d", refresh_interval=datetime.timedelta(seconds=1))
        c = s.add_collector()
        with s["d"].row() as d:
            c.collect(id=d["id"], text=d["text"])
        c.export("words", Table(), primary_key_fields=["id"])

    f = app.add_flow_def("live", define)
    with FlowLiveUpdater(f) as live:
        assert live.next_status_updates(120).updated_sources == ["d"]
        rows.append((2, "b", 1))
        assert live.next_status_updates(120).updated_sources == ["d"]
    assert f.table("words").where(F.col("id") == 2).count() == 1


def test_announced_changes_and_new_files_reach_targets(spark, app, tmp_path):
    import queue

    from indexflow.sources.base import FileSource
    from indexflow.sources.remote import with_queue

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")

    class Queue:
        def __init__(self):
            self.notices, self.deleted = queue.Queue(), []

        def receive(self, most, wait_s):
            try:
                return [self.notices.get(timeout=0.2)]
            except queue.Empty:
                return []

        def delete(self, receipt):
            self.deleted.append(receipt)

    news = Queue()

    def define(b, s):
        s["f"] = b.add_source(with_queue(FileSource(str(tmp_path / "in")), news, "bucket"), name="f")
        c = s.add_collector()
        with s["f"].row() as f:
            c.collect(name=f["filename"], content=f["content"])
        c.export("words", Table(), primary_key_fields=["name"])

    f = app.add_flow_def("notices", define)
    with FlowLiveUpdater(f) as live:
        assert live.next_status_updates(120).updated_sources == ["f"]
        (tmp_path / "in/b.txt").write_text("two")
        news.notices.put(("r1", json.dumps({"Records": [{"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "bucket"}, "object": {"key": "b.txt"}}}]})))
        assert live.next_status_updates(120).updated_sources == ["f"]
    assert f.table("words").count() == 2 and news.deleted == ["r1"]
    app.remove_flow("notices")

    def watch(b, s):
        s["f"] = b.add_source(FileSource(str(tmp_path / "in"), watch=True), name="f")
        c = s.add_collector()
        with s["f"].row() as row:
            c.collect(name=row["filename"], content=row["content"])
        c.export("words", Table(), primary_key_fields=["name"])

    f = app.add_flow_def("watch", watch)
    with FlowLiveUpdater(f) as live:
        live.next_status_updates(120)
        (tmp_path / "in/c.txt").write_text("three")
        for _ in range(60):
            live.next_status_updates(2)
            if f.table("words").count() == 3:
                break
    assert f.table("words").count() == 3


def test_live_sources_outlast_failures(spark, app, monkeypatch):
    import datetime

    from indexflow.streaming import live as streaming

    monkeypatch.setattr(streaming, "FIRST_PAUSE", 0.1)
    calls = []

    def rows():
        calls.append(1)
        if len(calls) in (2, 3):  # the first pass fails after the sources were looked at, and the next at once
            raise OSError("unreachable")
        return spark.createDataFrame([(1, "a", len(calls))], "id long, text string, at long")

    def define(b, s):
        s["docs"] = b.add_source(TableSource(rows(), "id", "at"), name="docs", refresh_interval=datetime.timedelta(seconds=1))
        out = s.add_collector()
        with s["docs"].row() as d:
            out.collect(id=d["id"], word=d["text"])
        out.export("words", Table(), primary_key_fields=["id"])

    f = app.add_flow_def("flaky", define)
    with FlowLiveUpdater(f) as live:
        assert live.next_status_updates(120).updated_sources == ["docs"]
    assert f.table("words").count() == 1 and len(calls) > 4


def test_tables_of_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of keys are far smaller than the rows in memory, so rows are counted."""
    from indexflow.plans import state as states

    state = states.FlowState(spark, f"file://{tmp_path}/state")
    rows = state.stage(spark.range(60_000).select(F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("k")), "rows")
    few = state.stage(spark.range(7).select(F.col("id").cast("string").alias("k")), "few")
    other = spark.range(90_000).select(F.col("id").cast("string").alias("k"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert (rows._indexflow_rows, few._indexflow_rows) == (60_000, 7)
    assert "Broadcast" not in plan(other.join(rows.where("k > '3'").select("k").distinct(), "k", "left_anti"))
    assert "Broadcast" in plan(other.join(few, "k", "left_anti"))


def test_graph_updates_are_the_same_without_broadcasts(spark, tmp_path, monkeypatch):
    from indexflow.plans import state as states, update as updates

    monkeypatch.setattr(states, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(updates, "FEW_FAILED", -1)
    rows = {"now": [(i, i % 4, i) for i in range(12)]}

    def define(b):
        b.scope["r"] = b.add_source(TableSource(spark.createDataFrame(rows["now"], "id long, c long, at long"), "id", "at"), name="r")
        out = b.scope.add_collector()
        with b.scope["r"].row() as r:
            out.collect(id=r["id"], c=r["c"])
        out.export("t", Table(), primary_key_fields=["id"])

    state = states.FlowState(spark, f"file://{tmp_path}/state", 2)
    asked = []
    hint = type(spark.range(0)).hint
    monkeypatch.setattr(type(spark.range(0)), "hint", lambda self, name, *a: asked.append(name) or hint(self, name, *a))
    assert updates.run_update(spark, define, state).sources["r"].insertions == 12
    rows["now"] = [(i, 9 if i % 3 == 0 else i % 4, 50) for i in range(12) if i % 5]
    stats = updates.run_update(spark, define, state).sources["r"]
    assert (stats.no_change, stats.updates, stats.deletions) == (6, 3, 3)
    assert sorted(tuple(r) for r in state.table(state.load(), "target.t").select("id", "c").collect()) == sorted((i, c) for i, c, _ in rows["now"])
    assert asked.count("merge") > 20


def test_a_function_gets_no_more_rows_at_once_than_a_part(spark):
    @function()
    def at_once(text: str) -> int:
        import sys

        frame = sys._getframe()
        while "rows" not in frame.f_locals:
            frame = frame.f_back
        return len(frame.f_locals["rows"])

    _, made = at_once.column({"text": (F.col("t"), basic("Str"))})
    got = spark.range(0, 5000, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), F.when(F.col("id") > 4000, 20_000).otherwise(5))).alias("t")).select("id", made.alias("m")).collect()
    assert [r["id"] for r in got] == list(range(5000)) and not any(r["m"]["error"] for r in got)
    assert max(r["m"]["value"] for r in got) <= 1024


def test_orphans_of_many_rows_are_found_without_any_broadcast(spark, sf_dir, monkeypatch):
    from indexflow.plans import catalogue, state as states, update as updates

    monkeypatch.setattr(states, "BROADCAST_ROWS", -1, raising=False)
    monkeypatch.setattr(updates, "FEW_FAILED", -1, raising=False)
    plans = []
    writer = type(spark.range(0)).write
    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or writer.fget(self)))
    found = catalogue.graph_orphans_after_update(spark, sf_dir)
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in catalogue.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0 and o_orderkey % 5 <> 0").select("o_custkey").distinct().collect())
    assert len(plans) > 20 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("many", [True, False])
def test_updates_of_many_rows_scan_tables_and_give_the_same(spark, tmp_path, monkeypatch, many):
    """Rows without a key, keys in several versions, and target keys that one source row loses and another keeps, takes or loses too."""
    from indexflow.plans import state as states, update as updates

    if many:
        monkeypatch.setattr(states, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(states, "FULL_ROWS", -1, raising=False)
        monkeypatch.setattr(updates, "FEW_FAILED", -1)
    read, asked = TableSource.read, []
    monkeypatch.setattr(TableSource, "read", lambda self, spark, keys=None: asked.append(keys is not None) or read(self, spark, keys))
    now = {}

    def define(b):
        b.scope["r"] = b.add_source(TableSource(spark.createDataFrame(now["rows"], "id long, t string not null, v long, at long"), "id", "at"), name="r")
        out = b.scope.add_collector()
        with b.scope["r"].row() as r:
            out.collect(t=r["t"], v=r["v"])
        out.export("t", Table(), primary_key_fields=["t"])

    state = states.FlowState(spark, f"file://{tmp_path}/state", 4)
    steps = [
        ([(1, "a", 1, 1), (2, "a", 2, 1), (3, "b", 3, 1), (4, "c", 4, 1), (4, "old", 9, 0), (None, "n", 5, 1)], {"a": 1, "b": 3, "c": 4}, (4, 0, 0, 0)),
        ([(1, "d", 1, 2), (2, "a", 2, 1), (3, "b", 3, 3), (5, "c", 4, 1), (5, "c", 6, None)], {"a": 1, "b": 3, "c": 4, "d": 1}, (1, 1, 1, 2)),
        ([(1, "d", 7, 3), (1, "a", 8, 2)], {"d": 7}, (0, 1, 3, 0)),
        ([], {}, (0, 0, 1, 0)),
    ]
    for now["rows"], want, counts in steps:
        s = updates.run_update(spark, define, state).sources["r"]
        assert {r["t"]: r["v"] for r in state.table(state.load(), "target.t").collect()} == want
        assert (s.insertions, s.updates, s.deletions, s.no_change) == counts
    assert any(asked) == (not many)


def test_versions_of_many_rows_are_updated_without_any_broadcast(spark, sf_dir, monkeypatch):
    from indexflow.plans import catalogue, state as states, update as updates

    monkeypatch.setattr(states, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(updates, "FEW_FAILED", -1)
    plans = []
    writer = type(spark.range(0)).write
    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or writer.fget(self)))
    keys = sorted(r[0] for r in catalogue.flow_versions(spark, sf_dir).where("export = 'size'").select("k").collect())
    assert keys == sorted(f"c{r[0]}" for r in catalogue.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 3").select("c_custkey").collect())
    assert len(plans) > 20 and not any("Broadcast" in p for p in plans)


def broadcast_rows(spark, beyond=-1):
    """Rows of every table that was broadcast by executions with a larger number, and the largest number."""
    seq = lambda found: [found.apply(i) for i in range(found.size())]
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    numbers = [e.executionId() for e in seq(store.executionsList())]
    for n in (n for n in numbers if n > beyond):
        values = store.executionMetrics(n)
        made = [m.accumulatorId() for node in seq(store.planGraph(n).allNodes()) if node.name() == "BroadcastExchange" for m in seq(node.metrics()) if m.name() == "number of output rows"]
        rows += [int(values.apply(m).replace(",", "")) for m in made if values.contains(m)]
    return rows, max(numbers)


def test_few_changes_to_many_rows_broadcast_few_rows(spark, tmp_path, monkeypatch):
    """Spark judges the owners of all target keys by their files' size; what the driver builds must follow the changes."""
    from indexflow.plans import state as states, update as updates

    monkeypatch.setattr(states, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(updates, "FEW_FAILED", 20)
    rows = {"now": [(i, f"k{i // 2}", i, 1) for i in range(400)]}

    def define(b):
        b.scope["r"] = b.add_source(TableSource(spark.createDataFrame(rows["now"], "id long, t string not null, v long, at long"), "id", "at"), name="r")
        out = b.scope.add_collector()
        with b.scope["r"].row() as r:
            out.collect(t=r["t"], v=r["v"])
        out.export("t", Table(), primary_key_fields=["t"])

    state = states.FlowState(spark, f"file://{tmp_path}/state", 2)
    updates.run_update(spark, define, state)
    _, last = broadcast_rows(spark)
    # k0 loses both owners, k1 one of two, and k2 gets another value
    rows["now"] = [(i, t, -1 if i == 4 else v, 2 if i == 4 else at) for i, t, v, at in rows["now"] if i > 2]
    stats = updates.run_update(spark, define, state).sources["r"]
    assert (stats.no_change, stats.updates, stats.deletions) == (396, 1, 3)
    got = {r["t"]: r["v"] for r in state.table(state.load(), "target.t").collect()}
    assert "k0" not in got and len(got) == 199 and got["k2"] == -1
    broadcast, _ = broadcast_rows(spark, last)
    assert broadcast and max(broadcast) <= 20


def test_staged_tables_without_rows_are_left_out_of_plans(spark, tmp_path):
    from indexflow.plans import state as states

    state = states.FlowState(spark, f"file://{tmp_path}/state")
    none = state.stage(spark.range(9).where("id > 9").select(F.col("id").cast("string").alias("k"), F.array(F.struct("id")).alias("a")), "none")
    other = spark.range(9).select(F.col("id").cast("string").alias("k"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert none._indexflow_rows == 0 and none.dtypes == [("k", "string"), ("a", "array<struct<id:bigint>>")]
    assert "Join" not in plan(other.join(none.select("k"), "k", "left_anti")) and other.join(none, "k", "left_anti").count() == 9
    manifest = states.Manifest()
    state.point(manifest, "none", none)
    assert state.table(manifest, "none").dtypes == none.dtypes and state.table(manifest, "none").count() == 0
