import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexflow.functions.builtin import LlmSpec, hash_embedding, image_mime, retried
from indexflow.operators import changes, graph, vector
from indexflow.operators.graph import DeclaredNode, NodeFromFields, TargetFieldMapping
from indexflow.setup import Change, Combined, Compatibility, TableState, commit_setup, compatibility, diff, next_ids
from indexflow.sources.base import FileSource, LocalFile, TableSource
from indexflow.sources.globs import matches
from indexflow.sources.remote import GoogleDrive, drain, object_changes
from indexflow.types import basic


@pytest.mark.parametrize(
    ("included", "excluded", "kept"),
    [
        (None, None, ["a/b/y.md", "a/x.md", "node/m/z.md", "z.txt"]),
        (["*.md"], None, ["a/b/y.md", "a/x.md", "node/m/z.md"]),
        (["**/*.{md,txt}"], ["node"], ["a/b/y.md", "a/x.md", "z.txt"]),
        (["a/?.md"], None, ["a/x.md"]),
        (["[a-n]*"], ["*/b/*"], ["a/x.md", "node/m/z.md"]),
        ([], ["*.md"], ["z.txt"]),
    ],
)
def test_globs(spark, included, excluded, kept):
    df = spark.createDataFrame([(p,) for p in ("a/x.md", "a/b/y.md", "node/m/z.md", "z.txt")], "p string")
    assert sorted(r[0] for r in df.where(matches(F.col("p"), included, excluded)).collect()) == kept


def test_local_files_are_listed_and_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    source = LocalFile(str(tmp_path), included_patterns=["*.txt"])
    assert [r["filename"] for r in source.listing(spark).collect()] == ["d/a.txt"]
    (row,) = source.read(spark).collect()
    assert row["content"] == "café �" and row["__ordinal"] > 10**15
    assert LocalFile(str(tmp_path), binary=True, excluded_patterns=["d"]).read(spark).first()["content"] == b"\x00\x01"


class Logged:
    """A file system that writes down what is opened."""

    def __init__(self, root):
        from pyarrow import fs

        self.fs, self.log = fs.LocalFileSystem(), f"{root}.log"

    def get_file_info(self, x):
        return self.fs.get_file_info(x)

    def open_input_stream(self, path, **options):
        with open(self.log, "a") as f:
            f.write(path + "\n")
        return self.fs.open_input_stream(path, **options)


def test_hidden_and_deep_files_are_listed_and_only_wanted_ones_opened(spark, tmp_path):
    root = tmp_path / "in"
    names = ["__init__.py", ".hid.py", "_d/y.py", "_d/.e/f/z.py", "a b/ü=1.py", *(f"x{i}/{j}/k.py" for i in range(20) for j in range(5))]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    (root / "empty").mkdir()
    source = FileSource(str(root), connect=lambda: (Logged(root), str(root)))
    listing = source.listing(spark)
    assert sorted(r["filename"] for r in listing.collect()) == sorted(names)
    assert not (tmp_path / "in.log").exists()
    (root / ".hid.py").rename(root / "moved.py")
    got = source.read(spark, spark.createDataFrame([("__init__.py", 1), ("_d/.e/f/z.py", 1), (".hid.py", 1)], "filename string, __ordinal long")).collect()
    assert sorted((r["filename"], r["content"]) for r in got) == [("__init__.py", "__init__.py"), ("_d/.e/f/z.py", "_d/.e/f/z.py")]
    assert sorted((tmp_path / "in.log").read_text().split("\n")[:-1]) == sorted(f"{root}/{n}" for n in ("__init__.py", "_d/.e/f/z.py"))
    prefixed = FileSource(str(root), prefix="x1/", prune=False)
    assert sorted(r["filename"] for r in prefixed.listing(spark).collect()) == [f"x1/{j}/k.py" for j in range(5)]
    assert FileSource(str(tmp_path / "none")).listing(spark).count() == 0


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    from indexflow.plans.state import FlowState
    from indexflow.plans.update import run_update
    from indexflow.targets import Table

    root = tmp_path / "in"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.txt").write_text(f"text {i}")

    def define(b):
        b.scope["f"] = b.add_source(FileSource(str(root), connect=lambda: (Logged(root), str(root))), name="f")
        out = b.scope.add_collector()
        with b.scope["f"].row() as f:
            out.collect(filename=f["filename"], text=f["content"])
        out.export("t", Table(), primary_key_fields=["filename"])

    state = FlowState(spark, f"file://{tmp_path}/state", 4)
    assert run_update(spark, define, state).sources["f"].insertions == 6
    (tmp_path / "in.log").unlink()
    os.utime(root / "3.txt", (2e9, 2e9))
    (root / "4.txt").unlink()
    (root / "3.txt").write_text("new")
    os.utime(root / "3.txt", (2e9, 2e9))
    stats = run_update(spark, define, state).sources["f"]
    assert (stats.updates, stats.deletions, stats.no_change) == (1, 1, 4)
    assert (tmp_path / "in.log").read_text() == f"{root}/3.txt\n"


def test_tables_are_read_by_key_range(spark):
    source = TableSource(spark.range(100).withColumn("v", F.col("id") * 2), "id")
    got = source.read(spark, spark.createDataFrame([(40,), (42,), (500,)], "id long"))
    assert sorted(map(tuple, got.drop("__ordinal").collect())) == [(40, 80), (42, 84)]
    assert source.read(spark, spark.createDataFrame([], "id long")).count() == 0


@pytest.mark.parametrize(
    ("had", "now", "skip"),
    [((1000, 2), (2000, 2), False), ((2000, 2), (1000, 2), True), ((1000, 2), (3000, 2), False), ((2000, 2), (2000, 2), True), ((None, 2), (2000, 2), False), ((2000, 2), (None, 2), False), ((2000, 1), (2000, 2), False), ((2000, 2), (2000, 3), False), ((2000, 3), (2000, 2), True)],
)
def test_skip_rule(spark, had, now, skip):
    df = spark.createDataFrame([(*had, *now)], "a long, b long, c long, d long")
    assert df.select(changes.should_skip(*(F.col(c) for c in "abcd"))).first()[0] is skip


def test_changes_of_empty_tables(spark):
    listing = spark.createDataFrame([("a", 1)], "k string, ordinal long")
    tracking = spark.createDataFrame([("b", 1, "l")], "k string, ordinal long, logic string")
    both = {r["k"]: r["class"] for r in changes.detect_changes(listing, tracking, "k", "l").collect()}
    assert both == {"a": "PROCESS", "b": "DELETE"}
    assert changes.detect_changes(listing.limit(0), tracking.limit(0), "k", "l").count() == 0


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0])], "id long, v array<double>")
    for metric in vector.METRICS:
        d = {"cosine": x @ x[3] / np.sqrt((x * x).sum(1)) / np.sqrt(x[3] @ x[3]), "ip": x @ x[3], "l2": -np.sqrt(((x - x[3]) ** 2).sum(1))}[metric]
        if metric != "cosine":  # a zero vector has a distance and a product too
            d = np.append(d, {"ip": 0.0, "l2": -np.sqrt(x[3] @ x[3])}[metric])
        ids = np.append(np.arange(200), 900)[: len(d)]
        want = [int(i) for i in ids[np.lexsort((ids, -np.round(d, 9)))][:6]]
        assert [r["id"] for r in vector.top_k(df, x[3].tolist(), 6, vector="v", metric=metric, tie="id").collect()] == want
        queries = spark.createDataFrame([(3, x[3].tolist()), (5, x[5].tolist())], "query_id long, query array<double>")
        got = vector.top_k_batch(df, queries, 6, id_col="id", vector="v", metric=metric)
        assert [r["id"] for r in got.where("query_id = 3").orderBy("rank").collect()] == want
        assert got.count() == 12


def test_graph_nodes_prefer_exported_rows_and_first_mentions(spark):
    exported = spark.createDataFrame([("p1", "own")], "key string, note string")
    rels = spark.createDataFrame([("r1", "p1", "x"), ("r3", "p2", "late"), ("r2", "p2", "early")], "__t string, place string, text string")
    end = NodeFromFields("Place", (TargetFieldMapping("place", "key"), TargetFieldMapping("text", "note")))
    found = {r["key"]: (r["note"], r["self_contained"]) for r in graph.nodes(["key"], exported, [graph.end_rows(rels, end, ["__t"])], ["note"]).collect()}
    assert found == {"p1": ("own", True), "p2": ("early", False)}
    left = graph.collect_orphans(spark.createDataFrame([(1, True), (2, False), (3, False)], "k int, self_contained boolean"), "k", spark.createDataFrame([(3,), (3,)], "k int"))
    assert sorted(r["k"] for r in left.collect()) == [1, 3]


def test_graph_mappings_are_checked():
    types = {"a": basic("Str"), "b": basic("Int64"), "c": basic("Str")}
    label = graph.Label("L", (("id", basic("Str")),), (("n", basic("Int64")), ("m", basic("Str"))))
    ok = NodeFromFields("L", (TargetFieldMapping("a", "id"),))
    graph.check_end(ok, types, {"L": label}, ["k"])
    for bad in (NodeFromFields("M", ok.fields), NodeFromFields("L", (TargetFieldMapping("b", "n"),)), NodeFromFields("L", (*ok.fields, TargetFieldMapping("b", "n"))), NodeFromFields("L", (TargetFieldMapping("b", "id"),)), NodeFromFields("L", (*ok.fields, TargetFieldMapping("c", "zz")))):
        with pytest.raises(ValueError):
            graph.check_end(bad, types, {"L": label}, ["k"])
    with pytest.raises(ValueError):
        graph.check_end(ok, types, {"L": label}, ["a"])
    assert graph.declared_label(DeclaredNode("L", ("id",)), [(ok, types)]).key == (("id", basic("Str")),)


def test_setup_steps():
    old, new = TableState({"k": "bigint"}, {"a": "string", "b": "int"}, {"i": "a cosine"}), TableState({"k": "bigint"}, {"a": "string", "c": "int"}, {"i": "a l2"})
    assert diff(old, Combined(old)).change is Change.NO_CHANGE
    step = diff(new, Combined(old))
    assert (step.drop_columns, step.add_columns, step.drop_indexes, step.add_indexes) == (["b"], {"c": "int"}, ["i"], {"i": "a l2"})
    assert diff(new, Combined(old, [None])).recreate and diff(TableState({"j": "int"}), Combined(old)).recreate
    assert diff(None, Combined(None, [old])).change is Change.DELETE and diff(None, Combined()).change is Change.NO_CHANGE
    assert compatibility(new, old) is Compatibility.PARTIAL and compatibility(TableState(old.key, old.values | {"z": "int"}), old) is Compatibility.COMPATIBLE
    assert next_ids(new, Combined(old), 3, 1, 9) == (3, 2) and next_ids(TableState({"j": "int"}), Combined(old), 3, 1, 9) == (10, 1)
    assert commit_setup({"t": {"current": None, "staging": [vars(new)]}, "u": {"current": vars(old), "staging": [None]}}) == {"t": {"current": vars(new), "staging": []}}


def test_object_notices_and_their_queue():
    notice = lambda bucket, key, event: json.dumps({"Records": [{"eventName": event, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}]})
    assert object_changes(notice("b", "p/a+b%21", "ObjectCreated:Put"), "b", "p/") == [("p/a b!", True)]
    assert object_changes(notice("c", "p/a", "ObjectCreated:Put"), "b") == [] == object_changes("not json", "b") == object_changes("[]", "b")

    class Queue:
        def __init__(self):
            self.deleted, self.waiting = [], [("1", notice("b", "k", "ObjectRemoved:Delete")), ("2", "{}")]

        def receive(self, most, wait_s):
            return self.waiting

        def delete(self, receipt):
            self.deleted.append(receipt)

    queue, seen = Queue(), []
    assert drain(queue, "b", "", seen.extend) == 1 and seen == [("k", False)] and queue.deleted == ["2", "1"]
    queue = Queue()
    with pytest.raises(RuntimeError):
        drain(queue, "b", "", lambda _: (_ for _ in ()).throw(RuntimeError("down")))
    assert queue.deleted == ["2"]


class FakeDrive:
    FILES = {"root": [{"id": "d", "name": "sub", "mimeType": "application/vnd.google-apps.folder"}, {"id": "1", "name": "n", "mimeType": "text/plain", "modified": 5}, {"id": "t", "name": "x", "mimeType": "text/plain", "trashed": True}], "d": [{"id": "1", "name": "n", "mimeType": "text/plain"}, {"id": "2", "name": "doc", "mimeType": "application/vnd.google-apps.document", "modified": 9}, {"id": "f", "name": "form", "mimeType": "application/vnd.google-apps.form"}]}

    def children(self, folder):
        return self.FILES[folder]

    def content(self, file, export):
        return f"{file}:{export}".encode()

    def recent(self, since):
        return [{"id": "2", "modified": 9_000_000}, {"id": "other", "modified": 8_000_000}]


def test_drive_walks_folders_and_exports(spark):
    source = GoogleDrive(FakeDrive, ("root",))
    assert sorted((r["file_id"], r["content"]) for r in source.read(spark).collect()) == [("1", "1:None"), ("2", "2:text/markdown")]
    found, cutoff = source.changed(7_000_000, 9_500_000)
    assert [f["id"] for f in found] == ["2"] and cutoff == 8_500_000


def test_small_helpers():
    assert image_mime(b"\x89PNG\r\n\x1a\n...") == "image/png" and image_mime(b"RIFF....WEBP") == "image/webp"
    with pytest.raises(ValueError):
        image_mime(b"text")
    assert np.isclose(np.linalg.norm(hash_embedding("a b", 16)), 1) and hash_embedding("", 3) == [0, 0, 0]
    tries = []
    assert retried(lambda: tries.append(1) or (1 / (len(tries) - 2) if len(tries) == 2 else 7), tries=3, first=0.001) == 7 or len(tries) == 3
    assert LlmSpec("OpenAi", "m") == LlmSpec("OpenAi", "m", client=print)


def test_json_with_anything_behind_its_value_is_malformed(spark):
    from indexflow.functions.builtin import ParseJson

    good = {"1": "1", ' {"b": 1, "a": [null]}\n': '{"a":[null],"b":1}', "null": None, '"x"': "x", "[]": "[]", " 5 ": "5"}
    bad = ["1 x", "47034 Achverber auf", '"a" b', "{} {}", "[1]]", "1], [2", '1,"x"] y', "1, 2", "", "  ", "tru", "-"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    _, value, error = ParseJson().column({"text": (F.col("t"), basic("Str", True))})
    got = {r["t"]: (r["v"], r["e"]) for r in df.select("t", value.alias("v"), error.alias("e")).collect()}
    assert {t: got[t][0] for t in good} == good and not any(got[t][1] for t in good)
    assert all(got[t] == (None, "ParseJson: malformed text") for t in bad) and got[None] == (None, None)


def test_the_best_rows_are_kept_from_block_to_block():
    rng = np.random.default_rng(3)
    for k in (1, 3, 7):
        ids, s = rng.permutation(60), rng.integers(0, 4, (5, 60)) / 3 + rng.choice([0.0, 1e-14], (5, 60))
        s[0], s[1, ::2] = np.nan, np.inf
        best = (*(np.empty(0, t) for t in (np.int64, np.float64, np.int64)), np.full(5, -np.inf))
        for i in range(0, 60, 8):
            best = vector.better(best, s[:, i : i + 8], ids[i : i + 8], k)
        want = [(q, i) for q in range(5) for _, i in sorted((-round(v, 12), i) for v, i in zip(s[q], ids, strict=True) if np.isfinite(v))[:k]]
        assert list(zip(best[0].tolist(), best[2].tolist(), strict=True)) == want


def test_tracked_fingerprints_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(changes, "ROWS_A_TASK", 10)
    tracked = spark.createDataFrame([(i, f"p{i % 3}") for i in range(40)] + [(1, "p7")], "k long, print string")
    new = spark.createDataFrame([(i, f"p{i % 2}") for i in range(5, 50)], "k long, print string")
    upserts, deletes = changes.changed_targets(new, tracked, ["k"], rows=41)
    assert sorted(r["k"] for r in upserts.collect()) == [i for i in range(5, 50) if i >= 40 or i % 2 != i % 3]
    assert sorted(r["k"] for r in deletes.collect()) == list(range(5))
    assert "Broadcast" not in upserts._jdf.queryExecution().executedPlan().toString()


def test_the_range_of_many_wanted_keys_is_not_looked_for(spark):
    source = TableSource(spark.range(100).withColumn("v", F.col("id") * 2), "id")
    keys = spark.createDataFrame([(40,), (42,), (500,)], "id long").withColumn("id", F.when(F.col("id") >= 0, F.col("id")).otherwise(F.raise_error(F.lit("read"))))
    keys._indexflow_rows = 10**6
    got = source.read(spark, keys)
    assert ">= 40" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.drop("__ordinal").collect())) == [(40, 80), (42, 84)]
