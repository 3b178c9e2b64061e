import pytest
from pyspark.sql import functions as F

from sedimark.errors import StorageError
from sedimark.operators.incremental import KeyedState, changed, clean_hash, content_hash, current_rows, new_part, pending_files
from sedimark.operators.references import ForeignKey, Keyed, cascade, direct, records
from sedimark.operators.skew import hot_keys, join_spread, join_unique
from sedimark.plans.general import QUERIES

META = "file_id string, hash string, modified long, extra string"
LOG = "file_id string, hash string, last_indexed long, status string"


def pend(spark, meta, log):
    return {(r.key, r.change) for r in pending_files(spark.createDataFrame(meta, META), spark.createDataFrame(log, LOG)).collect()}


def test_pending_files_cases(spark):
    meta = [
        ("same", "AA", 2, None), ("same", "bb", 1, None),
        ("moved", "aa", 1, None), ("moved", "cc", None, None),
        ("other", "bb", 5, None), ("none", "dd", None, None), ("blank", " ", 3, None), ("nohash", None, 3, None),
        (None, "ee", 1, None), ("failed", "ff", 1, None), ("twice", "gg", 1, None), ("twice", "gg", 1, None),
    ]
    log = [("same", " sha256:aa\n", 9, "\tIndexed"), ("moved", "aa", 1, "INDEXED "), ("other", "aa", 7, "indexed"), ("other", "bb", 6, "Indexed"), ("failed", "ff", 3, "Failed"), ("gone", "zz", 3, "Indexed"), ("twice", "", 3, "Indexed"), ("twice", None, 4, "Indexed")]
    assert pend(spark, meta, log) == {("other", "changed"), ("none", "new"), ("failed", "new"), ("twice", "new")}


def test_pending_files_empty(spark):
    assert pend(spark, [], []) == set()
    assert pend(spark, [("a", "x", 1, None)], []) == {("a", "new")}
    assert pend(spark, [], [("a", "x", 1, "Indexed")]) == set()


def test_clean_hash(spark):
    got = spark.createDataFrame([(" SHA256:Ab\n",), ("",), (None,), ("sha256:",)], "h string").select(clean_hash(F.col("h"))).collect()
    assert [r[0] for r in got] == ["ab", None, None, None]


def test_content_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), ("a1:b", ""), ("a", "b")], "x string, y string")
    assert df.select(content_hash(["x", "y"]).alias("h")).distinct().count() == 5


def test_state_survives_failure_and_conflict(spark, tmp_path):
    state = KeyedState(spark, f"file://{tmp_path}/state")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, hash string")
    picked = state.select(now)
    assert picked.count() == 2 and state.version() == 0
    again = state.select(now)  # the first run died before it committed
    assert again.count() == 2
    assert state.commit(again, 0) == 1
    assert state.select(now).count() == 0
    later = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "key string, hash string")
    picked = state.select(later)
    assert {(r.key, r.change) for r in picked.collect()} == {("b", "changed"), ("c", "new")}
    state.commit(picked, 1)
    with pytest.raises(StorageError):
        state.commit(picked, 1)
    assert {tuple(r) for r in state.read().collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_state_is_written_anew_after_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyedState, "MOST_PARTS", 3)
    state = KeyedState(spark, f"file://{tmp_path}/state")
    for n in range(6):
        now = spark.createDataFrame([("a", str(n)), (f"k{n}", "1")], "key string, hash string")
        picked = state.select(now)
        assert picked.count() == 2
        state.commit(picked, n)
    assert {tuple(r) for r in state.read().collect()} == {("a", "5"), *((f"k{n}", "1") for n in range(6))}
    assert {tuple(r) for r in state.read(2).collect()} == {("a", "1"), ("k0", "1"), ("k1", "1")}
    assert len(state.versions.parts(6)) < 4


def test_writers_that_interleave_lose_nothing(spark, tmp_path):
    """Both have passed every check on the same base when each puts up its version; one is turned away whole."""
    row = lambda *x: spark.createDataFrame(list(x), "key string, hash string")
    one, two = KeyedState(spark, f"file://{tmp_path}/state"), KeyedState(spark, f"file://{tmp_path}/state")
    one.commit(row(("base", "0")), 0)
    staged = two.versions.stage(row(("b1", "1")))
    part = new_part()
    one.commit(row(("a1", "1"), ("a2", "1")), 1)
    with pytest.raises(StorageError):
        two.versions.publish([*two.versions.names(1), part], {part: staged}, 1)
    assert one.version() == two.version() == 2
    assert {r.key for r in two.read().collect()} == {"base", "a1", "a2"}
    two.commit(row(("b1", "1")), two.version())
    assert {r.key for r in one.read().collect()} == {"base", "a1", "a2", "b1"}
    fresh = KeyedState(spark, f"file://{tmp_path}/state")
    (tmp_path / "state" / "HINT").unlink()
    assert fresh.version() == 3


def test_chains_of_any_length(spark):
    rows = [(str(i), str(i - 1)) for i in range(1, 56)]
    t = {"t": Keyed(spark.createDataFrame(rows, "id string, up string"), "id")}
    got = {(r.record_id, r.depth) for r in records(cascade(t, [ForeignKey("t", "up", "t")])).collect()}
    assert got == {(str(i), i - 1) for i in range(1, 56)}


def test_cascade_of_tables_and_a_circle(spark):
    a = spark.createDataFrame([("a1", "gone", "b1"), ("a2", None, "b2")], "id string, f string, b string")
    b = spark.createDataFrame([("b1", "a2"), ("b2", "a1"), ("b3", "a2")], "id string, a string")
    f = spark.createDataFrame([("f1",)], "id string")
    t = {"a": Keyed(a, "id"), "b": Keyed(b, "id"), "f": Keyed(f, "id")}
    got = {(r.table_name, r.record_id, r.depth) for r in records(cascade(t, [ForeignKey("a", "f", "f"), ForeignKey("a", "b", "b"), ForeignKey("b", "a", "a")])).collect()}
    assert got == {("a", "a1", 0), ("b", "b2", 1), ("a", "a2", 2), ("b", "b1", 3), ("b", "b3", 3)}


def test_state_ignores_half_written_version(spark, tmp_path):
    state = KeyedState(spark, f"file://{tmp_path}/state")
    now = spark.createDataFrame([("a", "1")], "key string, hash string")
    now.write.parquet(f"file://{tmp_path}/state/part-00000001")
    assert state.version() == 0
    assert state.commit(state.select(now), 0) == 1
    assert state.read().count() == 1


EDGE = "edge_id string, from_id string, to_id string, created_at long, ref string"
NODE = "id string, created_at long, ref string"


def graph(spark, edges, nodes):
    return {"e": Keyed(spark.createDataFrame(edges, EDGE), "edge_id", "created_at"), "n": Keyed(spark.createDataFrame(nodes, NODE), "id", "created_at")}, [ForeignKey("e", "from_id", "n", True), ForeignKey("e", "to_id", "n", True)]


def test_direct(spark):
    day = 86_400_000
    edges = [("1", "a", "b", 5 * day, "x"), ("1", "a", "b", 5 * day, "x"), ("2", "late", "gone", 1, None), ("3", "", None, 1, None), ("4", "late", "A", None, None), ("5", "late", "a", None, None), ("5", "late", "a", 40 * day, None), (None, "gone", "a", 1, None)]
    nodes = [("a", 0, "x"), ("b", None, None), ("late", 2 * day, None), ("late", 9 * day, None), (None, 1, None)]
    got = {tuple(r) for r in direct(cascade(*graph(spark, edges, nodes))).collect()}
    assert got == {
        ("e", "from_id", "2", "1970-01", "late"), ("e", "to_id", "2", "1970-01", "absent"), ("e", "to_id", "4", "unknown", "absent"), ("e", "from_id", None, "1970-01", "absent"),
    }


def test_direct_empty(spark):
    assert direct(cascade(*graph(spark, [], []))).count() == 0
    assert direct(cascade(*graph(spark, [("1", "a", "b", None, None)], []))).count() == 2


def test_cascade_reaches_fixpoint(spark):
    rows = [("a", "missing"), ("b", "a"), ("c", "b"), ("d", None), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "c"), ("y", "z")]
    t = {"t": Keyed(spark.createDataFrame(rows, "id string, up string"), "id")}
    got = {(r.record_id, r.origin, r.depth) for r in records(cascade(t, [ForeignKey("t", "up", "t")])).collect()}
    assert got == {("a", "direct", 0), ("b", "inherited", 1), ("c", "inherited", 2), ("z", "inherited", 3), ("y", "inherited", 4), ("x", "inherited", 5)}


def test_join_unique_with_hot_key(spark, monkeypatch):
    monkeypatch.setattr("sedimark.operators.skew.LEAST_ROWS", 10_000)
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    assert hot_keys(left, "k") == ["hot"]
    right = spark.createDataFrame([("hot", 1), ("2", 2)], "k string, v int")
    got = join_unique(left, right, "k")
    assert got.count() == 30_000
    assert got.groupBy("v").count().where("v is not null").orderBy("v").collect() == [(1, 10_000), (2, 1)]
    assert current_rows(left.withColumns({"h": F.lit("A"), "m": F.lit(1)}), "k", "h", "m").count() == 20_000
    assert changed(current_rows(left.withColumns({"h": F.lit("A"), "m": F.lit(1)}), "k", "h", "m"), spark.createDataFrame([("hot", "a")], "key string, hash string")).count() == 19_999


def test_join_spread_over_a_hub(spark):
    few = spark.createDataFrame([("hub", 1), ("hub", 2), ("leaf", 3), (None, 4)], "k string, seed int")
    many = spark.range(500).select(F.when(F.col("id") < 400, "hub").otherwise(F.concat(F.lit("leaf"), F.when(F.col("id") > 400, F.col("id").cast("string")).otherwise(""))).alias("k"), F.col("id").cast("string").alias("dst"))
    plain = {tuple(r) for r in join_spread(few, many, "k", "dst", []).select("k", "seed", "dst").collect()}
    assert {tuple(r) for r in join_spread(few, many, "k", "dst", ["hub"]).select("k", "seed", "dst").collect()} == plain and len(plain) == 801


def test_written_tables_can_be_forgotten(spark):
    from sedimark.storage_paths import forget, shared_dir, written

    forget(spark)
    t = written(spark.range(3).selectExpr("id", "array(id) AS a"), "x")
    assert t.count() == 3 and shared_dir(spark)
    assert forget(spark) == 1 and forget(spark) == 0


def test_package_is_shipped(spark):
    import zipfile

    from sedimark.session import ship

    ship(spark)
    ship(spark)
    sent = [f for f in spark.sparkContext._python_includes if f == "sedimark_package.zip"]
    assert len(sent) == 1
    from pyspark import SparkFiles

    assert "sedimark/operators/graph.py" in zipfile.ZipFile(SparkFiles.get("sedimark_package.zip")).namelist()


def test_orphans_are_inherited_down_to_the_edges(spark, tmp_path):
    may, june = 1_714_953_600_000, 1_717_632_000_000  # 2024
    for name, rows, schema in (
        ("file_meta", [("f",)], "file_id string"),
        ("chunks", [("good", "f", may), ("bad", "gone", may)], "chunk_id string, file_id string, created_at long"),
        ("graph_nodes", [("n", "Chunk", "good", may), ("heir", "Chunk", "bad", may), ("lost", "Chunk", "none", may), ("e", "Entity", "none", may)], "id string, node_type string, ref_id string, created_at long"),
        ("graph_edges", [("fine", "n", "e", june), ("deep", "heir", "e", june), ("near", "heir", "lost", None), ("own", "x", "heir", june), ("own", "e", "heir", may)], "edge_id string, from_id string, to_id string, created_at long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in QUERIES["p2_cascade"](spark, str(tmp_path)).select("table_name", "period", "origin", "depth", "n").collect()}
    assert got == {
        ("chunks", "2024-05", "direct", 0, 1), ("graph_nodes", "2024-05", "direct", 0, 1), ("graph_nodes", "2024-05", "inherited", 1, 1),
        ("graph_edges", "2024-05", "direct", 0, 1), ("graph_edges", "unknown", "inherited", 1, 1), ("graph_edges", "2024-06", "inherited", 2, 1),
    }
