"""Documents, segments, graph and store that change together."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import knowledge as K


def extract(segments):
    """Words in capitals are entities, neighbours among them are related."""
    words = segments.select(F.col("id").alias("segment_id"), F.regexp_extract_all("text", F.lit("([A-Z]+)"), 1).alias("w"))
    entities = words.select("segment_id", F.explode("w").alias("name"), F.lit("word").alias("entity_type"))
    pairs = words.where("size(w) > 1").select("segment_id", F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] AS a, w[i] AS b))")).alias("p"))
    return entities, pairs.select("segment_id", F.lit("next").alias("type"), F.col("p.a").alias("start_name"), F.lit("word").alias("start_type"), F.col("p.b").alias("end_name"), F.lit("word").alias("end_type"))


@pytest.fixture
def base(spark, tmp_path):
    k = K.Knowledge(spark, f"{tmp_path}/base", extract)
    k.add_documents(docs(spark, "1", "2"), segs(spark, ("1:0", "1", "A b B"), ("1:1", "1", "B C"), ("2:0", "2", "A B D")))
    return k


def docs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


def segs(spark, *rows):
    return spark.createDataFrame([(i, d, int(i.split(":")[1]), t) for i, d, t in rows], "id string, doc_id string, index int, text string")


def state(k, version=None):
    nodes = {r.name: (r.n_segments, r.n_documents) for r in k.references(version=version).collect()}
    names = {r.id: r.name for r in k.table("nodes", version).collect()}
    edges = {(names[r.start_node] + names[r.end_node]): r.n_segments for r in k.references("edge", version).collect()}
    assert len(names) == len(nodes) and k.table("edges", version).count() == len(edges)
    return nodes, edges, sorted(r.id for r in k.table("segments", version).collect())


FULL = ({"A": (2, 2), "B": (3, 2), "C": (1, 1), "D": (1, 1)}, {"AB": 2, "BC": 1, "BD": 1}, ["1:0", "1:1", "2:0"])


def test_add_and_remove(base, spark):
    assert state(base) == FULL
    base.put_values(spark.createDataFrame([("1:0", "weight", "2"), ("2:0", "weight", "3"), ("none", "weight", "1")], "segment_id string, key string, value string"))
    base.remove_segments(spark.createDataFrame([("1:1",), ("none",)], "id string"))
    assert state(base) == ({"A": (2, 2), "B": (2, 2), "D": (1, 1)}, {"AB": 2, "BD": 1}, ["1:0", "2:0"])
    base.remove_documents(docs(spark, "2", "9"))
    assert state(base) == ({"A": (1, 1), "B": (1, 1)}, {"AB": 1}, ["1:0"])
    assert [tuple(r) for r in base.table("store").collect()] == [("1:0", "weight", "2")] and base.table("documents").count() == 1
    base.remove_documents(docs(spark, "1"))
    assert state(base) == ({}, {}, []) and base.table("mentions").count() == base.table("store").count() == 0
    assert state(base, 1) == FULL


def test_update_keeps_what_new_texts_mention(base, spark):
    base.put_values(spark.createDataFrame([("1:1", "score", "5")], "segment_id string, key string, value string"))
    base.update_segments(spark.createDataFrame([("1:1", "C E"), ("2:0", "x"), ("no", "Z")], "id string, text string"))
    assert state(base) == ({"A": (1, 1), "B": (1, 1), "C": (1, 1), "E": (1, 1)}, {"AB": 1, "CE": 1}, ["1:0", "1:1", "2:0"])
    assert base.table("store").count() == 1 and {r["index"] for r in base.table("segments").collect()} == {0, 1}


def test_replacing_and_adding_to_documents(base, spark):
    base.add_documents(docs(spark, "1"), segs(spark, ("1:0", "1", "C D"), ("8:0", "8", "Z")))
    assert state(base) == ({"A": (1, 1), "B": (1, 1), "C": (1, 1), "D": (2, 2)}, {"AB": 1, "BD": 1, "CD": 1}, ["1:0", "2:0"])
    base.add_segments(segs(spark, ("1:5", "1", "A"), ("1:0", "1", "never"), ("7:0", "7", "Z")))
    assert state(base)[2] == ["1:0", "1:5", "2:0"] and state(base)[0]["A"] == (2, 2)
    nodes, edges = base.drawn_from(["1:0", "1:5"])
    assert {r.name for r in nodes.collect()} == {"A", "C", "D"} and edges.count() == 1


class Lost(Exception):
    pass


@pytest.mark.parametrize("after", [5])
def test_writer_lost_half_way(base, spark, monkeypatch, after):
    """Nothing is seen of a change that was not finished; done again, it takes over what was written."""
    new = segs(spark, ("3:0", "3", "A E"), ("1:0", "1", "E"))
    change = lambda k: k.add_documents(docs(spark, "3", "1"), new, op="third")
    made, write = [], K.Knowledge._rows
    from pyspark.sql.readwriter import DataFrameWriter

    parquet = DataFrameWriter.parquet

    def stopped(self, path, *a, **b):
        if len(made) == after:
            raise Lost
        made.append(path)
        return parquet(self, path, *a, **b)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", stopped)
        with pytest.raises(Lost):
            change(base)
    again = K.Knowledge(spark, base.root, extract)
    assert again.version() == 1 and state(again) == FULL and write is K.Knowledge._rows
    done = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (done.append(path), parquet(self, path, *a, **b))[1])
    assert change(again) == 2 and not set(done) & set(made)
    want = ({"A": (2, 2), "B": (1, 1), "D": (1, 1), "E": (2, 2)}, {"AB": 1, "AE": 1, "BD": 1}, ["1:0", "2:0", "3:0"])
    assert state(again) == want
    assert change(again) == 2 and state(again) == want


def test_a_lost_change_after_another_one_begins_anew(base, spark, monkeypatch):
    monkeypatch.setattr(K.Knowledge, "_write", lambda self, value, *parts: (_ for _ in ()).throw(Lost()) if parts[0] == "_log" else WRITE(self, value, *parts))
    with pytest.raises(Lost):
        base.remove_segments(spark.createDataFrame([("1:1",)], "id string"), op="late")
    monkeypatch.undo()
    base.add_segments(segs(spark, ("2:1", "2", "C")))
    base.remove_segments(spark.createDataFrame([("1:1",)], "id string"), op="late")
    assert state(base) == ({"A": (2, 2), "B": (2, 2), "C": (1, 1), "D": (1, 1)}, {"AB": 2, "BD": 1}, ["1:0", "2:0", "2:1"])


WRITE = K.Knowledge._write


def test_two_writers(base, spark):
    other = K.Knowledge(spark, base.root, extract)
    record = other.record()
    base.add_segments(segs(spark, ("2:1", "2", "C")))
    other.record = lambda version=None: record
    with pytest.raises(K.Conflict):
        other.remove_documents(docs(spark, "1"))
    assert state(base)[2] == ["1:0", "1:1", "2:0", "2:1"]


def test_compact_and_vacuum(base, spark):
    base.remove_segments(spark.createDataFrame([("1:1",)], "id string"))
    before = state(base)
    base.compact()
    assert state(base) == before and max(map(len, base.record()["tables"].values())) == 1
    assert base.vacuum() > 0 and state(base) == before
    base.add_segments(segs(spark, ("2:1", "2", "C")))
    assert state(base)[0]["C"] == (1, 1)


def test_backup_and_restore(base, spark, tmp_path):
    base.put_values(spark.createDataFrame([("1:0", "vote", "1")], "segment_id string, key string, value string"))
    manifest = base.backup(f"{tmp_path}/saved")
    assert manifest["tables"] == {"documents": 2, "segments": 3, "nodes": 4, "edges": 3, "mentions": 11, "store": 1}
    base.remove_documents(docs(spark, "1", "2"))
    base.add_documents(docs(spark, "5"), segs(spark, ("5:0", "5", "Z")))
    base.restore(f"{tmp_path}/saved")
    assert state(base) == FULL and base.table("store").count() == 1
    new = K.Knowledge(spark, f"{tmp_path}/new", extract)
    new.restore(f"{tmp_path}/saved")
    assert state(new) == FULL
    with pytest.raises(ValueError):
        new.restore(f"{tmp_path}/nowhere")
    spark.createDataFrame([], K.TABLES["nodes"]).write.mode("overwrite").parquet(f"{tmp_path}/saved/nodes")
    with pytest.raises(ValueError):
        new.restore(f"{tmp_path}/saved")
    assert state(new) == FULL


def test_restore_keeps_nothing_of_before_to_be_read(base, spark, tmp_path):
    """What a backup replaces leaves the record: no removals that each later read would join."""
    base.backup(f"{tmp_path}/saved")
    base.remove_documents(docs(spark, "1"))
    base.restore(f"{tmp_path}/saved")
    assert all(len(c) == 1 and "add" in c[0] for c in base.record()["tables"].values())
    assert state(base) == FULL and state(base, 1) == FULL


def test_removal_reads_mentions_once(base, spark):
    """What is lost is found by one join and one grouping of the mentions."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, parquet = {}, DataFrameWriter.parquet

    def seen(self, path, *a, **b):
        plans[path] = self._df._jdf.queryExecution().optimizedPlan().toString()
        return parquet(self, path, *a, **b)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", seen)
        base.remove_segments(spark.createDataFrame([("1:1",)], "id string"), op="gone")
    [lost] = [p for at, p in plans.items() if "/_steps/gone/" in at]
    assert lost.count("Join") == 1, lost
