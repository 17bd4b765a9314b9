"""Work that must not be done twice, in one task, or in pairs that are stored."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codeatlas import tree_demo
from codeatlas.extract import extract
from codeatlas.operators import closure
from codeatlas.plans import library as q
from codeatlas.resolve import build_graph
from codeatlas.schema import DEFINITION, IMPORT, RELS

SF = "/root/testdata/sf0.001"


def test_tree_is_parsed_in_many_tasks_and_once(spark, tmp_path):
    files = tree_demo.source_rows(spark, SF).where("status = 'ok'")
    assert files.rdd.getNumPartitions() > 1
    rows, met = extract(files), str(tmp_path)

    def seen(batches):
        open(os.path.join(met, os.urandom(8).hex()), "w").close()
        yield from batches

    one = rows.coalesce(1).mapInArrow(seen, rows.schema)
    g = build_graph(files, one, "tree", "/tree")
    n = files.count() // 10
    assert (g.scan(DEFINITION).count(), g.scan(IMPORT).count()) == (52 * n, 10 * n)
    assert len(os.listdir(met)) == 1


def test_small_files_share_a_batch(spark):
    files = tree_demo.source_rows(spark, SF).where("status = 'ok'").coalesce(1)
    rows = extract(files)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    assert rows.mapInArrow(sizes, "n long").count() < files.count() // 10


def brute(edges):
    near = {}
    for s, d in edges:
        near.setdefault(s, set()).add(d)
    out = {}
    for s in near:
        level, depth = near[s], 1
        while level := {x for x in level if (s, x) not in out}:
            out |= {(s, x): depth for x in level}
            level, depth = set().union(*(near.get(x, set()) for x in level)), depth + 1
    return out


@pytest.mark.parametrize("block", [4, 2048])
def test_closure_of_lines_rings_and_branches(spark, monkeypatch, block):
    monkeypatch.setattr(closure, "BLOCK", block)
    line = [(i, i + 1) for i in range(40)]
    edges = line + [(100 + i, 100 + (i + 1) % 12) for i in range(12)] + [(200 + i, 201 + i) for i in range(20)] + [(205, 300), (300, 301)] + [(400, 401), (500, 500)]
    edges += [(600 + i, 601 + i) for i in range(15)] + [(700 + i, 701 + i) for i in range(15)] + [(715, 610)] + [(800 + i, 801 + i) for i in range(11)] + [(811, 900), (811, 901)]
    got = closure.closure(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(set(got)) and {(r.src, r.dst): r.depth for r in got} == brute(edges)


def test_long_chain_stores_no_pairs(spark, monkeypatch):
    kept, cut = [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    out = closure.closure(spark.range(1500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert out.count() == 1500 * 1501 // 2
    assert max(t.count() for t in kept) < 8 * 1500


def test_dedup_nodes_deals_no_wide_rows(spark):
    from codeatlas.demo import Demo

    got = __spark_entry__.queries()["dedup_nodes"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "relationship_id" not in plan and "source_language" not in plan
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert {tuple(r) for r in got.collect()} == set(db.execute(__spark_entry__.oracle_sql()["dedup_nodes"]).fetchall())
    wide = q.unique_nodes(Demo(spark, SF).graph.sections(RELS))
    assert wide.count() == got.count() and len(wide.columns) == 17
