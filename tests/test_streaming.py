from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from disputeflow import constants as C
from disputeflow.operators import audit, report, retrieval
from disputeflow.plans import modelling
from disputeflow.plans.queries import _features
from disputeflow.sources import driver_tables as given, sinks
from disputeflow.sources.audit_store import AuditStore
from disputeflow.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def order_files(spark, tmp_path_factory):
    """The order table in three files, so that a stream has several files to take."""
    folder = str(tmp_path_factory.mktemp("orders") / "files")
    given.read(spark, SF, "orders").repartition(3).write.parquet(folder)
    return folder


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return given.from_orders(jobs.read_stream(spark, folder, schema))


def test_features_equal_the_batch(spark, order_files, tmp_path):
    enriched = jobs.enrich(
        stream(spark, order_files), given.customers(spark, SF), given.orders(spark, SF)
    )
    names = ["transaction_id", *C.FEATURE_COLUMNS]
    jobs.start_table(
        enriched.select(*names), str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = _features(spark, SF).select(*names)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_model_refresh(spark, tmp_path, order_files):
    table = _features(spark, SF)
    folder = str(tmp_path / "models")
    settings = {"n_trees": 3, "forest_depth": 3}
    first = modelling.fit_models(table, [C.RANDOM_FOREST], **settings)[C.RANDOM_FOREST]
    sinks.save_model(first, folder, C.RANDOM_FOREST)
    newest = jobs.ModelFile(spark, folder, C.RANDOM_FOREST)
    loaded = newest.current()
    assert newest.current() is loaded  # unchanged, not loaded again
    second = modelling.fit_models(table, [C.RANDOM_FOREST], seed=7, **settings)[C.RANDOM_FOREST]
    sinks.save_model(second, folder, C.RANDOM_FOREST)
    assert newest.current() is not loaded

    enriched = jobs.enrich(
        stream(spark, order_files), given.customers(spark, SF), given.orders(spark, SF)
    )
    jobs.start_batches(
        enriched, jobs.score_batches(newest, str(tmp_path / "out")), str(tmp_path / "cp")
    ).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    batch = report.score_records(modelling.score(second, table), C.RANDOM_FOREST)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_reviews_survive_a_repeated_batch(spark, tmp_path):
    folder = str(tmp_path / "reviews")
    batch = given.reviews(spark, SF)
    store = AuditStore(spark, f"{folder}/audit").declare()
    each = jobs.review_batches(store, folder)
    each(batch, 0)
    each(batch, 0)  # the same batch again after a failure
    stored = store.read()
    accepted, rejected = audit.split_by_decision(batch)
    assert stored.count() == accepted.count() == stored.select("audit_key").distinct().count()
    assert spark.read.parquet(f"{folder}/rejects").count() == rejected.count()


def test_investigations(spark, order_files, tmp_path):
    corpus = spark.createDataFrame(
        [(0, "delivery proof"), (1, "refund rules"), (2, "device checks")], "chunk_id long, text string"
    )
    index = retrieval.build_index(corpus)
    enriched = jobs.enrich(
        stream(spark, order_files), given.customers(spark, SF), given.orders(spark, SF)
    )
    number = F.regexp_extract("transaction_id", r"(\d+)$", 1).cast("int")
    asked = enriched.withColumns(
        {
            "risk_probability": F.when(number % 10 != 0, given.fixture_score()),
            "query_id": number % 2,
            "query": F.when(number % 2 == 0, "delivery").otherwise("refund device"),
        }
    )
    folder = str(tmp_path / "out")
    jobs.start_batches(
        asked, jobs.investigate_batches(corpus, index, folder), str(tmp_path / "cp")
    ).awaitTermination()
    done = spark.read.parquet(f"{folder}/reports")
    rejected = spark.read.parquet(f"{folder}/rejects")
    total = given.read(spark, SF, "orders").count()
    assert done.count() + rejected.count() == total and rejected.count() == total / 10
    best = {r["query"]: r["p"] for r in rows(
        done.select("query", F.col("policy_evidence")[0]["policy"].alias("p")).distinct())}
    assert best["delivery"] == "delivery proof" and best["refund device"] in ("refund rules", "device checks")
    assert done.where(F.size("policy_evidence") != 3).count() == 0


def test_a_folder_of_the_driver_is_refused_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from disputeflow.session import shared_folder

    def session(master, **conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)))

    for warehouse in ("file:/home/me/warehouse", "/home/me/warehouse"):
        known = {"spark.sql.warehouse.dir": warehouse}
        assert "/shared/x-" in shared_folder(session("local[8]", **known), "x")
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session("spark://host:7077", **known), "x")
        assert shared_folder(session("yarn", **known, **{"spark.checkpoint.dir": "/mnt/all"}), "x").startswith("/mnt/all/x-")
    shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "hdfs://n/warehouse"}), "x")
