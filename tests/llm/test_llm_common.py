"""Shared helpers: scratch tables, samples and key filters."""

import numpy as np

from sheetwise.llm import common as C


def test_key_filter_never_loses_a_key(spark):
    C.prepare(spark)
    keys = spark.range(0, 3000).selectExpr("xxhash64(id) AS k")
    shared = C.key_filter(keys, "k")
    assert shared.value.nbytes == 8 << 20
    passed = keys.where(C.maybe(shared, "k"))
    assert passed.count() == 3000
    others = spark.range(10_000, 20_000).selectExpr("xxhash64(id) AS k")
    assert others.where(C.maybe(shared, "k")).count() < 20
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS k").where(C.maybe(shared, "k")).count() == 1
    none = C.key_filter(keys.limit(0), "k")
    assert not C.may_hold(none.value, np.array([1, -5, 1 << 60])).any()


def test_sample_is_bounded_and_repeatable(spark):
    C.prepare(spark)
    d = spark.createDataFrame([(i % 50, f"t{i % 50}") for i in range(400)] + [(None, "x"), (77, None)], "k long, v string")
    got = C.sample(d, "k", "v", 20)
    assert 19 <= len(got) <= 20 and len(set(got)) == len(got)
    assert got == C.sample(d.repartition(7), "k", "v", 20)
    assert C.sample(d.limit(0), "k", "v", 20) == []


def test_stored_tables_keep_schema_and_rows(spark, odd_docs, no_docs):
    C.prepare(spark)
    for d in (odd_docs, no_docs):
        back = C.stored(d, "x")
        assert back.dtypes == d.dtypes and back.count() == d.count()
