"""Outputs measured by the jobs that write them."""

import json

import pytest
from pyspark.sql import functions as F

from tectra.operators import integrity
from tectra.schemas import CatalogError
from tectra.sources import outputs

GOOD = {
    "summary": {"source": "AFAD", "n_events": 1, "date_min": 1, "date_max": 2},
    "meta": {"source": "AFAD", "n_cells": 1, "n_big_events": 1, "disclaimer": "Deprem TAHMİNİ değildir", "mc": 2.5, "use_restriction": "rating girdisi değildir"},
    "cells": {"properties": dict.fromkeys(integrity.CELL_KEYS, 1)},
    "big_events": {"properties": {"mag": 5}},
}


def a_set(spark, **changes):
    row = lambda k: changes.get(k, GOOD[k])
    one = lambda k, column: spark.createDataFrame([] if row(k) is None else [(json.dumps(row(k)),)], f"{column} string")
    return {"catalog": spark.range(changes.get("n_events", 3)), "summary": one("summary", "json"), "meta": one("meta", "json"), "cells": one("cells", "feature"), "big_events": one("big_events", "feature")}


CHANGES = [{}, {"n_events": 0}, {"summary": GOOD["summary"] | {"source": "x"}}, {"summary": {"source": "AFAD"}}, {"meta": {k: v for k, v in GOOD["meta"].items() if k != "mc"}}, {"meta": GOOD["meta"] | {"source": None, "disclaimer": "", "use_restriction": "free"}}, {"cells": {"properties": {"risk_index": 1}}}, {"cells": None}, {"big_events": {}}, {"big_events": None}]


def test_same_faults_as_the_gate(spark, tmp_path):
    path = str(tmp_path)
    for change in CHANGES:
        o = a_set(spark, **change)
        want = integrity.output_faults(*o.values(), source="AFAD", site_layer=False).first()
        if want.faults:
            with pytest.raises(CatalogError, match=", ".join(want.faults)):
                outputs.publish_outputs(path, o, "AFAD", site_layer=False)
        else:
            assert outputs.publish_outputs(path, o, "AFAD", site_layer=False) == {"n_events": 3, "n_cells": 1, "n_big_events": 1}
        # what is refused is never published, and leaves nothing
        assert outputs.read_outputs(spark, path)["catalog"].count() == 3 and len(list((tmp_path / "sets").iterdir())) == 1


def test_one_scan_a_table(spark, tmp_path):
    """The job that writes is the only one that reads: rows pass a counter once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    o = a_set(spark)
    o["catalog"] = spark.range(1000).mapInArrow(count, "id long")
    assert outputs.publish_outputs(str(tmp_path), o, "AFAD", site_layer=False)["n_events"] == 1000 and seen.value == 1000
    o = a_set(spark)
    o["catalog"] = spark.range(5).select(F.assert_true(F.col("id") < 4))
    with pytest.raises(Exception):  # noqa: B017
        outputs.publish_outputs(str(tmp_path), o, "AFAD", site_layer=False)
    assert outputs.read_outputs(spark, str(tmp_path))["catalog"].count() == 1000
    assert outputs.read_outputs(spark, str(tmp_path / "none")) is None
    with pytest.raises(CatalogError):
        outputs.publish_outputs(str(tmp_path), {"catalog": o["catalog"]}, "AFAD")


def test_sets_share_one_catalog(spark, monkeypatch):
    """Two sets of outputs, one of them refused, make each of the catalog's rows once."""
    from tectra.plans import proofs
    from tests.conftest import DATA

    made = spark.sparkContext.accumulator(0)
    plain = proofs.catalog

    def counted(x):
        made.add(1)
        return x

    monkeypatch.setattr(proofs, "catalog", lambda *a: plain(*a).withColumn("mag", F.udf(counted, "double")("mag")))
    got = proofs.published_outputs(spark, f"{DATA}/sf0.001").first()
    assert got.source == "AFAD" and got.n_events == made.value == plain(spark, f"{DATA}/sf0.001").count()
