"""Tables that grow with the packages don't go through the driver, however small their files are."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelloom import staging
from labelloom.operators import fields, folds
from labelloom.operators.lines import prepare
from labelloom.plans import fixtures

DATA = "/root/testdata/sf0.001"


def _broadcast_keys(df) -> list[str]:
    """The keys of all joins that are planned as broadcasts."""
    return re.findall(r"Broadcast\w*Join \[([^\]]*)\]", df._jdf.queryExecution().sparkPlan().toString())


@pytest.mark.parametrize("name", ["extracted_fields", "package_analysis", "package_declarations", "value_clusters"])
def test_no_table_of_packages_is_broadcast(spark, monkeypatch, name):
    keys = []
    stage = staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, n: keys.extend(_broadcast_keys(df)) or stage(df, n))
    keys += _broadcast_keys(entry.queries()[name](spark, DATA))
    # what is left is joined with fixed tables: labels by their lengths
    assert [k for k in keys if not k.startswith("chars#")] == []


def test_letters_decide_before_texts_are_matched(spark, monkeypatch):
    """Longer and longer readings share half of their letters at most: none of their pairs need sequence matching."""
    found = []
    stage = staging.stage

    def counted(df, name):
        told = stage(df, name)
        if name == "near-pairs":
            found.append((told.where("near").count(), told.where("near is null").count()))
        return told

    monkeypatch.setattr(staging, "stage", counted)
    n = entry.queries()["alternative_readings"](spark, DATA).count()
    # six readings a line stay; seven others contain the first one
    assert found == [(0, 0), (7 * n // 6, 0)]


def test_no_pair_that_resembles_is_ruled_out_by_its_letters(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 40))) for letters in ("abn", "abcxyz019", "éaz¹n") for _ in range(40)]
    texts += ["", "n" * 255, "n" * 256, "a" * 300, "an" * 150, "a" * 300 + "b", "\U0001f600a" * 20]
    items = spark.createDataFrame([(1, no, t, 0.0, 0.0) for no, t in enumerate(texts)], "package_id long, no long, letters string, x double, y double")
    for least in (0.55, 0.72, 0.90):
        got = folds.within(items.withColumns(folds.profile(F.col("letters"))), 1.0, least)
        got = {(r["no"], r["earlier"]) for r in folds.resembling(got, least).collect()}
        want = set()
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                if a and b:
                    short, long_ = sorted((len(a), len(b)))
                    alike = 0.75 + 0.25 * short / long_ if a in b or b in a else SequenceMatcher(None, a, b).ratio()
                    if alike >= least:
                        want.add((i, j))
        assert got == want


@pytest.mark.parametrize("name", ["nearby_candidates", "nearby_fields"])
def test_keys_of_six_digits_against_sql(spark, tmp_path, name):
    """Keys that read as a PIN: extraction finds an address there, and the queries on labelled values equal their SQL."""
    con = duckdb.connect()
    for t, keys in {"part": ["p_partkey"], "lineitem": ["l_partkey"], "supplier": []}.items():
        shifted = ", ".join(f"{k} + 100000 AS {k}" for k in keys)
        told = f"* REPLACE ({shifted})" if keys else "*"
        con.execute(f"COPY (SELECT {told} FROM read_parquet('{DATA}/{t}.parquet')) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == want
    if name == "nearby_candidates":
        lines = fields.Lines.of(prepare(fixtures.close_lines(spark, str(tmp_path)).where("package_id % 8 = 5")))
        addresses = fields.address_candidates(lines)
        assert addresses.count() == addresses.where(r"value rlike 'Sugar and Salt \\d{6}'").count() > 0
