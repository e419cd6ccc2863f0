"""The driver's contract, and queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HELD = [
    "clean_text", "normal_forms", "adjusted_confidence", "box_pairs", "reading_order", "nearby_lines", "prices", "quantities", "printed_dates", "line_kinds",
    "fused_scores", "best_values", "fused_fields", "fused_declarations", "rule_findings", "compliance_summary", "history_kpis", "history_search", "signatures",
    "nearby_fields", "nearby_candidates", "merged_readings", "saved_summaries", "inspection_numbers", "inspection_delete", "package_analysis", "analyses_reused", "adapted_lines",
    "reading_clusters", "alternative_readings",
]


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True, timeout=120)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() == 200 and "compliance_percent" in found.columns


def _plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    return str([_plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", HELD)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    told = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(str([_plain(r[i]) for i in order]) for r in told.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str([_plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want
