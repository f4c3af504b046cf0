import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_rest_works_without_llm():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("tessera.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "yield_summary" in e.queries() and not any(n.startswith("op") for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row.n > 0 and 0 <= row.ratio <= 1 and row.n_pass <= min(row.n_z, row.n_dp, row.n_novel)


@pytest.mark.parametrize("name", ["yield_gates", "win_best_of_both", "agg_survival_funnel", "join_upstream_gaps", "sta_two_sample", "crv_hill_fit", "str_triage"])
def test_some_plans_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation supplier orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    plain = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    mine = sorted(str([plain(x) for x in r]) for r in got.select(columns).collect())
    theirs = sorted(str([plain(x) for x in r]) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert mine == theirs
