"""The driver's contract, with and without the subpackage for training data, and queries against DuckDB."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from conftest import DATA, ROOT

from quillgraph.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_imports_without_what_only_training_data_needs(tmp_path):
    blocked = tmp_path / "sitecustomize.py"
    blocked.write_text("import sys\nfor name in ('public_tokenizers', 'xxhash', 'zstandard', 'tiktoken', 'regex'):\n    sys.modules[name] = None\n")
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


CONTRACTS = sorted(n for n, f in QUERIES.items() if f.__module__.endswith("contract_queries"))


@pytest.mark.parametrize("name", [*CONTRACTS, "ag02_state_counts", "gr02_explore", "gr03_asset_routes", "ag29_trailing_hour", "wn03_ordinals", "gr16_keyword_search", "gr18_fused_search", "jn16_located_passages", "ag13_per_label", "gr10_intents", "sf05_substitutions", "sf32_same_number", "jn13_cross_references", "jn14_name_containment", "jn08_collaborators", "jn11_unbacked_claims", "gr04_evidence_closure", "gr08_entity_evidence", "gr09_counter_evidence"])
def test_queries_agree_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda x: None if x is None else round(x, 6) if isinstance(x, float) else x
    ours = sorted((tuple(show(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(show(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall()), key=repr)
    assert ours == theirs
