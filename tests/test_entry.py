import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 90
    assert entry.entry(spark).count() > 0


def test_catalog_stands_alone():
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('vellum.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'ingest_tiered_dedup' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
