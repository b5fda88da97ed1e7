import subprocess
import sys

from conftest import ROOT


def test_queries_and_oracles_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "site_audit" in e.queries()


def test_without_the_text_subpackage():
    code = "import sys; sys.modules['brandloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'site_audit' in q; assert not any(k.startswith('op1') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
