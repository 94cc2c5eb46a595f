import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['lociforge.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'top2_genotype' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sample_id", "locus", "allele", "obj", "n", "rn"] and df.count() > 0
