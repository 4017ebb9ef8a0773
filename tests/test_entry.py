import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    assert m.entry(spark).count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
