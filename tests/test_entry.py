import subprocess
import sys

import __spark_entry__ as entry


def test_catalogue():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50 and all(callable(f) for f in q.values())


def test_core_stands_alone():
    """The engine must not import the optional subpackage."""
    code = (
        "import sys; sys.modules['codestrata.llm'] = None\n"
        "import importlib, pkgutil, codestrata\n"
        "[importlib.import_module(m.name) for m in pkgutil.walk_packages(codestrata.__path__, 'codestrata.') if not m.name.startswith('codestrata.llm')]\n"
        "import codestrata.plans.catalog as c; assert len(c.queries()) > 50"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
