"""python tests/run_module.py <catalog module>: compare every query of one catalog module."""

import importlib
import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])
import compare  # noqa: E402

if __name__ == "__main__":
    from candorframe.catalog import QUERIES

    module = f"candorframe.catalog.{sys.argv[1]}"
    importlib.import_module(module)
    names = [n for n, f in QUERIES.items() if f.__module__ == module]
    names = [n for n in names if len(sys.argv) < 4 or any(n.startswith(a) for a in sys.argv[3:])]
    compare.main(([sys.argv[2]] if len(sys.argv) > 2 else []) + names)
