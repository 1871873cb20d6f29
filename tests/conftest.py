import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from codeloom.runtime import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, visibility string, is_exported boolean, decorators array<string>, return_type string, updated_at bigint"
EDGE = "id bigint, source string, target string, kind string, line int, col int, recorded_at bigint"


@pytest.fixture(scope="session")
def make_nodes(spark):
    def make(*rows, **common):
        names = [c.split()[0] for c in NODE.split(", ")]
        base = {"kind": "function", "file_path": "r/a.py", "language": "python", "start_line": 1, "end_line": 2, "is_exported": False, "updated_at": 1} | common
        return spark.createDataFrame([tuple((base | {"name": r["id"]} | r).get(k) for k in names) for r in rows], NODE)

    return make


@pytest.fixture(scope="session")
def make_edges(spark):
    def make(*rows):
        return spark.createDataFrame([(k, s, t, kind, None, None, 10) for k, (s, t, kind) in enumerate(rows)], EDGE)

    return make
