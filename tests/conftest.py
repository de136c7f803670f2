import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vettable.session import local_session
    s = local_session("*", 8)
    yield s


@pytest.fixture
def write_csv(tmp_path):
    counter = {"n": 0}

    def _write(text: str, name: str | None = None, raw: bytes | None = None) -> str:
        counter["n"] += 1
        p = tmp_path / (name or f"f{counter['n']}.csv")
        p.write_bytes(raw if raw is not None else text.encode("utf-8"))
        return str(p)
    return _write
