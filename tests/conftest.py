import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from corvane.session import build_session

    return build_session(4, 4, "4g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
