import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from oremill.session import local_session

    session = local_session(cpus=4, memory="4g", partitions=2, name="tests")
    compiled(session, False)
    return session


def compiled(session, on):
    """Code generation: tests of whole queries run the plans that are shipped, others spare the compiling, which takes longer than their few rows."""
    session.conf.set("spark.sql.codegen.wholeStage", str(on).lower())
    session.conf.set("spark.sql.codegen.factoryMode", "FALLBACK" if on else "NO_CODEGEN")


@pytest.fixture(scope="module")
def shipped_plans(spark):
    compiled(spark, True)
    yield
    compiled(spark, False)


def make_id(name: str) -> str:
    """A valid id that starts with the name."""
    return (name + "_" * 22)[:22]
