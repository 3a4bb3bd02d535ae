import os
import signal
import sys

# one thread for each linear-algebra call: Spark's tasks fill the cores already
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from answerscope.session import local_session  # noqa: E402


#: seconds a test may take
LIMIT = int(os.environ.get("ANSWERSCOPE_TEST_SECONDS", "600"))


@pytest.hookimpl(wrapper=True)
def pytest_runtest_call(item):
    """A test that hangs fails instead of taking the whole run with it."""
    def stop(signum, frame):
        raise TimeoutError(f"{item.nodeid} took more than {LIMIT} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    try:
        return (yield)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over a single row."""
    def run(col):
        return spark.range(1).select(col.alias("x")).collect()[0]["x"]
    return run
