import signal

import pytest

from graintide.session import local_session

#: Seconds that a test may take; one that hangs fails alone.
LIMIT_S = 300


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def limited(request):
    def stop(number, frame):
        if "spark" in request.fixturenames:
            request.getfixturevalue("spark").sparkContext.cancelAllJobs()
        raise TimeoutError(f"the test took more than {LIMIT_S} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT_S)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
