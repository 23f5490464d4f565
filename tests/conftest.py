import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quillmine.session import local_session

    return local_session(int(os.environ.get("TEST_CPUS", "4")), "tests")


@pytest.fixture(scope="session")
def exchanged(spark):
    """(bytes, rows) that all stages until now have exchanged."""

    def now():
        gateway = spark.sparkContext._gateway
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        found = {s.stageId(): (s.shuffleWriteBytes(), s.shuffleWriteRecords()) for s in map(stages.apply, range(stages.size()))}
        return sum(b for b, _ in found.values()), sum(r for _, r in found.values())

    return now
