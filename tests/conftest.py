import tempfile

import pytest

from ledgerlark.session import build_session, checkpoint_dir


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app="ledgerlark-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="ledgerlark-wh-")})
    checkpoint_dir(s)
    yield s
