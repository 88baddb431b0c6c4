import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "millrace-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walks():
    """Three series of very different length; the first holds most of the rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for name, n in (("hot", 400), ("mid", 60), ("tiny", 9)):
        value = rng.normal(10, 3, n)
        value[n // 2 :] += 6
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 3600, unit="s")
        frames.append(pd.DataFrame({"series": name, "ts": ts, "value": value}))
    return pd.concat(frames, ignore_index=True).sample(frac=1, random_state=1)
