import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphdyn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "graphdyn-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ring_lap():
    """Normalised Laplacian of a weighted ring with one chord, n = 6."""
    n = 6
    a = np.zeros((n, n))
    for i in range(n):
        a[i, (i + 1) % n] = a[(i + 1) % n, i] = 1.0 + 0.1 * i
    a[0, 3] = a[3, 0] = 0.5
    d = a.sum(axis=1)
    return np.eye(n) - a / np.sqrt(np.outer(d, d))


@pytest.fixture(scope="session")
def basis(spark, ring_lap):
    lam, u = np.linalg.eigh(ring_lap)
    return spark.createDataFrame([(lam.tolist(), u.T.ravel().tolist())],
                                 "lam array<double>, u array<double>")


def signals_frame(spark, recordings, drop=()):
    """{(subject, grp): (n, T) array} to the long table; ``drop`` cells are left out."""
    rows = [(s, g, c, t, float(x[c, t])) for (s, g), x in recordings.items()
            for c in range(x.shape[0]) for t in range(x.shape[1]) if (s, c, t) not in drop]
    return spark.createDataFrame(rows, "subject_id string, grp string, channel int, t long,"
                                       " value double")
