import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelkit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """A random out-of-fold table small enough for brute force: 5 folds x 4 dates x 3 times x 6 symbols."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    rows = [(f"rw_0{f + 1}", 4 * f + d, t, s) for f in range(5) for d in range(4) for t in range(3) for s in range(6)]
    pdf = pd.DataFrame(rows, columns=["fold", "date_id", "time_id", "symbol_id"])
    n = len(pdf)
    pdf["weight"] = rng.integers(1, 20, n).astype(float)
    pdf["a_prediction"] = rng.normal(size=n)
    pdf["b_prediction"] = rng.normal(size=n)
    pdf["feature_00"] = rng.normal(size=n)
    pdf["feature_01"] = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))
    pdf["responder_6"] = 0.5 * pdf.a_prediction + 0.2 * pdf.b_prediction + 0.3 * pdf.feature_00 + rng.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("feature_01", __import__("pyspark").sql.functions.expr("nanvl(feature_01, null)"))
    return pdf, df.persist()
