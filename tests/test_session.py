"""Session helpers: where shared data goes, and joins with few rows."""

import pytest
from pyspark.sql import functions as F

from heaplake import session


class Fake:
    """A session of another master, with nothing set."""

    def __init__(self, master, known=None):
        self.sparkContext, self.conf = self, self
        self.master, self.known = master, known

    def get(self, key, default=None):
        return self.known

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake(master))
    assert session.shared_dir(Fake(master, "s3://b/x")) == "s3://b/x"


@pytest.mark.parametrize("most", [100, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_join_few(spark, most, how):
    df = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 1), (None, 2), (1, 5)], "k int, v int")
    few = spark.createDataFrame([(1, "a"), (3, "c")], "k int, t string")
    got = session.join_few(df, few, ["k"], how, max_rows=most)
    want = df.join(few, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert session.join_few(df.where("false"), few, ["k"], how, max_rows=most).count() == 0
