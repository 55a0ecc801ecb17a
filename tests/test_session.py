import pytest

from reviewlake import session


class _Conf:
    def get(self, key, default=None):
        return default

    def set(self, key, value):
        self.value = value


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Spark:
    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), _Conf()


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Spark(master))


def test_a_local_session_gets_a_private_folder():
    spark = _Spark("local[2]")
    assert session.ensure_checkpoint_dir(spark) == spark.sparkContext.folder == spark.conf.value


def test_operators_with_python_workers_bound_their_batches(spark):
    from reviewlake import dictionaries as D
    from reviewlake.operators import chunking as CH
    from reviewlake.operators import entities as EN
    from reviewlake.operators import phrases as PH
    from reviewlake.operators import tagging as TG
    from reviewlake.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, phrases = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([("one two",)], "phrase string")
    for use in (lambda: CH.chunk_recursive(docs, "doc_id", "text"), lambda: PH.phrase_counts(docs, "text", phrases),
                lambda: EN.make_span_detector(D.GAZETTEER_EN), lambda: TG.make_tagging_detector(spark, TG.Tagger([]).dump())):
        spark.conf.unset(key)
        use()
        assert int(spark.conf.get(key)) == BATCH_BYTES
