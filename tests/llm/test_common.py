import pytest

from papyrine.llm import common


def test_labelled_rows_are_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(3, "again")] * 500 + [(4, None)] * 3 + [(None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (70, 1)], "doc_id long, toxic int")
    for bound in (10, 1000):
        rows = common.labelled_sample(docs, marks, "toxic", bound).collect()
        for label in (0, 1):
            of_label = [r for r in rows if r.label == label]
            assert 5 < len(of_label) <= bound
    assert len(rows) == 60 + 500 + 3


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
