import pytest

from recallsmith.llm import common, lang_id


def test_shared_folder_without_a_setting():
    class Conf:
        def get(self, *_):
            return None

    class Bare:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "local[2]", "app-2"
            getConf = staticmethod(Conf)

    assert common.shared_root(Bare) == common.shared_root(Bare) and common.shared_root(Bare).startswith("file:///")
    Bare.sparkContext.master = "spark://x:7077"
    with pytest.raises(RuntimeError):
        common.shared_root(Bare)


def test_numbers_are_no_letters(spark):
    said = [("en", "the thing and that other thing there"), ("de", "das und der schlecht gesetz nicht")]
    rows = [(i, said[i % 2][1] + f" {'xyz'[i % 3]}", said[i % 2][0]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, "² ½ ① Ⅷ 12 _", None), (101, "² the thing", None)], "doc_id long, text string, lang string")
    got = {r["id"]: r["lang_pred"] for r in lang_id.identify(docs, lang_id.train(docs)).collect()}
    assert got[100] == "und" and got[101] == "en"
