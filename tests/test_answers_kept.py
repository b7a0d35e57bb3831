import pytest

from lexaudit.operators import judges
from lexaudit.operators.answer_store import AnswerStore

SCHEMA = "doc_id long, chunk_index int, position string, should_analyze boolean, prompt string"


def counting(log, fails=lambda text, seen: False):
    """A judge that notes every request in a file, and fails where it is told to."""
    path = str(log)

    def answer(texts):
        with open(path, "a+") as f:
            f.seek(0)
            seen = f.read().split("\0")
            for t in texts:
                f.write(t + "\0")
        if any(fails(t, seen) for t in texts):
            raise RuntimeError("down")
        return [f"answer to {t}" for t in texts]

    return answer


def requests(log):
    return sorted(log.read_text().split("\0")[:-1]) if log.exists() else []


def rows(spark, prompts):
    return spark.createDataFrame([(i, 0, "Document", p is not None, p) for i, p in enumerate(prompts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("slices", [1, 3])
def test_nothing_is_asked_twice(spark, tmp_path, slices):
    log, store = tmp_path / "log", AnswerStore(spark, str(tmp_path / "store"))
    ask = lambda prompts, **o: {r.doc_id: (r.response, r.error, r.kept) for r in store.ask(rows(spark, prompts), counting(log, **o), 1, slices).collect()}
    first = ask(["a", "b", "a", None, "a", "c"])
    assert requests(log) == ["a", "b", "c"]  # once each, however many rows ask
    assert first == {0: ("answer to a", None, False), 1: ("answer to b", None, False), 2: ("answer to a", None, False), 3: ("", None, False), 4: ("answer to a", None, False), 5: ("answer to c", None, False)}
    log.unlink()
    again = ask(["a", "b", "a", None, "a", "c"])
    assert requests(log) == [] and {k: v[:2] for k, v in again.items()} == {k: v[:2] for k, v in first.items()} and all(v[2] for k, v in again.items() if k != 3)
    changed = ask(["a", "B", "a"])
    assert requests(log) == ["B"] and changed[1] == ("answer to B", None, False)
    store.clean()
    assert store.answers().count() == 4


def test_failed_requests_are_asked_again(spark, tmp_path):
    log, store = tmp_path / "log", AnswerStore(spark, str(tmp_path / "store"))
    down = counting(log, lambda t, seen: t == "bad")
    got = {r.doc_id: r for r in store.ask(rows(spark, ["good", "bad"]), down, 1).collect()}
    assert got[0].error is None and got[1].error == "RuntimeError: down" and got[1].response == ""
    log.unlink()
    got = {r.doc_id: r for r in store.ask(rows(spark, ["good", "bad"]), counting(log), 1).collect()}
    assert requests(log) == ["bad"] and got[1].response == "answer to bad" and got[1].error is None and got[0].kept


def test_a_batch_is_committed_once(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "store"))
    spark.createDataFrame([("k", "r", None), ("l", None, "failed")], "key string, response string, error string").write.parquet(str(tmp_path / "store" / "staged"))
    store._commit("staged")
    store._commit("staged")  # as a driver does that didn't learn of its success
    assert len(list((tmp_path / "store" / "batches").iterdir())) == 1
    assert [tuple(r) for r in store.answers().collect()] == [("k", "r")]
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("new-")]


def test_second_request_asks_once_and_loses_nothing(spark, tmp_path):
    fields = "COMPLIANCE ISSUES:\nISSUE 1: title {i}\nArticle: 5\nConfidence: High\nExplanation: why\nCitation: \"words of the text\"\n\nCOMPLIANCE POINTS:\nNo compliance points found"
    plain = "COMPLIANCE ISSUES:\n1. title {i}\nArticle 5\n"
    judged = spark.createDataFrame([(i, 0, "Document", True, plain.replace("{i}", str(i)), None) for i in range(40)], "doc_id long, chunk_index int, position string, should_analyze boolean, response string, error string").repartition(4)
    path = str(tmp_path / "log")

    def flaky(texts):
        import random

        with open(path, "a") as f:
            f.write("x" * len(texts))
        if random.random() < 0.4:
            raise RuntimeError("now and then")
        return [fields] * len(texts)

    for _ in range(3):
        (tmp_path / "log").write_text("")
        found = judges.restructure(judged, flaky, rows_per_call=1, template="{response}")
        assert sorted(r.doc_id for r in found.collect()) == list(range(40))
        assert len({r.description for r in found.collect()}) > 1 and {r.regulation for r in found.collect()} == {"Article 5"}
        # a request that fails is tried once more, row by row
        assert 40 <= len((tmp_path / "log").read_text()) <= 80
