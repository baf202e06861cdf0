"""Registry of runs: unique versions, one active version, two writers at once."""

import json
import threading

import pytest

from recsift.operators.registry import Registry
from recsift.sources.commits import CommitLog, Conflict


def rows(reg):
    return sorted((r["name"], r["version"], json.loads(r["metrics"]), r["is_active"]) for r in reg.runs().collect())


def test_versions_are_unique_and_one_is_active(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "r"))
    assert rows(reg) == []
    assert reg.register("a", {"ndcg": 0.5}, "2024-01-01") == 1
    assert reg.register("a", {"ndcg": 0.6}, "2024-01-02", activate=True) == 2
    assert reg.register("b", {}, "2024-01-02", version=7) == 7
    with pytest.raises(ValueError):
        reg.register("b", {}, "2024-01-03", version=7)
    with pytest.raises(ValueError):
        reg.activate("a", 9, "2024-01-03")
    assert rows(reg) == [("a", 1, {"ndcg": 0.5}, False), ("a", 2, {"ndcg": 0.6}, True), ("b", 7, {}, False)]
    reg.activate("a", 1, "2024-01-04")
    # another process sees the same
    assert rows(Registry(spark, str(tmp_path / "r"))) == [("a", 1, {"ndcg": 0.5}, True), ("a", 2, {"ndcg": 0.6}, False), ("b", 7, {}, False)]


def test_two_writers_of_one_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    seen = []

    def decide(last):
        seen.append(last)
        if len(seen) == 1:  # another writer is faster, after this one has read the log
            log.publish(last + 1, {"kind": "other"})
        return {"kind": "mine"}

    assert log.commit(decide)["number"] == 2 and seen == [0, 1]
    with pytest.raises(Conflict):
        log.publish(2, {"kind": "late"})
    assert [(r["number"], r["kind"]) for r in log.read("kind string").orderBy("number").collect()] == [(1, "other"), (2, "mine")]


def test_racing_writers(spark, tmp_path):
    """Eight registrations from two threads: eight versions, none twice, the last activation holds."""
    root, failed = str(tmp_path / "r"), []

    def work(k):
        try:
            reg = Registry(spark, root)
            for i in range(4):
                reg.register("m", {"w": k, "i": i}, "2024-01-01", activate=True)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    Registry(spark, root)
    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    out = rows(Registry(spark, root))
    assert not failed and [v for _, v, _, _ in out] == list(range(1, 9)) and [a for *_, a in out] == [False] * 7 + [True]


def test_one_number_is_published_once(spark, tmp_path):
    """Writers that publish the same numbers at the same time: one of them holds each number, whole; no draft stays."""
    root, numbers, won = str(tmp_path / "log"), range(1, 41), {}
    CommitLog(spark, root)
    start = threading.Barrier(4)

    def work(k):
        log = CommitLog(spark, root)
        for n in numbers:
            start.wait()
            try:
                log.publish(n, {"kind": f"w{k}"})
                won.setdefault(n, []).append(f"w{k}")
            except Conflict:
                pass

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = CommitLog(spark, root)
    assert [(r["number"], [r["kind"]]) for r in log.read("kind string").orderBy("number").collect()] == [(n, won[n]) for n in numbers]
    assert not list((tmp_path / "log" / "drafts").iterdir())
