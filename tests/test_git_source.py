import subprocess

import pytest

from recallsmith.sources import git_source


def git(path, *args):
    who = ["-c", "user.name=Zoë", "-c", "user.email=z@example.org"]
    return subprocess.run(["git", "-C", str(path), *who, *args], capture_output=True, text=True, check=True).stdout


def commit(path, name, text, message):
    (path / name).write_text(text)
    git(path, "add", "-A")
    git(path, "commit", "-q", "-m", message)


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "r"
    path.mkdir()
    git(path, "init", "-q", "-b", "main")
    for i in range(5):
        commit(path, f"f{i % 2}é.txt", "line\n" * (i + 1), f"change {i}\n\nmore\ttext")
    git(path, "checkout", "-q", "-b", "side", "HEAD~2")
    commit(path, "s.txt", "s\n", "side")
    git(path, "checkout", "-q", "main")
    git(path, "merge", "-q", "--no-ff", "-m", "merge", "side")
    return path


def shas(path):
    return git(path, "log", "--format=%h").split()


def test_ranges_equal_the_whole_history(spark, repo):
    spark.dataSource.register(git_source.GitHistory)
    read = spark.read.format("git_history").option("chunk", 2).load(str(repo))
    got = read.collect()
    assert [r["sha"] for r in got] == shas(repo) and read.rdd.getNumPartitions() == 4
    by = {r["message"]: r for r in got}
    assert by["change 3"]["files"] == ["f1é.txt"] and by["change 3"]["stat"] == "1 files, +2 -0" and by["change 3"]["author"] == "Zoë"
    assert by["merge"]["files"] == [] and by["merge"]["stat"] == ""
    assert [r["sha"] for r in spark.read.format("git_history").option("most", 3).load(str(repo)).collect()] == shas(repo)[:3]
    with pytest.raises(Exception, match="from 1"):
        spark.read.format("git_history").option("chunk", 0).load(str(repo)).collect()


def test_ranges_stay_when_commits_arrive(repo):
    reader = git_source.BatchReader({"path": str(repo), "chunk": "3"})
    parts, before = reader.partitions(), shas(repo)
    commit(repo, "new.txt", "x", "later")
    assert [r[0] for p in parts for r in reader.read(p)] == before
    with pytest.raises(RuntimeError):
        git_source.StreamReader({"path": str(repo)}).partitions({"sha": "0" * 40}, {"sha": before[0]})


def test_stream_gives_each_commit_once(spark, repo, tmp_path):
    spark.dataSource.register(git_source.GitHistory)

    def run():
        s = spark.readStream.format("git_history").option("chunk", 2).load(str(repo))
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r["sha"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == sorted(shas(repo))
    old = shas(repo)
    commit(repo, "a.txt", "a", "after the restart")
    git(repo, "commit", "-q", "--amend", "-m", "rewritten before it was read")
    assert run() == sorted(shas(repo)) and len(shas(repo)) == len(old) + 1
    assert run() == sorted(shas(repo))


def test_no_history(spark, tmp_path):
    spark.dataSource.register(git_source.GitHistory)
    git(tmp_path, "init", "-q")
    assert spark.read.format("git_history").load(str(tmp_path)).count() == 0
    assert spark.read.format("git_history").load(str(tmp_path / "none")).count() == 0
