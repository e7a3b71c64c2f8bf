"""Objects, commits and line counts of a made repository, loose and packed, against git itself."""

import os
import random
import shutil
import subprocess

import pytest

from folioweave.sources import git


pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="compares with git")


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder, r = str(tmp_path_factory.mktemp("repo")), random.Random(3)
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann Ö", "GIT_AUTHOR_EMAIL": "ann@x.example", "GIT_COMMITTER_NAME": "Bob", "GIT_COMMITTER_EMAIL": "b@x.example", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}
    run = lambda *a: subprocess.run(["git", *a], cwd=folder, env=env, check=True, capture_output=True).stdout
    run("init", "-q", "-b", "main")
    paths = ["a.md", "docs/b.md", "docs/deep/c.md", "x.bin", "odd name ß.txt"]
    for k in range(24):
        for path in r.sample(paths, 2):
            full = os.path.join(folder, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            if os.path.exists(full) and r.random() < 0.15:
                os.remove(full)
                continue
            lines = open(full, "rb").read().split(b"\n") if os.path.exists(full) else [b"line %d of words" % n for n in range(60)]
            for _ in range(r.randrange(1, 6)):
                lines.insert(r.randrange(len(lines)), b"new %d" % r.randrange(9)) if r.random() < 0.6 else lines.pop(r.randrange(len(lines)))
            open(full, "wb").write(b"\n".join(lines) + (b"\0" if path == "x.bin" else b""))
        env["GIT_AUTHOR_DATE"] = env["GIT_COMMITTER_DATE"] = f"{1_700_000_000 + k * 1000} +0100"
        run("add", "-A")
        run("commit", "-q", "--allow-empty", "-m", f"feat: step {k}\n\nparent of nothing")
        if k == 8:
            run("checkout", "-q", "-b", "side", "HEAD~3")
        if k == 12:
            run("checkout", "-q", "main")
            run("merge", "-q", "-s", "ours", "-m", "merge: side", "side")
        if k == 16:
            run("repack", "-q", "-a", "-d", "-f", "--depth=20")
    return folder, run


def test_objects_equal_git(spark, repository, monkeypatch):
    folder, run = repository
    monkeypatch.setattr(git, "PER_PARTITION", 40)
    got = git.objects(spark, folder).collect()
    want = {x.split()[0]: x.split()[1] for x in run("cat-file", "--batch-all-objects", "--batch-check").decode().splitlines()}
    assert {x["hash"]: x["type"] for x in got} == want
    assert all(git.object_hash(x["type"], bytes(x["content"])) == x["hash"] for x in got)
    assert os.listdir(os.path.join(folder, ".git/objects/pack"))


def test_commits_and_line_counts_equal_git(spark, repository):
    folder, run = repository
    found = git.objects(spark, folder).cache()
    log = run("log", "--all", "--format=%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%B%x1e").decode().split("\x1e")
    want = {}
    for x in log:
        if x.strip():
            h, parents, name, mail, at, message = x.strip("\n").split("\x1f")
            want[h] = (parents.split(), name, mail, int(at), message.strip("\n"))
    assert {x["hash"]: (x["parents"], x["author"], x["email"], int(x["timestamp"].timestamp()), x["message"]) for x in git.commits(found).collect()} == want
    counts, commit = set(), None
    for line in run("-c", "core.quotepath=off", "log", "--all", "--no-renames", "--diff-algorithm=minimal", "--numstat", "--format=%x1e%H").decode().split("\n"):
        if line.startswith("\x1e"):
            commit = line[1:]
        elif line:
            added, removed, path = line.split("\t")
            counts.add((commit, path, None if added == "-" else int(added), None if removed == "-" else int(removed)))
    got = git.numstat(found).collect()
    assert {(x["commit"], x["path"], x["additions"], x["deletions"]) for x in got} == counts
    assert {x["status"] for x in got} == {"added", "modified", "removed"}
