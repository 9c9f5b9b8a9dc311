import os
import random
import shutil
import subprocess

import pytest

from coppice.sources import repository as R

FILE = "docs/deep/the file.md"


def git(folder, *args, **env):
    return subprocess.run(["git", *args], cwd=folder, env=os.environ | env, capture_output=True, check=True, text=True).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """A history with a deletion, other files and time zones, packed up to some commit and loose after it."""
    if not shutil.which("git"):
        pytest.skip("the histories to compare with are made by git")
    folder = tmp_path_factory.mktemp("repo")
    rng = random.Random(4)
    git(folder, "init", "-q", "-b", "main")
    git(folder, "config", "user.email", "a@b.c")
    git(folder, "config", "user.name", "A > B")
    target = folder / FILE
    lines = [f"line {i} é" for i in range(400)]

    def commit(n, message):
        zone = rng.choice(["+0000", "+0200", "-0730"])
        git(folder, "add", "-A")
        git(folder, "commit", "-q", "--allow-empty", "-m", message, GIT_AUTHOR_DATE=f"{1700000000 + n * 3607} {zone}", GIT_COMMITTER_DATE=f"{1700000100 + n * 3607} +0100")

    for n in range(30):
        if n % 4 == 3:
            (folder / "other.txt").write_text(f"{n}")
        elif n == 14:
            target.unlink()
        else:
            for _ in range(3):
                lines[rng.randrange(400)] = f"changed {n}"
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text("\n".join(lines))
        commit(n, f"Change {n} (#{n})\nsecond line\n\nbody" if n % 3 else f"Subject {n}")
        if n == 20:
            git(folder, "gc", "-q", "--aggressive")
    return folder


def test_objects_have_their_ids(spark, repo):
    want = {tuple(x.split()[:2]) for x in git(repo, "cat-file", "--batch-all-objects", "--batch-check").splitlines()}
    rows = R.objects(spark, str(repo / ".git"))
    assert {(r.id, r.kind) for r in rows.select("id", "kind").collect()} == want
    assert any(p.suffix == ".pack" for p in (repo / ".git/objects/pack").iterdir())


def test_log_and_revisions(spark, repo):
    raw = git(repo, "log", "--reverse", "--format=%H %aI %s", "--", FILE).splitlines()
    want = [tuple(x.split(" ", 2)) for x in raw]
    got = R.log(spark, str(repo / ".git"), FILE).orderBy("seq").collect()
    assert [(r.hash, r.ts.replace("Z", "+00:00"), r.message) for r in got] == [(h, t.replace("Z", "+00:00"), m) for h, t, m in want] and [r.seq for r in got] == list(range(len(want)))
    hashes = spark.createDataFrame([(h,) for h, _, _ in want], "hash string")
    texts = {r.hash: r.text for r in R.file_revisions(spark, str(repo / ".git"), FILE, hashes).collect()}
    assert len(texts) == len(want)
    for h, text in texts.items():
        shown = subprocess.run(["git", "show", f"{h}:{FILE}"], cwd=repo, capture_output=True)
        assert text == (shown.stdout.decode() if shown.returncode == 0 else None)
    assert None in texts.values()
    assert R.log(spark, str(repo / ".git"), "absent/file").count() == 0


def test_deltas():
    base = bytes(range(256)) * 300
    copy = bytes([0x80 | 0x01 | 0x02 | 0x10, 5, 1, 9])  # nine bytes from place 261
    whole = bytes([0x80])  # 65,536 bytes from the beginning
    delta = b"\x80\xd8\x04\x80\x02" + copy + b"\x03abc" + whole
    assert R.apply_delta(base, delta) == base[261:270] + b"abc" + base[:65536]
