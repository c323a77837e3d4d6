import subprocess

from textloom.sources import paths


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


def test_selections(tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("x\n")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-q", "-m", "first")
    (tmp_path / "a.txt").write_text("one\nnew\ntwo\n")
    (tmp_path / "b.txt").write_text("y\n")
    git(tmp_path, "add", "b.txt")
    (tmp_path / "c.txt").write_text("u\n")
    names = lambda files: [f.rsplit("/", 1)[-1] for f in files]
    root = str(tmp_path)
    assert names(paths.git_files(root, changed=True)) == ["a.txt", "b.txt"]
    assert names(paths.git_files(root, staged=True)) == ["b.txt"]
    assert names(paths.git_files(root, changed=True, untracked=True)) == ["a.txt", "b.txt", "c.txt"]
    added = {(f.rsplit("/", 1)[-1], n) for f, n in paths.git_added_lines(root)}
    assert {("a.txt", 2), ("b.txt", 1), ("c.txt", 1)} <= added and ("a.txt", 1) not in added
    assert [(f.rsplit("/", 1)[-1], n) for f, n in paths.git_churn(root, 30)] == [("a.txt", 1), ("b.txt", 1)]
