"""Which files a scan reads: globs, excludes, hidden entries, lists and git selections. Runs on the driver; only paths leave it."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from functools import lru_cache

from textloom.errors import QueryError

MAGIC = re.compile(r"[*?\[{]")
MOST = 256  # expansions of a brace pattern


def braces(pattern: str) -> list[str]:
    """Alternatives of {a,b}, nested ones too."""
    depth, begin = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            depth += 1
            begin = i if depth == 1 else begin
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                parts, level, last = [], 0, begin + 1
                for j in range(begin + 1, i):
                    level += (pattern[j] == "{") - (pattern[j] == "}")
                    if pattern[j] == "," and level == 0:
                        parts.append(pattern[last:j])
                        last = j + 1
                parts.append(pattern[last:i])
                out = [f"{pattern[:begin]}{p}{rest}" for p in parts for rest in braces(pattern[i + 1 :])]
                out = [y for x in out for y in (braces(x) if "{" in x and x != pattern else [x])]
                if len(out) > MOST:
                    raise QueryError(f"brace pattern has more than {MOST} alternatives")
                return out
    return [pattern]


@lru_cache(maxsize=4096)
def _segment(glob: str) -> re.Pattern:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : j]
            out.append(f"[{'^' if inner[0] in '!^' else ''}{inner.lstrip('!^') if inner[0] in '!^' else inner}]".replace("\\", "\\\\"))
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return re.compile("".join(out) + r"\Z", re.S)


def glob_match(pattern: str, path: str) -> bool:
    """Whether the whole path matches; ** stands for any number of segments."""
    return any(_segments(tuple(p.split("/")), tuple(path.split("/"))) for p in braces(pattern))


@lru_cache(maxsize=65536)
def _segments(glob: tuple[str, ...], path: tuple[str, ...]) -> bool:
    if not glob:
        return not path
    if glob[0] == "**":
        return any(_segments(glob[1:], path[i:]) for i in range(len(path) + 1))
    return bool(path) and _segment(glob[0]).match(path[0]) is not None and _segments(glob[1:], path[1:])


def split_base(pattern: str) -> tuple[str, str]:
    """The part before the first magic segment, where the walk begins, and the rest."""
    parts = pattern.split("/")
    k = next((i for i, p in enumerate(parts) if MAGIC.search(p)), len(parts) - 1)
    base = "/".join(parts[:k])
    return (base or ("/" if pattern.startswith("/") else ".")), "/".join(parts[k:])


def excluded(path: str, rules: Iterable[str]) -> bool:
    """A rule with a final slash is a path prefix; one with magic is a glob on path or name; a bare name is any segment."""
    name = path.rsplit("/", 1)[-1]
    for rule in rules:
        if rule.endswith("/"):
            if f"{path}/".startswith(rule) or f"/{rule}" in f"{path}/":
                return True
        elif MAGIC.search(rule):
            if glob_match(rule, path) or glob_match(rule, name):
                return True
        elif "/" in rule:
            if path == rule or path.startswith(f"{rule}/"):
                return True
        elif rule in path.split("/"):
            return True
    return False


def _tree(top: str, rules: list[str]) -> Iterator[str]:
    """Files below top, depth first, names in order; hidden entries that are found, not named, are left out."""
    try:
        names = sorted(os.listdir(top))
    except OSError:
        return
    for name in names:
        if name.startswith("."):
            continue
        path = name if top == "." else f"{top.rstrip('/')}/{name}"
        if excluded(path, rules):
            continue
        if os.path.isdir(path) and not os.path.islink(path):
            yield from _tree(path, rules)
        elif os.path.isfile(path):
            yield path


def walk(scan: Iterable[str] = (), exclude: Iterable[str] = (), files: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Paths in scan order, each once, and those that were named but are missing. Listed files come first."""
    rules, out, missing = list(exclude), {}, []
    for path in files:
        if os.path.isfile(path):
            out.setdefault(path)
        else:
            missing.append(path)
    for item in scan:
        if not MAGIC.search(item):
            if os.path.isdir(item):
                out |= dict.fromkeys(_tree(item.rstrip("/") or "/", rules))
            elif os.path.isfile(item):
                if not excluded(item, rules):
                    out.setdefault(item)
            else:
                missing.append(item)
            continue
        found: dict[str, None] = {}
        for one in braces(item):
            base, rest = split_base(one)
            for path in _tree(base, rules):
                inner = path if base == "." else path[len(base.rstrip("/")) + 1 :]
                if glob_match(rest, inner):
                    found.setdefault(path)
            if os.path.isfile(one):
                found.setdefault(one)
        out |= dict.fromkeys(sorted(found, key=lambda p: p.split("/")))
    return list(out), missing


def file_list(data: bytes, zero: bool = False) -> list[str]:
    """Paths of a newline list (a final CR of a line goes) or of a NUL list."""
    parts = data.split(b"\0") if zero else [x.removesuffix(b"\r") for x in data.split(b"\n")]
    return [os.fsdecode(x) for x in parts if x]


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise QueryError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "surrogateescape")


def git_files(root: str, changed: bool = False, staged: bool = False, untracked: bool = False, range_: str | None = None) -> list[str]:
    """The union of the selections, first seen first; deleted files are left out."""
    asked = []
    if changed:
        asked.append(("diff", "--name-only", "-z", "--diff-filter=d", "HEAD"))
    if staged:
        asked.append(("diff", "--name-only", "-z", "--diff-filter=d", "--cached"))
    if untracked:
        asked.append(("ls-files", "-z", "--others", "--exclude-standard"))
    if range_:
        asked.append(("diff", "--name-only", "-z", "--diff-filter=d", range_))
    top = _git(root, "rev-parse", "--show-toplevel").strip()
    return list(dict.fromkeys(f"{top}/{p}" for args in asked for p in _git(top, *args).split("\0") if p))


def git_added_lines(root: str, range_: str | None = None) -> list[tuple[str, int]]:
    """(file, line) of every line that the working tree adds to HEAD or the range adds; all lines of untracked files."""
    top = _git(root, "rev-parse", "--show-toplevel").strip()
    out, file = [], None
    for line in _git(top, "diff", "-U0", "--no-color", range_ or "HEAD").split("\n"):
        if line.startswith("+++ "):
            file = None if line == "+++ /dev/null" else f"{top}/{line[6:]}"
        elif (m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)) and file:
            out += [(file, int(m[1]) + i) for i in range(int(m[2] or 1))]
    if not range_:
        for path in git_files(root, untracked=True):
            with open(path, "rb") as f:
                out += [(path, i + 1) for i in range(f.read().count(b"\n") + 1)]
    return out


def git_churn(root: str, days: int) -> list[tuple[str, int]]:
    """Commits that touched each file within the last days."""
    top = _git(root, "rev-parse", "--show-toplevel").strip()
    counts: dict[str, int] = {}
    for path in _git(top, "log", f"--since={days} days ago", "--name-only", "--pretty=format:").split("\n"):
        if path:
            counts[f"{top}/{path}"] = counts.get(f"{top}/{path}", 0) + 1
    return sorted(counts.items())
