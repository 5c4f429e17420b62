"""Git as a source of tables: diffs as lines, files at a revision, and the history of fixes.

The git program runs on the driver, as the repository lies there; its output becomes rows at once and is read by
DataFrame operators from then on.
"""

from __future__ import annotations

import datetime as dt
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.text import parse_diff

LINES = "file bigint, no int, text string"


def _git(repo: str, *args: str) -> str:
    r = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True)
    if r.returncode:
        raise ValueError(f"git {args[0]}: {r.stderr.decode(errors='replace').strip()}")
    return r.stdout.decode("utf-8", "replace")


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(text.split("\n"))], LINES)


def diff(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """(path, side, line, text) of every changed line between two revisions; renames are followed."""
    return parse_diff(_lines(spark, _git(repo, "diff", "-U0", "-M", base, head, "--"))).drop("file")


def working_tree(spark: SparkSession, repo: str) -> DataFrame:
    """As diff, of the working tree against HEAD; files git does not know count as added altogether."""
    changed = parse_diff(_lines(spark, _git(repo, "diff", "-U0", "-M", "HEAD", "--"))).drop("file")
    rows = []
    for path in _git(repo, "ls-files", "--others", "--exclude-standard").splitlines():
        with open(f"{repo}/{path}", encoding="utf-8", errors="replace") as f:
            rows += [(path, "new", i + 1, x) for i, x in enumerate(f.read().splitlines())]
    return changed.unionByName(spark.createDataFrame(rows, "path string, side string, line int, text string"))


def show(repo: str, rev: str, path: str) -> str | None:
    """A file's text at a revision, or None if it is not there."""
    try:
        return _git(repo, "show", f"{rev}:{path}")
    except ValueError:
        return None


def commits(spark: SparkSession, repo: str, rev: str = "HEAD") -> DataFrame:
    """(commit, at, subject, file): one row for each file each commit but merges touched, up to a revision."""
    out = _git(repo, "log", "--no-merges", "--name-only", "--format=%x01%H%x02%ct%x02%s", rev)
    rows = []
    for part in out.split("\x01")[1:]:
        head, *files = part.split("\n")
        commit, at, subject = head.split("\x02", 2)
        rows += [(commit, dt.datetime.fromtimestamp(int(at), dt.timezone.utc).replace(tzinfo=None), subject, f) for f in files if f]
    return spark.createDataFrame(rows, "commit string, at timestamp_ntz, subject string, file string")


def fix_history(spark: SparkSession, repo: str, rev: str = "HEAD", days: int = 360) -> DataFrame:
    """(file, fixes) in the window of days that ends at the revision."""
    from ripplemark.operators.changes import fix_counts

    c = commits(spark, repo, rev)
    end = dt.datetime.fromtimestamp(int(_git(repo, "show", "-s", "--format=%ct", rev)), dt.timezone.utc).replace(tzinfo=None)
    return fix_counts(c, F.lit(end).cast("timestamp_ntz"), days)
