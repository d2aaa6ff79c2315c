"""Checkouts by the git program, on the driver."""

from __future__ import annotations

import subprocess

CLONE_SECONDS, COMMAND_SECONDS = 300, 30


class GitError(RuntimeError):
    pass


def _git(*args: str, cwd: str | None = None, seconds: int = COMMAND_SECONDS) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitError(str(e)) from e
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout.strip()


def clone(remote_url: str, folder: str) -> None:
    """The newest commit of a repository into a folder."""
    _git("clone", "--depth", "1", "--", remote_url, folder, seconds=CLONE_SECONDS)


def inspect(folder: str) -> dict[str, str | None]:
    """commit_sha, branch (None when detached) and remote_url of a checkout."""
    return {"commit_sha": _git("rev-parse", "HEAD", cwd=folder), "branch": _git("branch", "--show-current", cwd=folder) or None, "remote_url": _git("remote", "get-url", "origin", cwd=folder)}
