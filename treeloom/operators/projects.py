"""Projects, their repository, and snapshots as rows of the catalog."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from treeloom import schemas
from treeloom.operators import store
from treeloom.operators.validate import repository_parts
from treeloom.sources.catalog import Catalog


class NotFoundError(LookupError):
    pass


class ConflictError(ValueError):
    pass


def _add(catalog: Catalog, table: str, row: dict) -> dict:
    catalog.upsert(table, catalog.spark.createDataFrame([tuple(row[c] for c in schemas.schema(table).names)], schemas.schema(table)))
    return row


def _get(catalog: Catalog, table: str, key: str) -> dict:
    r = store.by_key(catalog.read(table), key).first()
    if r is None:
        raise NotFoundError(f"no row {key} in {table}")
    return r.asDict()


def create_project(catalog: Catalog, name: str, description: str | None = None) -> dict:
    if not name.strip():
        raise ValueError("a project needs a name")
    return _add(catalog, "projects", {"id": str(uuid.uuid4()), "name": name.strip(), "description": (description or "").strip() or None, "status": "ACTIVE"})


def get_project(catalog: Catalog, project_id: str) -> dict:
    return _get(catalog, "projects", project_id)


def list_projects(catalog: Catalog):
    return store.listed(catalog.read("projects"), ["name"])


def register_repository(catalog: Catalog, project_id: str, remote_url: str) -> dict:
    """The one repository of a project; a second one is a conflict."""
    get_project(catalog, project_id)
    if catalog.read("repositories").where(F.col("project_id") == project_id).limit(1).count():
        raise ConflictError("the project has a repository")
    parts = catalog.spark.createDataFrame([(remote_url,)], "u string").select(repository_parts(F.col("u")).alias("p")).first()["p"]
    if parts is None:
        raise ValueError("no address of a repository")
    return _add(catalog, "repositories", {"id": str(uuid.uuid4()), "project_id": project_id, "provider": "GITHUB", "remote_url": remote_url.strip(), "owner": parts["owner"], "name": parts["name"], "status": "ACTIVE"})


def create_snapshot(catalog: Catalog, repository_id: str, commit_sha: str, remote_url: str, branch: str | None = None, now: datetime | None = None) -> dict:
    """A PENDING snapshot of a commit; one commit of a repository has one snapshot."""
    _get(catalog, "repositories", repository_id)
    sha = commit_sha.strip().lower()
    if len(sha) != 40 or set(sha) - set("0123456789abcdef"):
        raise ValueError("no commit")
    if catalog.read("snapshots").where((F.col("repository_id") == repository_id) & (F.col("commit_sha") == sha)).limit(1).count():
        raise ConflictError("the commit has a snapshot")
    return _add(catalog, "snapshots", {"id": str(uuid.uuid4()), "repository_id": repository_id, "commit_sha": sha, "branch": (branch or "").strip() or None, "remote_url": remote_url, "status": "PENDING", "created_at": now or datetime.now(UTC)})


def set_snapshot_status(catalog: Catalog, snapshot_id: str, status: str) -> dict:
    if status not in schemas.STATUSES["snapshots"]:
        raise ValueError(status)
    return _add(catalog, "snapshots", _get(catalog, "snapshots", snapshot_id) | {"status": status})


def start_job(catalog: Catalog, snapshot_id: str, now: datetime | None = None) -> dict:
    """A QUEUED job, unless the snapshot is unknown or its newest job hasn't ended."""
    from treeloom.operators.jobs import TERMINAL

    _get(catalog, "snapshots", snapshot_id)
    last = store.newest(catalog.read("analysis_jobs").where(F.col("snapshot_id") == snapshot_id), "snapshot_id").first()
    if last is not None and last["status"] not in TERMINAL:
        raise ConflictError("a job is running")
    at = now or datetime.now(UTC)
    return _add(catalog, "analysis_jobs", {"id": str(uuid.uuid4()), "snapshot_id": snapshot_id, "status": "QUEUED", "progress": 0, "error_message": None, "created_at": at, "updated_at": at})
