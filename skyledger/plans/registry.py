"""All registered queries of the archive operators, with their SQL."""

from __future__ import annotations

from . import access, files, images

QUERIES: dict = {**access.QUERIES, **images.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {**access.SQL, **images.SQL, **files.SQL}
