"""Folders for what the checks store."""

from __future__ import annotations

import uuid

from gustledger.plans.settle import shared_folder


def fresh_folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/gustledger-{uuid.uuid4().hex}"
