"""Decoding, checking and encoding of network telemetry as Spark DataFrame jobs."""

from wirelens.plans.model import (  # noqa: F401
    BitRule,
    Checks,
    Connection,
    Exclusion,
    Field,
    Message,
    Profile,
    Profiles,
)
