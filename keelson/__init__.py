"""Keelson: customer-retention analytics as Spark jobs."""

from keelson.roles import CUSTOMER, RoleSpec
from keelson.session import build_session

__all__ = ["CUSTOMER", "RoleSpec", "build_session"]
