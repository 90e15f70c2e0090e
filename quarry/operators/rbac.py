"""Users and privileges, as catalog metadata checked before a statement is planned."""

from __future__ import annotations

import hashlib
import hmac
import os

from ..sources.catalog import CatalogError, State

PRIVILEGES = {"ALL", "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"}
#: The grant that holds for every table.
EVERY = "*"


class Denied(PermissionError):
    """The user lacks a privilege."""


def hashed(password: str, salt: bytes | None = None) -> str:
    salt = salt or os.urandom(16)
    return f"{salt.hex()}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt, 50_000).hex()}"


def verified(stored: str, password: str) -> bool:
    salt = bytes.fromhex(stored.partition("$")[0])
    return hmac.compare_digest(stored, hashed(password, salt))


def create_user(state: State, name: str, password: str, if_not_exists: bool = False) -> None:
    if name in state.users:
        if if_not_exists:
            return
        raise CatalogError(f"the user {name} exists")
    state.users[name] = {"password": hashed(password), "grants": {}}


def drop_user(state: State, name: str, if_exists: bool = False) -> None:
    if state.users.pop(name, None) is None and not if_exists:
        raise CatalogError(f"there is no user {name}")


def _user(state: State, name: str) -> dict:
    if name not in state.users:
        raise CatalogError(f"there is no user {name}")
    return state.users[name]


def grant(state: State, name: str, privileges: list[str], table: str = EVERY) -> None:
    wrong = set(privileges) - PRIVILEGES
    if wrong:
        raise CatalogError(f"not a privilege: {', '.join(sorted(wrong))}")
    _user(state, name)["grants"].setdefault(table, set()).update(privileges)


def revoke(state: State, name: str, privileges: list[str], table: str = EVERY) -> None:
    held = _user(state, name)["grants"].get(table, set())
    held.difference_update(held.copy() if "ALL" in privileges else privileges)


def check(state: State, user: str | None, privilege: str, tables: list[str]) -> None:
    """Raises unless ``user`` (None: the engine's owner) may do this to all of the tables."""
    if user is None:
        return
    grants = _user(state, user)["grants"]
    everywhere = grants.get(EVERY, set())
    for table in tables or [EVERY]:
        held = everywhere | grants.get(table, set())
        if not held & {"ALL", privilege}:
            raise Denied(f"{user} may not {privilege} on {table}")
