"""Who is asking: bearer tokens by digest, with expiry, and a role for callers without one."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from dataclasses import dataclass
from datetime import UTC, datetime

import yaml

from .config import ConfigError, mapping


class AuthError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code, self.status = code, 401


@dataclass(frozen=True)
class Caller:
    user: str
    role: str
    credential: str = ""  # its id, for the audit trail


@dataclass(frozen=True)
class Credential:
    id: str
    digest: str
    user: str
    role: str
    expires: datetime | None = None
    disabled: bool = False


def digest(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def new_token() -> tuple[str, str]:
    """A token to hand out once, and the digest to keep."""
    token = secrets.token_urlsafe(32)
    return token, digest(token)


class StaticTokens:
    """Credentials by the digest of their token; a wrong token is refused and never taken for an anonymous caller."""

    def __init__(self, credentials: list[Credential], anonymous_role: str | None = None, now=lambda: datetime.now(UTC)):
        if len({c.digest for c in credentials}) < len(credentials) or len({c.id for c in credentials}) < len(credentials):
            raise ConfigError("credentials must differ in id and token")
        self.credentials, self.anonymous_role, self.now = credentials, anonymous_role, now

    @classmethod
    def load(cls, text: str, roles: set[str], now=lambda: datetime.now(UTC)) -> StaticTokens:
        d = mapping(yaml.safe_load(text), "credentials", ("version", "allow_anonymous", "anonymous_role", "credentials"))
        if int(d.get("version", 2)) != 2:
            raise ConfigError("unknown version of credentials")
        found = []
        for c in d.get("credentials") or ():
            mapping(c, "credential", ("id", "token_sha256", "user", "role", "expires_at", "disabled"))
            mark = str(c.get("token_sha256", "")).lower()
            if len(mark) != 64 or set(mark) - set("0123456789abcdef"):
                raise ConfigError(f"credential {c.get('id')}: token_sha256 must be 64 hexadecimal digits")
            if c.get("role") not in roles:
                raise ConfigError(f"credential {c.get('id')}: unknown role {c.get('role')}")
            at = c.get("expires_at")
            at = datetime.fromisoformat(str(at).replace("Z", "+00:00")) if at is not None else None
            if at is not None and at.tzinfo is None:
                raise ConfigError(f"credential {c.get('id')}: expires_at needs a time zone")
            found.append(Credential(str(c["id"]), mark, str(c["user"]), str(c["role"]), at, bool(c.get("disabled", False))))
        role = str(d.get("anonymous_role", "public")) if d.get("allow_anonymous") else None
        if role is not None and role not in roles:
            raise ConfigError(f"unknown role {role}")
        return cls(found, role, now)

    def caller(self, token: str | None) -> Caller:
        if not token:
            if self.anonymous_role is None:
                raise AuthError("credentials_required")
            return Caller("anonymous", self.anonymous_role)
        mark, hit = digest(token), None
        for c in self.credentials:  # all are compared, so the time tells nothing
            if hmac.compare_digest(mark, c.digest):
                hit = c
        if hit is None or hit.disabled:
            raise AuthError("invalid_credentials")
        if hit.expires is not None and self.now() >= hit.expires:
            raise AuthError("credential_expired")
        return Caller(hit.user, hit.role, hit.id)
