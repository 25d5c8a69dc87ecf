"""Keyed pseudonyms: keys on the driver, HMAC and tokens as expressions.

A master key never reaches a plan. For a purpose and tenant the driver derives a
key (HKDF) and turns it into the two HMAC pads; those travel as a one-row (or one
row a tenant) table that is joined by broadcast, so no literal in a plan or in an
event log holds key material.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.settings import Settings

# They are part of every token, and of the keys' derivation.
SALT = b"tt-pii-hkdf-salt/v1"
PURPOSE = "tt-pii-pseudo/v1|{purpose}|{tenant}"
MESSAGE = "tt-pii/v1\n"

KEY_ID = re.compile(r"[a-z0-9]{1,8}")
LEAST_KEY = 32
#: A token as a whole; it may end in any character of its alphabet.
TOKEN = r"^[A-Z]{2,12}_[a-z0-9]{1,8}_[A-Za-z0-9_-]{10,64}$"


class KeystoreError(ValueError):
    """A key is missing or malformed."""




def hkdf(key: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    if not 1 <= length <= 255 * 32:
        raise ValueError("length out of range")
    secret = hmac.digest(salt or bytes(32), key, "sha256")
    block, out = b"", b""
    for n in range(1, -(-length // 32) + 1):
        block = hmac.digest(secret, block + info + bytes([n]), "sha256")
        out += block
    return out[:length]


def decoded(raw: bytes | str) -> bytes:
    """A secret: base64 if that gives 32 bytes or more, else the bytes themselves."""
    data = raw.encode() if isinstance(raw, str) else raw
    data = data.strip()
    try:
        out = base64.b64decode(data, validate=True)
        if len(out) >= LEAST_KEY:
            return out
    except (binascii.Error, ValueError):
        pass
    if len(data) >= LEAST_KEY:
        return data
    raise KeystoreError("a master key needs 32 bytes or more")


class KeyStore:
    """Master keys by id, one of them active."""

    def __init__(self, keys: Mapping[str, bytes], active: str = "v1"):
        if not keys:
            raise KeystoreError("no master key")
        for kid, key in keys.items():
            if not KEY_ID.fullmatch(kid):
                raise KeystoreError(f"invalid key id: {kid!r}")
            if len(key) < LEAST_KEY:
                raise KeystoreError(f"key {kid} is shorter than {LEAST_KEY} bytes")
        if active not in keys:
            raise KeystoreError(f"the active key {active!r} is missing")
        self._keys, self.active = dict(keys), active
        self._derived: dict[tuple[str, str, str], bytes] = {}

    @classmethod
    def from_settings(cls, settings: Settings) -> KeyStore | None:
        """Keys of the list, then the file, then the base64 value; None if there are
        none. The first key is active where the named one is missing."""
        keys: dict[str, bytes] = {}
        for entry in filter(None, (x.strip() for x in settings.master_keys.split(","))):
            kid, colon, path = entry.partition(":")
            if not colon:
                raise KeystoreError(f"expected id:path, got {kid!r}")
            with open(path.strip(), "rb") as f:
                keys[kid.strip()] = decoded(f.read())
        if settings.master_key_file and settings.active_kid not in keys:
            with open(settings.master_key_file, "rb") as f:
                keys[settings.active_kid] = decoded(f.read())
        if settings.master_key_b64 and not keys:
            keys[settings.active_kid] = decoded(settings.master_key_b64)
        if not keys:
            return None
        return cls(keys, settings.active_kid if settings.active_kid in keys else next(iter(keys)))

    def derive(self, kid: str, purpose: str = "default", tenant: str = "_") -> bytes:
        purpose, tenant = (purpose or "").strip() or "default", (tenant or "").strip() or "_"
        if len(purpose) > 64 or len(tenant) > 64:
            raise KeystoreError("purpose and tenant take 64 characters at most")
        if kid not in self._keys:
            raise KeystoreError(f"unknown key id: {kid!r}")
        at = (kid, purpose, tenant)
        if at not in self._derived:
            if len(self._derived) > 256:
                self._derived.clear()
            self._derived[at] = hkdf(self._keys[kid], SALT, PURPOSE.format(purpose=purpose, tenant=tenant).encode())
        return self._derived[at]

    def ids(self) -> list[str]:
        return sorted(self._keys)

    def health(self) -> dict:
        return {"enabled": True, "active_kid": self.active, "kids": self.ids()}


def pads(key: bytes) -> tuple[bytes, bytes]:
    """HMAC's inner and outer pad of a key of up to 64 bytes."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def pad_table(spark: SparkSession, store: KeyStore, purpose: str, tenants: list[str], kid: str | None = None) -> DataFrame:
    """(__tenant, __inner, __outer), a row for each tenant."""
    kid = kid or store.active
    rows = [(t, *map(bytearray, pads(store.derive(kid, purpose, t)))) for t in tenants]
    return spark.createDataFrame(rows, "__tenant string, __inner binary, __outer binary")


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def token(label: Column, kid: str, mac: Column, n_bytes: int = 15) -> Column:
    """LABEL_kid_base64url of the first n bytes."""
    if not 8 <= n_bytes <= 32:
        raise ValueError(f"a token takes 8 to 32 bytes, not {n_bytes}")
    if not KEY_ID.fullmatch(kid):
        raise ValueError(f"invalid key id: {kid!r}")
    text = F.rtrim(F.translate(F.base64(F.substring(mac, 1, n_bytes)), "+/", "-_"), F.lit("="))
    return F.concat(F.upper(label), F.lit(f"_{kid}_"), text)


def message(label: Column, canonical: Column) -> Column:
    return F.concat(F.lit(MESSAGE), label, F.lit("\n"), canonical)


def is_token(text: Column) -> Column:
    return F.trim(text).rlike(TOKEN)
