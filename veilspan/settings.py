"""Settings of the engine, read from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

_TRUE = frozenset({"1", "true", "yes", "on"})

#: Environment names, where they are not the field's name in capitals.
_NAMES = {
    "active_kid": "PSEUDONYM_ACTIVE_KID",
    "master_key_b64": "PSEUDONYM_MASTER_KEY_B64",
    "master_key_file": "PSEUDONYM_MASTER_KEY_FILE",
    "master_keys": "PSEUDONYM_MASTER_KEYS",
    "allowed_purposes": "PSEUDONYM_ALLOWED_PURPOSES",
}


@dataclass(frozen=True)
class Settings:
    default_language: str = "pl"
    score_threshold: float = 0.4
    mapping_ttl_seconds: int = 900
    enable_krs: bool = False
    hash_salt: str = ""
    max_text_length: int = 100_000
    master_key_b64: str = ""
    master_key_file: str = ""
    #: "kid:path,kid:path"
    master_keys: str = ""
    active_kid: str = "v1"
    #: comma-separated; empty allows any
    allowed_purposes: str = ""
    default_purpose: str = "default"
    default_token_bytes: int = 15
    #: what a context word adds, the least score it gives, and how many words back it is sought
    context_boost: float = 0.35
    context_floor: float = 0.4
    context_words: int = 5
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(_NAMES.get(f.name, f.name.upper()))
            if raw is None:
                continue
            kind = type(f.default)
            given[f.name] = raw.strip().lower() in _TRUE if kind is bool else kind(raw)
        return cls(**given)

    def purposes(self) -> frozenset[str]:
        return frozenset(p.strip() for p in self.allowed_purposes.split(",") if p.strip())
