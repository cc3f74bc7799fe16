"""Settings from the environment and an optional ``.env`` file; the environment wins."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def dotenv(path: Path) -> dict[str, str]:
    found: dict[str, str] = {}
    if path.exists():
        for raw in path.read_text(encoding="utf-8").splitlines():
            key, sep, value = raw.strip().partition("=")
            if sep and not key.startswith("#"):
                found.setdefault(key.strip(), value.strip())
    return found


@dataclass(frozen=True)
class Settings:
    store: str
    source_username: str
    source_chat_id: str
    bot_token: str
    admin_chat_id: str
    gemini_key: str
    gemini_model: str
    openrouter_key: str
    openrouter_model: str
    brand: str
    place: str
    rules: bool
    zone: str
    group_link: str


def settings(root: Path) -> Settings:
    env = dotenv(root / ".env") | dict(os.environ)
    get = lambda key, default="": env.get(key, default)
    return Settings(
        store=get("DIGEST_STORE", str(root / "state" / "digest")),
        source_username=get("TELEGRAM_SOURCE_USERNAME").lstrip("@"),
        source_chat_id=get("TELEGRAM_SOURCE_CHAT_ID"),
        bot_token=get("TELEGRAM_BOT_TOKEN"),
        admin_chat_id=get("TELEGRAM_ADMIN_CHAT_ID"),
        gemini_key=get("GEMINI_API_KEY"),
        gemini_model=get("GEMINI_MODEL", "gemini-3.1-flash-lite"),
        openrouter_key=get("OPENROUTER_API_KEY"),
        openrouter_model=get("OPENROUTER_MODEL", "openrouter/free"),
        brand=get("DIGEST_BRAND", "обЪявления"),
        place=get("DIGEST_PLACE"),
        rules=get("DIGEST_RULES") == "1",
        zone=get("DIGEST_ZONE", "Europe/Madrid"),
        group_link=get("DIGEST_GROUP_LINK"),
    )
