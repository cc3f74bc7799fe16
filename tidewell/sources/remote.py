"""HTTP callables for the model providers and the messenger; all are replaceable."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

from .settings import Settings

MODEL_SECONDS, SEND_SECONDS, MODEL_TOKENS = 90, 40, 32768


def post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: int = MODEL_SECONDS) -> dict:
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
    with urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def providers(s: Settings) -> dict[str, Callable[[str], str]]:
    """Those with a key, in their order; keys travel in headers."""
    def gemini(text: str) -> str:
        url = f"https://generativelanguage.googleapis.com/v1beta/models/{s.gemini_model}:generateContent"
        body = {"contents": [{"parts": [{"text": text}]}], "generationConfig": {"responseMimeType": "application/json", "maxOutputTokens": MODEL_TOKENS}}
        return post(url, body, {"x-goog-api-key": s.gemini_key})["candidates"][0]["content"]["parts"][0]["text"]

    def openrouter(text: str) -> str:
        body = {"model": s.openrouter_model, "messages": [{"role": "user", "content": text}], "response_format": {"type": "json_object"}, "max_tokens": MODEL_TOKENS}
        return post("https://openrouter.ai/api/v1/chat/completions", body, {"Authorization": f"Bearer {s.openrouter_key}"})["choices"][0]["message"]["content"]

    return {n: f for n, f, key in (("gemini", gemini, s.gemini_key), ("openrouter", openrouter, s.openrouter_key)) if key}


def send(token: str, chat: str, html: str) -> dict:
    body = {"chat_id": chat, "text": html, "parse_mode": "HTML", "disable_web_page_preview": True}
    return post(f"https://api.telegram.org/bot{token}/sendMessage", body, timeout=SEND_SECONDS)
