"""A client for OpenAI-compatible chat endpoints, with the standard library alone."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field

from talkspark.operators.pairs import RateLimited


def routing(env: Mapping[str, str] = os.environ) -> dict:
    """Preferences of a routing provider from the environment; empty where none is set."""
    found: dict = {"sort": env["LLM_PROVIDER_SORT"]} if env.get("LLM_PROVIDER_SORT") else {}
    prices = {name: float(env[key]) for name, key in (("prompt", "LLM_PROVIDER_MAX_PROMPT"), ("completion", "LLM_PROVIDER_MAX_COMPLETION")) if key in env}
    return found | ({"max_price": prices} if prices else {})


@dataclass
class ChatClient:
    """(system, user) to (answer, metadata). A refusal for now raises RateLimited, an answer without content ValueError."""

    model: str
    url: str = field(default_factory=lambda: os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1"))
    key: str = field(default_factory=lambda: os.environ.get("OPENAI_API_KEY", ""), repr=False)
    provider: dict = field(default_factory=routing)
    timeout: float = 120.0

    def __call__(self, system: str, user: str) -> tuple[str, dict]:
        body: dict = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if self.provider:
            body["provider"] = self.provider
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
                told = json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(e.headers.get("Retry-After")) from e
            raise
        choice = told["choices"][0]
        if choice["message"].get("content") is None:
            raise ValueError(f"an answer without content (finish_reason {choice.get('finish_reason')})")
        usage = told.get("usage") or {}
        counted = {k: usage[k] for k in ("prompt_tokens", "completion_tokens", "total_tokens") if k in usage}
        return choice["message"]["content"], {"response_model": told.get("model"), "finish_reason": choice.get("finish_reason"), **counted}
