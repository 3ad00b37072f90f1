"""A narrative of a result: a template by default, or what a language model makes of the prompt.

A provider is a function (system prompt, user message) -> text. Four services are known by name; each needs its key in the
environment, and nothing is sent without one. Others are registered in PROVIDERS by their callers.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from urllib.request import Request, urlopen

from tidemark.operators.kpi import MetricsConfig
from tidemark.plans.findings import DiffResult

Provider = Callable[[str, str], str]
#: Providers that callers registered, by name.
PROVIDERS: dict[str, Provider] = {}


@dataclass(frozen=True)
class Service:
    """A chat service over HTTP: where it is, what it is asked and where its answer has the text."""

    key_variable: str
    url: str
    model: str
    style: str
    most_tokens: int | None = 500

    def request(self, key: str, system: str, user: str) -> Request:
        chat = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        limit = {"max_tokens": self.most_tokens} if self.most_tokens else {}
        headers, body = {
            "messages": ({"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": self.model, "system": system, "messages": chat[1:]} | limit),
            "chat": ({"Authorization": f"Bearer {key}"}, {"model": self.model, "messages": chat} | limit),
            "contents": ({"x-goog-api-key": key}, {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}]}),
        }[self.style]
        return Request(self.url.format(model=self.model), json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)

    def text(self, answer: dict) -> str:
        if self.style == "messages":
            return "".join(part.get("text", "") for part in answer["content"])
        if self.style == "chat":
            return answer["choices"][0]["message"]["content"]
        return "".join(part.get("text", "") for part in answer["candidates"][0]["content"]["parts"])

    def __call__(self, system: str, user: str) -> str:
        with urlopen(self.request(os.environ[self.key_variable], system, user), timeout=120) as answer:
            return self.text(json.load(answer))


#: Names, key variables and models of the services (fixed values).
SERVICES = {
    "claude": Service("ANTHROPIC_API_KEY", "https://api.anthropic.com/v1/messages", "claude-sonnet-4-20250514", "messages"),
    "openai": Service("OPENAI_API_KEY", "https://api.openai.com/v1/chat/completions", "gpt-4o-mini", "chat"),
    "deepseek": Service("DEEPSEEK_API_KEY", "https://api.deepseek.com/chat/completions", "deepseek-chat", "chat"),
    "gemini": Service("GEMINI_API_KEY", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "gemini-1.5-flash", "contents", None),
}


def provider_named(name: str) -> Provider | None:
    """A registered provider or a service whose key is there; without the key, or of an unknown name, none, which stderr is told."""
    if name in PROVIDERS:
        return PROVIDERS[name]
    if name not in SERVICES:
        print(f"no provider {name!r}; there are {', '.join(sorted({*PROVIDERS, *SERVICES}))}", file=sys.stderr)
    elif not os.environ.get(SERVICES[name].key_variable):
        print(f"{SERVICES[name].key_variable} is not set; the story of {name} is left out", file=sys.stderr)
    else:
        return SERVICES[name]
    return None


def system_prompt(config: MetricsConfig | None = None) -> str:
    lines = ["Summarise, for technical readers and in three to five plain sentences, how a dataset changed between two versions.", "Begin with what failed, then what is suspicious, then what to look into first. Business metrics come before other findings."]
    if config and config.business_context.strip():
        lines += ["", "Business context of the dataset:", config.business_context.strip(), "Name metrics as the business does."]
    return "\n".join(lines)


def user_message(result: DiffResult, redact: bool = False) -> str:
    return f"The comparison as JSON:\n{(result.redacted() if redact else result).to_json()}"


def story(result: DiffResult, config: MetricsConfig | None = None, provider: str | Provider | None = None, redact: bool = False) -> str | None:
    """The narrative; None if the provider that is asked for cannot be had or fails, which stderr is told."""
    if provider is not None:
        call = provider_named(provider) if isinstance(provider, str) else provider
        try:
            return call(system_prompt(config), user_message(result, redact)) if call else None
        except (OSError, KeyError, IndexError, ValueError) as e:
            print(f"no story: {type(e).__name__}", file=sys.stderr)
            return None
    out = [f"The dataset went from {result.rows_before:,} to {result.rows_after:,} rows ({result.row_delta_pct:+.1%}); the verdict is {result.summary_severity}."]
    order = lambda f: (f.layer != "custom", f.layer)
    for severity, lead in (("FAIL", "Failures"), ("WARN", "To look into")):
        found = sorted((f for f in result.findings if f.severity == severity), key=order)
        if found:
            out.append(f"{lead}: {'; '.join(f.title for f in found[:3])}" + (f"; and {len(found) - 3} more." if len(found) > 3 else "."))
    if len(out) == 1:
        out.append("Nothing stands out.")
    return " ".join(out)
