"""Models behind an HTTP API of chat completions. The transport can be replaced."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from loomspan.interfaces import Model


class Busy(Exception):
    """The service asks to try again."""


def post(url: str, headers: dict[str, str], body: dict, timeout: float = 120) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise Busy(str(e)) from e
        raise
    except (urllib.error.URLError, TimeoutError) as e:
        raise Busy(str(e)) from e


@dataclass(frozen=True)
class ChatModel(Model):
    """generate, generate_json, generate_vision and generate_contextual by one endpoint.

    Calls that meet a busy service are repeated, ``attempts`` in all, after waits that double up to
    ``longest`` seconds. The object is small and picklable; it can go to the executors as it is.
    """

    base_url: str
    model: str
    key: str = ""
    attempts: int = 5
    longest: float = 60.0
    temperature: float = 0.0
    send: Callable[[str, dict, dict], dict] = post
    sleep: Callable[[float], None] = time.sleep

    def _ask(self, content: object, system: str | None, max_tokens: int | None, as_json: bool) -> str:
        messages = [{"role": "system", "content": system}] if system else []
        body = {"model": self.model, "temperature": self.temperature, "messages": [*messages, {"role": "user", "content": content}]}
        if max_tokens:
            body["max_tokens"] = max_tokens
        if as_json:
            body["response_format"] = {"type": "json_object"}
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        for k in range(self.attempts):
            try:
                return self.send(f"{self.base_url.rstrip('/')}/chat/completions", headers, body)["choices"][0]["message"]["content"] or ""
            except Busy:
                if k + 1 == self.attempts:
                    raise
                self.sleep(min(self.longest, 2.0**k))
        raise AssertionError

    def generate(self, prompt: str, system: str | None = None, max_tokens: int | None = None) -> str:
        return self._ask(prompt, system, max_tokens, False)

    def generate_json(self, prompt: str, system: str | None = None) -> object:
        return json.loads(self._ask(prompt, system, None, True))

    def generate_vision(self, prompt: str, image: str, detail: str = "low", system: str | None = None) -> str:
        parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image, "detail": detail}}]
        return self._ask(parts, system, None, False)

    def generate_contextual(self, context: str, prompt: str, max_tokens: int | None = None) -> str:
        """The context goes first and unchanged, so that a service can reuse its work on it."""
        return self.generate(context + prompt, max_tokens=max_tokens)

    def later(self, prompt: str, pool: ThreadPoolExecutor) -> Future:
        return pool.submit(self.generate, prompt)


CHOICE_PROMPT = 'Passages of a document:\n\n{}\n\nName the first passage that turns to another subject. Answer with JSON: {{"split_index": number}}\n'


def split_index(answer: str) -> int | None:
    """The number that an answer names: split_index of a JSON object, else its first integer."""
    try:
        found = json.loads(answer)
        if isinstance(found, dict) and isinstance(found.get("split_index"), int):
            return found["split_index"]
    except ValueError:
        pass
    m = re.search(r"\d+", answer)
    return int(m[0]) if m else None


def choice(model: object) -> Callable[[list[str], int, int], int]:
    """The ``choose`` of a guided chunker by a model; an answer without a number is asked for again."""
    generate = getattr(model, "generate", model)

    def choose(passages: list[str], first: int, end: int) -> int:
        found = split_index(generate(CHOICE_PROMPT.format("\n".join(passages))))
        return end + 1 if found is None else found

    return choose
