"""Language models behind one protocol. Instances travel to the workers and are opened there."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass
from typing import Protocol

from .config import GeneratorConfig


class Generator(Protocol):
    def generate(self, system: str, prompt: str) -> str:
        """The answer, as text."""

    def reset(self) -> bool:
        """Drop the model's context; False if that failed."""


@dataclass
class RuleGenerator:
    """Offline and deterministic: the first sentence as context, years and capitalised words from the text."""

    metrics: int = 5

    def generate(self, system: str, prompt: str) -> str:
        body = prompt.split("\n\n", 1)[-1]
        years = sorted({int(y) for y in re.findall(r"\b(?:19|20)\d\d\b", body)})
        words = list(dict.fromkeys(w for w in re.findall(r"[^\W\d_]{4,}", body)))
        return json.dumps({"context": re.split(r"(?<=[.!?])\s", body.strip())[0][:256], "geo": [], "metrics": words[: self.metrics], "years": years, "time_granularity": "year" if years else None, "oked": None}, ensure_ascii=False)

    def reset(self) -> bool:
        return True


@dataclass
class HttpGenerator:
    """POST /api/generate. A read timeout is tried again after 2 and 4 seconds, other errors are raised."""

    cfg: GeneratorConfig = GeneratorConfig()
    extra: dict | None = None

    def _post(self, payload: dict, timeout: float) -> dict:
        from urllib.request import Request, urlopen

        req = Request(f"{self.cfg.base_url.rstrip('/')}/api/generate", json.dumps(payload).encode(), {"Content-Type": "application/json"})
        with urlopen(req, timeout=timeout) as r:
            return json.load(r)

    def generate(self, system: str, prompt: str) -> str:
        payload = {"model": self.cfg.model, "prompt": prompt, "system": system, "stream": False, "keep_alive": self.cfg.keep_alive, "options": self.cfg.options, **(self.extra or {})}
        for n in range(1, self.cfg.attempts + 1):
            try:
                return self._post(payload, self.cfg.timeout_s).get("response", "")
            except TimeoutError:
                if n == self.cfg.attempts:
                    raise
                time.sleep(2 * n)
        return ""

    def reset(self) -> bool:
        try:
            self._post({"model": self.cfg.model, "prompt": "", "keep_alive": "0", "stream": False}, 5)
            return True
        except Exception:
            return False
