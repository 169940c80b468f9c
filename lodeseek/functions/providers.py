"""Model services over HTTP: their addresses, headers and payloads in either dialect, and calls that the operators take.

A ``Provider`` is pickled to the executors; its calls are what ``vectors.embedder``,
``vectors.reranker`` and query expansion expect.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

from lodeseek.functions import vectors

_EXPLAINED = {401: "the key is missing or refused", 403: "the key may not do this", 404: "there is no such address or model"}


@dataclass(frozen=True)
class Provider:
    """url: of the service, with ``/v1`` at its end or not. dialect: openai or native.

    key: sent in ``header`` after ``prefix``; without one no header is sent.
    """

    url: str
    model: str
    dialect: str = "openai"
    key: str = ""
    header: str = "Authorization"
    prefix: str = "Bearer "
    timeout: float = 60.0

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"} | ({self.header: self.prefix + self.key} if self.key else {})

    def address(self, what: str) -> str:
        """what: embeddings, chat or rerank."""
        base = self.url.rstrip("/")
        if self.dialect == "native":
            return base.removesuffix("/v1").rstrip("/") + {"embeddings": "/api/embed", "chat": "/api/chat", "rerank": "/rerank"}[what]
        return base + {"embeddings": "/embeddings", "chat": "/chat/completions", "rerank": "/rerank"}[what]

    def post(self, what: str, body: dict) -> str:
        request = urllib.request.Request(self.address(what), json.dumps(body).encode(), self.headers())
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{request.full_url}: {_EXPLAINED.get(e.code, f'answer {e.code}')}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise RuntimeError(f"{request.full_url}: can't be reached ({e})") from e

    def embed(self, texts: list[str], dims: int) -> list[list[float]]:
        return vectors.vectors_of(self.post("embeddings", {"model": self.model, "input": texts}), dims, len(texts))

    def expand(self, query: str, instruction: str) -> list[str]:
        """Variants of a query; none if the service fails or answers anything else."""
        body = {"model": self.model, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": query}], "stream": False}
        body |= {"format": "json", "options": {"temperature": 0}} if self.dialect == "native" else {"response_format": {"type": "json_object"}, "temperature": 0}
        try:
            return vectors.variants_of(self.post("chat", body))
        except RuntimeError:
            return []

    def rerank(self, query: str, texts: list[str]) -> list[dict]:
        """Items with index and score; none if the service fails."""
        try:
            found = json.loads(self.post("rerank", {"query": query, "texts": texts, "raw_scores": True}))
        except (RuntimeError, ValueError):
            return []
        return found if isinstance(found, list) else []
