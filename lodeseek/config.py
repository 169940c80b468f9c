"""Settings of indexing and search. Defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

DOC_EXTENSIONS = (".md", ".markdown", ".txt")
CODE_FILES = ("Jenkinsfile", "Dockerfile", "Makefile", "docker-compose.yml", "docker-compose.yaml", "requirements.txt", "pyproject.toml")
CODE_SUFFIXES = (".yml", ".yaml", ".sh", ".tf", ".ini", ".cfg", ".toml")
SKIPPED_DIRS = (
    ".git", ".venv", "venv", "node_modules", "__pycache__", ".tox", ".mypy_cache", "migrations", "vendor", "third_party", "dist", "build", ".idea", ".vscode",
    "graphify-out", "site-packages", "graph", "tests", "test", "testing", "e2e", "fixtures",
)
SKIPPED_NAME_PARTS = ("test_", "_test", "conftest")


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1500
    code_chars: int = 4000
    doc_chars: int = 300
    window_lines: int = 120
    asciidoc_chars: int = 800
    dims: int = 1024
    top_k: int = 5
    top_k_most: int = 20
    candidates: int = 20
    score_least: float = 0.48
    code_score_least: float = 0.35
    gate: float = 0.62
    rrf_k: int = 60
    rerank_least: float = 0.0
    facet_most: int = 50
    shown_code_chars: int = 600


DEFAULTS = Settings()
