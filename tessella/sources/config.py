"""Settings in a YAML file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from pathlib import Path

STRATEGIES = ("none", "hyde", "multi_query", "auto", "auto_llm")


@dataclass(frozen=True)
class Settings:
    """What the queries take from the settings; the rest of a file is kept out."""

    embedding_language: str = "english"
    pre_retrieval_strategy: str = "none"
    use_reranker: bool = False
    chat_memory_turns: int = 0
    compression_threshold: int = 20
    custom_system_prompt: str = ""
    k: int = 5

    def __post_init__(self):
        if self.pre_retrieval_strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.pre_retrieval_strategy}")
        if self.embedding_language not in ("english", "chinese", "mixed"):
            raise ValueError(f"unknown language {self.embedding_language}")
        if self.k < 1:
            raise ValueError("k is at least 1")


def load(path: str) -> Settings:
    """The settings of a file; defaults without one. The former switch use_hyde becomes the strategy."""
    import yaml

    file = Path(path)
    found = (yaml.safe_load(file.read_text()) if file.exists() else None) or {}
    if "use_hyde" in found and "pre_retrieval_strategy" not in found:
        found["pre_retrieval_strategy"] = "hyde" if found["use_hyde"] else "none"
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in found.items() if k in known})


def save(settings: Settings, path: str) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(asdict(settings), sort_keys=False, allow_unicode=True))
