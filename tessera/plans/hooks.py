"""Extension points: tokenizers, embedders, rerankers, analyzers.

Models are never imitated: without a hook the operator that would call one says
so, or takes its documented fallback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@dataclass
class Registry:
    """Named hooks of one kind; reserved names cannot be taken."""

    kind: str
    reserved: tuple[str, ...] = ("none", "lexical")
    _held: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, hook: Callable) -> None:
        if name in self.reserved:
            raise ValueError(f"{name} is a reserved {self.kind}")
        self._held[name] = hook

    def get(self, name: str) -> Callable | None:
        """The hook, or None for a reserved name; an unknown name is an error."""
        if name in self.reserved:
            return None
        if name not in self._held:
            raise KeyError(f"no {self.kind} is called {name}")
        return self._held[name]


rerankers, tokenizers, embedders, analyzers = Registry("reranker"), Registry("tokenizer"), Registry("embedder"), Registry("analyzer")
#: Recall channels by name: (chunks, queries, fetch) to (query_id, chunk_id, score, rank).
providers = Registry("recall provider")


def tokenized(docs: DataFrame, hook: Callable[[str], list[str]]) -> DataFrame:
    """Id and tokens by a plugged-in tokenizer, trimmed, lower-cased, blank ones dropped."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w.strip().lower() for w in hook(t or "") if w.strip()])

    return docs.select("id", cut(F.coalesce("text", F.lit(""))).alias("tokens"))


def embedded(docs: DataFrame, hook: Callable[[list[str]], list[list[float]]], batch: int = 10, chars: int = 8192) -> DataFrame:
    """Vectors in batches; a failing batch goes one by one, then cut short, then without a vector and with a reason."""

    def one(text: str) -> tuple[list[float] | None, str | None]:
        for t in (text, text.strip()[:chars]):
            try:
                return hook([t])[0], None
            except Exception as e:  # noqa: BLE001  a model's failure is data here
                reason = str(e) or type(e).__name__
        return None, reason

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple[list[float] | None, str | None]] = []
            texts = part.text.fillna("").tolist()
            for i in range(0, len(texts), batch):
                try:
                    out += [(v, None) for v in hook(texts[i : i + batch])]
                except Exception:  # noqa: BLE001
                    out += [one(t) for t in texts[i : i + batch]]
            yield pd.DataFrame({"id": part.id, "vector": [v for v, _ in out], "error": [e for _, e in out]})

    return docs.select("id", "text").mapInPandas(run, "id string, vector array<double>, error string")


__all__ = ["Registry", "analyzers", "embedded", "embedders", "providers", "rerankers", "tokenized", "tokenizers"]
