"""Interfaces to models that are not here, with deterministic stand-ins: tokenizers, embeddings, generation, grading, triples."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[str]: ...

    def decode(self, tokens: list[str]) -> str: ...


class WhitespaceTokenizer:
    """Runs without white space."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


class HashedEmbedder:
    """Words hashed to signed places of a unit vector: a stand-in that puts texts of shared words near each other."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, text: str) -> list[float]:
        v = [0.0] * self.size
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % self.size] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v


class StubGenerator:
    """Answers with the first sentence of the prompt's first block, cited."""

    name = "stub"

    def generate(self, prompt: str) -> str:
        found = re.search(r"\[DOC_(\d+)\]\n([^.\n]*)", prompt)
        return f"{found[2].strip()} [DOC_{found[1]}]" if found else "The context does not say."


class StubJudge:
    """Grades by whether the answer's words are in the context."""

    name = "stub-judge"

    def grade(self, question: str, context: str, answer: str) -> str:
        words = [w for w in re.findall(r"\w+", answer.lower()) if not w.isdigit()]
        held = sum(w in context.lower() for w in words)
        quiet = not words or "does not say" in answer
        n, grade = 0 if quiet else 1, None if quiet else (5 if held == len(words) else 3)
        ok = int(not quiet and held == len(words))
        why = {"relevance": "words", "completeness": "words", "correctness": "words", "unsupported_claims": [] if ok or quiet else [answer]}
        return json.dumps({"total_claims": n, "supported_claims": ok, "unsupported_claims": n - ok, "relevance": grade, "completeness": grade, "correctness": grade, "context_sufficient": not quiet, "response_abstained": quiet, "justification": why})


class PatternTriples:
    """`A relation B.` sentences of three words as triples; types and relations may be limited."""

    def __init__(self, relations: set[str] | None = None):
        self.relations = relations

    def extract(self, text: str) -> list[tuple[str, str, str]]:
        found = re.findall(r"\b(\w+) (\w+) (\w+)\.", text)
        return [t for t in found if self.relations is None or t[1] in self.relations]


def with_retries(call: Callable[[], str], tries: int = 4, wait: float = 15.0, sleep: Callable[[float], None] = time.sleep, again: type[Exception] | tuple = Exception, growth: float = 2.0) -> tuple[str | None, int, str | None]:
    """(result, tries made, error): waits after each failure, growth times as long as before (1: the same time, as for rate
    limits); a blank result is a failure; errors other than again are raised at once."""
    error = None
    for n in range(1, tries + 1):
        try:
            out = call()
            if out and out.strip():
                return out, n, None
            error = "blank response"
        except again as e:
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            sleep(wait * growth ** (n - 1))
    return None, tries, error


def embed(df: DataFrame, model: HashedEmbedder, text_col: str = "text") -> DataFrame:
    """df with a float embedding of each text; a null text has none."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            yield pdf.assign(embedding=[model.encode(t) if t is not None else None for t in pdf[text_col]])

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", embedding array<float>")


def generate(prompts: DataFrame, model: StubGenerator, keys: list[str], tries: int = 4, wait: float = 15.0) -> DataFrame:
    """keys, model, status (ok or erro), answer, tries, error for rows with a prompt."""
    kinds = dict(prompts.dtypes)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            found = [with_retries(lambda p=p: model.generate(p), tries, wait) for p in pdf["prompt"]]
            yield pdf[keys].assign(model=model.name, status=["ok" if a else "erro" for a, _, _ in found], answer=[a for a, _, _ in found], tries=[n for _, n, _ in found], error=[e for _, _, e in found])

    return prompts.select(*keys, "prompt").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", model string, status string, answer string, tries int, error string")
