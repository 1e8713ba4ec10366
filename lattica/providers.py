"""Models that the library calls: embedders, generators and judges, with offline ones that always answer alike.

A provider is a picklable object whose `call` takes a list of strings and returns a list; it runs in Arrow batches on
the executors. Replies are worth keeping: write them once (`lattica.plans.lineage.cut`) before they are used twice.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Provider(Protocol):
    returns: str

    def call(self, texts: list[str]) -> list: ...


class HashEmbedder:
    """Signed counts of hashed words, of unit length; a text without words is the zero vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.returns = dimensions, "array<double>"

    def call(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!])\s+", (text or "").strip()) if s]


class ExtractiveGenerator:
    """Answers with the first sentence of what follows the last 'Context:' of a prompt."""

    returns = "string"

    def call(self, texts: list[str]) -> list[str]:
        return [(_sentences((t or "").rpartition("Context:")[2]) or [""])[0] for t in texts]


class PropositionExtractor:
    """JSON {"propositions": [...]}: the sentences of a text."""

    returns = "string"

    def call(self, texts: list[str]) -> list[str]:
        return [json.dumps({"propositions": _sentences(t)}, ensure_ascii=False) for t in texts]


class TripletExtractor:
    """JSON {"triplets": [[s, r, o], ...]}: of each sentence its first word, its second and the rest."""

    returns = "string"

    def call(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            parts = [s.strip(" .!?\n").split(maxsplit=2) for s in _sentences(t)]
            out.append(json.dumps({"triplets": [p for p in parts if len(p) == 3]}, ensure_ascii=False))
        return out


class QuestionWriter:
    """JSON {"qa": [...]}: for each of K personas N tasks with M questions about a text."""

    returns = "string"
    kinds = ("Global", "Local Direct", "One Fact")

    def __init__(self, personas: int = 1, tasks: int = 1, questions: int = 1):
        self.personas, self.tasks, self.questions = personas, tasks, questions

    def call(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            s = _sentences(t) or [""]
            rows = [
                {"question_type": self.kinds[m % 3], "question": f"What is said about {' '.join(s[m % len(s)].split()[:3])}?", "answer": s[m % len(s)], "persona": f"reader {k + 1}", "task": f"task {n + 1}"}
                for k in range(self.personas)
                for n in range(self.tasks)
                for m in range(self.questions)
            ]
            out.append(json.dumps({"qa": rows}, ensure_ascii=False))
        return out


class OverlapJudge:
    """JSON scores from 0 to 10 by the share of common words; takes JSON with question, truth, answer and contexts."""

    returns = "string"

    def call(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            x = json.loads(t)
            bag = lambda s: set(re.findall(r"\w+", str(s or "").lower()))
            truth, answer, context = bag(x.get("truth")), bag(x.get("answer")), bag(" ".join(x.get("contexts") or []))
            both = len(truth & answer)
            f1 = 2 * both / (len(truth) + len(answer)) if truth and answer else 0.0
            recall = len(truth & context) / len(truth) if truth else 0.0
            out.append(json.dumps({"answer_correctness": {"score": round(10 * f1, 4), "reason": f"{both} common words"}, "context_relevance": {"score": round(10 * recall, 4), "reason": f"{len(truth & context)} words found"}}))
        return out


class PassFailJudge:
    """pass if an answer has most of the words of its reference, else fail; takes JSON with answer and reference."""

    returns = "string"
    allowed = ("pass", "fail")

    def call(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            x = json.loads(t)
            need = set(re.findall(r"\w+", str(x.get("reference") or "").lower()))
            have = set(re.findall(r"\w+", str(x.get("answer") or "").lower()))
            out.append("pass" if need and len(need & have) > len(need) / 2 else "fail")
        return out


class VerdictJudge:
    """JSON {"verdict": 1} if a context has most of the words of a statement, else 0; takes JSON with statement and context."""

    returns = "string"

    def call(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            x = json.loads(t)
            need, have = (set(re.findall(r"\w+", str(x.get(k) or "").lower())) for k in ("statement", "context"))
            out.append(json.dumps({"verdict": int(bool(need) and 2 * len(need & have) > len(need))}))
        return out


class GraphTransformer:
    """JSON {"nodes": [...], "relationships": [[s, type, o], ...]} of a text, from its triplets."""

    returns = "string"

    def call(self, texts: list[str]) -> list[str]:
        out = []
        for reply in TripletExtractor().call(texts):
            found = json.loads(reply)["triplets"]
            out.append(json.dumps({"nodes": sorted({x for s, _, o in found for x in (s, o)}), "relationships": found}, ensure_ascii=False))
        return out


class HttpRetriever:
    """Replies of an HTTP endpoint as they come: a question as JSON by POST, or as a parameter by GET; an HTTP error is raised.

    `lattica.functions.metrics.normalise_reply` reads the shapes that endpoints answer in.
    """

    returns = "string"

    def __init__(self, url: str, method: str = "POST", field: str = "query", timeout: float = 30.0):
        self.url, self.method, self.field, self.timeout = url, method.upper(), field, timeout

    def call(self, texts: list[str]) -> list[str]:
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        out = []
        for t in texts:
            if self.method == "GET":
                request = Request(f"{self.url}?{urlencode({self.field: t})}")
            else:
                request = Request(self.url, json.dumps({self.field: t}).encode(), {"Content-Type": "application/json"})
            with urlopen(request, timeout=self.timeout) as reply:
                out.append(reply.read().decode())
        return out


class JsonOnly:
    """Another provider, asked to reply in JSON."""

    def __init__(self, inner: Provider):
        self.inner, self.returns = inner, inner.returns

    def call(self, texts: list[str]) -> list:
        return self.inner.call([f"{t}\nReply in JSON." for t in texts])


_registry: dict[str, Callable[..., Provider]] = {
    "embed-offline": HashEmbedder,
    "generate-offline": ExtractiveGenerator,
    "propositions-offline": PropositionExtractor,
    "triplets-offline": TripletExtractor,
    "questions-offline": QuestionWriter,
    "judge-offline": OverlapJudge,
    "passfail-offline": PassFailJudge,
    "verdict-offline": VerdictJudge,
    "graph-offline": GraphTransformer,
    "http": HttpRetriever,
}


def register(name: str, make: Callable[..., Provider]) -> None:
    _registry[name.lower()] = make


def get(name: str, **options) -> Provider:
    if name.lower() not in _registry:
        raise ValueError(f"no provider {name!r}; there are {sorted(_registry)}")
    return _registry[name.lower()](**options)


def timed(provider: Provider) -> Callable[[Column], Column]:
    """Like `column`, with the time it took: struct<reply, latency_ms>; a batch's time is shared by its texts."""

    @F.pandas_udf(f"reply {provider.returns}, latency_ms double")
    def reply(texts: pd.Series) -> pd.DataFrame:
        began = time.perf_counter()
        said = provider.call([t if t is not None else "" for t in texts])
        took = (time.perf_counter() - began) * 1000 / max(1, len(texts))
        return pd.DataFrame({"reply": said, "latency_ms": took}, index=texts.index)

    return reply


#: Texts whose replies a worker holds at once, where lists of texts are asked.
TEXTS = 2_000


def column(provider: Provider) -> Callable[[Column], Column]:
    """A function from a text column to the column of the provider's replies; its `each` takes and gives arrays of them."""

    @F.pandas_udf(provider.returns)
    def reply(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.call([t if t is not None else "" for t in texts]), index=texts.index)

    @F.pandas_udf(f"array<{provider.returns}>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            ends = lists.map(lambda x: 0 if x is None else len(x)).astype(int).cumsum()
            for _, some in lists.groupby(ends // TEXTS):
                flat = [t if t is not None else "" for x in some if x is not None for t in x]
                said = (r for at in range(0, len(flat), TEXTS) for r in provider.call(flat[at : at + TEXTS]))
                yield pd.Series([None if x is None else list(islice(said, len(x))) for x in some], index=some.index, dtype=object)

    reply.each = each
    return reply
