"""A question-answering loop over the engine with an injected language model."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from corvane.operators import expand, metrics, packing, retrieval
from corvane.plans.engine import Engine
from corvane.plans.ports import Generator


@dataclass
class Decision:
    """What the model says about a context."""

    sufficient: bool = True
    topics: list[str] = field(default_factory=list)
    lines: list[dict] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)


def decide(said: str) -> Decision:
    """The JSON between the first and last brace; a text without it is searched for a yes or no."""
    found = re.search(r"\{.*\}", said, re.S)
    try:
        values = json.loads(found[0]) if found else None
    except ValueError:
        values = None
    if not isinstance(values, dict):
        return Decision("insufficient" not in said.lower() and "not sufficient" not in said.lower())
    return Decision(bool(values.get("sufficient", True)), list(values.get("topics") or []), list(values.get("lines") or []), list(values.get("queries") or []))


def variants(said: str) -> list[str]:
    """Queries that a model lists, a line each, without bullets and numbers."""
    out = []
    for line in said.splitlines():
        line = line.strip()
        if line and line[0] not in "-*" and ":" not in line:
            out.append(line.lstrip("0123456789. ").strip())
    return [x for x in out if x]


@dataclass
class Agent:
    """Searches variants of a question, packs the pool, and asks the model whether that suffices."""

    engine: Engine
    model: Generator
    k: int = 10
    budget: int = 4000
    rounds: int = 2
    expand: bool = False

    def search(self, texts: list[str], k: int):
        """The pool of several queries: one job, best score for each passage."""
        found = self.engine.retrieve(self.engine.queries(*texts), k)
        best = retrieval.pooled(found)
        rest = found.dropDuplicates(["chunk_id"]).drop("score", "query_id", "rank")
        return best.join(rest, "chunk_id")

    def pack(self, question: str, pool) -> str:
        docs = self.engine.store.read("docs")
        rows = pool.withColumn("query_id", F.lit(0).cast("long"))
        packed = packing.packed_context(self.engine.queries(question), rows, docs, self.budget, self.engine.config.pack.recency_boost)
        return packing.context_text(packed).first()["context"]

    def answer(self, question: str, context: str) -> str:
        return self.model(f"Answer from this context and nothing else.\n\n{context}\nQuestion: {question}")

    def run(self, question: str, fast: bool = False) -> dict:
        texts = [question]
        if self.expand and not fast:
            texts += variants(self.model(f"List other ways to search for this, one a line.\n\n{question}"))
        pool = self.search(texts, self.k)
        context = self.pack(question, pool)
        done = 1
        while not fast and done < self.rounds:
            said = decide(self.model(f"Does this context answer the question? Reply in JSON with sufficient, topics, lines and queries.\n\n{context}\nQuestion: {question}"))
            if said.sufficient:
                break
            more = said.queries + said.topics
            if more:
                pool = pool.unionByName(self.search(more, self.k // 2 + 1))
                pool = pool.groupBy([c for c in pool.columns if c != "score"]).agg(F.max("score").alias("score"))
                context = self.pack(question, pool)
            for item in said.lines:
                asked = self.engine.spark.createDataFrame([(item["file"], int(item["line"]))], "name string, line int")
                for row in expand.around_line(asked, self.engine.store.read("docs")).collect():
                    context += f"=== {row['path']}:L{row['start_line']}-{row['end_line']} ===\n{row['text']}\n\n"
            done += 1
        return {"answer": self.answer(question, context), "context": context, "rounds": done}

    def savings(self, context: str, answer: str):
        """Tokens and costs against sending the whole corpus."""
        total = self.engine.store.read("chunks").agg(F.floor(F.sum(F.octet_length("text")) / 4).alias("total_tokens"))
        used = total.withColumns({"sent_tokens": F.lit(len(context.encode()) // 4), "answer_tokens": F.lit(len(answer.encode()) // 4)})
        return metrics.savings(used)
