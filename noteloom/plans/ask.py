"""Questions: retrieval, a numbered context, the model's answer and the notes it could cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, vectors
from ..operators.text_index import TextIndex
from ..operators.workspace import few
from .chat import ChatModel, StubChat, answer


def context(hits: DataFrame) -> str:
    """The few retrieved chunks as numbered blocks."""
    rows = hits.orderBy(F.desc("score"), "key").collect()
    return "\n\n".join(f"[{i + 1}] {r['file']}{' > ' + r['heading'] if r['heading'] else ''}\n{r['text']}" for i, r in enumerate(rows))


def ask(chunks: DataFrame, question: str, model: ChatModel | None = None, k: int = 8, index: TextIndex | None = None) -> tuple[str, list[str]]:
    """The answer and the distinct source files, best first. chunks: key, file, heading, text, embedding.

    index: the chunks' texts, if they are indexed by key; else all of them are tokenized.
    """
    vector = vectors.embed_text(question, len(chunks.select("embedding").first()[0]), {})
    hits = few(fusion.retrieve_chunks(chunks, question, vector, k, index=index))  # at most k chunks
    files = [r["file"] for r in fusion.cited_notes(hits).collect()]
    return answer(model or StubChat(), f"{question}\n\n{context(hits)}"), files
