"""Answers from retrieved contexts: joining hits, prompts and a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.search import Retriever

# The wording that models are prompted with.
SYSTEM = "You are a helpful scientific assistant. Answer based ONLY on the provided context."
MAX_NEW_TOKENS = 256


def joined_contexts(hits: DataFrame, text: str = "payload.text") -> DataFrame:
    """(query_id, contexts, scores, context) of hits (query_id, rank, score, text) in the order of ranks."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "score", F.col(text).alias("text"))))
    found = hits.groupBy("query_id").agg(in_order.alias("hits"))
    contexts = F.transform("hits", lambda h: h.text)
    return found.select("query_id", contexts.alias("contexts"), F.transform("hits", lambda h: h.score).alias("scores"), F.array_join(contexts, "\n\n").alias("context"))


def prompt(query: Column | str, context: Column | str) -> Column:
    query, context = (F.col(x) if isinstance(x, str) else x for x in (query, context))
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def messages(prompted: Column | str) -> Column:
    """The chat that a model is given: array<struct<role, content>>."""
    content = F.col(prompted) if isinstance(prompted, str) else prompted
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def chat_template(chat: Column | str) -> Column:
    """A chat as the one text that models of the ChatML format continue, up to where the assistant's turn begins."""
    turns = F.transform(F.col(chat) if isinstance(chat, str) else chat, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


class Generator(Protocol):
    def column(self, query: Column, context: Column) -> Column:
        """The answer to each query."""
        ...


class ExtractiveGenerator:
    """Stands in for a language model: the sentence of the context that shares most words with the query, the first of equals."""

    def column(self, query: Column, context: Column) -> Column:
        def words(x: Column) -> Column:
            return F.array_distinct(F.split(F.lower(x), r"[^\p{L}\p{N}]+"))

        sentences = F.filter(F.split(context, r"(?<=[.!?])\s+|\n\n"), lambda s: F.trim(s) != "")
        scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(words(s), words(query))).alias("n"), (-i).alias("first"), s.alias("s")))
        return F.coalesce(F.trim(F.array_max(scored)["s"]), F.lit(""))


class ModelGenerator:
    """Wraps ``load() -> answer(messages, max_new_tokens)``, where messages are dicts of role and content; it is loaded once in each worker."""

    def __init__(self, load: Callable[[], Callable[[list[dict[str, str]], int], str]], max_new_tokens: int = MAX_NEW_TOKENS) -> None:
        self.load, self.max_new_tokens = load, max_new_tokens

    def column(self, query: Column, context: Column) -> Column:
        load, most = self.load, self.max_new_tokens

        @F.pandas_udf("string")
        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            generate = load()
            for batch in batches:
                yield batch.map(lambda p: generate([{"role": "system", "content": SYSTEM}, {"role": "user", "content": p}], most).strip())

        return answer(prompt(query, context))


def rag(retriever: Retriever, generator: Generator, queries: DataFrame, top_k: int = 0, where: Column | None = None, fit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, query, answer, retrieved_contexts, scores) for ``queries`` (query_id, query).

    A query without hits has an empty context and is answered all the same. ``fit``, a function of contexts and of the
    chat without them, leaves what a model's window has room for, as ``tokens.fitting`` does; scores of contexts that go
    go with them.
    """
    found = joined_contexts(retriever.batch_retrieve(queries, top_k, where))
    if fit is not None:
        chat = chat_template(messages(prompt("query", F.lit(""))))
        found = found.join(queries.select("query_id", "query"), "query_id").withColumn("contexts", fit(F.col("contexts"), chat))
        found = found.withColumn("scores", F.slice("scores", F.lit(1), F.size("contexts"))).withColumn("context", F.array_join("contexts", "\n\n")).drop("query")
    context = F.coalesce("context", F.lit(""))
    return queries.select("query_id", "query").join(found, "query_id", "left").select(
        "query_id",
        "query",
        generator.column(F.col("query"), context).alias("answer"),
        F.coalesce("contexts", F.array().cast("array<string>")).alias("retrieved_contexts"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
    )
