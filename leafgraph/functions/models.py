"""Steps that call a model: embedding, relevance, answers, compression.

The model is an injected function. The defaults are deterministic, need no network and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgraph.functions.text import split_sentences, strip
from leafgraph.session import spread


def hashed_embedding(df: DataFrame, text: str = "text", output: str = "embedding", dim: int = 256) -> DataFrame:
    """Default embedding: unit-norm counts of lower-case words in ``dim`` buckets; a blank text gives zeros.

    A word's bucket is the first half of its md5 as a number, modulo ``dim``, so any engine can compute it.
    """
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    own = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim
    rows = df.withColumn("_words", F.transform(own, lambda w: bucket(w).cast("string")))
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], "_words", "_tf")
    rows = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counts.transform(rows))
    return rows.withColumn(output, vector_to_array("_unit")).drop("_words", "_tf", "_unit")


def embed(df: DataFrame, model_factory: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None,
          text: str = "text", output: str = "embedding", dim: int = 256, batch_size: int = 64) -> DataFrame:
    """Add a vector column. ``model_factory`` is called once per task and returns a function on lists of texts.

    Blank texts are not sent to the model; they get zeros.
    """
    if model_factory is None:
        return hashed_embedding(df, text, output, dim)
    import pandas as pd

    def run(batches: Iterable[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for texts in batches:
            out = [[0.0] * dim] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(todo), batch_size):
                part = todo[at:at + batch_size]
                for i, vec in zip(part, model([texts.iloc[i] for i in part])):
                    out[i] = [float(x) for x in vec]
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(output, F.pandas_udf(run, "array<double>")(F.col(text)))


def call_model(df: DataFrame, prompt: str, output: str,
               model_factory: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Add the model's reply to every prompt, in Arrow batches, one model per task."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        for batch in batches:
            replies = model(batch.column(prompt).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())],
                                             names=[*batch.schema.names, output])

    return spread(df).mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's words that occur in the text."""
    q = words(question)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))).cast("double"), F.size(q)), F.lit(0.0))


def default_judge(question: Column, text: Column, threshold: float = 0.5) -> Column:
    """Default relevance reply: ``YES, because ...`` from a share of common words on, else ``NO, because ...``."""
    share = F.floor(overlap(question, text) * 100 + 1e-9).cast("int")
    return F.concat(F.when(overlap(question, text) >= threshold, F.lit("YES")).otherwise(F.lit("NO")),
                    F.lit(", because "), share.cast("string"), F.lit("% of the question's words occur."))


def judge_relevance(hits: DataFrame, question: str = "question", text: str = "text", output: str = "reply",
                    model_factory=None, prompt: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Add a relevance reply to every (question, document) row, from the model or from common words."""
    if model_factory is None:
        return hits.withColumn(output, default_judge(F.col(question), F.col(text), threshold))
    return call_model(hits, prompt or text, output, model_factory)


def check_question(question: Column, k: Column) -> tuple[Column, Column]:
    """The question and k, or an error for a blank question and for k below 1."""
    q = F.when(strip(F.coalesce(question, F.lit(""))) == "", F.raise_error(F.lit("user_input cannot be empty"))
               .cast("string")).otherwise(question)
    n = F.when(F.coalesce(k, F.lit(0)) < 1, F.raise_error(F.lit("number_of_docs must be greater than 0"))
               .cast("int")).otherwise(k)
    return q, n


def first_sentence(text: Column) -> Column:
    return F.try_element_at(split_sentences(text), F.lit(1))


def generate_answers(prompts: DataFrame, best_text: str = "best_text", prompt: str = "prompt", output: str = "answer",
                     model_factory=None) -> DataFrame:
    """Add an answer per prompt; by default the first sentence of the best hit."""
    if model_factory is None:
        return prompts.withColumn(output, first_sentence(F.col(best_text)))
    return call_model(prompts, prompt, output, model_factory)


def compress(question: Column, text: Column, threshold: float = 0.2) -> Column:
    """Default compression: the sentences that share enough words with the question, one per line."""
    return F.array_join(F.filter(split_sentences(text), lambda s: overlap(question, s) >= threshold), "\n")
