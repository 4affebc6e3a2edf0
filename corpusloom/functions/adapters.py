"""External models as columns: enrichment, embeddings, reranking, answers, judges.

A model is a function from a list of inputs to a list of outputs of the same length, called with at most ``batch`` inputs at a time.
Without a model the defaults hold: no context, no vector, the fused order, no answer, and middling scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import truncate_words

# Batch of the embedding model, shortest context worth keeping, tokens that are embedded.
EMBED_BATCH, MIN_CONTEXT, EMBED_TOKENS = 90, 10, 512
# Sections of a long document that go to the model together with a chunk.
SECTION_TOKENS, HEADER_TOKENS = 30_000, 1_000


def apply_model(rows: DataFrame, model: Callable[[list], list], source: str, target: str, kind: str, batch: int = EMBED_BATCH) -> DataFrame:
    """Adds column ``target`` of SQL type ``kind``.  Rows that need no call are best split off before: an engine may evaluate a
    branch of CASE that a row does not take."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    schema = rows.withColumn(target, F.lit(None).cast(kind)).schema
    arrow = to_arrow_type(schema[target].dataType)
    at, names = rows.columns.index(source), [*rows.columns, target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inputs, out = b.column(at).to_pylist(), []
            for i in range(0, len(inputs), batch):
                got = model(inputs[i : i + batch])
                if len(got) != len(inputs[i : i + batch]):
                    raise RuntimeError(f"the model gave {len(got)} outputs for {len(inputs[i : i + batch])} inputs")
                out += got
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names)

    return rows.mapInArrow(run, schema)


def enriched(text: Column, context: Column) -> Column:
    """The text that is embedded: a context that says something, a blank line and the chunk, cut to the model's tokens."""
    own = F.regexp_replace(F.coalesce(context, F.lit("")), r"^\s+|\s+$", "")
    whole = F.when(F.length(own) > MIN_CONTEXT, F.concat(own, F.lit("\n\n"), text)).otherwise(text)
    return truncate_words(whole, EMBED_TOKENS)
