"""Token counts through a digest cache.

Stored counts are keyed by two digests: SHA-256 of the normalised content (a
null text is the empty text; nothing else may be normalised without changing a
count) and SHA-256 of the tokenizer file. Texts whose key is stored are not
encoded again; of the others each distinct text is encoded once and the new
counts are appended to the store.

Nulls, ties and odd input: a null text counts 0 bytes and 0 tokens, a null
doc_id keeps its row, repeated rows each get a row, an empty table gives an
empty result, and columns of other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from .common import cut

STORE_SCHEMA = "content binary, tokenizer string, n_tokens long"

#: Below U+0250 (Latin letters and signs) both encoders split alike; texts with any other character are left to the tokenizer library itself.
_BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def _encoders(path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    if ranks_path is None:
        return exact, None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items() if t.special}
    return exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def count_tokens(texts: list[str], path: str, ranks_path: str | None = None) -> list[int]:
    """Tokens of each whole text as the tokenizers library gives them.

    Where the same vocabulary is at hand as ranks, texts of Latin script go
    through the faster encoder, which splits and merges them alike (checked in
    the tests); all others go through the library.
    """
    exact, fast = _encoders(path, ranks_path)
    out = [0] * len(texts)
    rest = []
    for i, text in enumerate(texts):
        if fast is None or _BEYOND_LATIN.search(text):
            rest.append(i)
        else:
            out[i] = len(fast.encode(text, allowed_special="all"))
    for at in range(0, len(rest), 64):
        part = rest[at : at + 64]
        for i, encoded in zip(part, exact.encode_batch([texts[i] for i in part], add_special_tokens=False)):
            out[i] = len(encoded)
    return out


def _stored(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


def token_counts(docs: DataFrame, store: str, path: str, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row; new counts are appended to `store`.

    Only digests are compared and grouped; the texts to encode reach their
    tasks by doc_id, of which no group is large, so copies of one text never
    meet in one task.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("content"))
    known = _stored(spark, store).where(F.col("tokenizer") == version).select("content", "n_tokens")
    distinct = texts.groupBy("content").agg(F.min("_id").alias("_id"))
    missing = distinct.join(known.select("content"), "content", "left_anti")
    todo = texts.join(missing.hint("shuffle_hash"), ["_id", "content"], "left_semi").select("content", "_text")

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            n = count_tokens(batch.column(1).to_pylist(), path, ranks_path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    counted = todo.mapInArrow(encode, "content binary, n_tokens long")
    new = counted.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(store)
    # a table of its own, not an aggregate in the join's stage: so Spark can split the rows of a text with many copies
    counts = cut(_stored(spark, store).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content"))
    return keyed.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")
