"""Text encoders: each adds an L2-normalised vector column to a table."""

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.vectors import l2_normalize

# The encoding code travels with the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class HashEncoder:
    """Counts of hashed words.

    Texts are cut into words by the engine; a batch's distinct words are hashed
    once each, and all its counts are made in one go, so the time grows with the
    words and not with words times ``dim``.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column) -> Column:
        dim = self.dim

        def counts(words: pa.Array) -> pa.Array:
            n = len(words)
            coded = words.flatten().dictionary_encode()
            slots = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim if w else -1 for w in coded.dictionary.to_pylist()]
            slot = np.array(slots, np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
            at = (row * dim + slot)[slot >= 0]
            found = np.bincount(at, minlength=n * dim).reshape(n, dim).astype("float64")
            length = np.sqrt((found * found).sum(axis=1, keepdims=True))
            found /= np.where(length > 0, length, 1.0)
            cuts = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
            return pa.ListArray.from_arrays(cuts, pa.array(found.ravel()), mask=pc.is_null(words))

        counts.__annotations__ = {"words": pa.Array, "return": pa.Array}
        words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
        return F.arrow_udf(counts, "array<double>")(words)

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.column(F.col(text)))


class LookupEncoder:
    """Vectors from a table of (text, vector); any other text gets ``default``."""

    def __init__(self, table: DataFrame, default):
        self.table = table
        self.default = [float(x) for x in default]

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        known = self.table.select(F.col("text").alias("_known_text"), l2_normalize(F.col("vector")).alias("_known_vector"))
        other = l2_normalize(F.array(*[F.lit(x) for x in self.default]))
        joined = df.join(known, df[text] == known["_known_text"], "left")
        vector = F.when(F.col(text).isNotNull(), F.coalesce("_known_vector", other))
        return joined.withColumn(out, vector).drop("_known_text", "_known_vector")


class ModelEncoder:
    """A user's model: ``load()`` returns ``texts -> float array [n, dim]``.

    The model is loaded once per Python worker and fed Arrow batches. Rows
    without a text are not sent to it.
    """

    def __init__(self, load, dim: int, batch_size: int = 64):
        self.dim = dim

        def make_predict():
            import numpy as np

            model = load()

            def predict(texts):
                given = [i for i, t in enumerate(texts) if t is not None]
                out = np.zeros((len(texts), dim), dtype="float32")
                if given:
                    out[given] = model([texts[i] for i in given])
                return out

            return predict

        self._udf = predict_batch_udf(
            make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        encoded = df.withColumn(out, self._udf(F.col(text)))
        vector = F.when(F.col(text).isNotNull(), l2_normalize(F.col(out)))
        return encoded.withColumn(out, vector)
