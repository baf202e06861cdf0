"""Stand-in encoder for text.

The reference embeds images and text with a pretrained network that is not
available here.  The default encoder is JVM-side feature hashing: lower-case
word tokens (``RegexTokenizer``), ``HashingTF`` into ``dim`` buckets, L2
``Normalizer`` -- documented as a stand-in, pluggable by passing any function
that maps a (id, text) frame to (id, v).  Whole texts are tokenised; a long
document only means more tokens in its own row.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsift.functions import vectors as V

TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def encode_hashed(df: DataFrame, id_col: str, text_col: str, dim: int = 512) -> DataFrame:
    """(id, text) -> (id, v array<double> unit length; zeros for a text without tokens)."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, toLowercase=True,
                         gaps=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_n", p=2.0)
    x = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    out = norm.transform(tf.transform(tok.transform(x)))
    return out.select(id_col, vector_to_array("_n").alias("v"))


def text_search(catalog: DataFrame, id_col: str, text_col: str, query_text: str, k: int,
                dim: int = 512) -> DataFrame:
    """Encode the query text with the same encoder, then exact cosine top k
    over the encoded catalogue (R1).  Output: item id, score."""
    spark = catalog.sparkSession
    q = encode_hashed(spark.createDataFrame([(0, query_text)], f"{id_col} long, {text_col} string"),
                      id_col, text_col, dim).first()["v"]
    return vector_search(encode_hashed(catalog, id_col, text_col, dim), id_col, q, k)


def vector_search(encoded: DataFrame, id_col: str, query: list[float], k: int) -> DataFrame:
    """Exact cosine top k of a supplied vector over encoded rows (id, v unit vectors)."""
    score = V.dot("v", F.array(*[F.lit(float(x)) for x in query]))
    return (encoded.filter(V.is_valid("v")).select(id_col, score.alias("score"))
            .orderBy(V.rank_score("score").desc(), F.col(id_col)).limit(k))


def vectors_incremental(items: DataFrame, text: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Embed only the items that have an image but no vector yet (J5), then
    merge them into the vector table.  With none missing the table is returned
    unchanged.  Output: item_id, v, source ('existing' | 'new')."""
    from recsift.operators import prep
    missing = prep.items_with_image(items).select("item_id").join(vectors.select("item_id"), "item_id",
                                                                  "left_anti")
    new = encode_hashed(text.join(missing, "item_id"), "item_id", "text", dim)
    return (vectors.select("item_id", "v", F.lit("existing").alias("source"))
                   .unionByName(new.select("item_id", "v", F.lit("new").alias("source"))))
