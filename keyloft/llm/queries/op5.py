"""op5_embedding_near_dedup: links and components of all embeddings at cosine 0.93."""

from keyloft.llm.common import table
from keyloft.llm.vectors import near_vectors


def op5_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
