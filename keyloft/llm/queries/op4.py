"""op4_mixing: how many words of every document a mix of weighted sources takes."""

from keyloft.llm.common import table
from keyloft.llm.mixing import mix


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": op4_mixing}
