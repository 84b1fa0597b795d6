"""op6_packing: all documents as token pieces, packed into sequences of 2048."""

from keyloft.llm.common import table
from keyloft.llm.packing import pack_documents


def op6_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
