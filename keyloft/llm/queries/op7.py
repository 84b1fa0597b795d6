"""op7_simhash: near-duplicate groups of all documents by SimHash."""

from keyloft.llm.common import table
from keyloft.llm.simhash import near_duplicates


def op7_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash": op7_simhash}
