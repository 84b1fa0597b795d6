"""op1_quality: a quality score for every whole document, learned outside the held-out fold."""

from keyloft.llm.common import table
from keyloft.llm.quality import fit, judged


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_quality": op1_quality}
