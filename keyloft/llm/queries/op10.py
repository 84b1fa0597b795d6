"""op10_toxicity: a toxicity score for every whole document, learned outside the held-out fold."""

from keyloft.llm.common import table
from keyloft.llm.toxicity import fit, judged


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
