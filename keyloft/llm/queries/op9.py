"""op9_token_counts: token counts of every whole document."""

from keyloft.llm.common import table
from keyloft.llm.tokens import count_tokens


def op9_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
