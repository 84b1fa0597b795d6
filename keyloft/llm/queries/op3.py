"""op3_media_columns: every whole text stored as a baseline JPEG, read back and described."""

from keyloft.llm.common import table
from keyloft.llm.jpeg import media_columns


def op3_media_columns(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"))


QUERIES = {"op3_media_columns": op3_media_columns}
