"""op8_html_extraction: the main text of every page."""

from keyloft.llm.common import table
from keyloft.llm.html import extract


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
