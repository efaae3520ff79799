import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SCHEMAS = {
    "zones": "zone_id string, doc_id bigint, project string, page int, tag string, x0 double, y0 double, x1 double, y1 double, text string, parent_id string, level int, serial int, column_no int, attributes map<string,string>, created_order int, saved_at timestamp, loaded_at timestamp",
    "line_features": "line_id bigint, doc_id bigint, project string, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font string, font_size double, bold boolean, italic boolean, caps_ratio double, source string, rotated boolean, loaded_at timestamp",
    "pdf_tokens": "token_id bigint, doc_id bigint, page int, paragraph int, token_index int, text string, x0 double, y0 double, x1 double, y1 double, style map<string,boolean>, font string, flags int, size double, token_kind string, proof_status string",
    "xhtml_tokens": "token_id bigint, doc_id bigint, pdf_token_id bigint, xhtml_file string, element string, paragraph int, word_index int, token_index int, source_line int, text string, style map<string,boolean>, token_kind string, proof_status string",
    "differences": "diff_id bigint, doc_id bigint, kind string, severity string, pdf_text string, xhtml_text string, pdf_page int, xhtml_file string, pdf_token_index int, xhtml_token_index int, confidence double, message string, pdf_unicode string, xhtml_unicode string, found_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, doc_kind string, project string, pub_year int, received_at timestamp",
    "language_codes": "lang_code string, spelling string, script string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "reading_labels": "doc_id bigint, rater string, grade int, labelled_at timestamp",
}
EARLY = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def make(spark):
    """make(table, rows of dicts): a DataFrame with the table's columns, absent ones null."""

    def of(name, rows=()):
        schema = SCHEMAS[name]
        cols = [c.split()[0] for c in schema.replace("map<string,string>", "map").replace("map<string,boolean>", "map").split(", ")]
        return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)

    return of
