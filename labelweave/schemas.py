"""Explicit schemas of every input and hand-over file, so nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ITEM = _struct(
    type=S, description=S, text=S, title=S, numbers=T.ArrayType(S), url=S, standards=T.ArrayType(S)
)
CLUSTER = _struct(cluster=S, items=T.ArrayType(ITEM))
GROUP = _struct(concept=S, domain=S, standards=T.ArrayType(S), clusters=T.ArrayType(CLUSTER))
BOOK = _struct(title=S, items=T.ArrayType(GROUP))
CATALOGUE = _struct(standards_definitions=T.MapType(S, S), titles=T.ArrayType(BOOK))

FLAT_ITEMS = _struct(
    item_id=L, book_title=S, concept=S, domain=S, cluster_description=S, item_type=S, description=S, text=S,
    title=S, numbers=S, url=S, combined_text=S, standard=S, all_standards=S,
)
ENRICHED_ITEMS = _struct(
    item_id=L, combined_text=S, url_content=S, enhanced_text=S, standard=S, category_standard=S, category=S
)
LABELS = _struct(ord=L, std_id=S, definition=S, std_text=S, category=S)
PREDICTIONS = _struct(item_id=L, predicted_standard=S, true_standard=S, confidence=D)
SUBMISSION = _struct(item_id=L, predicted_standard=S)
PAGES = _struct(page_id=L, url=S, html=S)

#: Schemas of the tables the registered queries read.
TABLES = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}

#: Order column that ``read_catalogue`` gives documents.
DOCUMENT = "_document"
