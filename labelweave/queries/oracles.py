"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from labelweave.functions import text as T
from labelweave.functions.labels import FAILED, GOOD, PERFECT
from labelweave.functions.vocab import KEEP_WORDS, MAX_WORDS, NOISE_WORDS
from labelweave.operators.vectors import DIMS
from labelweave.queries.inputs import VOLUME


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_in(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


# Texts


def normalise(text: str) -> str:
    blank = f"regexp_replace(lower(coalesce({text}, '')), {q(T.SPACE)}, ' ', 'g')"
    no_urls = f"regexp_replace({blank}, 'http[^ ]+|www[^ ]+', '', 'g')"
    no_mail = f"regexp_replace({no_urls}, '[^ ]+@[^ ]+', '', 'g')"
    return f"regexp_replace({no_mail}, '[^\\p{{L}}\\p{{N}}_ -]', ' ', 'g')"


def raw_words(text: str) -> str:
    return f"list_filter(string_split({normalise(text)}, ' '), lambda w: w <> '')"


def clean_words(text: str, max_words: int | None) -> str:
    kept = (
        f"list_filter(string_split({normalise(text)}, ' '), lambda w: list_contains({words_in(KEEP_WORDS)}, w) OR "
        f"(length(w) > 3 AND NOT list_contains({words_in(NOISE_WORDS)}, w) AND "
        f"(regexp_matches(w, '^\\p{{L}}+$') OR regexp_matches(w, {q(T.DIGIT)}))))"
    )
    return kept if max_words is None else f"list_slice({kept}, 1, {max_words})"


def clean_text(text: str, max_words: int | None = MAX_WORDS) -> str:
    return f"array_to_string({clean_words(text, max_words)}, ' ')"


# Patterns of their own, not the engine's, so that a wrong one there doesn't agree with itself.
_MARKUP = (
    "(?is)<(?:!--.*?(?:-->|\\z)|script\\b[^>]*>.*?(?:</script\\s*>|\\z)|style\\b[^>]*>.*?(?:</style\\s*>|\\z)"
    "|[!?][^>]*>|/?[a-z](?:=\\s*\"[^\"]*\"|=\\s*'[^']*'|[^>])*>)"
)
_PHRASE_END = "\\n|\\r|\\x{0B}|\\x{0C}|[\\x{1C}-\\x{1E}]|\\x{85}|\\x{2028}|\\x{2029}|[ ][ ]"


def page_text(html: str) -> str:
    plain = f"regexp_replace({html}, {q(_MARKUP)}, '', 'g')"
    for name, char in {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}.items():
        plain = f"regexp_replace({plain}, '&{name};?', {q(char)}, 'g')"
    spaces = " || ".join(f"chr({ord(c)})" for c in T.SPACE_CHARS)
    phrases = f"list_transform(regexp_split_to_array({plain}, {q(_PHRASE_END)}), lambda p: trim(p, {spaces}))"
    return f"array_to_string(list_filter({phrases}, lambda p: p <> ''), ' ')"


def bucket(word: str) -> str:
    return f"(('0x' || substr(md5({word}), 1, 8))::BIGINT % {DIMS})"


# Classification: "scored" holds item_id, grp, hint, ord, std_id, category, sim for all pairs


def classify(scored: str, exact: bool = False) -> str:
    """CTEs ending in ``best(grp, item_id, predicted_standard, confidence)``."""
    admits = "s.category = s.hint" if exact else "starts_with(s.category, s.hint)"
    return f"""
    scored AS ({scored}),
    cats AS (SELECT grp, item_id, category, round(avg(sim), 9) AS m, min(ord) AS o FROM scored GROUP BY ALL),
    inferred AS (SELECT grp, item_id, category FROM cats
        QUALIFY row_number() OVER (PARTITION BY grp, item_id ORDER BY m DESC, o) = 1),
    known AS (SELECT DISTINCT category FROM scored),
    candidates AS (
        SELECT s.* FROM scored s JOIN inferred i USING (grp, item_id)
        WHERE CASE WHEN s.hint IN (SELECT category FROM known) THEN {admits} ELSE s.category = i.category END),
    best AS (SELECT grp, item_id, std_id AS predicted_standard, round(sim, 9) AS confidence FROM candidates
        QUALIFY row_number() OVER (PARTITION BY grp, item_id ORDER BY round(sim, 9) DESC, ord) = 1)"""


def vector_tables(per_class: int, categories: int) -> str:
    return f"""
    items AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS vector, label * {per_class} + vec_id % {per_class} AS ord,
        'L' || label || '.' || (vec_id % {per_class}) % {categories} || '.' || vec_id % {per_class} AS standard
        FROM embeddings),
    hinted AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN array_to_string(string_split(standard, '.')[1:2], '.')
        WHEN item_id % 4 = 3 THEN standard END AS hint FROM items),
    parts AS (SELECT ord, standard, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM items),
    means AS (SELECT ord, standard, i, avg(x) AS x FROM parts GROUP BY ALL),
    labels_ AS (SELECT ord, standard AS std_id, array_to_string(string_split(standard, '.')[1:2], '.') AS category,
        list(x ORDER BY i) AS vector FROM means GROUP BY ALL)"""


VECTOR_SCORED = """SELECT h.item_id, 0 AS grp, h.hint, l.ord, l.std_id, l.category,
    list_cosine_similarity(h.vector, l.vector) AS sim FROM hinted h, labels_ l"""


def vector_predictions(per_class: int, categories: int, exact: bool = False) -> str:
    """CTEs ending in ``predictions``."""
    return f"""WITH {vector_tables(per_class, categories)}, {classify(VECTOR_SCORED, exact)},
    predictions AS (SELECT item_id, predicted_standard, standard AS true_standard, confidence, hint
        FROM best JOIN hinted USING (item_id))"""


DEFINITION_PREDICTIONS = """definition AS (
    SELECT h.item_id, h.standard AS true_standard, l.std_id AS predicted_standard,
        round(list_cosine_similarity(h.vector, l.vector), 9) AS confidence FROM hinted h, labels_ l
    QUALIFY row_number() OVER (PARTITION BY h.item_id ORDER BY confidence DESC, l.ord) = 1)"""

KNN_PREDICTIONS = """classes AS (SELECT item_id, vector, string_split(standard, '.')[1] AS standard FROM items),
    near AS (SELECT t.item_id, t.standard AS true_standard, r.standard AS label,
        round(list_cosine_similarity(t.vector, r.vector), 9) AS sim
        FROM classes t, classes r
        WHERE t.item_id NOT IN (SELECT doc_id FROM labels) AND r.item_id IN (SELECT doc_id FROM labels)
        QUALIFY row_number() OVER (PARTITION BY t.item_id ORDER BY sim DESC, r.item_id) <= 5),
    votes AS (SELECT item_id, true_standard, label, count(*) AS n, max(sim) AS sim FROM near GROUP BY ALL),
    knn AS (SELECT item_id, true_standard, label AS predicted_standard, sim AS confidence FROM votes
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, sim DESC, label) = 1)"""

PREDICTION_COLUMNS = "item_id, predicted_standard, true_standard, confidence"

SCORES = "count(*) AS total, sum(CASE WHEN predicted_standard = true_standard THEN 1 ELSE 0 END)::BIGINT AS correct"


def accuracy_of(source: str, by: str | None = None) -> str:
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}total, correct, round(correct / total, 6) AS accuracy,
        round(100.0 * correct / total, 6) AS percent,
        CASE WHEN correct / total > 0.60 THEN 'excellent' WHEN correct / total > 0.553 THEN 'improved' ELSE 'below' END
        AS verdict FROM (SELECT {head}{SCORES} FROM {source}{group})"""


def compared(source: str, baseline: str) -> str:
    return f"""SELECT approach, total, correct, round(correct / total, 6) AS accuracy,
        round(correct / total - (SELECT s.correct / s.total FROM scores s WHERE s.approach = '{baseline}'), 6) AS gain
        FROM scores"""


# Sparse text vectors


def text_scores(items: str, item_words: str, label_words: str) -> str:
    """CTEs ending in ``pairs(grp, item_id, ord, std_id, category, sim)`` over all pairs.

    ``items`` selects ``grp, item_id`` and the texts ``item_words`` reads.
    """
    return f"""
    texts AS ({items}),
    label_texts AS (SELECT item_id AS ord, 'B.' || item_id % 5 || '.' || item_id AS std_id, 'B.' || item_id % 5 AS category,
        'B.' || item_id % 5 || '.' || item_id || ': ' || text AS std_text FROM benchmark),
    item_terms AS (SELECT grp, item_id, {bucket('w')} AS b, count(*) AS n
        FROM (SELECT grp, item_id, unnest({item_words}) AS w FROM texts) GROUP BY ALL),
    label_terms AS (SELECT ord, {bucket('w')} AS b, count(*) AS n
        FROM (SELECT ord, unnest({label_words}) AS w FROM label_texts) GROUP BY ALL),
    dots AS (SELECT i.grp, i.item_id, l.ord, sum(i.n * l.n) AS dot FROM item_terms i JOIN label_terms l USING (b) GROUP BY ALL),
    item_norms AS (SELECT grp, item_id, sqrt(sum(n * n)) AS len FROM item_terms GROUP BY ALL),
    label_norms AS (SELECT ord, sqrt(sum(n * n)) AS len FROM label_terms GROUP BY ALL),
    pairs AS (SELECT t.grp, t.item_id, l.ord, l.std_id, l.category, coalesce(d.dot / (i.len * n.len), 0) AS sim
        FROM (SELECT grp, item_id FROM texts) t CROSS JOIN label_texts l
        LEFT JOIN dots d ON d.grp = t.grp AND d.item_id = t.item_id AND d.ord = l.ord
        LEFT JOIN item_norms i ON i.grp = t.grp AND i.item_id = t.item_id LEFT JOIN label_norms n ON n.ord = l.ord)"""


META = "lang || ' ' || source"
VARIANT_ITEMS = f"""SELECT 'metadata' AS grp, doc_id AS item_id, {META} AS t FROM documents
    UNION ALL SELECT 'raw_pages', doc_id, {META} || ' ' || text FROM documents
    UNION ALL SELECT 'cleaned_pages', doc_id, {META} || ' ' || {clean_text('text')} FROM documents"""
VARIANTS = f"""WITH {text_scores(VARIANT_ITEMS, raw_words('t'), raw_words('std_text'))},
    {classify("SELECT *, NULL::VARCHAR AS hint FROM pairs")}"""

CONTAINED = """
    passages AS (SELECT item_id AS ord, 'B.' || item_id % 5 || '.' || item_id AS std_id, list_distinct(list_filter(
        list_transform(string_split(text, '.'), lambda s: trim(s, ' ' || chr(10) || chr(13) || chr(9))),
        lambda s: s <> '')) AS sentences FROM benchmark),
    wanted AS (SELECT ord, std_id, len(sentences) AS n_all, unnest(sentences) AS sentence FROM passages),
    said AS (SELECT DISTINCT doc_id AS item_id, trim(s, ' ' || chr(10) || chr(13) || chr(9)) AS sentence
        FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents)),
    truth AS (SELECT item_id, arg_min(std_id, ord) AS true_standard FROM (
        SELECT item_id, ord, std_id, n_all, count(*) AS n FROM said JOIN wanted USING (sentence) GROUP BY ALL)
        WHERE n = n_all GROUP BY item_id)"""

# Catalogue

_CATEGORY = "'R' || r_regionkey || '.N' || n_nationkey"
CATALOGUE = f"""WITH joined AS (
    SELECT customer.*, nation.*, region.*, c_custkey // {VOLUME} AS volume, {_CATEGORY} AS category_standard,
        {_CATEGORY} || '.' || c_mktsegment AS own,
        CASE WHEN c_acctbal < 0 THEN 'exercise' WHEN c_acctbal < 5000 THEN 'section' ELSE 'chapter' END AS item_type,
        CASE WHEN c_acctbal >= 0 THEN 'Balance ' || c_acctbal::DECIMAL(12, 2)::VARCHAR ELSE '' END AS text,
        c_mktsegment || ' ' || n_name AS title,
        c_custkey // 10 || ',' || c_custkey % 10 AS numbers,
        CASE WHEN c_acctbal >= 0 THEN coalesce(p.url, '') ELSE '' END AS url
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN pages p ON p.page_id = c_custkey % (SELECT count(*) FROM pages)),
  flat AS (
    SELECT row_number() OVER (ORDER BY volume, r_regionkey, n_nationkey, c_mktsegment, c_custkey) - 1 AS item_id,
        row_number() OVER (PARTITION BY volume ORDER BY r_regionkey, n_nationkey, c_mktsegment, c_custkey) - 1 AS own_id,
        volume, r_name AS book_title, n_name AS concept, r_name AS domain, category_standard,
        c_mktsegment AS cluster_description, item_type, c_name AS description, text, title, numbers, url,
        array_to_string(list_filter([c_name, text, title], lambda t: t <> ''), ' ') AS profile_text,
        array_to_string(list_filter([c_name, text, title, c_mktsegment, n_name, r_name], lambda t: t <> ''), ' ')
            AS combined_text,
        CASE WHEN c_acctbal >= 0 THEN own END AS standard,
        CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal > 9000 THEN own || ',' || category_standard ELSE own END
            AS all_standards,
        CASE WHEN c_acctbal >= 0 THEN category_standard END AS category,
        CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 2 ELSE 1 END::BIGINT AS n_labels
    FROM joined)"""
FLAT_COLUMNS = """item_id, book_title, concept, domain, category_standard, cluster_description, item_type, description,
    text, title, numbers, url, combined_text, standard, all_standards, category"""

PAGE_JOIN = f"""{CATALOGUE},
    page_rows AS (SELECT url, html FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
    read_pages AS (SELECT url, {page_text('html')} AS url_content FROM page_rows),
    enriched AS (SELECT f.*, coalesce(r.url_content, '') AS url_content FROM flat f LEFT JOIN read_pages r USING (url)),
    cleaned AS (SELECT *, {clean_text('url_content')} AS cleaned_url_content FROM enriched)"""

DOCUMENT_LABELS = """WITH side AS (SELECT source || '.' || lang AS standard,
    doc_id IN (SELECT doc_id FROM labels) AS train FROM documents)"""
OVERLAP = "SELECT standard FROM side WHERE train INTERSECT SELECT standard FROM side WHERE NOT train"


def frequency(column: str, limit: str = "") -> str:
    return f"""{CATALOGUE} SELECT {column}, count(*) AS n FROM flat WHERE {column} IS NOT NULL GROUP BY {column}
        ORDER BY n DESC, {column} {limit}"""


def _share(part: str, whole: str) -> str:
    return f"{part} || ' / ' || {whole} || ' (' || printf('%.0f', 100.0 * {part} / {whole}) || '%)'"


ALIGNMENT = f"""{PAGE_JOIN},
    texts AS (SELECT item_id, standard, category_standard AS hint,
        combined_text || ' ' || cleaned_url_content AS t FROM cleaned),
    dictionary AS (SELECT own AS std_id, category_standard AS category,
        own || ': ' || c_mktsegment || ' customers of ' || n_name AS std_text,
        min((volume, r_regionkey, n_nationkey, c_mktsegment)) AS seen FROM joined GROUP BY ALL),
    label_texts AS (SELECT *, row_number() OVER (ORDER BY seen) AS ord FROM dictionary),
    item_terms AS (SELECT item_id, {bucket('w')} AS b, count(*) AS n
        FROM (SELECT item_id, unnest({raw_words('t')}) AS w FROM texts) GROUP BY ALL),
    label_terms AS (SELECT ord, {bucket('w')} AS b, count(*) AS n
        FROM (SELECT ord, unnest({raw_words('std_text')}) AS w FROM label_texts) GROUP BY ALL),
    dots AS (SELECT item_id, ord, sum(i.n * l.n) AS dot FROM item_terms i JOIN label_terms l USING (b) GROUP BY ALL),
    item_norms AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM item_terms GROUP BY ALL),
    label_norms AS (SELECT ord, sqrt(sum(n * n)) AS len FROM label_terms GROUP BY ALL),
    {classify('''SELECT 0 AS grp, t.item_id, t.hint, l.ord, l.std_id, l.category,
        coalesce(d.dot / (i.len * n.len), 0) AS sim
        FROM texts t CROSS JOIN label_texts l LEFT JOIN dots d ON d.item_id = t.item_id AND d.ord = l.ord
        LEFT JOIN item_norms i ON i.item_id = t.item_id LEFT JOIN label_norms n ON n.ord = l.ord''')}
    SELECT item_id, predicted_standard, standard AS true_standard, confidence
    FROM best JOIN texts USING (item_id)"""


def build() -> dict[str, str]:
    zero_shot = vector_predictions(6, 3)
    host = "regexp_extract(url, '//([^/:?#]+)', 1)"
    host_category = f"array_to_string(string_split({host}, '.')[1:2], '.')"
    oracles = {
        "zero_shot_vectors": f"{zero_shot} SELECT {PREDICTION_COLUMNS} FROM predictions",
        "zero_shot_prefix_bleed": f"{vector_predictions(24, 12)} SELECT {PREDICTION_COLUMNS} FROM predictions",
        "zero_shot_exact_hint": f"{vector_predictions(24, 12, True)} SELECT {PREDICTION_COLUMNS} FROM predictions",
        "definition_match": f"""WITH {vector_tables(6, 3)}, {DEFINITION_PREDICTIONS}
            SELECT {PREDICTION_COLUMNS} FROM definition""",
        "knn_transfer": f"""WITH {vector_tables(6, 3)}, {KNN_PREDICTIONS} SELECT {PREDICTION_COLUMNS} FROM knn""",
        "knn_transfer_indexed": f"""WITH {vector_tables(6, 3)}, {KNN_PREDICTIONS} SELECT {PREDICTION_COLUMNS} FROM knn""",
        "compare_approaches": f"""{zero_shot}, {DEFINITION_PREDICTIONS}, {KNN_PREDICTIONS},
            tagged AS (SELECT 'k-NN' AS approach, true_standard, predicted_standard FROM knn
                UNION ALL SELECT 'definition', true_standard, predicted_standard FROM definition
                UNION ALL SELECT 'hierarchical', true_standard, predicted_standard FROM predictions),
            scores AS (SELECT approach, {SCORES} FROM tagged GROUP BY approach)
            {compared('scores', 'definition')}""",
        "text_term_vectors": f"""SELECT doc_id, {bucket('w')}::INTEGER AS bucket, count(*) AS n
            FROM (SELECT doc_id, unnest({clean_words('text', None)}) AS w FROM documents) GROUP BY ALL""",
        "text_label_match": f"""WITH {text_scores(
            "SELECT 0 AS grp, doc_id AS item_id, text AS t FROM documents",
            clean_words('t', None), clean_words('std_text', None))}
            SELECT item_id, std_id AS predicted_standard, round(sim, 9) AS confidence FROM pairs
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, ord) = 1""",
        "text_label_match_sparse": f"""WITH {text_scores(
            "SELECT 0 AS grp, doc_id AS item_id, text AS t FROM documents",
            clean_words('t', None), clean_words('std_text', None))}
            SELECT item_id, std_id AS predicted_standard, round(sim, 9) AS confidence FROM pairs
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, ord) = 1""",
        "text_variant_predictions": f"""{VARIANTS}
            SELECT grp AS approach, item_id, predicted_standard, confidence FROM best""",
        "compare_text_variants": f"""{VARIANTS}, {CONTAINED},
            scores AS (SELECT grp AS approach, {SCORES} FROM best JOIN truth USING (item_id) GROUP BY grp)
            {compared('scores', 'metadata')}""",
        "encode_hook": f"""SELECT std_id, {bucket('w')}::INTEGER AS bucket, count(*) AS n FROM (
            SELECT std_id, unnest(list_filter(regexp_split_to_array(std_id || ': ' || text, '\\s+'), lambda w: w <> ''))
            AS w FROM (SELECT 'B.' || item_id % 5 || '.' || item_id AS std_id, text FROM benchmark)) GROUP BY ALL""",
        "accuracy": f"{zero_shot} {accuracy_of('predictions')}",
        "accuracy_by_hint": f"""{zero_shot}, marked AS (SELECT *, CASE WHEN len(string_split(hint, '.')) = 2 THEN 'hinted'
            ELSE 'inferred' END AS basis FROM predictions) {accuracy_of('marked', 'basis')}""",
        "per_label_accuracy": f"""{zero_shot} SELECT standard, correct, total, round(correct / total, 6) AS accuracy
            FROM (SELECT true_standard AS standard, {SCORES} FROM predictions WHERE true_standard IS NOT NULL GROUP BY 1)
            ORDER BY total DESC, standard""",
        "performance_tiers": f"""{zero_shot} SELECT standard, correct, total, round(100 * correct / total, 6) AS accuracy,
            CASE WHEN correct = total THEN {q(PERFECT)} WHEN correct / total >= 0.5 THEN {q(GOOD)} ELSE {q(FAILED)} END
            AS tier FROM (SELECT true_standard AS standard, {SCORES} FROM predictions
            WHERE true_standard IS NOT NULL GROUP BY 1) ORDER BY accuracy, standard""",
        "tier_counts": f"""{zero_shot} SELECT count(*) AS labels, count_if(correct = total)::BIGINT AS perfect,
            count_if(correct / total >= 0.5)::BIGINT AS good
            FROM (SELECT true_standard, {SCORES} FROM predictions GROUP BY 1)""",
        "top_labels": f"""WITH {vector_tables(6, 3)} SELECT standard, count(*) AS n FROM items GROUP BY standard
            ORDER BY n DESC, standard LIMIT 6""",
        "confusion_topk": f"""{zero_shot}, classes AS (SELECT string_split(true_standard, '.')[1] AS t,
            string_split(predicted_standard, '.')[1] AS p FROM predictions),
            top AS (SELECT t FROM classes GROUP BY t ORDER BY count(*) DESC, t LIMIT 6)
            SELECT a.t AS true_standard, b.t AS predicted_standard, count(c.t) AS n FROM top a CROSS JOIN top b
            LEFT JOIN classes c ON c.t = a.t AND c.p = b.t GROUP BY ALL""",
        "category_confusion": f"""{zero_shot}, pairs AS (
            SELECT array_to_string(string_split(true_standard, '.')[1:2], '.') AS true_category,
            array_to_string(string_split(predicted_standard, '.')[1:2], '.') AS predicted_category FROM predictions)
            SELECT *, count(*) AS n, true_category <> predicted_category AS crossed FROM pairs GROUP BY ALL""",
        "label_overlap": f"{DOCUMENT_LABELS} {OVERLAP}",
        "label_counts": f"""{DOCUMENT_LABELS} SELECT
            (SELECT count(DISTINCT standard) FROM side WHERE train) AS train_labels,
            (SELECT count(DISTINCT standard) FROM side WHERE NOT train) AS test_labels,
            (SELECT count(*) FROM ({OVERLAP})) AS overlap""",
        "summary_table": f"""{zero_shot}, side AS (SELECT source || '.' || lang AS standard,
            doc_id IN (SELECT doc_id FROM labels) AS train FROM documents),
            totals AS (SELECT sum(total)::BIGINT AS total, sum(correct)::BIGINT AS correct, count(*) AS labels,
                count_if(correct = total)::BIGINT AS perfect, count_if(correct / total >= 0.5)::BIGINT AS good
                FROM (SELECT true_standard, {SCORES} FROM predictions GROUP BY 1))
            SELECT 'Total Test Items' AS metric, total::VARCHAR AS value FROM totals
            UNION ALL SELECT 'Correct Predictions', correct::VARCHAR FROM totals
            UNION ALL SELECT 'Overall Accuracy', printf('%.1f%%', 100.0 * correct / total) FROM totals
            UNION ALL SELECT 'Standards at 100%', {_share('perfect', 'labels')} FROM totals
            UNION ALL SELECT 'Standards at 50%+', {_share('good', 'labels')} FROM totals
            UNION ALL SELECT 'Embedding Dimension', '64 dimensions'
            UNION ALL SELECT 'Training/Test Overlap', count(*) || ' standards' FROM ({OVERLAP})
            UNION ALL SELECT 'Text Length (avg)', printf('%.0f characters', avg(length({clean_text('text')})))
                FROM documents""",
        "category_labels": f"""SELECT page_id, {host} AS std_id, {host_category} AS category,
            {host} || ': ' || url AS std_text,
            coalesce(nullif(regexp_extract(url, '#(.*)', 1), ''), {host_category}) AS hint FROM pages""",
        "clean_documents": f"SELECT doc_id, {clean_text('text')} AS cleaned FROM documents",
        "clean_documents_whole": f"SELECT doc_id, {clean_text('text', None)} AS cleaned FROM documents",
        "word_lists": f"""SELECT doc_id, len({raw_words('text')}) AS words, len({clean_words('text', None)}) AS meaningful,
            length(text) AS chars, substr(text, 1, 200) AS start FROM documents""",
        "page_texts": f"SELECT page_id, {page_text('html')} AS url_content FROM pages",
        "flatten_catalogue": f"{CATALOGUE} SELECT {FLAT_COLUMNS} FROM flat",
        "flatten_profile_form": f"""{CATALOGUE} SELECT volume, own_id AS item_id, book_title, concept, domain,
            cluster_description, item_type, description, text, title, numbers, url, profile_text AS combined_text
            FROM flat""",
        "label_flatten": f"{CATALOGUE} SELECT item_id, standard FROM flat WHERE standard IS NOT NULL",
        "label_relation": f"""{CATALOGUE}, defined AS (SELECT DISTINCT volume, r_regionkey, n_nationkey, c_mktsegment,
            own AS std_id, category_standard AS category, c_mktsegment || ' customers of ' || n_name AS definition FROM joined)
            SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY r_regionkey, n_nationkey, c_mktsegment) - 1
            AS ord, std_id, definition, std_id || ': ' || definition AS std_text, category FROM defined""",
        "enriched_items": f"""{PAGE_JOIN} SELECT item_id, url_content, combined_text || ' ' || url_content AS enhanced_text,
            cleaned_url_content, combined_text || ' ' || cleaned_url_content AS enhanced_text_cleaned FROM cleaned""",
        "enriched_first_items": f"""{PAGE_JOIN}, chosen AS (SELECT item_id FROM flat WHERE url <> '' ORDER BY item_id LIMIT 100)
            SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM chosen) THEN url_content ELSE '' END AS url_content
            FROM enriched""",
        "wanted_page_texts": f"""{PAGE_JOIN} SELECT url, url_content, {clean_text('url_content')} AS cleaned_url_content
            FROM read_pages WHERE url IN (SELECT url FROM flat WHERE url <> '')""",
        "item_alignment": ALIGNMENT,
        "profile_items": f"""{CATALOGUE} SELECT count(*) AS items, count_if(url <> '')::BIGINT AS with_url,
            round(100.0 * count_if(url <> '') / count(*), 6) AS url_percent,
            count_if(combined_text <> '')::BIGINT AS with_text, count_if(standard IS NULL)::BIGINT AS without_label
            FROM flat""",
        "dictionary_size": f"{CATALOGUE} SELECT count(DISTINCT own) AS labels FROM joined",
        "type_frequency": frequency("item_type"),
        "book_frequency": frequency("book_title"),
        "top10_labels": frequency("standard", "LIMIT 10"),
        "labels_histogram": f"{CATALOGUE} SELECT n_labels::INTEGER AS n_labels, count(*) AS n FROM flat GROUP BY n_labels",
        "labels_per_item_counts": f"{CATALOGUE} SELECT item_id, n_labels FROM flat",
        "missing_labels": f"{CATALOGUE} SELECT count_if(standard IS NULL)::BIGINT AS without_label FROM flat",
        "sample_rows": f"""{CATALOGUE} SELECT item_id, item_type, combined_text, standard FROM flat
            ORDER BY item_id LIMIT 5""",
        "row_at": f"""WITH texts AS (SELECT doc_id AS item_id, {META} || ' ' || text AS a,
            {META} || ' ' || {clean_text('text')} AS b FROM documents WHERE doc_id = 12)
            SELECT item_id, length(a) AS enhanced_text_chars, substr(a, 1, 200) AS enhanced_text_preview,
            length(b) AS enhanced_text_cleaned_chars, substr(b, 1, 200) AS enhanced_text_cleaned_preview FROM texts""",
        "length_reduction": f"""WITH means AS (SELECT avg(length({META} || ' ' || text)) AS a,
            avg(length({META} || ' ' || {clean_text('text')})) AS b FROM documents)
            SELECT round(a, 6) AS mean_before, round(b, 6) AS mean_after, round((1 - b / a) * 100, 6) AS reduction_percent
            FROM means""",
        "items_roundtrip": f"""{CATALOGUE} SELECT * REPLACE (nullif(text, '') AS text, nullif(url, '') AS url,
            nullif(all_standards, '') AS all_standards) FROM (SELECT {FLAT_COLUMNS} FROM flat)""",
        "labels_roundtrip": """SELECT item_id AS ord, 'B.' || item_id % 5 || '.' || item_id AS std_id, text AS definition
            FROM benchmark""",
        "submission_roundtrip": f"{zero_shot} SELECT item_id, predicted_standard FROM predictions",
    }
    return oracles
