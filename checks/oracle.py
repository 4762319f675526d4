"""SQL for DuckDB that gives the rows of each registered query, written apart from the Spark code."""

from __future__ import annotations

from mailsift.functions.stopwords import ENGLISH

# Fixed values, written out here so that the check does not take them from the code it checks: repairs in their order, numbers.
MOJIBAKE = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ãª", "ê"),
    ("Ã«", "ë"),
    ("Ã", "à"),
    ("Ã¢", "â"),
    ("Ã§", "ç"),
    ("Ã®", "î"),
    ("Ã¯", "ï"),
    ("Ã´", "ô"),
    ("Ã»", "û"),
    ("Ã¹", "ù"),
    ("Ã¶", "ö"),
    ("Ã¼", "ü"),
    ("Â©", "©"),
    ("Â®", "®"),
    ("Â£", "£"),
    ("Â", ""),
]
TABULAR = [
    "subject_capitalized_percentage",
    "body_capitalized_percentage",
    "body_word_count",
    "subject_word_count",
    "is_weekend",
    "is_night",
    "is_known_domain",
    "is_known_fortune_domain",
    "total_char_count",
    "symbol_count",
    "symbol_ratio",
    "repeating_symbol_count",
]

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
SYM = r"[^\p{L}\p{N}_" + WS + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def removed(x: str, pattern: str) -> str:
    """Number of characters of a class."""
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


def cleaned(x: str, entities: bool = False) -> str:
    """The cleaning chain for text that NFKC leaves alone."""
    step = x
    if entities:
        for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
            step = f"replace({step}, '{name}', '{char}')"
    step = f"regexp_replace({step}, '\\\\[nrt]', ' ', 'g')"
    step = f"translate({step}, chr(10) || chr(13) || chr(9), '   ')"
    step = f"regexp_replace({step}, '\\\\([\"''])', '\\1', 'g')"
    for bad, good in MOJIBAKE:
        step = f"replace({step}, {quoted(bad)}, {quoted(good)})"
    step = f"regexp_replace({step}, '{SYM}{{4,}}', ' [SYMBOL_NOISE] ', 'g')"
    step = f"lower({strip(f'''regexp_replace({step}, '[{WS}]+', ' ', 'g')''')})"
    step = f"replace({step}, '[symbol_noise]', '[SYMBOL_NOISE]')"
    return f"CASE WHEN {x} IN ('', 'NaN') THEN NULL ELSE nullif({step}, '') END"


BROKEN = "replace(replace(replace(text, '''', 'â€™'), 'é', 'Ã©'), 'ç', 'Ã§')"

EMAILS = r"""
base AS (
  SELECT d.doc_id AS email_id, d.text, d.source, regexp_extract(p.url, 'https?://([^/]+)', 1) AS host, e.ts,
         l.toxic AS label, strpos(d.text, chr(10)) AS line_end
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT max(page_id) + 1 FROM pages)
  LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
),
emails AS (
  SELECT email_id, label, ts,
    CASE WHEN email_id % 11 = 0 THEN source || ' < >' WHEN host IS NULL THEN ''
         WHEN email_id % 5 = 0 THEN source || '@' || host ELSE source || ' <' || source || '@' || host || '>' END AS sender,
    CASE WHEN email_id % 11 = 0 THEN NULL ELSE host END AS domain,
    CASE WHEN line_end > 0 THEN substr(text, 1, line_end - 1) ELSE text END AS subject,
    CASE WHEN line_end > 0 THEN substr(text, line_end + 1) ELSE '' END AS body
  FROM base
)"""

DEDUP = """
kept AS (
  SELECT * FROM emails QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY email_id) = 1
)"""


def stats(source: str) -> str:
    """Text statistics of `source`, with the runs of repeated symbols by gaps and islands."""
    return f"""
raw AS (
  SELECT *, {strip("(CASE WHEN subject = 'NaN' THEN '' ELSE subject END) || ' ' || "
                   "(CASE WHEN body = 'NaN' THEN '' ELSE body END)")} AS raw_text
  FROM {source}
),
counted AS (
  SELECT *, length(raw_text) AS total_chars, {removed('raw_text', SYM)} AS symbols,
    coalesce({removed('subject', r'\p{Lu}')} / nullif(length(subject), 0), 0) AS subject_caps,
    coalesce({removed('body', r'\p{Lu}')} / nullif(length(body), 0), 0) AS body_caps,
    len(regexp_extract_all(subject, '[^{WS}]+')) AS subject_words,
    len(regexp_extract_all(body, '[^{WS}]+')) AS body_words
  FROM raw
),
chars AS (
  SELECT email_id, unnest(string_split(raw_text, '')) AS c, generate_subscripts(string_split(raw_text, ''), 1) AS i
  FROM raw
),
islands AS (
  SELECT email_id, c, i - row_number() OVER (PARTITION BY email_id, c ORDER BY i) AS island
  FROM chars WHERE regexp_full_match(c, '{SYM}')
),
runs AS (
  SELECT email_id, count(*) AS n_runs
  FROM (SELECT email_id FROM islands GROUP BY email_id, c, island HAVING count(*) >= 3) GROUP BY email_id
)"""


INSTANT = """CASE email_id % 4 WHEN 2 THEN date_trunc('second', ts) + INTERVAL 7 HOUR WHEN 3 THEN NULL
             ELSE date_trunc('second', ts) END"""
TOP = "SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS h FROM pages WHERE suffix(regexp_extract(url, 'https?://([^/]+)', 1), '{}')"

CLEAN = f"""{EMAILS}, {DEDUP}, {stats('kept')},
clean AS (
  SELECT c.email_id, c.label,
    {cleaned('c.subject')} AS subject_clean, {cleaned('c.body')} AS body_clean,
    c.subject_caps AS subject_capitalized_percentage, c.body_caps AS body_capitalized_percentage,
    c.body_words AS body_word_count, c.subject_words AS subject_word_count,
    regexp_extract(c.domain, '[^.]*$') AS sender_tld,
    CAST(coalesce(dayofweek({INSTANT}) IN (0, 6), false) AS BIGINT) AS is_weekend,
    CAST(coalesce(hour({INSTANT}) < 5, false) AS BIGINT) AS is_night,
    CAST(coalesce(c.domain IN ({TOP.format('.com')}), false) AS BIGINT) AS is_known_domain,
    CAST(coalesce(c.domain IN ({TOP.format('.org')}), false) AS BIGINT) AS is_known_fortune_domain,
    c.total_chars AS total_char_count, c.symbols AS symbol_count,
    coalesce(c.symbols / nullif(c.total_chars, 0), 0) AS symbol_ratio,
    coalesce(r.n_runs, 0) AS repeating_symbol_count,
    nullif({strip("coalesce(" + cleaned('c.subject') + ", '') || ' ' || coalesce(" + cleaned('c.body') + ", '')")}, '')
      AS email_text_clean
  FROM counted c LEFT JOIN runs r USING (email_id)
)"""

STOP = ", ".join(quoted(w) for w in ENGLISH)
TOKENS = f"""
tokens AS MATERIALIZED (
  SELECT email_id, label,
    [t for t in regexp_extract_all(lower(coalesce(email_text_clean, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') if t NOT IN ({STOP})] AS words
  FROM clean
)"""


def grams(source: str, low: int, high: int, name: str = "grams") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT email_id, unnest([array_to_string(list_slice(words, i, i + {n - 1}), ' ')
            for i in range(1, len(words) - {n - 2})]) AS term FROM {source}"""
        for n in range(low, high + 1)
    )
    return f"{name} AS MATERIALIZED ({parts})"


def tfidf(fit: str, apply: str) -> str:
    """Vocabulary and idf of `fit`, weights of `apply`; both are relations with email_id and words."""
    return f"""
{grams(fit, 1, 3, 'fit_grams')}, {grams(apply, 1, 3, 'use_grams')},
vocabulary AS (SELECT term, count(*) AS term_count FROM fit_grams GROUP BY term ORDER BY term_count DESC, term LIMIT 1000),
idf AS (
  SELECT term, count(DISTINCT email_id) AS doc_freq,
         ln((1 + (SELECT count(*) FROM {fit})) / (1 + count(DISTINCT email_id))) + 1 AS idf
  FROM fit_grams JOIN vocabulary USING (term) GROUP BY term
),
tf AS (SELECT email_id, term, count(*) AS tf FROM use_grams JOIN vocabulary USING (term) GROUP BY ALL),
weights AS (
  SELECT email_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY email_id)) AS weight
  FROM tf JOIN idf USING (term)
)"""


LABELLED = """
labelled AS (
  SELECT d.doc_id AS email_id, CAST(l.toxic AS BIGINT) AS label, (d.n_chars % 1000) / 1000.0 AS prob
  FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL
)"""


def split(source: str, name: str = "split_rows") -> str:
    """is_test by rank in md5 order: ceil(n / 5) rows, shared out by largest remainder."""
    return f"""
class_size AS (
  SELECT label, n, floor(exact) AS whole, exact - floor(exact) AS rest, wanted FROM (
    SELECT label, count(*) AS n, ceil(sum(count(*)) OVER () * 2 / 10) AS wanted,
           count(*) * ceil(sum(count(*)) OVER () * 2 / 10) / sum(count(*)) OVER () AS exact
    FROM {source} GROUP BY label)
),
test_size AS (
  SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= wanted - sum(whole) OVER ()
                             THEN 1 ELSE 0 END AS n_test FROM class_size
),
{name} AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.label ORDER BY md5(email_id || '#42')) <= n_test AS is_test
  FROM {source} s JOIN test_size USING (label)
)"""


def dealt_folds(source: str, row_id: str) -> str:
    """Five folds of a relation with a label, which are dealt class by class and filled by rank in md5 order."""
    return f"""
    sizes AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS start
              FROM (SELECT label, count(*) AS n FROM {source} GROUP BY label)),
    dealt AS (SELECT label, (start + j) % 5 AS fold, count(*) AS k
              FROM (SELECT label, start, unnest(range(n)) AS j FROM sizes) GROUP BY ALL),
    bounds AS (SELECT label, fold, sum(k) OVER (PARTITION BY label ORDER BY fold) AS last,
                      sum(k) OVER (PARTITION BY label ORDER BY fold) - k AS before FROM dealt),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5({row_id} || '#42')) AS rn FROM {source}),
    folded AS (SELECT r.*, fold FROM ranked r JOIN bounds b ON b.label = r.label AND rn > before AND rn <= last)"""


def report(source: str) -> str:
    """Classification report of a relation with label and pred."""
    return f"""
per_class AS (
  SELECT CASE c WHEN 0 THEN 'Legitimate' ELSE 'Spam' END AS class,
    (SELECT count(*) FROM {source} WHERE label = c) AS support,
    (SELECT count(*) FROM {source} WHERE pred = c) AS hits,
    (SELECT count(*) FROM {source} WHERE label = c AND pred = c) AS tp
  FROM (SELECT DISTINCT label AS c FROM {source} UNION SELECT DISTINCT pred FROM {source})
),
measured AS (
  SELECT class, coalesce(tp / nullif(hits, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(hits + support, 0), 0) AS f1, support, tp FROM per_class
),
lines AS (
  SELECT class, precision, recall, f1, support FROM measured
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM measured
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM measured
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM measured
)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM lines"""


COUNTS = """count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
  count(*) FILTER (label = 1 AND prob < 0.5) AS fn, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp"""
MEASURES = """tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr"""
CLUSTERED = """
points AS (
  SELECT vec_id, embedding, CAST(label >= 5 AS BIGINT) AS label, CAST(embedding[1] > 0 AS BIGINT) AS cluster FROM embeddings
)"""
ROUNDED_TABULAR = ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c.endswith(("percentage", "ratio")) else f"CAST({c} AS BIGINT) AS {c}"
    for c in TABULAR
)
SCALED = ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () < 1e-12 THEN {c} - avg({c}) OVER () "
    f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END AS {c}"
    for c in TABULAR
)
EMBEDDED = """
hashed AS (
  SELECT email_id, ('0x' || substr(md5(word), 1, 4))::BIGINT % 64 AS dim,
         CASE WHEN ('0x' || substr(md5(word), 5, 1))::BIGINT < 8 THEN 1 ELSE -1 END AS sign
  FROM (SELECT email_id, unnest(regexp_extract_all(lower(coalesce(email_text_clean, '')), '[\\p{L}\\p{N}_]{2,}')) AS word FROM clean)
),
sums AS (SELECT email_id, dim, sum(sign) AS total FROM hashed GROUP BY ALL),
lengths AS (SELECT email_id, sqrt(sum(total * total)) AS len FROM sums GROUP BY email_id),
embedded AS (
  SELECT c.email_id, r.dim, CAST(CAST(coalesce(s.total / nullif(l.len, 0), 0) AS FLOAT) AS DOUBLE) AS value
  FROM clean c CROSS JOIN (SELECT unnest(range(64)) AS dim) r
  LEFT JOIN sums s ON s.email_id = c.email_id AND s.dim = r.dim LEFT JOIN lengths l ON l.email_id = c.email_id
)"""
TRIAGE_ROWS = "(VALUES ('Inbox', 1), ('Quarantine', 2), ('Spam', 3)) AS t(triage, k)"

ORACLE: dict[str, str] = {
    "dedup_keep_first": f"""WITH {EMAILS}, {DEDUP}
        SELECT email_id, CAST(length(subject) AS BIGINT) AS subject_chars, md5(body) AS body_md5,
               CAST(label AS BIGINT) AS label FROM kept""",
    "dedup_count": f"""WITH {EMAILS} SELECT count(*) AS total_rows, count(DISTINCT (subject, body)) AS kept_rows,
        count(*) - count(DISTINCT (subject, body)) AS dropped_rows FROM emails""",
    "sender_parts": f"""WITH {EMAILS}, s AS (
        SELECT email_id, CASE WHEN email_id % 11 = 0 THEN NULL ELSE nullif(sender, '') END AS sender_clean FROM emails),
        m AS (SELECT *, CASE WHEN contains(sender_clean, '<') THEN regexp_extract(sender_clean, '<([^<>]+)>', 1)
                             ELSE sender_clean END AS sender_email FROM s)
        SELECT *, CASE WHEN contains(sender_email, '@') THEN split_part(sender_email, '@', 2) END AS sender_domain,
          CASE WHEN contains(sender_email, '@') THEN regexp_extract(split_part(sender_email, '@', 2), '[^.]*$') END
            AS sender_tld FROM m""",
    "text_stats": f"""WITH {EMAILS}, {stats('emails')}
        SELECT email_id, round(subject_caps, 6) AS subject_capitalized_percentage,
          round(body_caps, 6) AS body_capitalized_percentage, CAST(body_words AS BIGINT) AS body_word_count,
          CAST(subject_words AS BIGINT) AS subject_word_count, CAST(total_chars AS BIGINT) AS total_char_count,
          CAST(symbols AS BIGINT) AS symbol_count,
          round(coalesce(symbols / nullif(total_chars, 0), 0), 6) AS symbol_ratio FROM counted""",
    "repeat_symbols": f"""WITH {EMAILS}, {stats('emails')}
        SELECT email_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS repeating_symbol_count
        FROM emails LEFT JOIN runs USING (email_id)""",
    "date_features": f"""WITH {EMAILS}, d AS (SELECT email_id, {INSTANT} AS utc FROM emails)
        SELECT email_id, CAST(epoch(utc) AS BIGINT) AS unix_seconds, dayname(utc) AS day_of_week,
          CAST(coalesce(dayofweek(utc) IN (0, 6), false) AS BIGINT) AS is_weekend,
          CAST(coalesce(hour(utc) < 5, false) AS BIGINT) AS is_night FROM d""",
    "clean_text": f"""WITH {EMAILS}, c AS (
        SELECT email_id, {cleaned('subject')} AS subject_clean, {cleaned('body')} AS body_clean FROM emails)
        SELECT *, nullif({strip("coalesce(subject_clean, '') || ' ' || coalesce(body_clean, '')")}, '') AS email_text_clean
        FROM c""",
    "clean_html_text": f"SELECT page_id, {cleaned('html', entities=True)} AS html_clean FROM pages",
    # ligatures are not put in here: NFKC takes them out again
    "clean_broken_text": f"SELECT doc_id, {cleaned(BROKEN)} AS text_clean FROM documents",
    "known_domain_flags": f"""WITH {EMAILS} SELECT email_id,
        CAST(coalesce(domain IN ({TOP.format('.com')}), false) AS BIGINT) AS is_known_domain,
        CAST(coalesce(domain IN ({TOP.format('.org')}), false) AS BIGINT) AS is_known_fortune_domain FROM emails""",
    "clean_emails": f"""WITH {CLEAN}
        SELECT email_id, coalesce(subject_clean, 'NaN') AS subject_clean, coalesce(body_clean, 'NaN') AS body_clean,
          {ROUNDED_TABULAR}, coalesce(sender_tld, 'NaN') AS sender_tld,
          coalesce(email_text_clean, 'NaN') AS email_text_clean, 'NaN' AS urls, CAST(label AS BIGINT) AS label FROM clean""",
    "domain_flag_summary": f"""WITH {CLEAN} SELECT is_known_domain, CAST(label AS BIGINT) AS label, count(*) AS n_emails,
        round(avg(symbol_ratio), 6) AS avg_symbol_ratio FROM clean GROUP BY ALL""",
    "sentinel_roundtrip": f"""WITH {EMAILS} SELECT email_id, CASE sender WHEN '' THEN 'NaN' ELSE sender END AS sender_out,
        CASE WHEN body IN ('', 'NaN') THEN 'NaN' ELSE md5(body) END AS body_out, sender AS sender_back,
        CASE WHEN body IN ('', 'NaN') THEN NULL ELSE md5(body) END AS body_back FROM emails""",
    "feature_coerce": """SELECT event_id, 0.0::DOUBLE AS from_json,
        coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS from_piece, round(value, 6) AS from_value,
        0.0::DOUBLE AS from_type FROM events""",
    "optional_columns": f"""WITH {EMAILS} SELECT email_id, sender, strftime(ts, '%a, %d %b %Y %H:%M:%S') ||
        CASE email_id % 4 WHEN 0 THEN ' +0000' WHEN 1 THEN ' +0000 (UTC)' WHEN 2 THEN ' -0700' ELSE ' GMT' END AS date,
        'NaN' AS urls, CAST(label AS BIGINT) AS label FROM emails""",
    "csv_roundtrip": f"""WITH {CLEAN} SELECT email_id, coalesce(email_text_clean, 'NaN') AS email_text_clean,
        coalesce(sender_tld, 'NaN') AS sender_tld, CAST(label AS BIGINT) AS label,
        {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in TABULAR)} FROM clean""",
    "domain_list_roundtrip": "SELECT DISTINCT regexp_extract(url, 'https?://([^/]+)', 1) AS domain FROM pages",
    "token_counts": f"""WITH {CLEAN}, {TOKENS} SELECT email_id, CAST(len(words) AS BIGINT) AS n_tokens,
        CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct, md5(coalesce(array_to_string(words, ' '), '')) AS tokens_md5
        FROM tokens""",
    "tfidf_terms": f"""WITH {CLEAN}, {TOKENS}, {grams('tokens', 1, 3)}
        SELECT term, count(*) AS term_count FROM grams GROUP BY term ORDER BY term_count DESC, term LIMIT 1000""",
    "tfidf_idf": f"""WITH {CLEAN}, {TOKENS}, {tfidf('tokens', 'tokens')}
        SELECT term, doc_freq, round(idf, 6) AS idf FROM idf""",
    "tfidf_weights": f"""WITH {CLEAN}, {TOKENS}, {tfidf('tokens', 'tokens')}
        SELECT email_id, term, round(weight, 6) AS weight FROM weights""",
    "tfidf_holdout_weights": f"""WITH {CLEAN}, {TOKENS}, lab AS (SELECT * FROM tokens WHERE label IS NOT NULL),
        {split('lab')}, tr AS (SELECT * FROM split_rows WHERE NOT is_test), te AS (SELECT * FROM split_rows WHERE is_test),
        {tfidf('tr', 'te')} SELECT email_id, term, round(weight, 6) AS weight FROM weights""",
    "ngram_ranges": f"WITH {CLEAN}, {TOKENS}, "
    + ", ".join(grams("tokens", lo, lo + 1, f"g{lo}") for lo in (1, 2, 3, 4))
    + " "
    + " UNION ALL ".join(
        f"SELECT '{lo}-{lo + 1}' AS ngram_range, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM g{lo}"
        for lo in (1, 2, 3, 4)
    ),
    "standard_scale": f"""WITH {CLEAN}, scaled AS (SELECT email_id, {SCALED} FROM clean)
        SELECT email_id, {", ".join(f"round({c}, 6) AS {c}" for c in TABULAR)} FROM scaled""",
    "embed_text": f"WITH {CLEAN}, {EMBEDDED} SELECT email_id, dim, round(value, 6) AS value FROM embedded",
    "embedding_roundtrip": """SELECT vec_id, CAST(label >= 5 AS BIGINT) AS label,
        generate_subscripts(embedding, 1) - 1 AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings""",
    "embedding_shape": "SELECT count(*) AS n_rows, max(len(embedding))::BIGINT AS n_dims FROM embeddings",
    "fused_features": f"""WITH {CLEAN}, {TOKENS}, {EMBEDDED}, lab AS (SELECT * FROM tokens WHERE label IS NOT NULL),
        {tfidf('lab', 'lab')}, scaled AS (SELECT email_id, {SCALED} FROM clean WHERE label IS NOT NULL),
        entries AS (
          SELECT email_id, unnest([{", ".join(TABULAR)}]) AS x FROM scaled
          UNION ALL SELECT email_id, weight FROM weights
          UNION ALL SELECT email_id, value FROM embedded JOIN lab USING (email_id)
        )
        SELECT email_id, {len(TABULAR)} + 64 + (SELECT count(*) FROM vocabulary) AS n_features, round(sum(x), 6) AS total,
               round(sum(x * x), 6) AS squared_length FROM entries GROUP BY email_id""",
    "stratified_split": f"""WITH {LABELLED}, {split('labelled')}
        SELECT email_id, label, CAST(is_test AS BIGINT) AS is_test FROM split_rows""",
    "stratified_folds": f"""WITH {LABELLED}, {dealt_folds('labelled', 'email_id')}
        SELECT email_id, label, CAST(fold AS BIGINT) AS fold FROM folded""",
    "plain_folds": """SELECT d.doc_id AS email_id, CAST(l.toxic AS BIGINT) AS label,
        ntile(5) OVER (ORDER BY md5(d.doc_id || '#42')) - 1 AS fold FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "size_summary": f"""WITH {LABELLED} SELECT count(*) AS total_rows,
        count(*) - CAST(ceil(count(*) * 2 / 10) AS BIGINT) AS train_rows, CAST(ceil(count(*) * 2 / 10) AS BIGINT) AS test_rows
        FROM labelled""",
    "score_threshold": f"WITH {LABELLED} SELECT email_id, prob::DOUBLE AS prob, CAST(prob >= 0.5 AS BIGINT) AS pred FROM labelled",
    "align_rows": f"""WITH {EMAILS}, {stats('emails')}, {LABELLED} SELECT l.email_id, l.label,
        CAST(c.symbols AS BIGINT) AS symbol_count, l.prob::DOUBLE AS prob FROM labelled l JOIN counted c USING (email_id)""",
    "confusion": f"WITH {LABELLED} SELECT {COUNTS} FROM labelled",
    "binary_metrics": f"WITH {LABELLED}, c AS (SELECT {COUNTS} FROM labelled) SELECT {MEASURES} FROM c",
    "roc_auc": f"""WITH {LABELLED}, r AS (
        SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS rk FROM labelled)
        SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
          / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6) AS roc_auc FROM r""",
    "triage": f"""WITH {LABELLED}, g AS (
        SELECT CASE WHEN prob < 0.30 THEN 1 WHEN prob <= 0.75 THEN 2 ELSE 3 END AS k FROM labelled)
        SELECT triage, (SELECT count(*) FROM g WHERE g.k = t.k) AS n,
          round((SELECT count(*) FROM g WHERE g.k = t.k) / (SELECT count(*) FROM g), 6) AS share FROM {TRIAGE_ROWS}""",
    "triage_crosstab": f"""WITH {LABELLED}, g AS (
        SELECT label, CASE WHEN prob <= 0.30 THEN 1 WHEN prob <= 0.75 THEN 2 ELSE 3 END AS k FROM labelled)
        SELECT triage, (SELECT count(*) FROM g WHERE g.k = t.k AND label = 0) AS legitimate,
          (SELECT count(*) FROM g WHERE g.k = t.k AND label = 1) AS spam FROM {TRIAGE_ROWS}""",
    "class_distribution": f"WITH {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "classification_report": f"""WITH {LABELLED},
        p AS (SELECT label, CAST(prob >= 0.5 AS BIGINT) AS pred FROM labelled), {report('p')}""",
    "class_weights": f"""WITH {LABELLED} SELECT label, count(*) AS n,
        round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labelled GROUP BY label""",
    "method_compare": f"""WITH {LABELLED}, {split('labelled')}, m AS (
        SELECT label, CASE WHEN is_test THEN 'held_out' ELSE 'cross_validation' END AS eval_set,
               unnest(['chars', 'inverse', 'id_hash']) AS feature_set,
               unnest([prob::DOUBLE, 1.0::DOUBLE - prob::DOUBLE, ((email_id * 7919) % 1009) / 1009.0::DOUBLE]) AS prob FROM split_rows),
        r AS (SELECT *, rank() OVER (PARTITION BY feature_set, eval_set ORDER BY prob)
                + (count(*) OVER (PARTITION BY feature_set, eval_set, prob) - 1) / 2 AS rk FROM m),
        c AS (SELECT feature_set, eval_set, {COUNTS}, count(*) FILTER (prob < 0.30) AS inbox,
                count(*) FILTER (prob >= 0.30 AND prob <= 0.75) AS quarantine, count(*) FILTER (prob > 0.75) AS spam,
                (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
                  / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc
              FROM r GROUP BY ALL)
        SELECT feature_set, eval_set, {MEASURES}, round(auc, 6) AS roc_auc, inbox, quarantine, spam FROM c""",
    "cluster_majority": f"""WITH {CLUSTERED}
        SELECT cluster, label AS majority_label FROM points GROUP BY cluster, label
        QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) = 1""",
    "cluster_report": f"""WITH {CLUSTERED},
        major AS (SELECT cluster, label AS pred FROM points GROUP BY cluster, label
                  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) = 1),
        p AS (SELECT label, pred FROM points JOIN major USING (cluster)), {report('p')}""",
    "silhouette": f"""WITH {CLUSTERED}, sums AS (
        SELECT a.vec_id, a.cluster AS own, b.cluster AS kind, count(*) AS n,
               sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS total
        FROM points a CROSS JOIN points b GROUP BY ALL),
        s AS (SELECT vec_id, max(total / nullif(n - 1, 0)) FILTER (kind = own) AS a, min(total / n) FILTER (kind <> own) AS b
              FROM sums GROUP BY vec_id)
        SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s""",
    "ari": f"""WITH {CLUSTERED},
        cells AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM points GROUP BY label, cluster)),
        la AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM points GROUP BY label)),
        cl AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM points GROUP BY cluster)),
        t AS (SELECT count(*) * (count(*) - 1) / 2 AS s FROM points)
        SELECT round((cells.s - la.s * cl.s / t.s) / ((la.s + cl.s) / 2 - la.s * cl.s / t.s), 6) AS ari
        FROM cells, la, cl, t""",
    "nmi": f"""WITH {CLUSTERED}, n AS (SELECT count(*)::DOUBLE AS n FROM points),
        la AS (SELECT label, count(*) / n AS p FROM points, n GROUP BY label, n),
        cl AS (SELECT cluster, count(*) / n AS q FROM points, n GROUP BY cluster, n),
        ce AS (SELECT label, cluster, count(*) / n AS r FROM points, n GROUP BY label, cluster, n)
        SELECT round((SELECT sum(r * ln(r / (p * q))) FROM ce JOIN la USING (label) JOIN cl USING (cluster))
          / (((SELECT -sum(p * ln(p)) FROM la) + (SELECT -sum(q * ln(q)) FROM cl)) / 2), 6) AS nmi""",
    # facts that hold for every right result of these learners
    "oof_logistic": f"""WITH e AS (SELECT vec_id, CAST(label >= 5 AS BIGINT) AS label FROM embeddings), {dealt_folds('e', 'vec_id')}
        SELECT vec_id, label, CAST(fold AS BIGINT) AS fold, 1::BIGINT AS scored FROM folded""",
    "oof_gbt": f"""WITH {EMAILS}, {DEDUP}, marked AS (SELECT email_id, CAST(label AS BIGINT) AS label FROM kept WHERE label IS NOT NULL),
        {dealt_folds('marked', 'email_id')}
        SELECT email_id, label, CAST(fold AS BIGINT) AS fold, feature_set, 1::BIGINT AS scored
        FROM folded, (VALUES ('pure_bert'), ('pure_tfidf'), ('fused')) AS sets(feature_set)""",
    "kmeans_best": """SELECT vec_id, CAST(label >= 5 AS BIGINT) AS label, 1::BIGINT AS at_nearest, 1::BIGINT AS at_mean
        FROM embeddings""",
    "pca_2d": """SELECT count(*) AS n_rows, 0::DOUBLE AS mean_pc1, 0::DOUBLE AS mean_pc2, 0::DOUBLE AS covariance,
        1::BIGINT AS falling FROM embeddings""",
    "pca_variance": """WITH x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        t AS (SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_samp(x) AS v FROM x GROUP BY i))
        SELECT unnest([1, 2])::BIGINT AS component, total_variance, 1::BIGINT AS agrees FROM t""",
    "pca_centroids": "SELECT unnest([0, 1])::BIGINT AS cluster, 1::BIGINT AS at_mean",
}
