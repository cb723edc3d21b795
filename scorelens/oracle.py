"""DuckDB twins of the registered queries, built from shared table expressions."""

from __future__ import annotations

from scorelens.functions.text import LINK, WORD_RUN
from scorelens.plans.models import REG_GRID
from scorelens.queries import (
    BUCKET_REGS,
    COMMUNITY_REG,
    HASH_BUCKETS,
    LARGE_LEXICON,
    LINEAR_FEATURES,
    ROW_CAP,
    SOME_COMMUNITIES,
    TOP_SCORES,
    VOCABULARY,
)
from scorelens.sources.readers import COMMENT_COLUMNS
from scorelens.sources.tables import SMALL_LEXICON

# Spark's default English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return ", ".join(map(_text, values))


# Named table expressions, each over the ones it mentions.
TABLES = {
    "comments": """
        SELECT d.doc_id AS id,
               d.text || coalesce(' ' || p.url, '') AS body,
               CASE WHEN e.event_type = 'error' THEN '[deleted]' ELSE cast(e.user_id AS varchar) END AS author,
               d.source AS subreddit,
               cast(cast(floor(epoch(e.ts)) AS bigint) AS varchar) AS created_utc,
               cast(cast(floor(e.value) AS bigint) - 5 AS varchar) AS score
        FROM documents d
        LEFT JOIN events e ON d.doc_id = e.event_id
        LEFT JOIN pages p ON p.page_id = d.doc_id""",
    "kept": """
        SELECT * FROM comments
        WHERE author <> '[deleted]' AND body NOT IN ('[removed]', '[deleted]')""",
    "scored": """
        SELECT * FROM (SELECT *, try_cast(score AS double) AS score_double FROM kept)
        WHERE score_double IS NOT NULL""",
    "raw": r"""
        SELECT id, CASE WHEN body <> '' AND regexp_full_match(body, '[\s\x0b]+') THEN []
            ELSE string_split_regex(lower(regexp_replace(body, '[\s\x0b]+$', '')), '[\s\x0b]')
            END AS words
        FROM kept""",
    "tokens": """
        SELECT id, list_transform(words, lambda t: regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) AS words
        FROM raw""",
    "content": f"""
        SELECT id, list_filter(words, lambda t: t NOT IN ({_texts(STOP_WORDS)})) AS words FROM tokens""",
    "lexicon": "SELECT * FROM (VALUES "
    + ", ".join(f"({_text(word)}, {valence})" for word, valence in SMALL_LEXICON.items())
    + ") AS v(word, valence)",
    "token_rows": "SELECT id, unnest(words) AS term FROM tokens",
    "content_rows": "SELECT id, unnest(words) AS term FROM content",
    "run_rows": f"SELECT id, unnest(regexp_extract_all(lower(body), '{WORD_RUN}')) AS term FROM kept",
    "sentiments": """
        SELECT id, sum(valence) / count(*)::double AS sentiment
        FROM token_rows JOIN lexicon ON term = word GROUP BY id""",
    "run_sentiments": """
        SELECT id, sum(valence) / count(*)::double AS sentiment
        FROM run_rows JOIN lexicon ON term = word WHERE valence <> 0 GROUP BY id""",
    "lengths": """
        SELECT id, len(words) AS n, coalesce(list_sum(list_transform(words, lambda t: length(t))), 0) AS chars
        FROM tokens""",
    "features": f"""
        SELECT k.id, try_cast(score AS double) AS score_double,
               n::integer AS words_count, chars::integer AS chars_count,
               CASE WHEN n > 0 THEN chars::double / n ELSE 0.0 END AS avg_word_length,
               len(regexp_extract_all(body, '{LINK}'))::integer AS link_count,
               hour(to_timestamp(try_cast(created_utc AS bigint)) AT TIME ZONE 'UTC')::double AS hour,
               coalesce(s.sentiment, 0.0) AS sentiment,
               (length(body) - length(replace(body, '?', '')))::integer AS question_mark,
               (length(body) - length(replace(body, '!', '')))::integer AS excl_mark
        FROM kept k JOIN lengths l ON k.id = l.id LEFT JOIN sentiments s ON k.id = s.id""",
    "body_stats": f"""
        SELECT id, length(body)::integer AS body_chars,
               len(regexp_extract_all(body, '{LINK}'))::integer AS link_count,
               len(string_split(body, ' '))::integer AS space_words,
               list_sum(list_transform(string_split(body, ' '), lambda t: length(t)))::double
                   / len(string_split(body, ' ')) AS space_word_length
        FROM kept""",
    "ranked": """
        SELECT *, row_number() OVER (ORDER BY score_double) AS place,
               count(*) OVER () AS total FROM scored""",
    "threshold": "SELECT max(score_double) AS threshold FROM ranked WHERE place = total - total // 4",
    "labelled": """
        SELECT s.*, CASE WHEN score_double > threshold THEN 1.0 ELSE 0.0 END::double AS label
        FROM scored s, threshold""",
    "bucketed": """
        SELECT *, CASE WHEN score_double <= 0 THEN 0.0
            ELSE trunc(ln(score_double) / ln(2)) + 1 END::double AS label FROM scored""",
    "parts": """
        SELECT *, CASE WHEN ('0x' || substr(md5(cast(id AS varchar)), 1, 8))::bigint % 100 < 70
            THEN 'train' ELSE 'test' END AS part FROM kept""",
    # Murmur3 (32 bit, seed 42) of every distinct token, four bytes at a time.
    "murmur_blocks": """
        SELECT term, length(term)::ubigint AS n,
            list_transform(range(0, length(term) // 4), lambda i:
                ascii(term[4*i+1])::ubigint + ascii(term[4*i+2])::ubigint * 256
                + ascii(term[4*i+3])::ubigint * 65536 + ascii(term[4*i+4])::ubigint * 16777216) AS blocks,
            list_sum(list_transform(range(0, length(term) % 4), lambda i:
                ascii(term[(length(term) // 4) * 4 + i + 1]) * (256 ** i)::bigint))::ubigint AS tail
        FROM (SELECT DISTINCT term FROM token_rows)""",
    "murmur_mixed": """
        SELECT term, n,
            list_transform(list_transform(blocks, lambda k: (k * 3432918353) % 4294967296),
                lambda k: (((k * 32768) % 4294967296 + k // 131072) * 461845907) % 4294967296) AS blocks,
            (coalesce(tail, 0)::ubigint * 3432918353) % 4294967296 AS tail
        FROM murmur_blocks""",
    "murmur_state": """
        SELECT term, n,
            xor(list_reduce(blocks, lambda h, k:
                (((xor(h, k) * 8192) % 4294967296 + xor(h, k) // 524288) * 5 + 3864292196) % 4294967296,
                42::ubigint),
              (((tail * 32768) % 4294967296 + tail // 131072) * 461845907) % 4294967296) AS h
        FROM murmur_mixed""",
    "murmur_a": "SELECT term, xor(h, n) AS h FROM murmur_state",
    "murmur_b": "SELECT term, (xor(h, h // 65536) * 2246822507) % 4294967296 AS h FROM murmur_a",
    "murmur_c": "SELECT term, (xor(h, h // 8192) * 3266489909) % 4294967296 AS h FROM murmur_b",
    "murmur_d": "SELECT term, xor(h, h // 65536)::bigint AS h FROM murmur_c",
    # The hash is a signed number; its remainder is taken so that it is not negative.
    "hashed_terms": f"""
        SELECT term, (((h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END) % {HASH_BUCKETS} + {HASH_BUCKETS})
            % {HASH_BUCKETS})::integer AS slot FROM murmur_d""",
    "hashed_tf": """
        SELECT id, slot, count(*)::double AS value FROM token_rows JOIN hashed_terms USING (term)
        GROUP BY id, slot""",
    "hashed_weights": """
        SELECT slot, ln(((SELECT count(*) FROM tokens) + 1.0) / (count(*) + 1.0)) AS idf
        FROM hashed_tf GROUP BY slot""",
    "hashed_tfidf": """
        SELECT id, slot, value * idf AS value FROM hashed_tf JOIN hashed_weights USING (slot)""",
    # Naive Bayes, binary labels, stop words removed, vocabulary of all rows.
    "nb_terms": """
        SELECT l.id, label, part, term FROM content_rows c
        JOIN labelled l ON c.id = l.id JOIN parts p ON c.id = p.id""",
    "nb_sizes": """
        SELECT label, count(*) AS n FROM labelled l JOIN parts p ON l.id = p.id WHERE part = 'train' GROUP BY label""",
    "nb_prior": """
        SELECT label, n AS "rows", ln((n + 1.0) / (sum(n) OVER () + count(*) OVER ())) AS log_prior
        FROM nb_sizes""",
    "nb_counts": """
        SELECT t.term, s.label, count(x.term) AS n
        FROM (SELECT DISTINCT term FROM content_rows) t CROSS JOIN nb_sizes s
        LEFT JOIN (SELECT term, label FROM nb_terms WHERE part = 'train') x
            ON x.term = t.term AND x.label = s.label
        GROUP BY t.term, s.label""",
    "nb_theta": """
        SELECT term, label,
               ln((n + 1.0) / (sum(n) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label))) AS log_prob
        FROM nb_counts""",
    "nb_scores": """
        SELECT r.id, r.label AS actual, p.label AS guess, p.log_prior + coalesce(t.total, 0) AS score
        FROM (SELECT l.id, label FROM labelled l JOIN parts q ON l.id = q.id WHERE part = 'test') r
        CROSS JOIN nb_prior p
        LEFT JOIN (SELECT c.id, h.label, sum(log_prob) AS total
                   FROM content_rows c JOIN nb_theta h USING (term) GROUP BY c.id, h.label) t
            ON t.id = r.id AND t.label = p.label""",
    "nb_guesses": """
        SELECT id, any_value(actual) AS label, arg_max(guess, score) AS prediction FROM nb_scores GROUP BY id""",
    # Least squares of the score on one and on two features.
    "points": """
        SELECT s.id, part, s.score_double AS y, words_count::double AS x1, link_count::double AS x2
        FROM scored s JOIN features f ON s.id = f.id JOIN parts p ON s.id = p.id""",
    "moments": """
        SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(y) AS sy,
               var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
               covar_pop(y, x1) AS c1, covar_pop(y, x2) AS c2
        FROM points WHERE part = 'train'""",
    "two_weights": """
        SELECT (v2 * c1 - c12 * c2) / (v1 * v2 - c12 * c12) AS b1,
               (v1 * c2 - c12 * c1) / (v1 * v2 - c12 * c12) AS b2, my, m1, m2 FROM moments""",
    "two_predictions": """
        SELECT id, part, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS prediction FROM points, two_weights""",
}


def _mentions(name: str, sql: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


def _needed(sql: str) -> list[str]:
    found: list[str] = []

    def visit(query: str, own: str = "") -> None:
        for name, body in TABLES.items():
            if name != own and name not in found and _mentions(name, query):
                visit(body, name)
                found.append(name)

    visit(sql)
    return list(dict.fromkeys(found))


def _query(sql: str) -> str:
    """The query with just the table expressions it needs in front."""
    sql = sql.strip()
    ctes = [f"{name} AS MATERIALIZED ({TABLES[name].strip()})" for name in _needed(sql)]
    if not ctes:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql[15:]
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def _joined_words(table: str, where: str = "") -> str:
    return f"SELECT id, len(words)::integer AS n, array_to_string(words, '|') AS words FROM {table} {where}"


def _vocabulary(rows: str, size: int) -> str:
    """(term, slot) of the most used terms."""
    return f"""
        SELECT term, (row_number() OVER (ORDER BY uses DESC, term) - 1)::integer AS slot
        FROM (SELECT term, count(*) AS uses FROM {rows} GROUP BY term
              ORDER BY uses DESC, substr(md5(term), 1, 15) LIMIT {size})"""


def _bag(rows: str, size: int) -> str:
    return f"""
        SELECT id, slot, count(*)::double AS value FROM {rows} JOIN ({_vocabulary(rows, size)}) USING (term)
        GROUP BY id, slot"""


def _metadata_slots(offset: str, punctuation: bool = True) -> str:
    """(id, slot, value) of the metadata block that starts at slot `offset`."""
    slots = [
        (0, "chars_count"),
        (1, "avg_word_length"),
        (2, "link_count"),
        (3, "words_count"),
        (27, "sentiment"),
    ]
    if punctuation:
        slots += [(28, "question_mark"), (29, "excl_mark")]
    rows = [f"SELECT id, {offset} + {slot} AS slot, {name}::double AS value FROM features" for slot, name in slots]
    rows.append(f"SELECT id, {offset} + 4 + hour::integer AS slot, 1.0::double AS value FROM features WHERE hour < 23")
    return " UNION ALL ".join(rows)


def _slots(*parts: str) -> str:
    rows = " UNION ALL ".join(f"({part})" for part in parts)
    return f"SELECT id, slot::integer AS slot, round(value, 9) AS value FROM ({rows}) WHERE value <> 0"


def _width(rows: str, size: int) -> str:
    """Slots of the word block: the vocabulary may be smaller than asked for."""
    return f"(SELECT least({size}, count(DISTINCT term)) FROM {rows})"


SENTIMENT_ROWS = "(SELECT id, term FROM token_rows JOIN lexicon ON term = word)"
QUARTILES = """
    SELECT subreddit, max(total) AS "rows", max(score_double) AS max_score,
           max(CASE WHEN place = total - total // 4 THEN score_double END) AS threshold
    FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY score_double) AS place,
                 count(*) OVER (PARTITION BY subreddit) AS total FROM scored)
    GROUP BY subreddit"""
SHARES = """
    SELECT count(*) AS "rows", count(*) FILTER (label = prediction) AS "right",
           count(*) FILTER (label = prediction) / count(*)::double AS accuracy FROM """


def _arm_metrics(mode: str, guesses: str, labelled: str) -> str:
    """The metric rows of one naive Bayes arm."""
    metric = f"SELECT 'words' AS plan, '{mode}' AS mode, 0.0::double AS reg_param,"
    return f"""
        {metric} 'test_accuracy' AS metric,
               round(count(*) FILTER (label = prediction) / count(*)::double, 9) AS value
        FROM ({guesses})
        UNION ALL
        {metric} 'majority_share', round(max(n) / sum(n)::double, 9)
        FROM (SELECT label, count(*) AS n FROM {labelled} GROUP BY label)"""


def _bayes_guesses(labelled: str, by: str, out: str = "") -> str:
    """Accuracy (per group) from one fit per group, or what `out` selects from the test rows' guesses."""
    out = out or f"""
        SELECT {by} count(*) AS "rows", count(*) FILTER (label = prediction) AS "right",
               count(*) FILTER (label = prediction) / count(*)::double AS accuracy
        FROM guesses GROUP BY grp"""
    return f"""
        WITH labels AS MATERIALIZED ({labelled}),
        r AS MATERIALIZED (SELECT l.id, l.label, l.grp, part FROM labels l JOIN parts p ON l.id = p.id),
        x AS MATERIALIZED (SELECT r.id, r.label, r.grp, part, term FROM r JOIN content_rows c ON c.id = r.id),
        sizes AS (SELECT grp, label, count(*) AS n FROM r WHERE part = 'train' GROUP BY grp, label),
        prior AS (SELECT grp, label, ln((n + 1.0) / (sum(n) OVER g + count(*) OVER g)) AS log_prior
                  FROM sizes WINDOW g AS (PARTITION BY grp)),
        counted AS (SELECT grp, label, term, count(*) AS n FROM x WHERE part = 'train' GROUP BY ALL),
        vocabulary AS (SELECT DISTINCT grp, term FROM x),
        theta AS MATERIALIZED (
            SELECT v.grp, s.label, v.term,
                   ln((coalesce(n.n, 0) + 1.0) / (sum(coalesce(n.n, 0)) OVER w + count(*) OVER w)) AS log_prob
            FROM vocabulary v JOIN sizes s ON v.grp = s.grp
            LEFT JOIN counted n ON n.grp = v.grp AND n.label = s.label AND n.term = v.term
            WINDOW w AS (PARTITION BY v.grp, s.label)),
        added AS (SELECT x.id, t.label, sum(log_prob) AS total FROM x
                  JOIN theta t ON t.grp = x.grp AND t.term = x.term WHERE part = 'test' GROUP BY ALL),
        guesses AS (SELECT r.id, r.grp, any_value(r.label) AS label,
                           arg_max(p.label, p.log_prior + coalesce(a.total, 0)) AS prediction
                    FROM r JOIN prior p ON p.grp = r.grp
                    LEFT JOIN added a ON a.id = r.id AND a.label = p.label
                    WHERE part = 'test' GROUP BY r.id, r.grp)
        {out}"""


def _newton(points: str, out: str, steps: int = 40) -> str:
    """Logistic regression on one standardised feature for each grp of points (grp, y, x, reg), by full Newton steps.

    `out` selects from fits (grp, rows, reg, intercept, weight), over the feature's own values.
    """
    return f"""
        WITH RECURSIVE spread AS MATERIALIZED (
            SELECT grp, reg, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM ({points}) GROUP BY grp, reg),
        scaled AS MATERIALIZED (
            SELECT p.grp, p.reg, y, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0.0 END AS z
            FROM ({points}) p JOIN spread s ON p.grp = s.grp AND p.reg = s.reg),
        newton AS (
            SELECT grp, reg, 0 AS step, 0.0::double AS b0, 0.0::double AS b1 FROM spread
            UNION ALL
            SELECT grp, reg, step + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
                   b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
            FROM (SELECT grp, reg, step, b0, b1, avg(p - y) AS g0, avg((p - y) * z) + reg * b1 AS g1,
                         avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + reg AS h11
                  FROM (SELECT n.*, y, z, 1 / (1 + exp(-(b0 + b1 * z))) AS p
                        FROM newton n JOIN scaled s ON n.grp = s.grp AND n.reg = s.reg WHERE step < {steps})
                  GROUP BY grp, reg, step, b0, b1)),
        fits AS (
            SELECT s.grp, n AS "rows", s.reg, CASE WHEN sd > 0 THEN b0 - b1 * m / sd ELSE b0 END AS intercept,
                   CASE WHEN sd > 0 THEN b1 / sd ELSE 0.0 END AS weight
            FROM newton f JOIN spread s ON f.grp = s.grp AND f.reg = s.reg WHERE step = {steps})
        {out}"""


REG_ROWS = ", ".join(f"({reg!r}::double)" for reg in REG_GRID)

QUERIES = {
    "warehouse_comments": "SELECT "
    + ", ".join(
        f"cast({name} AS varchar) AS {name}"
        if name in ("id", "body", "author", "subreddit", "created_utc", "score")
        else f"cast(NULL AS varchar) AS {name}"
        for name in COMMENT_COLUMNS
    )
    + " FROM comments",
    "json_comments": "SELECT cast(id AS varchar) AS id, body, author, subreddit, created_utc, score FROM comments",
    "csv_comments": "SELECT cast(id AS varchar) AS id, body, author, subreddit, created_utc, score FROM comments",
    "lexicon_hits": """
        SELECT word, valence, count(term) AS uses FROM lexicon LEFT JOIN token_rows ON term = word
        GROUP BY word, valence""",
    "sentiment_large_lexicon": f"""
        WITH entries AS (SELECT term AS word, length(term) % 7 - 3 AS valence
                         FROM ({_vocabulary("token_rows", LARGE_LEXICON)})),
        means AS (SELECT id, sum(valence) / count(*)::double AS sentiment
                  FROM token_rows JOIN entries ON term = word GROUP BY id)
        SELECT k.id, round(coalesce(sentiment, 0.0), 9) AS sentiment FROM kept k LEFT JOIN means m ON k.id = m.id""",
    "community_tables": f"""
        SELECT strftime(to_timestamp(created_utc::bigint) AT TIME ZONE 'UTC', '%Y-%m') AS month, subreddit,
               count(*) AS comments, sum(length(body))::bigint AS chars
        FROM comments WHERE subreddit IN ({_texts(SOME_COMMUNITIES)}) GROUP BY ALL""",
    "filter_placeholders": "SELECT id, author, body FROM kept",
    "community_comments": "SELECT id, score FROM kept WHERE subreddit = 'src3'",
    "row_cap": f"SELECT id, score FROM kept ORDER BY id LIMIT {ROW_CAP}",
    "subreddit_counts": "SELECT subreddit, count(*) AS comments FROM kept GROUP BY subreddit",
    "stage_counts": f"""
        SELECT (SELECT count(*) FROM comments) AS loaded, (SELECT count(*) FROM kept) AS filtered,
               count(*) AS limited, count(*) FILTER (part = 'train') AS train,
               count(*) FILTER (part = 'test') AS test
        FROM (SELECT * FROM parts ORDER BY id LIMIT {ROW_CAP})""",
    "score_cast": "SELECT id, try_cast(score AS double) AS score_double FROM kept",
    "top_scores": f"""
        SELECT id, subreddit, score_double FROM scored ORDER BY score_double DESC, id LIMIT {TOP_SCORES}""",
    "score_summary": "SELECT count(*) AS comments, max(try_cast(score AS double)) AS highest_score FROM kept",
    "tokens_raw": _joined_words("raw"),
    "tokens_clean": _joined_words("tokens"),
    "stopword_filter": _joined_words("content"),
    "lexicon_filter": f"""
        WITH hits AS (
            SELECT id, list_filter(words, lambda t: t IN ({_texts(SMALL_LEXICON)})) AS words FROM tokens)
        """
    + _joined_words("hits", "WHERE len(words) > 0"),
    "metadata_features": "SELECT * FROM features",
    "sentiment_by_join": "SELECT id, sentiment FROM features",
    "run_sentiment": """
        SELECT k.id, coalesce(sentiment, 0.0) AS sentiment FROM kept k LEFT JOIN run_sentiments s ON k.id = s.id""",
    "raw_text_stats": "SELECT * FROM body_stats",
    "record_features": """
        SELECT b.*, coalesce(sentiment, 0.0) AS sentiment, try_cast(score AS double) AS score_double
        FROM body_stats b JOIN kept k ON b.id = k.id LEFT JOIN run_sentiments s ON b.id = s.id""",
    "regex_bag": "SELECT id, term, count(*) AS tf FROM run_rows GROUP BY id, term",
    "vocabulary_topk": f"""
        SELECT term, count(*) AS uses FROM content_rows GROUP BY term
        ORDER BY uses DESC, substr(md5(term), 1, 15) LIMIT {VOCABULARY}""",
    "term_doc_freq": "SELECT term, count(DISTINCT id) AS doc_freq FROM content_rows GROUP BY term",
    "idf_weights": """
        SELECT term, count(*) AS uses, count(DISTINCT id) AS doc_freq,
               round(ln(((SELECT count(*) FROM tokens) + 1.0) / (count(DISTINCT id) + 1.0)), 9) AS idf
        FROM token_rows GROUP BY term""",
    "tfidf_terms": """
        WITH tf AS (SELECT id, term, count(*) AS tf FROM token_rows GROUP BY id, term),
        idf AS (SELECT term, ln(((SELECT count(*) FROM tokens) + 1.0) / (count(*) + 1.0)) AS idf
                FROM tf GROUP BY term)
        SELECT id, term, tf, round(tf * idf, 9) AS tfidf FROM tf JOIN idf USING (term)""",
    "bag_of_words": _slots(_bag("content_rows", VOCABULARY)),
    "hashing_tf": _slots("SELECT * FROM hashed_tf"),
    "hashed_tfidf": _slots("SELECT * FROM hashed_tfidf"),
    "hour_one_hot": "SELECT id, hour::integer AS slot, 1.0::double AS value FROM features WHERE hour < 23",
    "features_metadata": _slots(_metadata_slots("0")),
    "features_bag": _slots(
        _bag("content_rows", VOCABULARY), _metadata_slots(_width("content_rows", VOCABULARY))
    ),
    "features_sentiment": _slots(
        _bag(SENTIMENT_ROWS, 2**18),
        f"SELECT * FROM ({_metadata_slots(_width(SENTIMENT_ROWS, 2**18), punctuation=False)}) "
        f"WHERE id IN (SELECT id FROM {SENTIMENT_ROWS})",
    ),
    "features_tfidf": _slots("SELECT * FROM hashed_tfidf", _metadata_slots(str(HASH_BUCKETS))),
    "features_record": _slots(
        *[
            f"SELECT b.id, {slot} AS slot, {name}::double AS value FROM body_stats b"
            for slot, name in enumerate(("body_chars", "link_count", "space_words", "space_word_length"))
        ],
        "SELECT id, 4 AS slot, sentiment AS value FROM run_sentiments",
        f"SELECT id, slot + 5 AS slot, value FROM ({_bag('run_rows', 2**31)})",
    ),
    "features_words": _slots(_bag("content_rows", 2**18)),
    "quartile_threshold": """
        SELECT count(*) AS "rows", max(score_double) AS max_score, (SELECT threshold FROM threshold) AS threshold
        FROM scored""",
    "quartile_by_community": QUARTILES,
    "binary_label": "SELECT id, score_double, label AS score_bucket FROM labelled",
    "log_bucket": "SELECT id, score_double, label AS score_bucket FROM bucketed",
    "binary_distribution": """
        SELECT max(t.threshold) AS threshold, count(*) FILTER (label = 0) AS below,
               count(*) FILTER (label = 0) / count(*)::double AS below_share,
               count(*) FILTER (label = 1) AS above,
               count(*) FILTER (label = 1) / count(*)::double AS above_share
        FROM labelled, threshold t""",
    "bucket_distribution": """
        SELECT label AS bucket, CASE WHEN label <= 0 THEN -1 ELSE 2 ** (label - 1) END::bigint AS low,
               CASE WHEN label <= 0 THEN -1 ELSE 2 ** label END::bigint AS high,
               count(*) AS comments, count(*) / (SELECT count(*) FROM bucketed)::double AS share
        FROM bucketed GROUP BY label""",
    "majority_baseline": """
        SELECT sum(n)::bigint AS comments, max(n) / sum(n)::double AS baseline
        FROM (SELECT label, count(*) AS n FROM labelled GROUP BY label)""",
    "binary_distribution_by_community": f"""
        SELECT s.subreddit, count(*) AS comments, max(threshold) AS threshold,
               count(*) FILTER (score_double > threshold) AS above,
               count(*) FILTER (score_double > threshold) / count(*)::double AS above_share
        FROM scored s JOIN ({QUARTILES}) q ON s.subreddit = q.subreddit GROUP BY s.subreddit""",
    "hash_split": "SELECT id, part FROM parts",
    "tuning_split": """
        SELECT id, CASE WHEN ('0x' || substr(md5('tuning-' || cast(id AS varchar)), 1, 8))::bigint % 100 < 80
            THEN 'train' ELSE 'test' END AS part FROM parts WHERE part = 'train'""",
    "ordered_split": """
        SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= (SELECT count(*) * 60 // 100 FROM kept)
            THEN 'train' ELSE 'test' END AS part FROM kept""",
    "ordered_split_text": """
        WITH RECURSIVE digits AS (
            SELECT id, id AS rest, '' AS name FROM kept
            UNION ALL
            SELECT id, rest // 36, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (rest % 36 + 1)::integer, 1) || name
            FROM digits WHERE rest > 0),
        named AS (
            SELECT 't1_' || CASE WHEN id = 0 THEN '0' ELSE name END AS id FROM digits WHERE rest = 0)
        SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= (SELECT count(*) * 60 // 100 FROM named)
            THEN 'train' ELSE 'test' END AS part FROM named""",
    # Communities in the order of their digests, until there are enough rows; the last one gives what is missing.
    "row_cap_repeated": f"""
        SELECT subreddit, least(n, {ROW_CAP} - before)::bigint AS comments
        FROM (SELECT *, sum(n) OVER (ORDER BY substr(md5(subreddit), 1, 15)) - n AS before
              FROM (SELECT subreddit, count(*) AS n FROM kept GROUP BY subreddit))
        WHERE before < {ROW_CAP}""",
    "nb_priors": 'SELECT label, "rows", round(log_prior, 9) AS log_prior FROM nb_prior',
    "nb_theta": "SELECT term, label, round(log_prob, 9) AS log_prob FROM nb_theta",
    "nb_predictions": "SELECT id, label, prediction FROM nb_guesses",
    "nb_accuracy": SHARES + "nb_guesses",
    "nb_bucket_accuracy": _bayes_guesses("SELECT id, label, 0 AS grp FROM bucketed", ""),
    "nb_top_terms": """
        SELECT * FROM (SELECT 'top' AS side, term, round(log_prob, 9) AS weight FROM nb_theta
                       WHERE label = 0 ORDER BY log_prob DESC, term LIMIT 10)
        UNION ALL
        SELECT * FROM (SELECT 'bottom' AS side, term, round(log_prob, 9) AS weight FROM nb_theta
                       WHERE label = 0 ORDER BY log_prob, term LIMIT 10)""",
    "nb_by_community": _bayes_guesses(
        f"""SELECT s.id, CASE WHEN score_double > threshold THEN 1.0 ELSE 0.0 END::double AS label,
                   s.subreddit AS grp
            FROM scored s JOIN ({QUARTILES}) q ON s.subreddit = q.subreddit""",
        "grp AS subreddit,",
    ),
    "linear_errors": """
        SELECT count(*) AS "rows", round(avg((y - prediction) ** 2), 6) AS mse,
               round(sqrt(avg((y - prediction) ** 2)), 6) AS rmse
        FROM two_predictions WHERE part = 'test'""",
    "sgd_errors": """
        SELECT count(*) AS "rows", round(sqrt(avg((y - prediction) ** 2)), 4) AS rmse
        FROM two_predictions WHERE part = 'test'""",
    "sgd_three_steps": """
        WITH z AS MATERIALIZED (
            SELECT id, y, (x1 - m1) / sqrt(v1) AS z1, (x2 - m2) / sqrt(v2) AS z2 FROM points, moments WHERE part = 'train'),
        s0 AS (SELECT 0.0::double AS b0, 0.0::double AS b1, 0.0::double AS b2),
        s1 AS (
            SELECT b0 - h * avg(m) AS b0, b1 - h * avg(m * z1) AS b1, b2 - h * avg(m * z2) AS b2
            FROM (SELECT z.*, b0, b1, b2, b0 + b1 * z1 + b2 * z2 - y AS m, 0.5 / sqrt(1.0) AS h FROM z, s0
                  WHERE ('0x' || substr(md5('step1-' || cast(id AS varchar)), 1, 8))::bigint % 100 < 50)
            GROUP BY b0, b1, b2, h),
        s2 AS (
            SELECT b0 - h * avg(m) AS b0, b1 - h * avg(m * z1) AS b1, b2 - h * avg(m * z2) AS b2
            FROM (SELECT z.*, b0, b1, b2, b0 + b1 * z1 + b2 * z2 - y AS m, 0.5 / sqrt(2.0) AS h FROM z, s1
                  WHERE ('0x' || substr(md5('step2-' || cast(id AS varchar)), 1, 8))::bigint % 100 < 50)
            GROUP BY b0, b1, b2, h),
        s3 AS (
            SELECT b0 - h * avg(m) AS b0, b1 - h * avg(m * z1) AS b1, b2 - h * avg(m * z2) AS b2
            FROM (SELECT z.*, b0, b1, b2, b0 + b1 * z1 + b2 * z2 - y AS m, 0.5 / sqrt(3.0) AS h FROM z, s2
                  WHERE ('0x' || substr(md5('step3-' || cast(id AS varchar)), 1, 8))::bigint % 100 < 50)
            GROUP BY b0, b1, b2, h)
        SELECT round(b0 - b1 * m1 / sqrt(v1) - b2 * m2 / sqrt(v2), 6) AS intercept, round(b1 / sqrt(v1), 6) AS words_count,
               round(b2 / sqrt(v2), 6) AS link_count FROM s3, moments""",
    "linear_weights": f"""
        WITH w AS (SELECT 0::integer AS slot, {_text(LINEAR_FEATURES[0])} AS feature, round(b1, 6) AS weight
                   FROM two_weights UNION ALL
                   SELECT 1::integer, {_text(LINEAR_FEATURES[1])}, round(b2, 6) FROM two_weights)
        SELECT * FROM (SELECT 'top' AS side, * FROM w ORDER BY weight DESC, slot LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'bottom' AS side, * FROM w ORDER BY weight, slot LIMIT 1)""",
    # With one standardised feature, penalty r shrinks the slope by 1 + r / sd(score).
    "reg_path_one_feature": f"""
        WITH errors AS (
            SELECT reg_param, part, y - (my + c1 / v1 / (1 + reg_param / sy) * (x1 - m1)) AS error
            FROM points, moments, (VALUES {REG_ROWS}) AS regs(reg_param))
        SELECT reg_param, round(sqrt(avg(error ** 2) FILTER (part = 'train')), 6) AS train_rmse,
               round(sqrt(avg(error ** 2) FILTER (part = 'test')), 6) AS test_rmse
        FROM errors GROUP BY reg_param""",
    # Moments of one feature for a part of the rows give the slope under any penalty.
    "ridge_one_feature": f"""
        WITH tuned AS (
            SELECT *, ('0x' || substr(md5('tuning-' || cast(id AS varchar)), 1, 8))::bigint % 100 < 80 AS fits
            FROM points WHERE part = 'train'),
        fitted AS (SELECT avg(y) AS my, avg(x1) AS m1, stddev_pop(y) AS sy, var_pop(x1) AS v1,
                        covar_pop(y, x1) AS c1 FROM tuned WHERE fits),
        judged AS (
            SELECT reg_param, sqrt(avg((y - (my + c1 / v1 / (1 + reg_param / sy) * (x1 - m1))) ** 2)) AS tuning_rmse
            FROM tuned, fitted, (VALUES {REG_ROWS}) AS regs(reg_param) WHERE NOT fits GROUP BY reg_param),
        best AS (SELECT arg_min(reg_param, tuning_rmse) AS reg FROM judged),
        tested AS (
            SELECT sqrt(avg((y - (my + c1 / v1 / (1 + reg / sy) * (x1 - m1))) ** 2)) AS test_rmse
            FROM points, moments, best WHERE part = 'test')
        SELECT reg_param, round(tuning_rmse, 6) AS tuning_rmse, reg_param = reg AS chosen,
               CASE WHEN reg_param = reg THEN round(test_rmse, 6) END AS test_rmse
        FROM judged, best, tested""",
    "logistic_one_feature_by_community": _newton(
        f"""SELECT s.subreddit AS grp, CASE WHEN score_double > threshold THEN 1 ELSE 0 END AS y,
                   n::double AS x, {COMMUNITY_REG}::double AS reg
            FROM scored s JOIN ({QUARTILES}) q ON s.subreddit = q.subreddit
            JOIN lengths l ON s.id = l.id JOIN parts p ON s.id = p.id WHERE part = 'train'""",
        """SELECT grp AS subreddit, "rows", round(intercept, 5) AS intercept, round(weight, 6) AS weight FROM fits""",
    ),
    "bucket_logistic_one_feature": _newton(
        f"""SELECT bucket AS grp, CASE WHEN label = bucket THEN 1 ELSE 0 END AS y, n::double AS x, reg
            FROM bucketed b JOIN lengths l ON b.id = l.id JOIN parts p ON b.id = p.id,
                 (SELECT DISTINCT label AS bucket FROM bucketed d JOIN parts e ON d.id = e.id WHERE part = 'train'),
                 (VALUES {", ".join(f"({reg!r}::double)" for reg in BUCKET_REGS)}) AS regs(reg)
            WHERE part = 'train'""",
        """SELECT grp AS bucket, reg AS reg_param, round(intercept, 5) AS intercept, round(weight, 6) AS weight FROM fits""",
    ),
    # Where all sums of residuals meet the penalty's pull, the fit is the optimum: there is only one.
    "logistic_by_community": f"""
        SELECT s.subreddit, count(DISTINCT s.id) AS "rows", count(DISTINCT term) AS terms, true AS settled
        FROM scored s JOIN parts p ON s.id = p.id JOIN ({QUARTILES}) q ON s.subreddit = q.subreddit
        LEFT JOIN content_rows c ON c.id = s.id WHERE part = 'train' GROUP BY s.subreddit""",
    "bucket_logistic_metadata": f"""
        SELECT label AS bucket, reg AS reg_param, count(*) AS members, true AS settled
        FROM bucketed b JOIN parts p ON b.id = p.id,
             (VALUES {", ".join(f"({reg!r}::double)" for reg in BUCKET_REGS)}) AS regs(reg)
        WHERE part = 'train' GROUP BY label, reg""",
    "experiment_binary": _arm_metrics("binary", "SELECT label, prediction FROM nb_guesses", "labelled"),
    "experiment_bayes": _arm_metrics(
        "bayes",
        _bayes_guesses("SELECT id, label, 0 AS grp FROM bucketed", "", "SELECT label, prediction FROM guesses"),
        "bucketed",
    ),
    # Eigenvalues and vectors of a symmetric 2 x 2 matrix, the larger loading of each made positive.
    "pca_two_features": """
        WITH m AS (SELECT var_samp(x1) AS a, var_samp(x2) AS b, covar_samp(x1, x2) AS c FROM points),
        e AS (SELECT *, unnest([1, 2]) AS component FROM m),
        v AS (SELECT *, (a + b) / 2 + (CASE component WHEN 1 THEN 1 ELSE -1 END) * sqrt(((a - b) / 2) ** 2 + c * c) AS value FROM e),
        d AS (SELECT *, CASE WHEN c = 0 THEN (CASE WHEN value = a THEN 1.0 ELSE 0.0 END) ELSE c END AS p,
                     CASE WHEN c = 0 THEN (CASE WHEN value = a THEN 0.0 ELSE 1.0 END) ELSE value - a END AS q FROM v),
        u AS (SELECT *, CASE WHEN abs(p) >= abs(q) THEN sign(p) ELSE sign(q) END / sqrt(p * p + q * q) AS f FROM d)
        SELECT component::integer AS component, round(value / (a + b), 8) AS share, round(p * f, 8) AS words_count,
               round(q * f, 8) AS link_count FROM u""",
    "ridge_path_metadata": f"""
        SELECT reg_param, count(*) AS "rows", true AS settled
        FROM points, (VALUES {REG_ROWS}) AS regs(reg_param) WHERE part = 'train' GROUP BY reg_param""",
    # The cut between two hours that leaves the least squared error.
    "tree_on_hour": """
        WITH hours AS (SELECT f.hour, s.score_double AS y, part FROM features f JOIN scored s ON f.id = s.id JOIN parts p ON f.id = p.id),
        sums AS (SELECT hour, count(*) AS n, sum(y) AS t FROM hours WHERE part = 'train' GROUP BY hour),
        sides AS (
            SELECT hour, lead(hour) OVER (ORDER BY hour) AS next_hour, sum(n) OVER u AS nl, sum(t) OVER u AS tl,
                   sum(n) OVER () AS n, sum(t) OVER () AS t
            FROM sums WINDOW u AS (ORDER BY hour ROWS UNBOUNDED PRECEDING)),
        best AS (
            SELECT (hour + next_hour) / 2 AS cut, tl / nl AS below, (t - tl) / (n - nl) AS above
            FROM sides WHERE next_hour IS NOT NULL
            ORDER BY tl * tl / nl + (t - tl) * (t - tl) / (n - nl) DESC, hour LIMIT 1)
        SELECT hour, count(*) AS "rows", round(max(CASE WHEN hour <= cut THEN below ELSE above END), 6) AS prediction
        FROM hours, best GROUP BY hour""",
    "prediction_sample": """
        SELECT p.id, k.body, array_to_string(t.words, '|') AS words, y AS score_double,
               round(prediction, 6) AS prediction, round((y - prediction) ** 2, 4) AS sq_err
        FROM two_predictions p JOIN kept k ON p.id = k.id JOIN tokens t ON p.id = t.id
        WHERE part = 'test' ORDER BY p.id LIMIT 10""",
    "last_predictions": """
        SELECT id, y AS score_double, round(prediction, 6) AS prediction
        FROM two_predictions WHERE part = 'test' ORDER BY id DESC LIMIT 5""",
}
QUERIES["features_reloaded"] = QUERIES["features_metadata"]
QUERIES["run_counts"] = QUERIES["stage_counts"]
QUERIES["lexicon_filter_by_join"] = QUERIES["lexicon_filter"]
QUERIES["lexicon_file_hits"] = QUERIES["lexicon_hits"]

ALL = {name: _query(sql) for name, sql in QUERIES.items()}
