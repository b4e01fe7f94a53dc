"""The registered queries as DuckDB SQL over the same tables, written from the rules, not from the plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from registry import views
from registry.queries import SEARCH_PHRASE
from shelfwise import fixed_values as fixed
from shelfwise.functions.text import Lexicon


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def listed(words: Sequence[str]) -> str:
    return ", ".join(quoted(w) for w in words)


def values(rows: Sequence[Sequence]) -> str:
    cells = [", ".join(quoted(c) if isinstance(c, str) else f"{c!r}::DOUBLE" for c in row) for row in rows]
    return "(VALUES " + ", ".join(f"({c})" for c in cells) + ")"


VIEWS = {
    "docs": "SELECT doc_id AS id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents",
    "lens": "SELECT id, len(toks) AS dl FROM docs",
    "tfs": "SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest(toks) AS w FROM docs) GROUP BY ALL",
    "totals": "SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lens",
    "dfs": "SELECT term, count(*) AS df FROM tfs GROUP BY term",
    "queries": """SELECT item_id AS qid,
        regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM benchmark""",
    "query_terms": "SELECT DISTINCT qid, unnest(toks) AS term FROM queries",
    "hits": """SELECT q.qid, t.id,
        sum(ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0
            / (tf + 1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))) AS score
        FROM query_terms q JOIN tfs t USING (term) JOIN dfs USING (term) JOIN lens l ON l.id = t.id, totals
        GROUP BY ALL""",
    "products": """SELECT p_partkey AS id, p_name AS title, concat_ws(' ', p_brand, p_type) AS description,
        p_type AS category, p_brand AS brand, string_split(p_name, ' ')[2] AS material, p_retailprice AS price,
        coalesce(greatest(1.0e0, 5.0e0 - 0.4e0 * cents / n), 1.0e0) AS rating, coalesce(n, 0) AS rating_count,
        created_at
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n,
            sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS cents, min(l_shipdate)::DATE AS created_at
            FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "reviews": """SELECT d.doc_id AS id, lang || '-' || source AS product_id, lang AS category,
        floor(d.doc_id / 5)::BIGINT AS author, text AS body,
        DATE '2024-01-01' + CAST(n_chars % 12 AS INTEGER) AS created_at, n_chars % 50 AS helpful_votes,
        quality = 0 AS is_fake FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "transactions": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
        o_custkey AS buyer_id, l_extendedprice AS amount, sr.r_name AS shipping_region, br.r_name AS billing_region,
        date_diff('day', first_order::DATE, o_orderdate::DATE) AS age, o_orderdate AS created_at,
        l_returnflag = 'R' AS is_fraud
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation bn ON bn.n_nationkey = c_nationkey
        JOIN region br ON br.r_regionkey = bn.n_regionkey
        JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey
        JOIN region sr ON sr.r_regionkey = sn.n_regionkey
        JOIN (SELECT o_custkey AS k, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON k = o_custkey""",
    "history": """SELECT l_partkey AS product_id, l_shipdate::DATE AS date, sum(l_quantity)::BIGINT AS units,
        bool_or(l_returnflag = 'R') AS stockout, (l_partkey * 37 + sum(l_quantity)::BIGINT) % 200 AS stock,
        isodow(l_shipdate::DATE) - 1 AS wd FROM lineitem GROUP BY l_partkey, l_shipdate::DATE, wd""",
    "pricing": """SELECT p_partkey AS product_id, 1.15e0 + (p_partkey % 20) / 10.0e0 AS e,
        p_retailprice * (0.20e0 + (p_partkey % 5) / 10.0e0) AS c, p_retailprice AS p0, q0
        FROM part JOIN (SELECT l_partkey, sum(l_quantity)::BIGINT AS q0 FROM lineitem GROUP BY 1)
        ON l_partkey = p_partkey""",
    "cart_events": """SELECT user_id AS cart_id, event_id AS seq,
        CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' WHEN 'error' THEN 'remove'
            WHEN 'purchase' THEN 'clear' ELSE CASE WHEN event_id % 4 = 0 THEN 'clear' ELSE 'add' END END AS action,
        CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS product_id,
        floor(value)::BIGINT % 4 AS quantity FROM events""",
}


def sql(body: str, *extra: tuple[str, str], needs: str = "", recursive: bool = False) -> str:
    parts = [f"{name} AS ({VIEWS[name]})" for name in needs.split()]
    parts += [f"{name} AS ({text})" for name, text in extra]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def r9(expression: str) -> str:
    return f"round({expression}, 9) + 0.0e0"


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0e0"


def r4(expression: str) -> str:
    return f"round({expression}, 4) + 0.0e0"


def exact(expression: str, digits: int) -> str:
    return f"(printf('%.{digits}f', {expression})::DOUBLE + 0.0e0)"


def r9_columns(*names: str) -> str:
    return ", ".join(f"{r9(n)} AS {n}" for n in names)


SEARCH = "docs lens tfs totals dfs"


def sentiment_steps(source: str, lexicon: Lexicon, name: str) -> list[tuple[str, str]]:
    """``source(key, body)`` to ``name(key, score)``; a text without polarity words has no row."""
    polarity = values(list(lexicon.weights().items()))
    scale = values(list(lexicon.intensifiers.items()))
    negations = listed(lexicon.negations)
    return [
        (
            f"{name}_tok",
            f"""SELECT key, unnest(t) AS w, generate_subscripts(t, 1) AS i
            FROM (SELECT key, regexp_extract_all(lower(body), '[a-z'']+') AS t FROM {source})""",
        ),
        (
            f"{name}_near",
            f"""SELECT *, lag(w, 1) OVER p AS p1, lag(w, 2) OVER p AS p2, lag(w, 3) OVER p AS p3
            FROM {name}_tok WINDOW p AS (PARTITION BY key ORDER BY i)""",
        ),
        (
            name,
            f"""SELECT key, sum(polarity * CASE WHEN p1 IN ({negations}) OR p2 IN ({negations})
                OR p3 IN ({negations}) THEN -1 ELSE 1 END * coalesce(factor, 1.0e0) ORDER BY i) / count(*) AS score
            FROM {name}_near JOIN {polarity} AS a(word, polarity) ON w = word
            LEFT JOIN {scale} AS b(scaler, factor) ON p1 = scaler GROUP BY key""",
        ),
    ]


def aspect_steps(source: str, lexicon: Lexicon, keywords: Mapping) -> list[tuple[str, str]]:
    """``source(id, category, body)`` to ``opinions(id, aspect, score)``."""
    triggers = [
        (category, aspect, trigger)
        for category, aspects in keywords.items()
        for aspect, found in aspects.items()
        for trigger in found
    ]
    return [
        (
            "sentence",
            f"""SELECT id, category, {{'id': id, 'n': n}} AS key, body FROM (
                SELECT id, category, unnest(s) AS piece, generate_subscripts(s, 1) AS n,
                    trim(piece, {quoted(fixed.WHITESPACE)}) AS body
                FROM (SELECT id, category, string_split_regex(body, '[.!?]+') AS s FROM {source}))
            WHERE body <> ''""",
        ),
        *sentiment_steps("sentence", lexicon, "sentence_score"),
        (
            "mention",
            f"""SELECT DISTINCT s.id, s.key, aspect FROM sentence s
            JOIN {values(triggers)} AS k(cat, aspect, trigger) ON cat = category AND contains(lower(body), trigger)""",
        ),
        (
            "opinions",
            """SELECT id, aspect, sum(coalesce(score, 0) ORDER BY m.key) / count(*) AS score
            FROM mention m LEFT JOIN sentence_score USING (key) GROUP BY id, aspect""",
        ),
    ]


def analysis_steps(digits: int | None) -> list[tuple[str, str]]:
    def rounded(expression: str) -> str:
        return expression if digits is None else exact(expression, digits)

    return [
        *sentiment_steps("(SELECT id AS key, body FROM reviews)", views.LEXICON, "review_score"),
        *aspect_steps("reviews", views.LEXICON, views.ASPECTS),
        ("per_review", "SELECT id, count(*) AS n_aspects FROM opinions GROUP BY id"),
        ("copies", "SELECT body, count(*) AS copies FROM reviews GROUP BY body"),
        (
            "bursts",
            """SELECT author, (count(*) >= 3 AND count(DISTINCT product_id) >= 3
            AND max(created_at) - min(created_at) <= 7) AS burst FROM reviews GROUP BY author""",
        ),
        (
            "indicators",
            f"""SELECT r.id AS review_id, r.product_id, r.helpful_votes, r.is_fake,
            {rounded("coalesce(score, 0.0e0)")} AS sentiment_score, coalesce(n_aspects, 0) AS n_aspects,
            len(regexp_extract_all(lower(r.body), '[a-z'']+')) AS n_tokens,
            len(r.body) - len(replace(r.body, '!', '')) >= 2 AS punchy,
            CASE WHEN n_tokens = 0 OR coalesce(n_aspects, 0) > 0 THEN 0.0e0 WHEN n_tokens <= 12 AND punchy THEN 1.0e0
                WHEN n_tokens <= 12 OR punchy THEN 0.5e0 ELSE 0.0e0 END AS generic_text,
            CASE WHEN copies >= 3 THEN 1.0e0 ELSE 0.0e0 END AS duplicate_text,
            CASE WHEN burst THEN 1.0e0 ELSE 0.0e0 END AS author_burst
            FROM reviews r LEFT JOIN review_score s ON s.key = r.id LEFT JOIN per_review p ON p.id = r.id
            JOIN copies USING (body) JOIN bursts USING (author)""",
        ),
        (
            "analysis",
            f"""SELECT *, {rounded("0.4e0 * duplicate_text + 0.35e0 * author_burst + 0.25e0 * generic_text")}
            AS fake_score, fake_score >= 0.5e0 AS likely_fake FROM indicators""",
        ),
    ]


SUMMARY_STEPS = [
    *analysis_steps(None),
    (
        "pool",
        """SELECT a.* FROM analysis a JOIN (SELECT product_id, bool_and(likely_fake) AS only_fake
        FROM analysis GROUP BY 1) USING (product_id) WHERE only_fake OR NOT likely_fake""",
    ),
    (
        "badges",
        """SELECT product_id, aspect, sum(o.score) / count(*) AS mean, count(*) AS mentions
        FROM pool JOIN opinions o ON o.id = review_id GROUP BY product_id, aspect""",
    ),
]


def evaluation(source: str, flag: str, truth: str) -> str:
    return f"""SELECT true_positives, false_positives, false_negatives, true_negatives,
        {r9("p")} AS precision, {r9("r")} AS recall,
        {r9("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END")} AS f1
        FROM (SELECT *, CASE WHEN true_positives + false_positives > 0
                THEN true_positives / (true_positives + false_positives) ELSE 0.0e0 END AS p,
            CASE WHEN true_positives + false_negatives > 0
                THEN true_positives / (true_positives + false_negatives) ELSE 0.0e0 END AS r
        FROM (SELECT count(*) FILTER ({flag} AND {truth}) AS true_positives,
            count(*) FILTER ({flag} AND NOT {truth}) AS false_positives,
            count(*) FILTER (NOT {flag} AND {truth}) AS false_negatives,
            count(*) FILTER (NOT {flag} AND NOT {truth}) AS true_negatives FROM {source}))"""


PAIRS = (
    "pairs",
    """SELECT q.qid, d.vec_id AS id, coalesce(h.score, 0.0e0) AS kw,
        list_dot_product(d.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cs
        FROM queries q JOIN embeddings e ON e.vec_id = q.qid, lens JOIN embeddings d ON d.vec_id = lens.id
        LEFT JOIN hits h ON h.qid = q.qid AND h.id = d.vec_id""",
)
# the search corpus is what both documents and embeddings know
HYBRID_VIEWS = {**VIEWS, "docs": VIEWS["docs"] + " JOIN embeddings ON vec_id = doc_id"}


def hybrid_steps(alpha: float) -> list[str]:
    """From ``pairs(qid, id, kw, cs)`` to ``ranked``."""
    return [
        """ext AS (SELECT qid, min(kw) AS kl, max(kw) AS kh, min(cs) AS cl, max(cs) AS ch FROM pairs GROUP BY qid)""",
        """scaled AS (SELECT p.*, CASE WHEN kh - kl < 1e-9 THEN 0 ELSE (kw - kl) / (kh - kl) END AS kn,
            CASE WHEN ch - cl < 1e-9 THEN 0 ELSE (cs - cl) / (ch - cl) END AS cn FROM pairs p JOIN ext USING (qid))""",
        f"fuse AS (SELECT *, round({alpha}e0 * kn + {1 - alpha}e0 * cn, 9) AS fused FROM scaled)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM fuse)",
    ]


def hybrid(columns: str, limit: int, alpha: float) -> str:
    parts = [f"{n} AS ({HYBRID_VIEWS[n]})" for n in (SEARCH + " queries query_terms hits").split()]
    parts += [f"pairs AS ({PAIRS[1]})", *hybrid_steps(alpha)]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT qid, id AS doc_id, rank, {columns} FROM ranked "
        f"JOIN documents ON doc_id = id WHERE rank <= {limit}"
    )


def rerank_steps(pool: str, limit: int, weights: Mapping[str, float]) -> list[tuple[str, str]]:
    return [
        (
            "boosted",
            f"""SELECT *, {weights['rating']!r}::DOUBLE * ((rating - 1) / 4) AS rating_boost,
            {weights['popularity']!r}::DOUBLE * least(1.0e0, log10(rating_count + 1) / log10(4201)) AS popularity_boost,
            base_score + rating_boost + popularity_boost AS final_score,
            category || '::' || lower(string_split(title, ' ')[1]) AS dkey FROM {pool}""",
        ),
        (
            "penalised",
            f"""SELECT *, {weights['diversity']!r}::DOUBLE * (row_number() OVER (PARTITION BY qid, dkey
            ORDER BY final_score DESC, id) - 1) AS diversity_penalty,
            final_score - diversity_penalty AS adjusted_score FROM boosted""",
        ),
        (
            "reranked",
            f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY adjusted_score DESC, id) AS rank
            FROM penalised) WHERE rank <= {limit}""",
        ),
    ]


CATEGORY_POOL = rerank_steps(
    "(SELECT *, category AS qid, price / 2000 AS base_score FROM products)", 12, fixed.SEARCH_WEIGHTS
)


def velocity(source: str, minutes: int) -> str:
    return f"""SELECT *, CASE WHEN nearby >= 3 THEN 1.0e0 WHEN nearby = 2 THEN 0.6e0 WHEN nearby = 1 THEN 0.3e0
        ELSE 0.0e0 END AS velocity FROM (SELECT *, count(*) OVER (PARTITION BY buyer_id ORDER BY created_at
        RANGE BETWEEN INTERVAL {minutes} MINUTES PRECEDING AND INTERVAL {minutes} MINUTES FOLLOWING) - 1 AS nearby
        FROM {source})"""


EVENT_TRANSACTIONS = "(SELECT event_id AS id, user_id AS buyer_id, ts AS created_at FROM events)"
FRAUD_STEPS = [
    (
        "scored",
        f"""SELECT *, CASE WHEN shipping_region = billing_region THEN 0.0e0 WHEN age <= 14 THEN 1.0e0
            ELSE 0.4e0 END AS region_risk,
        CASE WHEN age <= 14 AND amount >= 50000 THEN 1.0e0 ELSE 0.0e0 END AS new_account_high_value,
        {exact("0.55e0 * velocity + 0.3e0 * region_risk + 0.25e0 * new_account_high_value", 3)} AS fraud_score,
        fraud_score >= 0.5e0 AS likely_fraud FROM ({velocity("transactions", 15)})""",
    )
]

SEASON_STEPS = [
    (
        "season",
        """SELECT p.product_id, w AS wd, coalesce(m / CASE WHEN mean = 0 THEN 1e-6 ELSE mean END, 1.0e0) AS factor
        FROM (SELECT product_id, avg(units) AS mean FROM history GROUP BY 1) p
        JOIN (SELECT unnest(range(7)) AS w) ON true
        LEFT JOIN (SELECT product_id, wd, avg(units) AS m FROM history GROUP BY 1, 2) d
            ON d.product_id = p.product_id AND d.wd = w""",
    )
]
HOLT_STEPS = [
    *SEASON_STEPS,
    (
        "demand",
        """SELECT h.product_id, units / CASE WHEN factor = 0 THEN 1 ELSE factor END AS x, stockout,
        row_number() OVER (PARTITION BY h.product_id ORDER BY date) AS i,
        count(*) OVER (PARTITION BY h.product_id) AS n FROM history h JOIN season s USING (product_id, wd)""",
    ),
    (
        "fold",
        """SELECT a.product_id, 1 AS i, a.n, a.x AS level, coalesce(b.x - a.x, 0) AS trend
        FROM demand a LEFT JOIN demand b ON b.product_id = a.product_id AND b.i = 2 WHERE a.i = 1
        UNION ALL
        SELECT product_id, i, n, nl, 0.1e0 * (nl - level) + 0.9e0 * trend FROM (
            SELECT d.product_id, d.i, d.n, f.level, f.trend,
            0.3e0 * CASE WHEN d.stockout THEN f.level + f.trend ELSE d.x END + 0.7e0 * (f.level + f.trend) AS nl
            FROM fold f JOIN demand d ON d.product_id = f.product_id AND d.i = f.i + 1)""",
    ),
    ("state", "SELECT product_id, level, trend FROM fold WHERE i = n"),
]
FORECAST_STEPS = [
    *HOLT_STEPS,
    (
        "lastday",
        """SELECT product_id, max_by(stock, date) AS current_stock, max_by(wd, date) AS wd, stddev_pop(units) AS sd,
        count(*) FILTER (stockout) AS stockout_days_observed FROM history GROUP BY 1""",
    ),
    (
        "ahead",
        """SELECT s.product_id, avg(greatest(0.0e0, (level + h * trend) * factor)) AS f
        FROM state s JOIN lastday l USING (product_id) JOIN (SELECT unnest(range(1, 15)) AS h) ON true
        JOIN season e ON e.product_id = s.product_id AND e.wd = (l.wd + h) % 7 GROUP BY 1""",
    ),
    (
        "forecast",
        f"""SELECT product_id, current_stock, {r6("f")} AS avg_daily_forecast, {r6("sd")} AS demand_std_dev,
        f * 7 + 1.65e0 * sd * sqrt(7.0e0) AS point, {r6("f * 7 + 1.65e0 * sd * sqrt(7.0e0)")} AS reorder_point,
        {r6("CASE WHEN f > 1e-6 THEN current_stock / f ELSE -1.0e0 END")} AS days_of_supply,
        current_stock <= f * 7 + 1.65e0 * sd * sqrt(7.0e0) AS needs_reorder, stockout_days_observed
        FROM ahead JOIN lastday USING (product_id)""",
    ),
]

PRICE_STEPS = [
    (
        "best",
        f"""SELECT *, CASE WHEN e > 1 THEN {exact("c * e / (e - 1)", 2)} END AS p, q0 * pow(p / p0, -e) AS q,
        (p0 - c) * q0 AS profit, (p - c) * q AS best_profit, {exact("(p - p0) / p0 * 100", 1)} AS change
        FROM pricing""",
    ),
    (
        "priced",
        """SELECT *, CASE WHEN change >= 5 THEN 'raise' WHEN change <= -5 THEN 'lower'
        WHEN change IS NOT NULL THEN 'near-optimal' END AS recommendation FROM best""",
    ),
]

CART_STEPS = [
    (
        "steps",
        """SELECT *, row_number() OVER (PARTITION BY cart_id, product_id ORDER BY seq) AS i,
        count(*) OVER (PARTITION BY cart_id, product_id) AS n FROM (
            SELECT * FROM cart_events WHERE action <> 'clear'
            UNION ALL SELECT c.cart_id, c.seq, 'remove', p.product_id, 0 FROM cart_events c
            JOIN (SELECT DISTINCT cart_id, product_id FROM cart_events WHERE action <> 'clear') p
                ON p.cart_id = c.cart_id WHERE action = 'clear')""",
    ),
    (
        "replay",
        """SELECT cart_id, product_id, 0::BIGINT AS i, NULL::BIGINT AS quantity FROM steps WHERE i = 1
        UNION ALL
        SELECT s.cart_id, s.product_id, s.i, CASE s.action WHEN 'add' THEN coalesce(r.quantity, 0) + s.quantity
            WHEN 'set' THEN CASE WHEN s.quantity > 0 AND r.quantity IS NOT NULL THEN s.quantity END END
        FROM replay r JOIN steps s ON s.cart_id = r.cart_id AND s.product_id = r.product_id AND s.i = r.i + 1""",
    ),
    (
        "lines",
        """SELECT r.cart_id, r.product_id, r.quantity FROM replay r JOIN steps s
        ON s.cart_id = r.cart_id AND s.product_id = r.product_id AND s.i = r.i AND s.i = s.n
        WHERE r.quantity IS NOT NULL""",
    ),
]

NOUN_ROWS = values(views.NOUNS)
NOUN_LIST = "[" + listed([noun for noun, _ in views.NOUNS]) + "]"
CREDIT_STEPS = [
    (
        "photo",
        f"""SELECT noun, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM (
            SELECT *, {NOUN_LIST}[page_id % {len(views.NOUNS)} + 1] AS noun FROM pages)
        GROUP BY noun""",
    ),
    (
        "noun_products",
        f"""SELECT noun, id FROM products p JOIN {NOUN_ROWS} AS n(noun, cat)
        ON cat = category AND contains(title, noun)""",
    ),
    (
        "credit",
        """SELECT id AS product_id, noun, url || '.jpeg' AS commons_title, url AS source_url, 'someone' AS artist,
        'CC0' AS license, '' AS license_url, 'jpg' AS extension FROM noun_products JOIN photo USING (noun)""",
    ),
]

OVERRIDE = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in views.PHOTO_OVERRIDES.items())
WORD_KEYWORDS = listed([k for k in views.PHOTO_KEYWORDS if k.isalnum()])
PHRASE_TESTS = " OR ".join(f"contains(body, {quoted(k)})" for k in views.PHOTO_KEYWORDS if not k.isalnum())
PHOTO_STEPS = [
    (
        "candidate",
        f"""SELECT noun, page_id AS position, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        ['CC0', ' cc-by ', 'GFDL', 'Public domain'][page_id % 4 + 1] AS license,
        lower(title || ' ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS body,
        coalesce(nullif(regexp_extract(url, '(\\.[a-z]+)$', 1), ''), 'none') AS extension,
        CASE noun {OVERRIDE} ELSE noun END AS phrase
        FROM pages, (SELECT unnest([{listed(views.PHOTO_NOUNS)}]) AS noun)""",
    ),
    (
        "checked",
        f"""SELECT *, title NOT IN ({listed(views.PHOTO_REJECTED)}) AS not_rejected,
        extension IN ('.html', 'none') AS extension_allowed,
        lower(trim(license)) IN ({listed(fixed.PHOTO_LICENSES)}) AS license_allowed,
        list_filter(list_transform(regexp_extract_all(phrase, '[a-zA-Z]+'), lambda w: lower(w)), lambda w: w <> 'the')
            AS wanted,
        len(wanted) > 0 AND list_has_all(list_transform(regexp_extract_all(title, '[a-zA-Z]+'), lambda w: lower(w)),
            wanted) AS covers_words,
        NOT (list_has_any(regexp_extract_all(body, '[a-z0-9]+'), [{WORD_KEYWORDS}]) OR {PHRASE_TESTS})
            AS no_negative_keyword,
        NOT (regexp_matches(body, '\\b(1[6-9]\\d{{2}}|19[0-8]\\d)\\b')
            OR regexp_matches(body, '\\b\\d{{1,2}}(st|nd|rd|th)[\\s-]century\\b') OR contains(body, 'century'))
            AS not_historical,
        not_rejected AND extension_allowed AND license_allowed AND covers_words AND no_negative_keyword
            AND not_historical AS accepted FROM candidate""",
    ),
]

CATALOG_VIEWS = {
    **VIEWS,
    "docs": """SELECT id, regexp_extract_all(lower(title || ' ' || description), '[a-z0-9]+') AS toks
        FROM products JOIN embeddings ON vec_id = id""",
    "queries": """SELECT min(vec_id) AS qid, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS toks
        FROM part JOIN embeddings ON vec_id = p_partkey GROUP BY p_name""",
}
CATALOG_SEARCH = (
    "WITH "
    + ",\n".join(
        [f"{n} AS ({CATALOG_VIEWS[n]})" for n in ("products " + SEARCH + " queries query_terms hits").split()]
        + [f"pairs AS ({PAIRS[1]})", *hybrid_steps(0.5)]
        + [
            f"{n} AS ({s})"
            for n, s in rerank_steps(
                "(SELECT qid, id, fused AS base_score, p.* EXCLUDE (id) FROM ranked JOIN products p USING (id) WHERE rank <= 30)",
                12,
                fixed.SEARCH_WEIGHTS,
            )
        ]
    )
    + f"\nSELECT qid, id, rank, title, {r9('base_score')} AS base_score, {r9('adjusted_score')} AS adjusted_score"
    + " FROM reranked WHERE rating >= 2.9e0"
)

PHRASE_TERMS = sorted(set(SEARCH_PHRASE.split()))

ORACLES: dict[str, str] = {
    "bm25_topk": sql(
        f"""SELECT id AS doc_id, {r9("score")} AS score FROM (
            SELECT l.id, round(coalesce(score, 0), 9) AS score FROM lens l LEFT JOIN hits h ON h.id = l.id)
        ORDER BY score DESC, id LIMIT 20""",
        ("query_terms", f"SELECT 0 AS qid, unnest([{listed(PHRASE_TERMS)}]) AS term"),
        ("hits", VIEWS["hits"]),
        needs=SEARCH,
    ),
    "text_measures": f"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS search_tokens,
        len(regexp_extract_all(lower(text), '[a-z'']+')) AS review_tokens,
        len(list_filter(string_split_regex(text, '[.!?]+'),
            lambda s: trim(s, {quoted(fixed.WHITESPACE)}) <> '')) AS sentences FROM documents""",
    "postings": sql(
        "SELECT term, id AS doc_id, tf, dl AS length FROM tfs JOIN lens USING (id)", needs="docs lens tfs"
    ),
    "term_statistics": sql(
        f"SELECT term, df, {r9('ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0))')} AS idf FROM dfs, totals",
        needs=SEARCH,
    ),
    "corpus_totals": sql(f"SELECT n_docs, {r9('avgdl')} AS avg_length FROM totals", needs="docs lens totals"),
    "bm25_batch": sql(
        f"""SELECT qid, id AS doc_id, {r9("score")} AS score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
                SELECT q.qid, l.id, round(coalesce(h.score, 0), 9) AS score FROM queries q JOIN lens l ON true
                LEFT JOIN hits h ON h.qid = q.qid AND h.id = l.id)) WHERE rank <= 5""",
        needs=SEARCH + " queries query_terms hits",
    ),
    "hybrid_search": hybrid(
        ", ".join(
            f"{r9(e)} AS {n}"
            for e, n in [
                ("kw", "bm25_raw"), ("kn", "bm25_normalized"), ("cs", "semantic_raw_cosine"),
                ("cn", "semantic_normalized"), ("fused", "fused"),
                ("0.5e0 * kn / CASE WHEN 0.5e0 * kn + 0.5e0 * cn = 0 THEN 1 ELSE 0.5e0 * kn + 0.5e0 * cn END",
                 "keyword_share"),
            ]
        ),
        12,
        0.5,
    ),
    "hybrid_keyword_only": hybrid(r9_columns("fused") + ", lang, source", 10, 1.0),
    "hybrid_semantic_only": hybrid(r9_columns("fused"), 10, 0.0),
    "minmax_normalize": f"""SELECT event_id, event_type,
        {r9("CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (value - lo) / (hi - lo) END")} AS normalized
        FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
        USING (event_type)""",
    "embed_documents": f"""WITH tok AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h
        FROM documents), place AS (SELECT doc_id, CAST('0x' || h[1:8] AS BIGINT) % 64 AS place,
            sum(CASE WHEN CAST('0x' || h[9:9] AS BIGINT) < 8 THEN 1.0e0 ELSE -1.0e0 END) AS x FROM tok GROUP BY ALL),
        scaled AS (SELECT doc_id, place, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM place WHERE x <> 0)
        SELECT doc_id, place, {r6("weight")} AS weight FROM scaled WHERE round(weight, 6) <> 0""",
    "knn_cosine": f"""SELECT qid, id AS vec_id, rank, {r9("score")} AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
            SELECT a.vec_id AS qid, b.vec_id AS id,
            round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 12""",
    "similar_for_ids": f"""SELECT qid, id AS vec_id, rank, {r9("score")} AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
            SELECT a.vec_id AS qid, b.vec_id AS id,
            round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
            WHERE a.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 12""",
    "search_manifest": sql(
        f"""SELECT count(*) AS n_docs, max(len(embedding)) AS dim, {r9("avg(dl)")} AS avg_length,
        {fixed.BM25_K1}::DOUBLE AS k1, {fixed.BM25_B}::DOUBLE AS b, {fixed.FUSION_ALPHA}::DOUBLE AS alpha
        FROM lens JOIN embeddings ON vec_id = id""",
        needs="docs lens",
    ),
    "align_embeddings": f"""SELECT p_partkey AS id, p_name AS title,
        {r9("list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])")} AS squared_norm
        FROM part JOIN embeddings ON vec_id = p_partkey""",
    "similar_products": sql(
        f"SELECT qid, id, rank, {r9_columns('base_score', 'diversity_penalty', 'adjusted_score')} FROM reranked",
        (
            "near",
            """SELECT a.vec_id AS qid, b.vec_id AS id,
            round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS base_score
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
            WHERE a.vec_id IN (SELECT id FROM products) AND b.vec_id IN (SELECT id FROM products)""",
        ),
        (
            "candidates",
            """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_score DESC, id) AS place
            FROM near) JOIN products USING (id) WHERE place <= 12""",
        ),
        *rerank_steps("candidates", 4, fixed.RECOMMENDATION_WEIGHTS),
        needs="products",
    ),
    "rerank_diverse": sql(
        "SELECT qid, id, rank, "
        + r9_columns(
            "base_score", "rating_boost", "popularity_boost", "diversity_penalty", "final_score", "adjusted_score"
        )
        + " FROM reranked",
        *CATEGORY_POOL,
        needs="products",
    ),
    "search_page": sql(
        f"""SELECT qid, id, rank, price, {r9("rating")} AS rating FROM reranked
        WHERE rating >= 2.9e0 AND price <= 2500""",
        *CATEGORY_POOL,
        needs="products",
    ),
    "category_page": sql(
        f"""SELECT id, title, brand, price, {r9("rating")} AS rating FROM products
        WHERE category = 'STANDARD' AND rating >= 2.5e0
        AND brand IN ({listed([f"Brand#{n}" for n in range(1, 16)])})""",
        needs="products",
    ),
    "category_slugs": """SELECT label, trim(regexp_replace(replace(lower(label), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '-')
        AS slug FROM (SELECT DISTINCT p_type || ' & ' || p_brand AS label FROM part)""",
    "faceted_filter": sql(
        f"""SELECT id, material, price, {r9("rating")} AS rating FROM products
        WHERE rating >= 3.0e0 AND price <= 1000 AND material IN ('ring', 'bolt', 'rod')""",
        needs="products",
    ),
    "facets": sql(
        """SELECT 'brand' AS facet, brand AS value FROM products UNION
        SELECT 'material', material FROM products""",
        needs="products",
    ),
    "price_ceiling": "SELECT ceil(max(p_retailprice))::BIGINT AS price_max FROM part",
    "top_rated": sql(
        f"""SELECT id, rating_count, {r9("rating")} AS rating FROM products
        ORDER BY products.rating * rating_count DESC, id LIMIT 10""",
        needs="products",
    ),
    "newest": sql(
        "SELECT id, title, created_at FROM products ORDER BY created_at DESC NULLS LAST, id LIMIT 10",
        needs="products",
    ),
    "product_detail": sql("SELECT id, title, category, brand, price FROM products WHERE id = 7", needs="products"),
    "sentiment": sql(
        f"""SELECT doc_id, {r9("coalesce(a.score, 0)")} AS default_score, {r9("coalesce(b.score, 0)")} AS custom_score
        FROM documents LEFT JOIN plain a ON a.key = doc_id LEFT JOIN custom b ON b.key = doc_id""",
        *sentiment_steps("(SELECT doc_id AS key, text AS body FROM documents)", Lexicon(), "plain"),
        *sentiment_steps("(SELECT doc_id AS key, text AS body FROM documents)", views.LEXICON, "custom"),
    ),
    "aspects": sql(
        f"SELECT id AS doc_id, aspect, {r9('score')} AS score FROM opinions",
        *aspect_steps(
            "(SELECT doc_id AS id, lang AS category, text AS body FROM documents)", views.LEXICON, views.ASPECTS
        ),
    ),
    "duplicate_text": """SELECT doc_id, copies, copies >= 3 AS is_duplicate FROM documents JOIN
        (SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) >= 2) USING (text)""",
    "author_burst": """SELECT *, reviews >= 3 AND products >= 3 AND span_days <= 1500 AS burst FROM (
        SELECT o_custkey AS author, count(*) AS reviews, count(DISTINCT l_partkey) AS products,
        date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS span_days
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)""",
    "fake_score": sql(
        f"""SELECT review_id, product_id, {r9("sentiment_score")} AS sentiment_score, n_aspects, generic_text,
        duplicate_text, author_burst, fake_score, likely_fake FROM analysis""",
        *analysis_steps(3),
        needs="reviews",
    ),
    "review_summary": sql(
        f"""SELECT product_id, review_count, {r9("mean")} AS avg_sentiment, likely_fake_count,
        coalesce(n, 0) AS n_aspects FROM (SELECT product_id, count(*) AS review_count,
            count(*) FILTER (likely_fake) AS likely_fake_count FROM analysis GROUP BY 1)
        JOIN (SELECT product_id, avg(sentiment_score) AS mean FROM pool GROUP BY 1) USING (product_id)
        LEFT JOIN (SELECT product_id, count(*) AS n FROM badges GROUP BY 1) USING (product_id)""",
        *SUMMARY_STEPS,
        needs="reviews",
    ),
    "aspect_summary": sql(
        f"""SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, aspect) - 1 AS position,
        aspect, {r9("mean")} AS avg_sentiment, mentions,
        CASE WHEN mean > 0.3e0 THEN 'positive' WHEN mean < -0.3e0 THEN 'negative' ELSE 'neutral' END AS polarity
        FROM badges""",
        *SUMMARY_STEPS,
        needs="reviews",
    ),
    "review_evaluation": sql(
        evaluation("(SELECT * FROM analysis WHERE is_fake IS NOT NULL)", "likely_fake", "is_fake"),
        *analysis_steps(3),
        needs="reviews",
    ),
    "product_reviews": sql(
        """SELECT review_id AS id, product_id, helpful_votes, sentiment_score, fake_score, likely_fake FROM analysis""",
        *analysis_steps(3),
        needs="reviews",
    ),
    "review_manifest": sql(
        """SELECT count(*) AS num_reviews, count(*) FILTER (likely_fake) AS num_likely_fake,
        count(DISTINCT product_id) AS num_products, '{"fake_score_threshold": 0.5}' AS parameters FROM analysis""",
        *analysis_steps(3),
        needs="reviews",
    ),
    "velocity": f"SELECT id, nearby, velocity FROM ({velocity(EVENT_TRANSACTIONS, 15)})",
    "velocity_six_hours": f"SELECT id, nearby, velocity FROM ({velocity(EVENT_TRANSACTIONS, 360)})",
    "fraud_score": sql(
        """SELECT id, velocity, region_risk, new_account_high_value, fraud_score, likely_fraud FROM scored""",
        *FRAUD_STEPS,
        needs="transactions",
    ),
    "fraud_report": sql(
        """SELECT id, buyer_id, amount, fraud_score, likely_fraud FROM scored
        ORDER BY fraud_score DESC, id LIMIT 200""",
        *FRAUD_STEPS,
        needs="transactions",
    ),
    "fraud_evaluation": sql(evaluation("scored", "likely_fraud", "is_fraud"), *FRAUD_STEPS, needs="transactions"),
    "seasonal_index": sql(
        f"SELECT product_id, wd AS weekday, {r9('factor')} AS factor FROM season", *SEASON_STEPS, needs="history"
    ),
    "holt_state": sql(
        f"SELECT product_id, {r6('level')} AS level, {r6('trend')} AS trend FROM state",
        *HOLT_STEPS,
        needs="history",
        recursive=True,
    ),
    "inventory_forecast": sql(
        """SELECT product_id, current_stock, needs_reorder, stockout_days_observed, avg_daily_forecast, demand_std_dev,
        reorder_point, days_of_supply FROM forecast""",
        *FORECAST_STEPS,
        needs="history",
        recursive=True,
    ),
    "supply_report": sql(
        """SELECT product_id, p_name AS title, current_stock, days_of_supply FROM forecast
        LEFT JOIN part ON p_partkey = product_id ORDER BY days_of_supply, product_id LIMIT 200""",
        *FORECAST_STEPS,
        needs="history",
        recursive=True,
    ),
    "reorder_count": sql(
        """SELECT count(*) AS num_products, count(*) FILTER (needs_reorder) AS num_products_needing_reorder
        FROM forecast""",
        *FORECAST_STEPS,
        needs="history",
        recursive=True,
    ),
    "price_recommendation": sql(
        "SELECT product_id, recommendation, "
        + ", ".join(
            f"{r4(e)} AS {n}"
            for e, n in [
                ("e", "elasticity"), ("c", "marginal_cost"), ("p0", "current_price"),
                ("q0::DOUBLE", "current_quantity"), ("p0 * q0", "current_revenue"), ("profit", "current_profit"),
                ("p", "optimal_price"), ("q", "optimal_quantity"), ("p * q", "optimal_revenue"),
                ("best_profit", "optimal_profit"), ("change", "price_change_pct"),
                ("CASE WHEN profit = 0 THEN 0 ELSE (best_profit - profit) / profit * 100 END", "profit_uplift_pct"),
            ]
        )
        + " FROM priced",
        *PRICE_STEPS,
        needs="pricing",
    ),
    "price_curve": sql(
        f"""SELECT product_id, m AS price_multiplier, {r4("price")} AS price, {r4("quantity")} AS quantity,
        {r4("price * quantity")} AS revenue, {r4("(price - c) * quantity")} AS profit
        FROM (SELECT *, q0 * pow(price / p0, -e) AS quantity FROM (SELECT *, {exact("p0 * m", 2)} AS price
            FROM pricing, (SELECT unnest({fixed.CURVE_MULTIPLIERS!r}::DOUBLE[]) AS m)))""",
        needs="pricing",
    ),
    "price_label_counts": sql(
        f"""SELECT recommendation, count(product_id) AS products FROM
        (SELECT unnest([{listed(fixed.PRICE_LABELS)}]) AS recommendation) LEFT JOIN priced USING (recommendation)
        GROUP BY 1""",
        *PRICE_STEPS,
        needs="pricing",
    ),
    "photo_checks": sql(
        """SELECT noun, position, not_rejected, extension_allowed, license_allowed, covers_words, no_negative_keyword,
        not_historical, accepted FROM checked""",
        *PHOTO_STEPS,
    ),
    "photo_match": sql(
        """SELECT noun, position, title, license FROM (SELECT *, row_number() OVER (PARTITION BY noun
        ORDER BY position) AS place FROM checked WHERE accepted) WHERE place = 1""",
        *PHOTO_STEPS,
    ),
    "photo_pages": """WITH named AS (SELECT *, 'File:' || regexp_replace(url, '[./]', '_', 'g')
            || ['.JPEG', '.png', '', '.', '.tar.Jpg'][page_id % 5 + 1] AS title FROM pages)
        SELECT page_id AS position, title, CASE WHEN page_id % 2 = 0 THEN url || '?thumb' ELSE url END AS url,
        CASE WHEN page_id % 3 <> 0 THEN 'page ' || page_id ELSE 'unknown' END AS artist,
        CASE WHEN page_id % 3 <> 0 THEN 'CC0' ELSE 'unknown' END AS license, '' AS license_url,
        ['.jpeg', '.png', '', '', '.jpg'][page_id % 5 + 1] AS suffix,
        ['jpg', 'png', 'jpg', 'jpg', 'jpg'][page_id % 5 + 1] AS extension FROM named""",
    "photo_match_counts": sql(
        """SELECT count(*) FILTER (noun IN (SELECT noun FROM photo)) AS matched,
        count(*) FILTER (noun NOT IN (SELECT noun FROM photo)) AS skipped
        FROM (SELECT DISTINCT noun FROM noun_products)""",
        *CREDIT_STEPS,
        needs="products",
    ),
    "noun_products": sql("SELECT noun, id FROM noun_products", *CREDIT_STEPS, needs="products"),
    "photo_attribution": sql("SELECT * FROM credit", *CREDIT_STEPS, needs="products"),
    "attribution_invert": sql(
        f"""SELECT product_id, noun, commons_title, extension FROM (SELECT *, row_number() OVER (
            PARTITION BY product_id ORDER BY list_position({NOUN_LIST}, noun) DESC) AS place FROM credit)
        WHERE place = 1""",
        *CREDIT_STEPS,
        needs="products",
    ),
    "image_prompts": sql(
        """SELECT id, 'product photo of ' || lower(title) || ', a ' || lower(category) || ' item, ' || lower(material)
            || ', white background, studio lighting' AS prompt,
        CAST('0x' || sha256(CAST(id AS VARCHAR))[1:8] AS BIGINT) AS seed
        FROM products WHERE id NOT IN (SELECT product_id FROM credit)""",
        *CREDIT_STEPS,
        needs="products",
    ),
    "cart_state": sql("SELECT cart_id, product_id, quantity FROM lines", *CART_STEPS, needs="cart_events", recursive=True),
    "cart_totals": sql(
        f"""SELECT cart_id, sum(quantity)::BIGINT AS item_count, {r9("sum(quantity * price)")} AS subtotal
        FROM lines JOIN products ON id = product_id GROUP BY 1""",
        *CART_STEPS,
        needs="cart_events products",
        recursive=True,
    ),
    "catalog_search": CATALOG_SEARCH,
    "columnar_embeddings": f"""SELECT vec_id, len(embedding) AS dim, place, {r6("embedding[place + 1]::DOUBLE")} AS value
        FROM (SELECT *, unnest(range(len(embedding))) AS place FROM embeddings)""",
    "published_inputs": sql(
        f"""SELECT CAST(product_id AS VARCHAR) AS product_id, q0 AS reference_quantity, {r9("e")} AS elasticity,
        {r9("c")} AS marginal_cost, {r9("p0")} AS reference_price FROM pricing""",
        needs="pricing",
    ),
}

CHANGED_VIEWS = {
    **VIEWS,
    "docs": f"""SELECT doc_id AS id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
        UNION ALL
        SELECT {views.BENCHMARK_IDS} + item_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') FROM benchmark""",
}


def changed(body: str, needs: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CHANGED_VIEWS[n]})" for n in needs.split()) + "\n" + body


_RANKED = f"""SELECT qid, id AS doc_id, {r9("score")} AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT q.qid, l.id, round(coalesce(h.score, 0), 9) AS score FROM queries q JOIN lens l ON true
        LEFT JOIN hits h ON h.qid = q.qid AND h.id = l.id)) WHERE rank <= 5"""
_HITS = SEARCH + " queries query_terms hits"

ORACLES |= {
    "bm25_segments": sql(
        f"""SELECT r.*, coalesce(p.postings, 0) AS postings FROM ({_RANKED}) r LEFT JOIN (
            SELECT qid, CAST(sum(df) AS BIGINT) AS postings FROM query_terms JOIN dfs USING (term) GROUP BY qid) p USING (qid)""",
        needs=_HITS,
    ),
    "changed_term_statistics": changed(
        f"SELECT term, df, {r9('ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0))')} AS idf FROM dfs, totals", SEARCH
    ),
    "changed_search": changed(_RANKED, _HITS),
    "merged_search": changed(_RANKED, _HITS),
    "knn_cells": ORACLES["knn_cosine"],
    "quantized_recall": f"""SELECT count(DISTINCT qid) AS n_queries, count(*) AS neighbours, true AS reached
        FROM ({ORACLES["knn_cosine"]}) WHERE qid % 50 = 0""",
}

_WHITESPACE = quoted(fixed.WHITESPACE)
_SORTS = {"relevance": "rank NULLS FIRST", "rating": "rating DESC NULLS LAST", "price-asc": "price NULLS FIRST", "price-desc": "price DESC NULLS LAST"}


def _placed(columns: str, source: str, modes: Sequence[str], last: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS sort, row_number() OVER (ORDER BY {_SORTS[m]}, id{last}) AS position, {columns} FROM {source}" for m in modes
    )


ORACLES |= {
    "category_positions": sql(
        _placed(f"id, price, {r9('rating')} AS rating", "products WHERE category = 'STANDARD' AND rating >= 2.5e0", ["rating", "price-asc", "price-desc"], ""),
        needs="products",
    ),
    "search_positions": sql(
        _placed("qid, id, rank", "reranked WHERE rating >= 2.9e0 AND price <= 2500", list(_SORTS), ", qid"), *CATEGORY_POOL, needs="products"
    ),
    "review_positions": sql(
        """SELECT row_number() OVER (ORDER BY product_id NULLS FIRST, helpful_votes DESC, id) AS position, id, product_id, helpful_votes
        FROM reviews""",
        needs="reviews",
    ),
    "trigger_mentions": f"""WITH trig AS (
            SELECT DISTINCT category, 'length ' || (length(w) % 7) AS aspect, w AS trigger
            FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
                (VALUES ('en'), ('fr'), ('de'), ('es')) c(category) WHERE length(w) >= 5),
        cut AS (SELECT doc_id, lang, unnest(string_split_regex(text, '[.!?]+')) AS t FROM documents),
        sentence AS (
            SELECT doc_id, lang, row_number() OVER () AS s, lower(t) AS t FROM cut WHERE trim(t, {_WHITESPACE}) <> '')
        SELECT doc_id, aspect, count(*) AS mentions FROM (
            SELECT DISTINCT doc_id, s, aspect FROM sentence JOIN trig ON category = lang AND contains(t, trigger))
        GROUP BY ALL""",
    "holt_scan": ORACLES["holt_state"],
    "name_containment": sql(
        "SELECT noun, id FROM products JOIN names ON cat = category AND contains(title, noun)",
        (
            "names",
            """SELECT DISTINCT noun, category AS cat FROM (
            SELECT title AS noun, category FROM products UNION ALL SELECT unnest(string_split(title, ' ')), category FROM products)""",
        ),
        needs="products",
    ),
    "facet_selections": sql(
        """SELECT s.facet || '=' || s.value AS selection, f.facet, f.value, count(*) AS n
        FROM valued s JOIN valued f USING (id) GROUP BY ALL""",
        ("valued", "SELECT id, 'brand' AS facet, brand AS value FROM products UNION ALL SELECT id, 'material', material FROM products"),
        needs="products",
    ),
}

ORACLES |= {
    "kept_manifest": f"""SELECT count(*) AS num_documents, count(DISTINCT lang) AS num_languages,
        '{{"limit": {fixed.DEFAULT_LIMIT}}}' AS parameters, true AS other_is_absent FROM documents""",
    "blank_queries": f"SELECT qid, doc_id, rank, fused FROM ({ORACLES['hybrid_search']}) WHERE qid % 2 = 0",
    "sorted_export": f"""SELECT product_id, current_stock, row_number() OVER (ORDER BY product_id) AS position
        FROM ({ORACLES['inventory_forecast']})""",
}

_CHAIN_PHRASE = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in views.CHAIN_PHRASES.items())
ORACLES["photo_pipeline"] = sql(
    """SELECT CAST(id AS VARCHAR) AS product_id, noun, title AS commons_title, url AS source_url, 'page ' || position AS artist, license,
        replace(extension[2:], 'jpeg', 'jpg') AS extension
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY noun DESC) AS last
        FROM products p JOIN chosen c ON c.cat = p.category AND contains(p.title, c.noun)) named(
            id, product_title, description, category, brand, material, price, rating, rating_count, created_at,
            noun, cat, position, title, url, license, extension, last)
    WHERE last = 1""",
    (
        "candidate",
        f"""SELECT noun, cat, page_id AS position, 'File:' || regexp_extract(html, '<title>([^<]*)</title>', 1)
            || [{listed(views.CHAIN_SUFFIXES)}][page_id % 5 + 1] AS title, url,
        [{listed(views.CHAIN_LICENSES)}][page_id % 4 + 1] AS license,
        lower(title || ' ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS body,
        lower(regexp_extract(title, '(?s)(?:^|/)[^/]+(\\.[^./]+)$', 1)) AS extension,
        CASE noun {_CHAIN_PHRASE} ELSE noun END AS phrase FROM pages, {NOUN_ROWS} AS n(noun, cat)""",
    ),
    (
        "checked",
        PHOTO_STEPS[1][1]
        .replace("extension IN ('.html', 'none')", f"extension IN ({listed(fixed.PHOTO_EXTENSIONS)})")
        .replace("lambda w: w <> 'the'", f"lambda w: w NOT IN ({listed(fixed.PHOTO_STOPWORDS)})")
        .replace(listed(views.PHOTO_REJECTED), listed([f"File:{t}.png" for t in views.PHOTO_REJECTED])),
    ),
    (
        "chosen",
        """SELECT noun, cat, position, title, url, license, extension FROM (
            SELECT *, row_number() OVER (PARTITION BY noun ORDER BY position) AS place FROM checked WHERE accepted) WHERE place = 1""",
    ),
    needs="products",
)

#: Queries whose rows depend on how the data lies; the tests check what must hold of them.
WITHOUT_SQL = {"segment_work", "neighbour_work", "quantized_neighbours"}
