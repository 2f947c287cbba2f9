"""SQL fragments shared by the oracles: common table expressions over the stored tables."""

# the same token class as the word operator, quoted for SQL
WORD = r"'[\p{L}\p{Nl}\p{No}]+(?:''[\p{L}\p{Nl}\p{No}]+)?'"
SENTENCE = r"'[^.!?]+[.!?]*'"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def squeeze(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def phrase(expr: str) -> str:
    return (
        rf"trim(lower(regexp_replace(regexp_replace({expr}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), "
        rf"'\s+', ' ', 'g')))"
    )


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {WORD})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


N = "n AS (SELECT count(*) AS n FROM documents)"
TOKENS = f"tokens AS (SELECT doc_id, lang, unnest({words('text')}) AS term FROM documents)"
TF = "tf AS (SELECT doc_id, term, count(*)::INT AS tf FROM tokens GROUP BY doc_id, term)"
DFS = "dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
RAW = (
    "raw AS (SELECT doc_id, term, tf * ln(n::DOUBLE / df) AS w "
    "FROM tf JOIN dfs USING (term) CROSS JOIN n)"
)
NORMS = "norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id)"
WEIGHTS = (
    "weights AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id) "
    "WHERE norm > 0 AND w <> 0)"
)
INDEX = (N, TOKENS, TF, DFS, RAW, NORMS, WEIGHTS)

QTOKENS = f"qtokens AS (SELECT item_id AS query_id, unnest({words('text')}) AS term FROM benchmark)"
QTF = "qtf AS (SELECT query_id, term, count(*) AS tf FROM qtokens GROUP BY query_id, term)"
QRAW = (
    "qraw AS (SELECT query_id, term, tf * ln(n::DOUBLE / df) AS w "
    "FROM qtf JOIN dfs USING (term) CROSS JOIN n)"
)
QNORM = "qnorm AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qraw GROUP BY query_id)"
QVEC = (
    "qvec AS (SELECT query_id, term, w / norm AS weight FROM qraw JOIN qnorm USING (query_id) "
    "WHERE norm > 0 AND w <> 0)"
)
QUERY = (QTOKENS, QTF, QRAW, QNORM, QVEC)
SCORES = (
    "scores AS (SELECT query_id, doc_id, round(sum(q.weight * w.weight), 6) AS score "
    "FROM qvec q JOIN weights w USING (term) GROUP BY query_id, doc_id)"
)
RANKED = (
    "ranked AS (SELECT query_id, doc_id, score, (row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM scores)"
)
SEARCH = (*INDEX, *QUERY, SCORES, RANKED)


def shingles(table: str, key: str, name: str) -> tuple[str, ...]:
    """Distinct 8-word shingles of a table."""
    return (
        f"{name}_w AS (SELECT {key} AS id, {words('text')} AS w FROM {table})",
        f"{name} AS (SELECT DISTINCT id, array_to_string(w[i:i+7], ' ') AS s FROM "
        f"(SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM {name}_w WHERE len(w) >= 8))",
    )


QRELS = (
    *shingles("documents", "doc_id", "dsh"),
    *shingles("benchmark", "item_id", "qsh"),
    "qrels AS (SELECT DISTINCT q.id AS query_id, d.id AS doc_id FROM qsh q JOIN dsh d USING (s))",
)

# Word errors of each turn against the next one of its conversation: a row of edit distances is
# folded over the words of the turn, and insertions run along it as a running minimum.
WORD_ERRORS = (
    f"""turn_words AS (SELECT conv_id, turn, role, text, list_filter(string_split(
        {phrase('text')}, ' '), lambda x: x <> '') AS w FROM conversations)""",
    """turn_pairs AS (SELECT a.conv_id, a.turn, a.role, a.text, a.w, b.w AS h FROM turn_words a
        JOIN turn_words b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    """word_errors AS (SELECT conv_id, turn, role, text, w, list_reduce(list_prepend(
        range(0, len(h) + 1), list_transform(w, lambda x: list_transform(h,
        lambda y: (x <> y)::BIGINT))), lambda r, c: list_transform([list_prepend(r[1] + 1,
        list_transform(c, lambda d, j: least(r[j + 1] + 1, r[j] + d)))], lambda b:
        list_transform(b, lambda v, j: list_min(list_transform(b[1:j], lambda u, k: u - k)) + j)
        )[1])[-1] AS errors FROM turn_pairs)""",
)
