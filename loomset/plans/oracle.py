"""DuckDB statements equal to the registered queries (the correctness oracle).

Built from the same rule tables as the Spark side (:mod:`loomset.functions.rules`)
in RE2 syntax; RE2 classes are ASCII, which gives the same results on the
provided corpus. Column names and types match the Spark queries one to one.
"""

from __future__ import annotations

from loomset.functions import rules
from loomset.plans import catalog
from loomset.sources import render

CATS = list(rules.HARM_PATTERNS)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(rules.WHITESPACE_CHARS)})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {lit(rules.WHITESPACE_CHARS)})"


def harm(x: str, tables: rules.RuleTables = rules.TABLES) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN regexp_matches({low}, {lit(rules.harm_regex(c, 're2', tables.harm))}) THEN {lit(c)}" for c in tables.harm)
    return f"(CASE {whens} ELSE NULL END)"


def redact(x: str, tables: rules.RuleTables = rules.TABLES) -> str:
    out = f"coalesce({x}, '')"
    for kind, pattern in tables.pii.items():
        out = f"regexp_replace({out}, {lit(rules.re2_regex(pattern))}, {lit(tables.replacements[kind])}, 'g')"
    return out


def words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split_regex({x}, {lit(rules.WS + '+')}) END)"


def _case(key: str, cases: list[tuple[int, str]]) -> str:
    whens = " ".join(f"WHEN {rem} THEN {lit(txt)}" for rem, txt in cases)
    return f"(CASE {key} {whens} ELSE '' END)"


DOCS = (
    "docs AS (SELECT doc_id, lang, text || "
    + _case("doc_id % 97", catalog.DOC_HITS_97)
    + " || "
    + _case("doc_id % 89", catalog.DOC_HITS_89)
    + " AS text FROM documents)"
)

_conv_whens = " ".join(
    f"WHEN conv_id % 23 = {rem} AND turn = {turn} THEN {lit(txt)}" for rem, turn, txt in catalog.CONV_HITS_23
)
CONVS = f"convs AS (SELECT conv_id, turn, role, text || (CASE {_conv_whens} ELSE '' END) AS text FROM conversations)"

K = rules.DEFAULT_CHUNK_WORDS
MIN_CHARS = rules.MIN_CHUNK_CHARS


def _prepared(guardrails: bool = True, sanitize: bool = True) -> str:
    h = harm("s") if guardrails else "CAST(NULL AS VARCHAR)"
    body = redact("s") if sanitize else "coalesce(s, '')"
    return (
        f"stripped AS (SELECT doc_id, {strip('text')} AS s FROM docs), "
        f"prepared AS (SELECT doc_id, {h} AS harm_category, {body} AS body FROM stripped)"
    )


def _chunks_sql(guardrails: bool = True, sanitize: bool = True, docs: str = DOCS) -> str:
    return (
        f"WITH {docs}, {_prepared(guardrails, sanitize)}, "
        f"ws AS (SELECT doc_id, {words('body')} AS w FROM prepared WHERE harm_category IS NULL AND body <> ''), "
        f"e AS (SELECT doc_id, w, unnest(range(0, len(w), {K})) AS i FROM ws), "
        f"c AS (SELECT doc_id, CAST(i // {K} AS BIGINT) AS chunk_index, array_to_string(w[i + 1 : i + {K}], ' ') AS chunk FROM e) "
    )


def note_chunks(guardrails: bool = True, sanitize: bool = True) -> str:
    return _chunks_sql(guardrails, sanitize) + f"SELECT doc_id, chunk_index, chunk FROM c WHERE length(chunk) > {MIN_CHARS}"


def notes_split() -> str:
    text = f"text || {_case('doc_id % 1997', catalog.NOTE_HITS_1997)} || {_case('doc_id % 89', catalog.DOC_HITS_89)}"
    joined = (
        f"docs AS (SELECT doc_id // {render.DOCS_PER_NOTE} AS doc_id, string_agg({text}, chr(10) ORDER BY doc_id) AS text "
        f"FROM documents GROUP BY doc_id // {render.DOCS_PER_NOTE})"
    )
    return _chunks_sql(docs=joined) + f"SELECT doc_id AS note, chunk_index, chunk FROM c WHERE length(chunk) > {MIN_CHARS}"


def notes_to_instruction() -> str:
    return _chunks_sql() + (
        f"SELECT doc_id, chunk_index, {lit(rules.NOTE_INSTRUCTION_PREFIX)} || 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS instruction, "
        f"'' AS input, chunk AS output FROM c WHERE length(chunk) > {MIN_CHARS}"
    )


def _counts(table: str) -> str:
    per = ", ".join(f"count(*) FILTER (WHERE harm_category = {lit(c)}) AS {c}" for c in CATS)
    return f"{per}, count(harm_category) AS rejected FROM {table}"


def rejection_counts() -> str:
    return f"WITH {DOCS}, {_prepared()} SELECT {_counts('prepared')}"


def run_summary() -> str:
    samples = f"(SELECT count(*) FROM c WHERE length(chunk) > {MIN_CHARS})"
    per = ", ".join(f"count(*) FILTER (WHERE harm_category = {lit(c)}) AS {c}" for c in CATS)
    return _chunks_sql() + (
        f"SELECT 'sharegpt' AS dataset_format, true AS sanitize_pii, true AS enforce_guardrails, "
        f"CAST({samples} AS BIGINT) AS samples, {per}, count(harm_category) AS rejected FROM prepared"
    )


MESSAGES = f"m AS (SELECT conv_id, turn, role, {strip('text')} AS content FROM convs)"
F2 = "content <> '' AND role IN ('user', 'assistant')"


def message_filter() -> str:
    return f"WITH {CONVS}, {MESSAGES} SELECT conv_id, turn, role, content FROM m WHERE {F2}"


def _conv_json(role: str, content: str, order: str) -> str:
    return f"to_json(list(struct_pack(role := {role}, content := {content}) ORDER BY {order}))"


ASSEMBLED = (
    f"k AS (SELECT conv_id, turn, role, {redact('content')} AS content FROM m WHERE {F2} AND {harm('content')} IS NULL), "
    f"a AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, {_conv_json('role', 'content', 'turn')} AS conversations_json, "
    f"list(struct_pack(role := role, content := content) ORDER BY turn) AS conversations FROM k GROUP BY conv_id HAVING count(*) >= {rules.MIN_TURNS})"
)


def conversation_assemble() -> str:
    return f"WITH {CONVS}, {MESSAGES}, {ASSEMBLED} SELECT conv_id, n_messages, conversations_json FROM a"


def _windows(content_expr: str, file_expr: str = "conv_id") -> str:
    """Log windows over ``convs``: content ``content_expr`` (of ``text``), one log per ``file_expr``,
    lines in (conv_id, turn) order."""
    n = rules.LOG_WINDOW
    role = "CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END"
    body = "role || ': ' || content"
    return (
        f"lm AS (SELECT {file_expr} AS log, conv_id AS cid, turn, role, {content_expr} AS content FROM convs), "
        f"lk AS (SELECT log, cid, turn, role, content FROM lm WHERE content <> '' AND NOT starts_with(content, {lit(rules.MEDIA_PREFIX)}) "
        f"AND {harm('content')} IS NULL), "
        f"li AS (SELECT log AS conv_id, role, {redact('content')} AS content, "
        f"row_number() OVER (PARTITION BY log ORDER BY cid, turn) - 1 AS i FROM lk), "
        f"lw AS (SELECT conv_id, CAST(i // {n} AS BIGINT) AS window_index, CAST(count(*) AS BIGINT) AS n_messages, "
        f"{_conv_json(role, body, 'i')} AS conversations_json "
        f"FROM li GROUP BY conv_id, i // {n} HAVING count(*) >= {rules.MIN_TURNS})"
    )


def message_log_windows() -> str:
    return f"WITH {CONVS}, {_windows(strip('text'))} SELECT conv_id, window_index, n_messages, conversations_json FROM lw"


def _log_content() -> str:
    return rstrip("regexp_replace(text, '[\\r\\n]+', ' ', 'g')")


LOG_FILE = f"conv_id // {render.LOG_CONVS_PER_FILE}"


def samples_end_to_end() -> str:
    windows = _windows(_log_content(), LOG_FILE)
    return f"WITH {CONVS}, {windows} SELECT '{{\"conversations\":' || conversations_json || '}}' AS record FROM lw"


def message_log_scan() -> str:
    return (
        f"WITH {CONVS}, x AS (SELECT {LOG_FILE} AS log, role AS sender, {_log_content()} AS content FROM convs) "
        f"SELECT log, sender, content FROM x WHERE content <> '' AND NOT starts_with(content, {lit(rules.MEDIA_PREFIX)})"
    )


def notes_scan() -> str:
    return f"WITH {DOCS} SELECT lang, {strip('text')} AS text FROM docs"


def notes_tree() -> str:
    return f"WITH {DOCS} SELECT lang, doc_id % 2 = 1 AS draft, {strip('text')} AS text FROM docs"


def alpaca_turns() -> str:
    """The first two messages of every three, in turn order."""
    return (
        f"WITH {CONVS}, {MESSAGES}, p AS (SELECT conv_id, turn // 3 AS part, list(content ORDER BY turn) AS said FROM m GROUP BY ALL) "
        "SELECT CAST(conv_id AS VARCHAR) || '#' || CAST(part AS VARCHAR) AS sample_id, "
        "to_json(struct_pack(instruction := said[1], input := '', output := said[2])) AS record "
        f"FROM p WHERE len(said) >= {rules.MIN_TURNS}"
    )


def harm_category() -> str:
    return f"WITH {DOCS} SELECT doc_id, {harm(strip('text'))} AS harm_category FROM docs"


def harm_filter() -> str:
    return f"WITH {DOCS}, s AS (SELECT doc_id, {strip('text')} AS text FROM docs) SELECT doc_id, text FROM s WHERE {harm('text')} IS NULL"


def pii_redact() -> str:
    return f"WITH {DOCS} SELECT doc_id, {redact(strip('text'))} AS redacted FROM docs"


def own_tables() -> str:
    own = catalog.OWN_TABLES
    return (
        f"WITH {DOCS}, s AS (SELECT doc_id, {strip('text')} AS text FROM docs) "
        f"SELECT doc_id, {harm('text', own)} AS harm_category, {redact('text', own)} AS redacted FROM s"
    )


def _samples_sql() -> str:
    """Notes instruction samples and assembled conversations, as in ``catalog._samples``."""
    return (
        _chunks_sql()
        + f", {CONVS}, {MESSAGES}, {ASSEMBLED}, "
        + f"inst AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt#' || CAST(chunk_index AS VARCHAR) AS sample_id, "
        + f"{lit(rules.NOTE_INSTRUCTION_PREFIX)} || 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS instruction, '' AS input, chunk AS output "
        + f"FROM c WHERE length(chunk) > {MIN_CHARS}) "
    )


def format_sharegpt() -> str:
    return _samples_sql() + (
        "SELECT sample_id, to_json(struct_pack(conversations := [struct_pack(role := 'user', content := instruction), "
        "struct_pack(role := 'assistant', content := output)])) AS record FROM inst "
        "UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS sample_id, to_json(struct_pack(conversations := conversations)) AS record FROM a"
    )


def format_alpaca() -> str:
    return _samples_sql() + (
        "SELECT sample_id, to_json(struct_pack(instruction := instruction, input := input, output := output)) AS record FROM inst "
        "UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS sample_id, "
        "to_json(struct_pack(instruction := conversations[1].content, input := '', output := conversations[2].content)) AS record "
        f"FROM a WHERE len(conversations) >= {rules.MIN_TURNS}"
    )


def format_jsonl() -> str:
    return _samples_sql() + (
        "SELECT sample_id, to_json(struct_pack(instruction := instruction, input := input, output := output)) AS record FROM inst "
        "UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS sample_id, to_json(struct_pack(conversations := conversations)) AS record FROM a"
    )


def jsonl_sink() -> str:
    return f"SELECT record FROM ({format_sharegpt()})"


def chat_tree_scan() -> str:
    return conversation_assemble()


def notes_stream() -> str:
    return _chunks_sql() + f"SELECT chunk FROM c WHERE length(chunk) > {MIN_CHARS}"


def _run_row(source: str, dataset_format: str, records: str, judged: str) -> str:
    """A run's summary from its record and verdict tables."""
    per = ", ".join(f"(SELECT count(*) FILTER (WHERE harm_category = {lit(c)}) FROM {judged}) AS {c}" for c in CATS)
    return (
        f"SELECT {lit(source)} AS source, {lit(dataset_format)} AS dataset_format, true AS sanitize_pii, true AS enforce_guardrails, "
        f"count(*) AS samples, {per}, (SELECT count(harm_category) FROM {judged}) AS rejected, count(*) AS records, "
        f"CAST(coalesce(sum(length(record)), 0) AS BIGINT) AS characters FROM {records}"
    )


def pipeline_e2e() -> str:
    tree_records = (
        "tree_records AS (SELECT to_json(struct_pack(instruction := conversations[1].content, input := '', "
        "output := conversations[2].content)) AS record FROM a)"
    )
    tree_judged = f"tree_judged AS (SELECT {harm('content')} AS harm_category FROM m WHERE {F2})"
    log_records = "log_records AS (SELECT '{\"conversations\":' || conversations_json || '}' AS record FROM lw)"
    log_judged = (
        f"log_judged AS (SELECT {harm('content')} AS harm_category FROM lm WHERE content <> '' "
        f"AND NOT starts_with(content, {lit(rules.MEDIA_PREFIX)}))"
    )
    note_records = (
        f"note_records AS (SELECT to_json(struct_pack(instruction := {lit(rules.NOTE_INSTRUCTION_PREFIX)} || 'doc_' || "
        f"CAST(doc_id AS VARCHAR) || '.txt', input := '', output := chunk)) AS record FROM c WHERE length(chunk) > {MIN_CHARS})"
    )
    return (
        _chunks_sql()
        + f", {CONVS}, {MESSAGES}, {ASSEMBLED}, {_windows(_log_content(), LOG_FILE)}, "
        + ", ".join([tree_records, tree_judged, log_records, log_judged, note_records])
        + " "
        + " UNION ALL ".join(
            [
                _run_row("chat_tree", "alpaca", "tree_records", "tree_judged"),
                _run_row("message_log", "sharegpt", "log_records", "log_judged"),
                _run_row("notes", "jsonl", "note_records", "prepared"),
            ]
        )
    )


ORACLE: dict[str, str] = {
    "harm_category": harm_category(),
    "harm_filter": harm_filter(),
    "pii_redact": pii_redact(),
    "own_tables": own_tables(),
    "note_chunks": note_chunks(),
    "notes_to_instruction": notes_to_instruction(),
    "guardrails_off": note_chunks(guardrails=False),
    "redaction_off": note_chunks(sanitize=False),
    "rejection_counts": rejection_counts(),
    "run_summary": run_summary(),
    "message_filter": message_filter(),
    "conversation_assemble": conversation_assemble(),
    "message_log_windows": message_log_windows(),
    "format_sharegpt": format_sharegpt(),
    "format_alpaca": format_alpaca(),
    "alpaca_turns": alpaca_turns(),
    "format_jsonl": format_jsonl(),
    "chat_tree_scan": chat_tree_scan(),
    "chat_tree_split": chat_tree_scan(),
    "message_log_scan": message_log_scan(),
    "notes_scan": notes_scan(),
    "notes_tree": notes_tree(),
    "notes_split": notes_split(),
    "jsonl_sink": jsonl_sink(),
    "samples_end_to_end": samples_end_to_end(),
    "notes_stream": notes_stream(),
    "pipeline_e2e": pipeline_e2e(),
}
