"""Table functions of SQL: the rows that a text or a number of tokens gives, for lateral joins.

``SELECT d.doc_id, s.* FROM documents d, LATERAL regex_spans(d.text) s``. Their bodies are SQL over built-in functions,
which Catalyst puts in place of the call: nothing is shuffled and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import vocab


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(label: str, pattern: str) -> str:
    """An array of struct(label, start, end) of the pattern's matches in t, which is cut at them; the parts' lengths add up to where each begins. Texts that can't hold a match aren't searched."""
    cut = f"split(regexp_replace(translate(t, '\\u0001\\u0002', '\\u0003\\u0003'), {_quoted(pattern)}, '\\u0001$0\\u0002'), '\\u0001')"
    kind = "array<struct<label: string, start: bigint, end: bigint>>"
    here = f"named_struct('label', {_quoted(label)}, 'start', acc.at, 'end', CAST(acc.at + locate('\\u0002', p) - 1 AS BIGINT))"
    step = f"named_struct('at', CAST(acc.at + length(p) - 1 AS BIGINT), 'found', array_append(acc.found, {here}))"
    fold = f"aggregate(slice(q, 2, greatest(size(q) - 1, 0)), named_struct('at', CAST(length(q[0]) AS BIGINT), 'found', CAST(array() AS {kind})), (acc, p) -> {step}, acc -> acc.found)"
    found = f"transform(array({cut}), q -> {fold})[0]"
    return f"CASE WHEN t RLIKE {_quoted(vocab.NEEDED[label])} THEN {found} ELSE CAST(array() AS {kind}) END"


_SENTENCES = r"split(t, '(?<=[.!?])\\s+')"
_PACKED = """aggregate({0}, named_struct('now', '', 'done', CAST(array() AS array<string>)),
  (acc, s) -> CASE WHEN length(acc.now) + length(s) < 4 * chunk THEN named_struct('now', CASE WHEN acc.now = '' THEN s ELSE concat(acc.now, ' ', s) END, 'done', acc.done)
    ELSE named_struct('now', s, 'done', CASE WHEN acc.now = '' THEN acc.done ELSE array_append(acc.done, acc.now) END) END,
  acc -> CASE WHEN acc.now = '' THEN acc.done ELSE array_append(acc.done, acc.now) END)""".format(_SENTENCES)
_STEP = "greatest(1L, capacity - stride)"

TABLES = {
    "regex_spans(t STRING) RETURNS TABLE (label STRING, start BIGINT, end BIGINT, value STRING)": "SELECT h.label, h.start, h.end, substring(t, CAST(h.start + 1 AS INT), CAST(h.end - h.start AS INT)) FROM (SELECT explode(concat(" + ", ".join(_hits(k, p) for k, p in vocab.PATTERNS.items()) + ")) AS h)",
    "annotation_marks(t STRING) RETURNS TABLE (ord BIGINT, content STRING)": r"SELECT CAST(pos AS BIGINT), col FROM (SELECT posexplode(regexp_extract_all(t, '(?s)\\[\\[(.*?)\\]\\]', 1)))",
    "sentence_chunks(t STRING, chunk BIGINT) RETURNS TABLE (ord BIGINT, content STRING)": f"SELECT CAST(pos AS BIGINT), col FROM (SELECT posexplode({_PACKED}))",
    "token_windows(n BIGINT, capacity BIGINT, stride BIGINT) RETURNS TABLE (number BIGINT, ts BIGINT, te BIGINT)": f"SELECT w, w * {_STEP}, least(w * {_STEP} + capacity, n) - 1 FROM (SELECT explode(CASE WHEN n > 0 THEN sequence(0L, greatest(0L, CAST(ceil((n - capacity) / {_STEP}) AS BIGINT))) ELSE CAST(array() AS array<bigint>) END) AS w)",
    "candidate_spans(n BIGINT, most BIGINT) RETURNS TABLE (ts BIGINT, te BIGINT)": "SELECT a, explode(sequence(a, least(a + most - 1, n - 1))) FROM (SELECT explode(CASE WHEN n > 0 THEN sequence(0L, n - 1) ELSE CAST(array() AS array<bigint>) END) AS a)",
}


def register(spark: SparkSession) -> None:
    """Temporary table functions of a session. A null text or number gives no rows; so does a text without matches."""
    for signature, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
