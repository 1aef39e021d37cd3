"""SQL for the text problems that SQL can express, run by another engine over the same tables."""

from __future__ import annotations

from binweave.llm.leakage import ACCENTS, LETTERS

_TERMS = """
WITH held AS (
  SELECT file_id, decode(name) AS term FROM (
    SELECT file_id, name FROM ne_names WHERE name IS NOT NULL AND TRY(decode(name)) IS NOT NULL)
  UNION ALL SELECT file_id, name FROM exports WHERE kind = 'pe' AND name IS NOT NULL
), counted AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT file_id) AS n_files FROM held GROUP BY term
), marked AS (
  SELECT *, CASE WHEN n_files <= 1 THEN 'rare' WHEN n_files * 1000 >= 50 * (SELECT count(DISTINCT file_id) FROM held) THEN 'common' ELSE 'useful' END AS mark FROM counted
)
"""

_RECORDS = r"""
WITH cells AS (
  SELECT line_id, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, string_split(line, chr(9)) AS c FROM export_lines
), fields AS (
  SELECT line_id,
    CASE WHEN t LIKE '{%' THEN TRY(json_extract_string(t, '$.file')) WHEN len(c) = 3 THEN coalesce(TRY(array_to_string(CAST(c[1]::JSON AS VARCHAR[]), '/')), c[1])
         WHEN regexp_matches(t, '(?is)(?:^|[;,|])\s*file\s*=') THEN regexp_extract(t, '(?is)(?:^|[;,|])\s*file\s*=(.*?)(?:[;,|]\s*(?:file|ordinal|name)\s*=.*)?$', 1) END AS file,
    CASE WHEN t LIKE '{%' THEN TRY(json_extract_string(t, '$.ordinal')) WHEN len(c) = 3 THEN c[2]
         WHEN regexp_matches(t, '(?is)(?:^|[;,|])\s*ordinal\s*=') THEN regexp_extract(t, '(?is)(?:^|[;,|])\s*ordinal\s*=(.*?)(?:[;,|]\s*(?:file|ordinal|name)\s*=.*)?$', 1) END AS ordinal,
    CASE WHEN t LIKE '{%' THEN TRY(json_extract_string(t, '$.name')) WHEN len(c) = 3 THEN c[3]
         WHEN regexp_matches(t, '(?is)(?:^|[;,|])\s*name\s*=') THEN regexp_extract(t, '(?is)(?:^|[;,|])\s*name\s*=(.*?)(?:[;,|]\s*(?:file|ordinal|name)\s*=.*)?$', 1) END AS name
  FROM cells
), normal AS (
  SELECT line_id, regexp_replace(lower(file), '[^\p{L}\p{N}]+', '', 'g') AS file, regexp_replace(lower(ordinal), '[^\p{L}\p{N}]+', '', 'g') AS ordinal,
         regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g') AS name FROM fields
), grouped AS (
  SELECT line_id, min(line_id) OVER w AS first_line_id, count(*) OVER w AS copies FROM normal
  WHERE file <> '' AND regexp_matches(ordinal, '^[0-9]+$') AND name IS NOT NULL WINDOW w AS (PARTITION BY file, ordinal, name)
)
"""

_SIMILAR = """
WITH held AS (SELECT DISTINCT file_id, name FROM exports WHERE name IS NOT NULL AND file_id IS NOT NULL
), sizes AS (SELECT file_id, count(*) AS n FROM held GROUP BY file_id
), shared AS (SELECT a.file_id AS file_id_a, b.file_id AS file_id_b, count(*) AS k FROM held a JOIN held b ON a.name = b.name AND a.file_id < b.file_id GROUP BY ALL)
SELECT file_id_a, file_id_b FROM shared JOIN sizes x ON x.file_id = file_id_a JOIN sizes y ON y.file_id = file_id_b WHERE k * 5 >= (x.n + y.n - k) * 4
"""



def _tex_words(text: str) -> str:
    """The words of a text as leakage.words reads them, as an SQL expression."""
    letter = r"(?:\\([ij])|(\p{L}))"
    around = lambda x: f"chr(57344) || {x} || chr(57345)"
    out = f"replace({text}, chr(92) || chr(92), ' ')"
    for mark, combining in ACCENTS.items():
        quoted = mark.replace("'", "''")
        if mark.isalpha():
            pattern = rf"\\{quoted}(?:[ \t]*\{{[ \t]*{letter}[ \t]*\}}|[ \t]+(\p{{L}}))"
            back = r"'\1\2\3'"
        else:
            pattern = rf"\\[{quoted}][ \t]*(?:\{{[ \t]*{letter}[ \t]*\}}|{letter})" if mark != "^" else rf"\\\^[ \t]*(?:\{{[ \t]*{letter}[ \t]*\}}|{letter})"
            back = r"'\1\2\3\4'"
        combined = f"{back} || chr({ord(combining)})"
        out = f"regexp_replace({out}, '{pattern}', {around(combined)}, 'g')"
    for name, printed in LETTERS.items():
        out = rf"regexp_replace({out}, '\\{name}(?:\b(?:\{{\}}|[ \t]+)?|([0-9_]))', {around(f"'{printed}'")} || '\1', 'g')"
    for gone in ("'{' || chr(57344)", "chr(57345) || '}'", "chr(57344)", "chr(57345)"):
        out = f"replace({out}, {gone}, '')"
    return rf"regexp_extract_all(lower(nfc_normalize(regexp_replace({out}, '\\[A-Za-z]+\*?', '', 'g'))), '[\p{{L}}\p{{N}}]+')"


def _windows(name: str, key: str, table: str) -> str:
    words = f"SELECT {key}, {_tex_words('text')} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL"
    return f"{name} AS (SELECT {key}, i - 1 AS at, array_to_string(w[i : i + 12], ' ') AS grams FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM ({words})))"


_LEAKS = f"""
WITH {_windows("d", "doc_id", "documents")}, {_windows("e", "item_id", "eval_items")}, same AS (
  SELECT doc_id, item_id, d.at AS doc_word, e.at AS item_word,
         d.at - row_number() OVER (PARTITION BY doc_id, item_id, d.at - e.at ORDER BY d.at) AS run FROM d JOIN e USING (grams)
), runs AS (
  SELECT doc_id, item_id, count(*) + 12 AS n_words, min(doc_word) AS doc_word, min(item_word) AS item_word FROM same GROUP BY doc_id, item_id, doc_word - item_word, run
), longest AS (
  SELECT doc_id, item_id, CAST(n_words AS INT) AS n_words, CAST(doc_word AS INT) AS doc_word, CAST(item_word AS INT) AS item_word FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) = 1
)
"""

#: White space in regular expressions, as Unicode has it.
_BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_STATISTICS = rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words, length(text) - length(regexp_replace(text, '[{_BLANK}]', '', 'g')) AS spaces,
         list_filter(string_split(regexp_replace(text, '\\(?:begin|end)\{{document\}}', chr(10), 'g'), chr(10)), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS lines FROM documents
), n AS (
  SELECT doc_id, length(text) AS n_chars, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS letters, spaces, len(lines) AS n_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '[.!?:;…。！？]["''”’»)\]}}]{{0,7}}[{_BLANK}]*$'))) AS n_ended,
         len(list_filter(words, lambda x: list_contains(common, x))) AS n_common
  FROM w, (SELECT list(DISTINCT lower(word)) AS common FROM common_words WHERE word IS NOT NULL)
)
SELECT doc_id, n_chars, CAST(n_words AS BIGINT) AS n_words, CASE WHEN n_words > 0 THEN letters / n_words END AS mean_word_length,
  CASE WHEN n_chars > spaces THEN (n_chars - spaces - coalesce(letters, 0)) / (n_chars - spaces) END AS symbol_ratio,
  CASE WHEN n_lines > 0 THEN n_ended / n_lines END AS ended_line_share, CASE WHEN n_words > 0 THEN n_common / n_words END AS common_word_share FROM n
"""

SQL = {
    "p10_stats": _STATISTICS,
    "p8_matches": _LEAKS + "SELECT doc_id, item_id, n_words, doc_word, item_word FROM longest",
    "p8_found": _LEAKS + "SELECT doc_id, item_id FROM longest",
    "p8_kept": _LEAKS + "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM longest)",
    "p7_found": _SIMILAR,
    "p4_found": _TERMS + "SELECT term, mark FROM marked WHERE mark <> 'useful'",
    "p4_terms": _TERMS + "SELECT term, occurrences, n_files, mark FROM marked",
    "p6_found": _RECORDS + "SELECT first_line_id, line_id FROM grouped WHERE line_id > first_line_id",
    "p6_copies": _RECORDS + "SELECT DISTINCT first_line_id, copies FROM grouped",
}
