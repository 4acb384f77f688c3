"""Fragments of the DuckDB SQL that the queries are compared with. DuckDB's expressions are RE2: no look-around, other class names."""

from __future__ import annotations

SP = r"\s\x0b\x1c-\x1f\x{85}\pZ"


def words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[^{SP}]+'))"


def effective(t: str) -> str:
    w = words(t)
    return f"(CASE WHEN {w} = 0 THEN 0 WHEN length({t}) / {w} > 15 THEN greatest(1, length({t}) // 2) ELSE {w} END)"


def trim(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^[{SP}]+', ''), '[{SP}]+$', '')"


def ltrim(t: str) -> str:
    return f"regexp_replace({t}, '^[{SP}]+', '')"


def rtrim(t: str) -> str:
    return f"regexp_replace({t}, '[{SP}]+$', '')"


#: Units: the lines of documents that are not blank, trimmed, numbered from 0 by their place among all lines.
UNITS = f"units AS (SELECT doc_id, lang, pos, {trim('line')} AS text FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) x WHERE {trim('line')} <> '')"


def packed(limit: int) -> str:
    """CTEs up to ``packed`` (doc_id, pos, group_id)."""
    return f"""{UNITS},
w AS (SELECT doc_id, text, pos, {effective('text')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM units),
packed AS (
  SELECT doc_id, pos, n, w AS acc, 0 AS group_id, text FROM w WHERE n = 1
  UNION ALL
  SELECT w.doc_id, w.pos, w.n, CASE WHEN p.acc + w.w > {limit} THEN w.w ELSE p.acc + w.w END, CASE WHEN p.acc + w.w > {limit} THEN p.group_id + 1 ELSE p.group_id END, w.text
  FROM packed p JOIN w ON w.doc_id = p.doc_id AND w.n = p.n + 1)"""


def normalized(path: str) -> str:
    """A relative path with '.' and '..' resolved, as a list fold."""
    step = "CASE WHEN p IN ('', '.') THEN a WHEN p = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:-2] ELSE list_append(a, p) END"
    return f"coalesce(nullif(array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({path}, '/'), lambda p: [p])), lambda a, q: (CASE WHEN q[1] IN ('', '.') THEN a WHEN q[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:-2] ELSE list_append(a, q[1]) END)), '/'), ''), '.')"


#: A translation for tests: the text with 3 for e, and with what the anomaly checks look for in documents chosen by number.
STUB = "concat(replace(text, 'e', '3'), CASE WHEN doc_id % 7 = 0 THEN '...' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN concat(chr(10), '* one', chr(10), '* two') ELSE '' END, CASE WHEN doc_id % 13 = 0 THEN ' I cannot translate' ELSE '' END)"
ANOMALIES = r"""array_to_string(list_filter([
  CASE WHEN contains(tr, '...') AND NOT contains(text, '...') AND NOT contains(text, '…') THEN 'puntos suspensivos no presentes en el original' END,
  CASE WHEN len(regexp_extract_all(tr, '(?m)(?:^[\s\x0b\pZ]*[\*\-•][\s\x0b\pZ]+\*{0,2}[^\s\x0b\pZ]|\*[\s\x0b\pZ]+\*{2}[^\s\x0b\pZ])')) >= 2 AND len(regexp_extract_all(text, '(?m)(?:^[\s\x0b\pZ]*[\*\-•][\s\x0b\pZ]+\*{0,2}[^\s\x0b\pZ]|\*[\s\x0b\pZ]+\*{2}[^\s\x0b\pZ])')) = 0 THEN 'listas/explicaciones no presentes en el original' END,
  CASE WHEN (regexp_matches(tr, '(?i)se traduce como') AND NOT regexp_matches(text, '(?i)se traduce como')) OR (regexp_matches(tr, '(?i)no puedo traducir') AND NOT regexp_matches(text, '(?i)no puedo traducir'))
    OR (regexp_matches(tr, '(?i)por favor[,\s]+(proporciona|proporcione|provide)') AND NOT regexp_matches(text, '(?i)por favor[,\s]+(proporciona|proporcione|provide)'))
    OR (regexp_matches(tr, '(?i)texto (completo|que desea)') AND NOT regexp_matches(text, '(?i)texto (completo|que desea)'))
    OR (regexp_matches(tr, '(?i)I can(not|''?t) translate') AND NOT regexp_matches(text, '(?i)I can(not|''?t) translate')) THEN 'posible meta-comentario del modelo' END], lambda x: x IS NOT NULL), ';')"""
