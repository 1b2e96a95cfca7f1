"""DuckDB SQL for the operator queries that SQL can express on whole tables.

Sharding needs CRC-32 and chat formatting URL-encoding, which DuckDB lacks; the other operators rest
on tokenizers, trained models or graph iteration. Those are tested against brute force.
"""

from __future__ import annotations

from trailmark.llm import collocations as c
from trailmark.llm import quality as q

_W = r"'[^\x20\x09-\x0D]+'"


def _quality() -> str:
    rates = {
        "symbol_rate": "CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END",
        "dup_line_rate": "CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END",
        "repeat_rate": "CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END",
        "upper_rate": "CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END",
        "word_length": "CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END",
    }
    levels = {"source": "lang, source", "lang": "lang", "all": ""}
    ctes = []
    for level, by in levels.items():
        comma = by + ", " if by else ""
        part = f"PARTITION BY {comma}measure"
        ctes.append(f"""
 c_{level} AS (SELECT {comma}measure, bin, SUM(n) AS n FROM sketch GROUP BY {comma}measure, bin),
 r_{level} AS (SELECT {comma}measure, bin, SUM(n) OVER ({part} ORDER BY bin) AS c, SUM(n) OVER ({part}) AS docs FROM c_{level}),
 q_{level} AS (SELECT {comma}measure, MAX(docs) AS docs, MIN(bin) FILTER (c * 100 >= docs * 25) * {q.STEP} AS q25,
   MIN(bin) FILTER (c * 100 >= docs * 75) * {q.STEP} AS q75 FROM r_{level} GROUP BY {comma}measure)""")
    up = " ".join(f"WHEN '{m}' THEN {a}" for m, (a, _) in q.MARGINS.items())
    down = " ".join(f"WHEN '{m}' THEN {b}" for m, (_, b) in q.MARGINS.items() if b is not None)
    unpivot = " UNION ALL ".join(f"SELECT doc_id, row_no, lang, source, base_failed, '{m}' AS measure, {m} AS v FROM m" for m in q.MARGINS)
    return rf"""WITH w AS (SELECT doc_id, row_number() OVER () AS row_no, lang, source, coalesce(text, '') AS t,
   regexp_extract_all(coalesce(text, ''), {_W}) AS words,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_W})) AS lines FROM documents),
 win AS (SELECT row_no, i, array_to_string(words[i:i + {q.WINDOW - 1}], ' ') AS x
   FROM (SELECT row_no, words, unnest(range(1, len(words) - {q.WINDOW - 2})) AS i FROM w WHERE len(words) >= {q.WINDOW})),
 twice AS (SELECT row_no, i FROM (SELECT row_no, i, COUNT(*) OVER (PARTITION BY row_no, x) AS n FROM win) WHERE n > 1),
 rep AS (SELECT row_no, SUM(least({q.WINDOW}, i - before)) AS n FROM
   (SELECT row_no, i, coalesce(lag(i) OVER (PARTITION BY row_no ORDER BY i), -{q.WINDOW}) AS before FROM twice) GROUP BY row_no),
 f AS (SELECT doc_id, row_no, lang, source, CAST(len(words) AS BIGINT) AS n_words,
   CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
   length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, len(lines) AS n_lines
   FROM w LEFT JOIN rep USING (row_no)),
 m AS (SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEAT_PERCENT} AS base_failed,
   {', '.join(f'CAST({e} AS BIGINT) AS {m}' for m, e in rates.items())} FROM f),
 v AS ({unpivot}),
 sketch AS (SELECT lang, source, measure, least(v, {q.TOP}) // {q.STEP} AS bin, COUNT(*) AS n FROM v WHERE NOT base_failed
   GROUP BY lang, source, measure, least(v, {q.TOP}) // {q.STEP}),{','.join(ctes)},
 judged AS (SELECT v.row_no, CASE WHEN s.docs >= {q.MIN_DOCS} THEN 'source' WHEN l.docs >= {q.MIN_DOCS} THEN 'lang' ELSE 'all' END AS level,
   CASE WHEN s.docs >= {q.MIN_DOCS} THEN s.q25 WHEN l.docs >= {q.MIN_DOCS} THEN l.q25 ELSE a.q25 END AS q25,
   CASE WHEN s.docs >= {q.MIN_DOCS} THEN s.q75 WHEN l.docs >= {q.MIN_DOCS} THEN l.q75 ELSE a.q75 END AS q75, v.measure, v.v,
   CASE v.measure {up} END AS up, CASE v.measure {down} END AS down
   FROM v LEFT JOIN q_source s ON s.measure = v.measure AND s.lang IS NOT DISTINCT FROM v.lang AND s.source IS NOT DISTINCT FROM v.source
   LEFT JOIN q_lang l ON l.measure = v.measure AND l.lang IS NOT DISTINCT FROM v.lang
   LEFT JOIN q_all a ON a.measure = v.measure),
 ok AS (SELECT row_no, MIN(level) AS level, bool_and(v <= q75 + greatest({q.FENCE} * (q75 - q25), up)
   AND (down IS NULL OR v >= q25 - greatest({q.FENCE} * (q75 - q25), down))) AS inside FROM judged GROUP BY row_no)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 {', '.join(q.MARGINS)}, CASE WHEN EXISTS (SELECT 1 FROM c_source s WHERE s.lang IS NOT DISTINCT FROM m.lang AND s.source IS NOT DISTINCT FROM m.source)
   THEN level END AS threshold_level, NOT base_failed AND coalesce(inside, false) AS kept
 FROM m JOIN ok USING (row_no)"""


def _collocations() -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, {size} AS size, {' || chr(32) || '.join(f'w{j}' for j in range(1, size + 1))} AS phrase FROM ahead WHERE w{size} IS NOT NULL"
        for size in range(1, c.LONGEST + 1))
    ahead = ", ".join(f"LEAD(w, {j}) OVER piece AS w{j + 1}" for j in range(1, c.LONGEST))
    return rf"""
WITH docs AS (SELECT ROW_NUMBER() OVER () AS d, COALESCE(lang, 'und') AS lang, TRANSLATE(COALESCE(text, ''), '{up}', '{low}') AS t FROM documents),
 pieces AS (SELECT d, lang, UNNEST(p) AS piece, GENERATE_SUBSCRIPTS(p, 1) AS k
   FROM (SELECT d, lang, STRING_SPLIT_REGEX(t, '[.,;:!?
-
]') AS p FROM docs)),
 words AS (SELECT d, k, lang, UNNEST(p) AS w, GENERATE_SUBSCRIPTS(p, 1) AS i
   FROM (SELECT d, k, lang, REGEXP_EXTRACT_ALL(piece, '[^ 	]+') AS p FROM pieces)),
 ahead AS (SELECT lang, w AS w1, {ahead} FROM words WINDOW piece AS (PARTITION BY d, k ORDER BY i)),
 f AS (SELECT lang, size, phrase, COUNT(*) AS a FROM ({grams}) GROUP BY lang, size, phrase HAVING COUNT(*) >= {c.LEAST}),
 totals AS (SELECT lang, COUNT(*) AS n FROM words GROUP BY lang),
 several AS (SELECT lang, size, phrase, a, STRING_SPLIT(phrase, ' ') AS p FROM f WHERE size > 1),
 cuts AS (SELECT s.lang, s.phrase, s.a, k, x.a AS l, y.a AS r, ({c.SCALE}::HUGEINT * s.a) // (x.a + y.a) AS score
   FROM several s CROSS JOIN UNNEST([1, 2, 3]) AS cut(k)
   JOIN f x ON x.lang = s.lang AND x.phrase = ARRAY_TO_STRING(s.p[1:k], ' ')
   JOIN f y ON y.lang = s.lang AND y.phrase = ARRAY_TO_STRING(s.p[k + 1:], ' ') WHERE k < s.size),
 lowest AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inner_phrases AS (SELECT lang, ARRAY_TO_STRING(p[i:i + m - 1], ' ') AS phrase, MAX(a) AS longer
   FROM several, UNNEST([2, 3]) AS t(m), UNNEST([1, 2, 3]) AS u(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
 kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_phrases USING (lang, phrase)
   WHERE longer IS NULL OR 100::HUGEINT * longer < {c.CONTAINED}::HUGEINT * a),
 ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
 CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {c.TOP}"""


SQL: dict[str, str] = {"op4_adaptive_quality": _quality(), "op13_collocations": _collocations()}
