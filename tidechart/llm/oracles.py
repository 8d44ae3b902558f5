"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from tidechart.llm import fill_in_middle, importance
from tidechart.llm.decontamination import NOT_WORD, WINDOW
from tidechart.llm.mixing import BUDGET, EPOCHS, WEIGHTS
from tidechart.llm.secret_scans import BASE_RULES, RULES
from tidechart.llm.substring_dedup import WINDOW as SPAN

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
 v AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {SPAN - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS p FROM d WHERE len(w) >= {SPAN}) x),
 r AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(p, p + {SPAN})) AS p FROM v JOIN r USING (h)),
 k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
 s AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k ANTI JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY 1)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0) x),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
   WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) m ON m.a = d.doc_id"""

_FIND = f"list_filter(string_split_regex({{}}, '{NOT_WORD}'), lambda x: x <> '')"
OP4 = f"""WITH d AS (SELECT doc_id, {_FIND.format(LOWER.format('text'))} AS w FROM documents), i AS (SELECT item_id, {_FIND.format(LOWER.format('text'))} AS w FROM benchmark),
 q AS (SELECT DISTINCT CAST(item_id AS STRING) AS item, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS p FROM i WHERE len(w) > 0) x),
 v AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM q) z WHERE len(w) >= n) x),
 m AS (SELECT v.doc_id, v.p, v.n, q.item FROM v JOIN q ON q.g = v.g AND q.n = v.n),
 h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM m) x GROUP BY 1),
 t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_W = "[" + ", ".join(f"{w}e0" for w in WEIGHTS) + "]"
_JUNK = "#$%&*|=<>{}[]\\^~_@0123456789!"
OP6 = f"""WITH d AS (SELECT doc_id, source, coalesce(len({WORDS.format('text')}), 0) AS size, text, concat_ws(':', '17', CAST(doc_id AS STRING), md5(coalesce(text, ''))) AS tag FROM documents),
 k AS (SELECT doc_id, source, size, md5(coalesce(text, '')) AS mark, (CAST(('0x' || substr(md5(tag), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS unit,
   coalesce(greatest(0.25e0, 1e0 - 4e0 * (length(text) - length(translate(text, '{_JUNK}', ''))) / greatest(length(text), 1)), 0.25e0) AS weight FROM d),
 p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
 w AS (SELECT *, {_W}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM p),
 c AS (SELECT *, {EPOCHS} * source_size AS cap, {EPOCHS} * source_size / w AS ratio FROM w),
 f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
   sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, {BUDGET} * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS r FROM c),
 v AS (SELECT arg_min((total - capped) / open_w, r) AS level FROM f WHERE (total - capped) / open_w <= ratio),
 t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM f, v),
 b AS (SELECT k.*, -ln(unit) / weight AS key FROM k),
 s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM b)
 SELECT s.doc_id, CAST(size AS BIGINT) AS size, t.source_size, round(target, 6) AS target, s.source,
   CAST(size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END + CASE WHEN size > 0 AND before_ + size / 2.0 <= target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
 FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source"""


def _spans(rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS o, start_ - n AS s, start_ AS e FROM (
   SELECT doc_id, n, kept, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) AS start_ FROM (
     SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(g, lambda x: length(x))) AS kept, unnest(list_transform(b[1:len(m)], lambda x: length(x))) AS gap FROM (
       SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS b FROM d) x WHERE len(m) > 0) y) z WHERE kept >= {rule.keep}"""


_ALL = "\n UNION ALL ".join(_spans(r, k) for k, r in enumerate(RULES))
_LINE = "string_agg(concat(kind, ':', CAST(CAST(s AS BIGINT) AS STRING), ':', CAST(CAST(e AS BIGINT) AS STRING)), ',' ORDER BY s, o)"
OP10 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({_ALL}),
 b AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
   {_LINE} FILTER (WHERE o < {len(BASE_RULES)}) AS base, {_LINE} AS spans FROM a GROUP BY 1)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (doc_id)"""

# CRC-32 by its table of 256 entries, for each distinct word
_HEX = "CAST(('0x' || substr({}, {}, {})) AS BIGINT)"
OP12 = f"""WITH b AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS e FROM (SELECT unnest(range(256)) AS i) x),
 tab AS (SELECT list(e ORDER BY i) AS t FROM b),
 d AS (SELECT doc_id, {_FIND.format(LOWER.format('text'))} AS w FROM documents),
 q AS (SELECT unnest({_FIND.format(LOWER.format('text'))}) AS word FROM benchmark),
 own AS (SELECT doc_id, unnest(w) AS word FROM d),
 a AS (SELECT DISTINCT word FROM (SELECT word FROM own UNION ALL SELECT word FROM q) x),
 h AS (SELECT word, list_transform(range(strlen(word)), lambda i: {_HEX.format('hex(word)', '2 * i + 1', 2)}) AS o FROM a),
 c AS (SELECT word, xor(list_reduce(list_prepend(4294967295, o), lambda c, v: xor(c // 256, t[1 + (xor(c, v) & 255)])), 4294967295) % {importance.BUCKETS} AS bucket FROM h, tab),
 s AS (SELECT bucket, count(*) AS n FROM own JOIN c USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM q JOIN c USING (word) GROUP BY 1),
 k AS (SELECT (SELECT count(*) FROM own) + 0e0 AS s, (SELECT count(*) FROM q) + 0e0 AS t),
 g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (k.s + {importance.BUCKETS}) / ((s.n + 1) * (k.t + {importance.BUCKETS})))) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, k),
 v AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM own JOIN c USING (word) JOIN g ON g.bucket = c.bucket GROUP BY 1),
 f AS (SELECT d.doc_id, len(d.w) AS n, coalesce(v.weight, 0) AS weight, coalesce(v.weight, 0) + floor(-1000 * ln(-ln(({_HEX.format(f"sha256('{importance.SEED}:' || CAST(d.doc_id AS STRING))", 1, 8)} + 0.5e0) / 4294967296e0))) AS score FROM d LEFT JOIN v USING (doc_id)),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM f WHERE n >= {importance.MIN_WORDS}),
 n AS (SELECT count(*) * {importance.SHARE} // 100 AS n FROM r)
 SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r.r <= n.n THEN r.r END AS rank FROM f LEFT JOIN r USING (doc_id), n"""

_DIGITS = f"sha256('{fill_in_middle.SEED}:' || CAST(doc_id AS STRING))"
OP13 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{fill_in_middle.UNIT}') AS u, {', '.join(f"{_HEX.format(_DIGITS, 8 * i + 1, 8)} AS h{i + 1}" for i in range(4))} FROM documents),
 c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_in_middle.SHARE} THEN 'plain' WHEN h4 % 100 < {fill_in_middle.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES = {"op1_substring_dedup": OP1, "op3_jaccard_join": OP3, "op4_decontamination": OP4, "op6_mixing": OP6, "op10_secret_scans": OP10, "op12_importance": OP12, "op13_fill_in_middle": OP13}
