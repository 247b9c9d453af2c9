"""Queries of the corpus operators: one ``opN_<name>`` each over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm.common import Workspace, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import warc

    ws = Workspace(spark, "warc")
    folder = ws.path("archives")
    warc.write_archives(spark, table(spark, sf_dir, "pages"), folder, ws=ws)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths, so they stand in a made-up tree: folders of ten below folders of a hundred below the
    source. The first document of each folder of ten is its LICENSE, the second of each hundred is that folder's COPYING."""
    from polescale.llm import licenses

    i = F.col("doc_id")
    part = lambda c, n: F.concat(F.lit(c), F.floor(i / n).cast("string"))
    name = F.when(i % 10 == 0, "LICENSE").otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.when(i % 100 == 1, F.concat_ws("/", "source", part("p", 100), F.lit("COPYING"))).otherwise(F.concat_ws("/", "source", part("p", 100), part("q", 10), name))
    return licenses.scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import minhash

    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from polescale.llm import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import katz

    scored = katz.score_texts(spark, table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import decontam

    return decontam.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_uid")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import urlfilter

    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import suffix

    return suffix.remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept_text", "_uid")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import quality

    return quality.judge(spark, table(spark, sf_dir, "documents")).drop("_uid").withColumns({c: F.round(c, 9) for c in ("shrunk_rate", "low_rate")})


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polescale.llm import mixing

    return mixing.mix(spark, table(spark, sf_dir, "documents")).drop("_uid")


QUERIES = {f.__name__: f for f in (op1_warc, op2_license_scan, op3_minhash, op4_token_counts, op5_katz, op6_decontaminate, op7_url_filter, op8_suffix_dedup, op9_quality_rules, op10_mix)}

# --- DuckDB ---------------------------------------------------------------------

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex(coalesce({x}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexadecimal: str) -> str:
    """Of 40 hexadecimal digits, five (20 bits) at a time."""
    part = f"CAST(concat('0x', substr({hexadecimal}, 5 * i + 1, 5)) AS BIGINT)"
    letters = " || ".join(f"substr('{_B32}', CAST(({part} // {32**k}) % 32 AS BIGINT) + 1, 1)" for k in (3, 2, 1, 0))
    return f"array_to_string(list_transform(range(8), lambda i: {letters}), '')"


def _url_sql() -> str:
    from polescale.llm import urlfilter as u

    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in u.RULES)
    hit = lambda terms: " + ".join(rf"CAST(regexp_matches(low, '(^|[^\p{{L}}\p{{N}}]){t}([^\p{{L}}\p{{N}}]|$)') AS BIGINT)" for t in terms)
    return f"""WITH cut AS (SELECT page_id, coalesce(url, '') AS u, {_LOWER.format(x="url_decode(coalesce(url, ''))")} AS low FROM pages),
 parts AS (SELECT page_id, low, {_LOWER.format(x="regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, {hit(u.STRICT)} AS strict_hits, {hit(u.SOFT)} AS soft_hits FROM cut),
 rules(h, p, v) AS (VALUES {rules}),
 fit AS (SELECT page_id, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1)
 SELECT parts.page_id, host, path, rule, strict_hits, soft_hits, coalesce(v, CASE WHEN strict_hits > 0 OR soft_hits >= {u.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict FROM parts LEFT JOIN fit ON parts.page_id = fit.page_id"""


def _quality_sql() -> str:
    from polescale.llm import quality as q

    return rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_SPLIT.format(x="text")} AS ws FROM documents),
 win AS (SELECT doc_id, unnest(range(len(ws) - 7)) AS i, ws FROM w WHERE len(ws) > 8),
 keyed AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS k FROM win),
 twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
 gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM twice WHERE c > 1),
 rep AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS r FROM gaps GROUP BY doc_id),
 m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  (SELECT CAST(len(l) - len(list_distinct(l)) AS BIGINT) FROM (SELECT list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l)) AS n_dup_lines,
  coalesce(r, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
 f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM m),
 hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY source),
 prior AS (SELECT sum(bad) / greatest(sum(n), 1) AS m, coalesce(var_pop(bad / n), 0.0) AS v, avg(1.0 / n) AS inv FROM hosts),
 beta AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, {q.LEAST_VARIANCE!r}) - 1, 2.0), {q.MOST_STRENGTH!r}) AS k FROM prior),
 shrunk AS (SELECT source, n + k + 1 AS z, m, (bad + m * k) / (n + k) AS rate FROM hosts, beta),
 rates AS (SELECT source, m, rate, rate - {q.SIGMAS!r} * sqrt(rate * (1 - rate) / z) AS low FROM shrunk)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS shrunk_rate, round(low, 9) AS low_rate, NOT base_failed AND low <= least(greatest({q.HOST_TIMES!r} * m, {q.HOST_LEAST!r}), {q.HOST_MOST!r}) AS kept FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source"""


def _near_sql(percent: int = 85) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(x=_LOWER.format(x="text"))} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(1, len(ws) - 4)), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) AS g FROM w WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
 edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
 reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON r.to_id = e.x),
 comp AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
 SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM comp c LEFT JOIN n ON c.doc_id = n.doc_id"""


def _mix_sql(most: int = 3, seed: int = 10) -> str:
    """Water filling in closed form: sources by stop / weight, and the first whose level is not above its own ratio."""
    number = "CAST(concat('0x', substr(md5({x}), 1, 15)) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, source, CAST(len({_SPLIT.format(x="text")}) AS BIGINT) AS size, {number.format(x=f"concat('{seed}/', doc_id)")} AS h FROM documents),
 per AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
 stop AS (SELECT *, {most}::DOUBLE * source_size AS s, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM per),
 line AS (SELECT *, coalesce(sum(s) OVER o, 0) AS held, coalesce(sum(w) OVER o, 0) AS gone FROM stop WINDOW o AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 level AS (SELECT max((total - held) / (all_w - gone)) FILTER ((total - held) / (all_w - gone) <= s / w) AS v FROM line),
 goal AS (SELECT source, source_size, least(s, v * w) AS target FROM stop, level),
 salted AS (SELECT *, h % CAST(ceil(sqrt(count(*) OVER (PARTITION BY source, size))) AS BIGINT) AS salt FROM d),
 placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, salt, h, doc_id) AS p FROM salted),
 rated AS (SELECT p.*, source_size, target, least(coalesce(target / nullif(source_size, 0), 0.0), {float(most)}) AS rate, ({number.format(x=f"concat('{seed}/offset/', coalesce(p.source, ''))")} % {1 << 40}) / {float(1 << 40)} AS o FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source),
 drawn AS (SELECT *, CAST(least(floor(p * rate + o) - floor((p - 1) * rate + o), {most}) AS BIGINT) AS copies FROM rated)
 SELECT doc_id, size, source, source_size, target, copies, copies * size AS taken FROM drawn"""


def _license_sql() -> str:
    """Own licences of all units, then those of the folder or of the one above; no document of the tables is a template as a whole."""
    from polescale.llm import licenses as m

    idf, other, rows, _ = m.model(m.TEMPLATES, m.THRESHOLD)
    known = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    weights = ", ".join(f"({k}, '{name}', '{w}', {x!r}::DOUBLE)" for k, name, w, x in rows)
    return rf"""WITH known(word, idf) AS (VALUES {known}), weights(template, licence, word, weight) AS (VALUES {weights}),
 lines AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), string_split_regex(t, '
[ 	
]*
'), [t]))) AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
 units AS (SELECT *, row_number() OVER () AS unit FROM lines),
 words AS (SELECT doc_id, unit, unnest(string_split_regex(lower(line), '[^\p{{L}}\p{{N}}]+')) AS word FROM units),
 tf AS (SELECT doc_id, unit, word, count(*) AS tf FROM words WHERE word <> '' GROUP BY doc_id, unit, word),
 v AS (SELECT doc_id, unit, tf.word, tf * coalesce(idf, {other!r}) AS x FROM tf LEFT JOIN known ON tf.word = known.word),
 norms AS (SELECT unit, sqrt(sum(x * x)) AS n FROM v GROUP BY unit),
 dots AS (SELECT doc_id, unit, template, licence, sum(x * weight) AS d FROM v JOIN weights ON v.word = weights.word GROUP BY doc_id, unit, template, licence),
 best AS (SELECT doc_id, licence, round(d / n, 9) AS score FROM dots JOIN norms ON dots.unit = norms.unit WHERE round(d / n, 9) >= {m.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(d / n, 9) DESC, licence) = 1),
 placed AS (SELECT doc_id, concat_ws('/', source, 'p' || (doc_id // 100)) AS above, CASE WHEN doc_id % 100 = 1 THEN concat_ws('/', source, 'p' || (doc_id // 100)) ELSE concat_ws('/', source, 'p' || (doc_id // 100), 'q' || (doc_id // 10)) END AS dir,
  CASE WHEN doc_id % 100 = 1 THEN 'COPYING' WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END AS name FROM documents),
 own AS (SELECT p.*, licence, score FROM placed p LEFT JOIN best b ON p.doc_id = b.doc_id),
 grants AS (SELECT dir, licence, score FROM own WHERE licence IS NOT NULL AND name IN ('LICENSE', 'COPYING') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1)
 SELECT o.doc_id, concat(o.dir, '/', o.name) AS path, coalesce(o.licence, g.licence, h.licence) AS licence, CASE WHEN o.licence IS NOT NULL THEN o.score WHEN g.licence IS NOT NULL THEN g.score ELSE h.score END AS score,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN coalesce(g.licence, h.licence) IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN o.licence IS NULL THEN coalesce(g.dir, h.dir) END AS inherited_from
 FROM own o LEFT JOIN grants g ON o.dir = g.dir LEFT JOIN grants h ON o.above = h.dir"""


def _discount_sql(name: str, counts: str) -> str:
    """One row: Good-Turing ratios of the largest K that has them (null if none), and the absolute discount."""
    n = ", ".join(f"count(*) FILTER (c = {r})::DOUBLE AS n{r}" for r in range(1, 7))
    ratio = lambda r, k: f"(({r + 1} * n{r + 1}) / ({r} * n{r}) - {k + 1} * n{k + 1} / n1) / (1 - {k + 1} * n{k + 1} / n1)"
    lists = ", ".join(f"CASE WHEN {' AND '.join(f'n{r} > 0' for r in range(1, k + 2))} THEN CASE WHEN {k + 1} * n{k + 1} < n1 THEN [{', '.join(ratio(r, k) for r in range(1, k + 1))}] END END AS d{k}" for k in range(5, 1, -1))
    good = lambda k: f"d{k} IS NOT NULL AND list_min(d{k}) > 0 AND list_max(d{k}) < 1"
    pick = " ".join(f"WHEN {good(k)} THEN d{k}" for k in range(5, 1, -1))
    return f"""{name}_n AS (SELECT {n} FROM {counts}), {name}_d AS (SELECT *, {lists} FROM {name}_n),
 {name} AS (SELECT CASE {pick} END AS d, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS m FROM {name}_d)"""


def _katz_sql() -> str:
    """Of order 3: the ends stand twice before a text."""
    disc = lambda c, d: f"CASE WHEN {d}.d IS NULL THEN greatest({c} - {d}.m, 0) ELSE {c} * coalesce({d}.d[{c}], 1) END"
    weigh = "ch, 1 - mass / ch < 1e-12 AS filled, CASE WHEN 1 - mass / ch < 1e-12 THEN 1 / (ch + 1.0) ELSE 1 - mass / ch END / (1 - low) AS a"
    return f"""WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
 docs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 5 = 1 AS held, {_SPLIT.format(x=_LOWER.format(x="text"))} AS ws FROM documents, crc),
 tk AS (SELECT doc_id, held, unnest(list_append(ws, ' end')) AS w, unnest(list_prepend(' end', ws)) AS v, unnest(list_resize(list_concat([' end', ' end'], ws), len(ws) + 1)) AS u FROM docs),
 one AS (SELECT w, count(*) AS c FROM tk WHERE NOT held GROUP BY w), two AS (SELECT v, w, count(*) AS c FROM tk WHERE NOT held GROUP BY v, w), three AS (SELECT u, v, w, count(*) AS c FROM tk WHERE NOT held GROUP BY u, v, w),
 s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM one), {_discount_sql("e", "one")}, {_discount_sql("f", "two")}, {_discount_sql("g", "three")},
 p1 AS (SELECT w, c, ({disc("c", "e")}) / n AS p FROM one, e, s), unk AS (SELECT 1 - sum(p) AS rest FROM p1),
 h2 AS (SELECT v, sum(two.c) AS ch, sum({disc("two.c", "f")}) AS mass, sum(p1.p) AS low FROM two JOIN p1 ON two.w = p1.w, f GROUP BY v), b2 AS (SELECT v, {weigh} FROM h2),
 p2 AS (SELECT two.v, two.w, CASE WHEN filled THEN ch / (ch + 1.0) ELSE 1 END * ({disc("two.c", "f")}) / ch AS p FROM two JOIN b2 ON two.v = b2.v, f),
 h3 AS (SELECT u, three.v, sum(three.c) AS ch, sum({disc("three.c", "g")}) AS mass, sum(p2.p) AS low FROM three JOIN p2 ON three.v = p2.v AND three.w = p2.w, g GROUP BY u, three.v), b3 AS (SELECT u, v, {weigh} FROM h3),
 p3 AS (SELECT three.u, three.v, three.w, CASE WHEN filled THEN ch / (ch + 1.0) ELSE 1 END * ({disc("three.c", "g")}) / ch AS p FROM three JOIN b3 ON three.u = b3.u AND three.v = b3.v, g),
 grams AS (SELECT DISTINCT u, v, w FROM tk),
 prob AS (SELECT x.u, x.v, x.w, coalesce(p3.p, coalesce(b3.a, 1) * coalesce(p2.p, coalesce(b2.a, 1) * coalesce(p1.p, unk.rest))) AS p, coalesce(p1.c, 0) AS c
  FROM grams x LEFT JOIN p3 ON x.u = p3.u AND x.v = p3.v AND x.w = p3.w LEFT JOIN b3 ON x.u = b3.u AND x.v = b3.v LEFT JOIN p2 ON x.v = p2.v AND x.w = p2.w LEFT JOIN b2 ON x.v = b2.v LEFT JOIN p1 ON x.w = p1.w, unk)
 SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, round(sum(log10((c + 0.5) / (n + 0.5 * (s.v + 1)))), 6) AS base_score, round(sum(log10(p)), 6) AS score
 FROM tk JOIN prob ON tk.u = prob.u AND tk.v = prob.v AND tk.w = prob.w, s GROUP BY doc_id, held"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
 d AS (SELECT page_id, payload_bytes, {_base32("h")} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
 SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op2_license_scan": _license_sql(),
    "op3_minhash": _near_sql(),
    "op5_katz": _katz_sql(),
    "op7_url_filter": _url_sql(),
    "op9_quality_rules": _quality_sql(),
    "op10_mix": _mix_sql(),
}
