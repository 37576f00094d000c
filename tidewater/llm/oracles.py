"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidewater.llm.line_dedup import DEPTH, LONG, LONG_MIN_DOCS, MIN_DOCS, SIMILARITY, WILDCARD
from tidewater.llm.mixing import EPOCHS, SEED, SHARE, WEIGHTS
from tidewater.llm.quality_rules import LONGEST_MEAN, OTHER_STOP_WORDS, RULES, STOP_WORDS, UNSPACED

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def near_duplicates() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(lower)} AS ws FROM documents),
        d AS (
          SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
          FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        p AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
          SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


def line_dedup() -> str:
    """With ``passages``.  Texts are told apart by themselves; ids are taken to differ."""
    longest = f"CASE WHEN size >= {LONG} THEN {LONG_MIN_DOCS} ELSE {MIN_DOCS} END"
    recurring = """
        SELECT {0}, min_by(text, first) AS keeper FROM (SELECT {0}, text, min(doc_id) AS first, min(least_docs) AS m FROM {1} GROUP BY {0}, text)
        GROUP BY {0} HAVING count(*) >= min(m)"""
    run = f"""
        SELECT doc_id, text, 2 AS least_docs, list(line) OVER {{0}} AS run, sum(size) OVER {{0}} AS length, min(n) OVER {{0}} AS low, max(n) OVER {{0}} AS high
        FROM ends WINDOW {{0}} AS (PARTITION BY doc_id ORDER BY {{1}})"""
    after = run.format("w", f"stop - size RANGE BETWEEN CURRENT ROW AND {LONG - 1} FOLLOWING")
    before = run.format("w", f"stop RANGE BETWEEN {LONG - 1} PRECEDING AND CURRENT ROW")
    return rf"""
        WITH raw AS (
          SELECT doc_id, text, unnest(lines) AS x, unnest(range(len(lines))) AS n
          FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
        clean AS (SELECT doc_id, text, n, trim(regexp_replace(x, '[ \t\x0B\x0C\r]+', ' ', 'g')) AS line FROM raw),
        tok AS (SELECT *, string_split(line, ' ') AS words FROM clean WHERE line <> ''),
        msk AS (SELECT *, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{WILDCARD}' ELSE w END) AS masked FROM tok),
        cnt AS (SELECT *, len(words) AS size, len(list_filter(masked, lambda w: w <> '{WILDCARD}')) AS own, masked <> words AS digits FROM msk),
        few AS (SELECT *, {longest} AS least_docs, digits AND (own < 2 OR 2 * own < size) AS few FROM cnt),
        ln AS (
          SELECT *, CASE WHEN few THEN 'figures ' || lower(line) ELSE 'words ' || array_to_string(masked, ' ') END AS template,
            size || ' ' || array_to_string(masked[1:{DEPTH}], ' ') AS leaf
          FROM few),
        exact AS ({recurring.format("template", "ln")}),
        busy AS (SELECT leaf FROM ln GROUP BY leaf HAVING count(*) >= min(least_docs)),
        op AS (SELECT * FROM ln WHERE NOT few AND leaf IN (FROM busy) AND template NOT IN (SELECT template FROM exact)),
        toks AS (
          SELECT * FROM (SELECT doc_id, text, n, leaf, least_docs, own, unnest(masked) AS w, unnest(range(size)) AS p FROM op) WHERE w <> '{WILDCARD}'),
        const AS (SELECT leaf, p, w, count(DISTINCT text) AS c FROM toks GROUP BY ALL HAVING c >= min(least_docs)),
        has AS (SELECT doc_id, text, n, toks.leaf, least_docs, own, c, toks.p, toks.w
          FROM toks JOIN const ON const.leaf = toks.leaf AND const.p = toks.p AND const.w = toks.w),
        lvl AS (
          SELECT doc_id, text, n, least_docs, leaf || ' ' || string_agg(p || '=' || w, ' ' ORDER BY p) AS mask
          FROM has, range(40) r(k) WHERE c >= least_docs * 2 ** k
          GROUP BY doc_id, text, n, least_docs, leaf, own, k HAVING count(*) >= {SIMILARITY} * own),
        mask AS (SELECT DISTINCT doc_id, text, n, least_docs, mask FROM lvl),
        general AS ({recurring.format("mask", "mask")}),
        ends AS (SELECT doc_id, text, n, line, size, sum(size) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM ln),
        runs AS (SELECT * FROM ({after} UNION ALL {before}) WHERE length >= {LONG}),
        passage AS ({recurring.format("run", "runs")}),
        gone AS (
          SELECT ln.text, n FROM ln JOIN exact USING (template) WHERE ln.text <> keeper
          UNION SELECT mask.text, n FROM mask JOIN general USING (mask) WHERE mask.text <> keeper
          UNION SELECT text, unnest(range(low, high + 1)) FROM (SELECT runs.text, low, high FROM runs JOIN passage USING (run) WHERE runs.text <> keeper)),
        cut AS (
          SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone.n IS NOT NULL) AS n_dropped,
            string_agg(x, chr(10) ORDER BY raw.n) FILTER (gone.n IS NULL) AS left_over
          FROM raw LEFT JOIN gone ON gone.text = raw.text AND gone.n = raw.n GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 1) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
          CASE WHEN text IS NULL THEN NULL ELSE coalesce(left_over, '') END AS text
        FROM documents LEFT JOIN cut USING (doc_id)"""


def quality_rules() -> str:
    stops, more = (", ".join(f"'{w}'" for w in words) for words in (STOP_WORDS, OTHER_STOP_WORDS))
    unspaced = "".join(rf"\p{{{x}}}" for x in UNSPACED)
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    rules = " AND ".join(
        f"{r.measure} {sign} {bound}" for r in RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS ws FROM documents),
        g AS (
          SELECT doc_id, i, ws[i:i + 7] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t WHERE len(ws) >= 8)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM f, range(8) s(k) GROUP BY doc_id),
        m AS (
          SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS bangs,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
            len(list_distinct(ws)) AS n_distinct, len(list_filter(ws, lambda w: w IN ({stops}))) AS stops,
            len(list_filter(ws, lambda w: lower(w) IN ({stops}, {more}))) AS listed,
            {count(chr(92) + "p{L}")} AS letters, {count(chr(92) + "p{Latin}")} AS latin, {count(f"[{unspaced}]")} AS unspaced
          FROM t),
        x AS (
          SELECT m.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            greatest(n_words, 1) AS n, greatest(len(ls), 1) AS n_lines
          FROM m LEFT JOIN c USING (doc_id)),
        y AS (
          SELECT *, CASE WHEN word_chars > {LONGEST_MEAN} * n_words AND 2 * unspaced > letters THEN {LONGEST_MEAN}
              ELSE word_chars / n END AS mean_word_chars, n_symbols / n AS symbol_ratio, bangs / n AS exclamation_ratio,
            n_distinct / least(n, 200) AS distinct_ratio, n_dup_lines / n_lines AS dup_line_ratio, n_words / n_lines AS words_per_line,
            CASE WHEN stops > 0 OR n_words < 50 OR listed > 0 OR 2 * latin <= letters THEN 1 ELSE 0 END AS stop_or_long,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
          FROM x)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept
        FROM y"""


def source_mixing() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
        WITH d AS (
          SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size,
            CAST('0x' || substr(md5(concat_ws(':', {SEED}, coalesce(CAST(doc_id AS VARCHAR), ''), text)), 1, 15) AS BIGINT) AS k
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM s),
        w AS (SELECT *, [{weights}][i % {len(WEIGHTS)} + 1] AS w, {EPOCHS} * source_size AS cap FROM r),
        l AS (
          SELECT *, (sum(source_size) OVER () * {SHARE}
              - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
          FROM w),
        f AS (SELECT cap / w AS ratio, i AS fi, own AS level FROM l WHERE cap > w * own ORDER BY ratio, fi LIMIT 1),
        t AS (
          SELECT source, source_size,
            CAST(CASE WHEN level IS NULL OR (cap / w, i) < (ratio, fi) THEN cap ELSE least(cap, w * level) END AS DOUBLE) AS target
          FROM l LEFT JOIN f ON true),
        e AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS epochs FROM t),
        x AS (
          SELECT doc_id, size, source_size, target, epochs, CAST(round(target - epochs * source_size) AS BIGINT) AS budget,
            sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS run
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, budget - run)) AS BIGINT) AS taken FROM x"""


def warc() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31))::INTEGER, 1)"
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha1 FROM pages),
        d AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
          array_to_string(list_transform(range(32), lambda k: {digit}), '') AS payload_digest,
          CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
        FROM d"""


def merkle_manifest() -> str:
    """Nodes of all levels by a recursive query, then each leaf's way up by another."""
    def leaf(n_chars: str) -> str:
        parts = (f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"))
        return f"sha256({' || '.join(parts)})"

    # CRC-32, a bit at a time: each byte is followed by seven zeros.
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1))"
    changed = f"doc_id IS NOT NULL AND xor(list_reduce({bits}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295) % 7 = 0"
    # A tree of each language is t = 0, that of their roots t = 1.
    nodes = """
        SELECT *, count(*) OVER (PARTITION BY {0}) AS n FROM {1}
        UNION ALL
        SELECT {0}, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max((n + 1) // 2)
        FROM {2} WHERE n > 1 GROUP BY {0}, level, pos // 2"""
    return f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, coalesce(' ' || lang, '') AS lang, {leaf("n_chars")} AS leaf, CASE WHEN {changed} THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS changed FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
        a AS (SELECT lang, 0 AS level, pos, leaf AS h FROM r),
        t AS ({nodes.format("lang", "a", "t")}),
        s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang)) - 1 AS place FROM t WHERE n = 1),
        b AS (SELECT 0 AS one, 0 AS level, place AS pos, subroot AS h FROM s),
        u AS ({nodes.format("one", "b", "u")}),
        up AS (
          SELECT r.doc_id, r.pos AS leaf_pos, r.lang, r.leaf, r.pos, s.place, s.subroot, 0 AS level, r.changed AS h, '' AS proof FROM r JOIN s USING (lang)
          UNION ALL
          SELECT doc_id, leaf_pos, lang, leaf, pos // 2, place, subroot, level + 1,
            sha256(CASE WHEN pos % 2 = 1 THEN other || h ELSE h || other END), proof || other
          FROM (
            SELECT up.*, coalesce(x.h, '') AS other FROM up JOIN t AS own ON own.lang = up.lang AND own.level = up.level AND own.pos = up.pos AND own.n > 1
            LEFT JOIN t AS x ON x.lang = up.lang AND x.level = up.level AND x.pos = xor(up.pos, 1))),
        top AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY lang, leaf_pos ORDER BY level DESC) = 1),
        over AS (
          SELECT doc_id, leaf_pos, lang, leaf, subroot, place AS pos, 0 AS level, h, proof FROM top
          UNION ALL
          SELECT doc_id, leaf_pos, lang, leaf, subroot, pos // 2, level + 1, sha256(CASE WHEN pos % 2 = 1 THEN other || h ELSE h || other END), proof || other
          FROM (
            SELECT over.*, coalesce(x.h, '') AS other FROM over JOIN u AS own ON own.level = over.level AND own.pos = over.pos AND own.n > 1
            LEFT JOIN u AS x ON x.level = over.level AND x.pos = xor(over.pos, 1))),
        done AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY lang, leaf_pos ORDER BY level DESC) = 1)
        SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
          h = (SELECT h FROM u WHERE n = 1) AS verified
        FROM done"""
