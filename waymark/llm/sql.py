"""SQL twins of queries that need more than a page of it, made from a rule."""

from __future__ import annotations

from math import ceil

from waymark.llm.licenses import PHRASES, SPAN, TEMPLATES

#: CRC-32 of a text's bytes, over a table made by the polynomial's rule.
_CRC_TABLE = "tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i)))"
_CRC_OF = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295)"
_CRC = f"""{_CRC_TABLE},
        hx AS (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents),
        d AS (SELECT doc_id, source, lang, len(h) // 2 + 1 AS size,
          {_CRC_OF} AS text_crc32 FROM hx, tb)"""


def sharding(dims: tuple[str, ...] = ("source", "lang", "size", "doc_id"), bits: int = 4, shards: int = 8) -> str:
    """Parts by rank, the Hilbert index one step a WITH item, and places in its order."""
    parts = ", ".join(f"(rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits} // count(*) OVER () AS x{i}" for i, c in enumerate(dims))
    steps, n = [f"h0 AS (SELECT *, {parts} FROM d)"], len(dims)

    def step(*changes: str) -> None:
        steps.append(f"h{len(steps)} AS (SELECT * REPLACE ({', '.join(changes)}) FROM h{len(steps) - 1})")

    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        step(f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END AS x0")
        for i in range(1, n):
            swap = f"xor(x0, x{i}) & {p}"
            step(f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {swap}) END AS x0", f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}")
    for i in range(1, n):
        step(f"xor(x{i}, x{i - 1}) AS x{i}")
    turn = "0"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x{n - 1} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    digits = [f"(((xor(x{i}, {turn}) >> {level}) & 1) << {level * n + n - 1 - i})" for level in range(bits) for i in range(n)]
    return f"""WITH {_CRC}, {', '.join(steps)}, c AS (SELECT doc_id, size, text_crc32, CAST({' + '.join(digits)} AS BIGINT) AS curve FROM h{len(steps) - 1}),
        p AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM c)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * {shards} // n AS INTEGER) AS shard, CAST(place - (place * {shards} // n * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM p"""


def license_scan(least: float = 0.8) -> str:
    """Phrases by their words' places, and windows of each template by a join of its words' places."""
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    lists = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    phrases = ", ".join(f"({lists(p.split())}, {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    rows = []
    for i, (label, text, must, never) in enumerate(TEMPLATES):
        own, seq = sorted(set(words(text))), words(text)
        codes = "[" + ", ".join(str(own.index(w) + 1) for w in seq) + "]"
        rows.append(f"({i}, '{label}', {lists(own)}, {len(own)}, {max(1, ceil(least * len(own) - 1e-9))}, {SPAN * len(seq)}, {lists(must.split())}, {lists(never.split())}, {codes}, {max(1, ceil(least * len(seq) - 1e-9))})")
    # a row of the longest common subsequence from the row before it and the next word's code
    step = "list_transform(range(1, len(seq) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN seq[i] = w[1] THEN CASE WHEN i = 1 THEN 0 ELSE x[i - 1] END + 1 ELSE x[i] END)))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t),
        ph AS (SELECT * FROM (VALUES {phrases}) v(ws, k, label)), tp AS (SELECT * FROM (VALUES {', '.join(rows)}) v(tid, label, toks, n_toks, need, span, must, never, seq, chain)),
        bs AS (SELECT rid, pos - 1 AS place, label FROM x JOIN ph ON word = ws[1] JOIN t USING (rid) WHERE w[pos:pos + k - 1] = ws),
        m AS (SELECT rid, tid, pos, word FROM x JOIN (SELECT tid, unnest(toks) AS word FROM tp) USING (word)),
        c AS (SELECT a.rid, a.tid, a.pos AS lo, max(b.pos) AS hi, list(DISTINCT b.word) AS held, list(b.word ORDER BY b.pos) AS run FROM m a JOIN tp ON tp.tid = a.tid JOIN m b ON b.rid = a.rid AND b.tid = a.tid AND b.pos BETWEEN a.pos AND a.pos + span - 1 GROUP BY 1, 2, 3),
        g0 AS (SELECT rid, tid, lo, hi, len(held) / n_toks::DOUBLE AS share, label, never, chain, list_transform(seq, lambda t: t::BIGINT) AS seq, list_transform(run, lambda t: [list_position(toks, t)::BIGINT]) AS run FROM c JOIN tp USING (tid) WHERE len(held) >= need AND list_has_all(held, must)),
        g AS (SELECT * FROM (SELECT *, (list_reduce([list_transform(seq, lambda t: 0::BIGINT)] || run, lambda x, w: {step}))[-1] AS n_chain FROM g0) WHERE n_chain >= chain),
        f AS (SELECT rid, label, share FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.rid = g.rid AND x.pos BETWEEN g.lo AND g.hi AND list_contains(g.never, x.word))),
        b AS (SELECT rid, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM bs GROUP BY 1),
        l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM bs UNION ALL SELECT rid, label FROM f) GROUP BY 1), s AS (SELECT rid, max(share) AS share FROM f GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
        FROM t LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)"""


def centroids(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    """Integer k-means, a WITH item for each assignment and each move."""
    distance = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
    assign = lambda n: f"a{n} AS MATERIALIZED (SELECT rid, min({distance} * 64 + k) AS m FROM v, c{n} GROUP BY rid)"
    steps = []
    for n in range(rounds):
        sums = f"SELECT m % 64 AS k, unnest(q) AS x, unnest(range({dim})) AS i FROM a{n} JOIN v USING (rid)"
        means = f"SELECT k, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM ({sums}) GROUP BY k, i"
        steps += [assign(n), f"c{n + 1} AS MATERIALIZED (SELECT o.k, coalesce(z.c, o.c) AS c FROM c{n} o LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM ({means}) GROUP BY k) z ON o.k = z.k)"]
    return f"""WITH s AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {dim}),
        v AS MATERIALIZED (SELECT rid, vec_id, list_transform(e, lambda x: CAST(floor(x * {scale}) AS BIGINT)) AS q FROM s WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k})),
        {', '.join(steps)}, {assign(rounds)},
        f AS (SELECT vec_id, m % 64 AS k, m // 64 AS d FROM a{rounds} JOIN v USING (rid))
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM f JOIN c{rounds} USING (k)"""


def vector_links(least: float = 0.93) -> str:
    """All pairs of a label by their cosine, and the least id that each reaches."""
    return f"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        v AS MATERIALIZED (SELECT * FROM s WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {least}),
        r AS (SELECT rid AS root, rid FROM s UNION SELECT r.root, l.b FROM r JOIN l ON r.rid = l.a),
        c AS (SELECT root, min(vec_id) AS component_id FROM r JOIN s USING (rid) GROUP BY root), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c ON root = rid LEFT JOIN n ON a = rid"""


def persistent_audit() -> str:
    """Damage, faults, and the audit by a fold over each conversation's rows: for each of four states the least string of a six-digit cost and the edits."""
    add = lambda x, n, e: f"CASE WHEN {x} = '~' THEN '~' ELSE printf('%06d', CAST({x}[1:6] AS INTEGER) + {n}) || {x}[7:] || '{e}' END"
    z, s, u, a, code = "x[1]", "x[2]", "x[3]", "x[4]", "c"
    extra, may = f"CAST({code} <> lower({code}) AS INTEGER)", f"{code} <> 'D'"
    when = lambda test, value: f"CASE WHEN {test} THEN {value} ELSE '~' END"
    is_system = f"{code} IN ('s', 'S')"
    to_user = [when(may, add(y, f"2 + {extra}", "R")) for y in (z, s, a)] + [when(f"{code} IN ('u', 'U')", add(y, extra, "K")) for y in (z, s, a)]
    to_other = [when(may, add(u, f"2 + {extra}", "R")), when(f"{code} IN ('a', 'A')", add(u, extra, "K"))]
    row = f"[{add(z, 3, 'D')}, least({add(s, 3, 'D')}, {when(is_system, add(z, extra, 'K'))}), least({add(u, 3, 'D')}, {', '.join(to_user)}), least({add(a, 3, 'D')}, {', '.join(to_other)})]"
    users = f"least({u}, {add(z, 2, 'I')}, {add(s, 2, 'I')}, {add(a, 2, 'I')})"
    inserted = lambda inner: f"list_transform(list_transform([{inner}], lambda x: [{z}, {s}, {users}, {a}]), lambda x: [{z}, {s}, {u}, least({a}, {add(u, 2, 'I')})])[1]"
    white = r"[^\x20\x09-\x0D]"
    return rf"""WITH {_CRC_TABLE},
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
        d AS (SELECT conv_id, turn, role, text, {_CRC_OF} % 20 AS kind FROM k, tb),
        e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_extract_all(text, '{white}') AS seen FROM e),
        f AS (SELECT *, CASE WHEN len(seen) = 0 THEN 'blank' WHEN again THEN 'duplicate' WHEN seen[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS initial, role[1:1] AS own, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM p),
        g AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS code FROM f),
        q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(before IS NOT NULL AND before || own NOT IN ('su', 'ua', 'au')) AS illegal,
          list(code ORDER BY place) AS codes FROM g GROUP BY conv_id),
        b AS (SELECT *, list_reduce([{inserted("['000000', '~', '~', '~']")}] || list_transform(codes, lambda c: [c]), lambda x, y: list_transform([y[1]], lambda c: {inserted(row)})[1]) AS ends FROM q),
        w AS (SELECT *, least(ends[1], ends[4]) AS won FROM b),
        o AS (SELECT conv_id, unnest(string_split(won[7:], '')) AS edit, unnest(range(1, len(won) - 5)) AS nr FROM w WHERE len(won) > 6),
        r AS (SELECT *, sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY nr) AS place FROM o),
        t AS (SELECT r.conv_id, nr, edit, role, text FROM r LEFT JOIN p ON r.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.place = p.place WHERE edit <> 'D'),
        y AS (SELECT *, coalesce(edit = 'K' AND role[1:1] = 's', false) AS sys, sum(CAST(NOT coalesce(edit = 'K' AND role[1:1] = 's', false) AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY nr) AS nth FROM t),
        z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nr) AS kept FROM y GROUP BY conv_id)
        SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
          CAST(coalesce(won[1:6], '0') AS BIGINT) AS cost, coalesce(won[7:], '') AS audit, sha256(coalesce(kept, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN w ON i.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN z ON i.conv_id IS NOT DISTINCT FROM z.conv_id"""
